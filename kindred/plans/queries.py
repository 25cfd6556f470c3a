"""The engine's contract queries over the document tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.hashing import coefficients, sql_wrap_mod
from kindred.operators import candidates, merge, rollup, sketch, verify, views
from kindred.params import TEXT
from kindred.plans.engine import CloneEngine
from kindred.sources import text
from kindred.storage import materialise

P = TEXT
PERCENT = 80


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.units(_docs(spark, sf_dir), P)


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Units of enough size, and their pairs at Jaccard 0.8 as clone pairs over whole units."""
    units = materialise(text.large_enough(materialise(_units(spark, sf_dir), "units"), P), "units")
    tokens = CloneEngine(spark, P).unit_tokens(units)
    sets = sketch.shingles(tokens, P.shingle).select("unit_id", "shingles")
    bands = materialise(sketch.bands(tokens, P), "bands")
    met = candidates.jaccard(candidates.candidates(bands), sets).where(100 * F.col("n_both") >= PERCENT * F.col("n_union"))
    ends = lambda n: units.select(F.col("unit_id").alias(f"{n}_id"), F.struct(F.lit(0).alias("from_stmt"), (F.col("n_stmts") - 1).cast("int").alias("to_stmt")).alias("a" if n == "left" else "b"), F.col("stmts").alias(f"{n}_stmts"))
    both = met.join(ends("left"), "left_id").join(ends("right"), "right_id")
    same = F.transform("left_stmts", lambda s: s["text"]) == F.transform("right_stmts", lambda s: s["text"])
    sim = F.col("sim").cast("int")
    pairs = both.select("left_id", "right_id", sim.alias("sim"), verify.level(sim, P).alias("level"), verify.weight(sim, P).alias("weight"), F.when(same, 0).otherwise(2).alias("clone_type"), "a", "b")
    return units, materialise(pairs, "pairs")


def _clones(spark: SparkSession, sf_dir: str):
    units, pairs = _pairs(spark, sf_dir)
    return CloneEngine(spark, P).search(units, pairs)


# ------------------------------------------------------------------ queries
def scan_partitioned(spark, sf_dir):
    return _units(spark, sf_dir).where("partition_key <> ''").groupBy("partition_key").agg(F.count("*").alias("n_units"), F.sum("n_newlines").alias("n_newlines"))


def newline_count(spark, sf_dir):
    return _units(spark, sf_dir).select("unit_id", "n_newlines")


def tokenize_units(spark, sf_dir):
    t = text.tokens(_docs(spark, sf_dir)).where("tokens is not null")
    return t.select("unit_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("bigint").alias("n_distinct"), F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("token_sum"))


def stmt_explode(spark, sf_dir):
    return text.statements(_units(spark, sf_dir)).select("unit_id", F.col("pos").cast("bigint").alias("pos"), F.size("tokens").cast("bigint").alias("n_tokens"), "text", F.col("cc").cast("bigint").alias("cc"))


def unit_size_filter(spark, sf_dir):
    return text.large_enough(materialise(_units(spark, sf_dir), "units"), P).select("unit_id", "n_stmts", "num_tokens", "cc")


def token_dictionary(spark, sf_dir):
    words = _docs(spark, sf_dir).where("text is not null").select(F.explode(text.words(F.col("text"))).alias("token"))
    return rollup.dense_ids(words, "token", "token_id")


def kgram_shingles(spark, sf_dir):
    return sketch.shingles(text.tokens(_docs(spark, sf_dir)), P.shingle).select("unit_id", "n_grams", "gram_sum")


def shingle_set_size(spark, sf_dir):
    return sketch.shingles(text.tokens(_docs(spark, sf_dir)), P.shingle).select("unit_id", F.size("shingles").cast("bigint").alias("n_shingles"))


def minhash_signature(spark, sf_dir):
    s = sketch.signatures(text.tokens(_docs(spark, sf_dir)), P).where(F.size("bands") > 0)
    return s.select("unit_id", F.posexplode("signature").alias("i", "value")).select("unit_id", F.col("i").cast("bigint").alias("i"), "value")


def band_hashes(spark, sf_dir):
    return sketch.bands(text.tokens(_docs(spark, sf_dir)), P).select("unit_id", F.col("band").cast("bigint").alias("band"), "h")


def lsh_candidates(spark, sf_dir):
    return candidates.candidates(materialise(sketch.bands(text.tokens(_docs(spark, sf_dir)), P), "bands"))


def lsh_bucket_stats(spark, sf_dir):
    return candidates.bucket_stats(sketch.bands(text.tokens(_docs(spark, sf_dir)), P))


def lsh_candidates_partitioned(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    bands = materialise(sketch.bands(text.tokens(docs), P), "bands").join(docs.select(F.col("doc_id").alias("unit_id"), F.coalesce("lang", F.lit("")).alias("partition_key")), "unit_id")
    return candidates.candidates(bands, ("partition_key",))


def pair_lookup(spark, sf_dir):
    units, pairs = _pairs(spark, sf_dir)
    side = lambda n: units.select(F.col("unit_id").alias(f"{n}_id"), F.col("folder").alias(f"{n}_folder"), F.col("n_stmts").alias(f"{n}_stmts"))
    return pairs.select("left_id", "right_id", F.col("sim").cast("bigint").alias("sim")).join(side("left"), "left_id").join(side("right"), "right_id")


def pair_levels(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)[1]
    return pairs.groupBy("level", "clone_type").agg(F.count("*").alias("n_pairs"), F.min("weight").cast("bigint").alias("least_weight"), F.max("weight").cast("bigint").alias("most_weight")).select(F.col("level").cast("bigint").alias("level"), F.col("clone_type").cast("bigint").alias("clone_type"), "n_pairs", "least_weight", "most_weight")


def near_dup_classes(spark, sf_dir):
    return CloneEngine(spark, P).near_duplicates(_docs(spark, sf_dir), PERCENT)


def exact_dup_classes(spark, sf_dir):
    t = text.tokens(_docs(spark, sf_dir)).where(F.size("tokens") > 0)
    return candidates.representatives(t).groupBy(F.col("rep_id").alias("class_id")).agg(F.count("*").alias("n_units")).where("n_units > 1")


def fragment_table(spark, sf_dir):
    units, pairs = _pairs(spark, sf_dir)
    f = merge.fragments(merge.numbered_pairs(pairs), units)
    return f.select("pair_id", *(F.col(c).cast("bigint").alias(c) for c in ("side", "unit_id", "partner_id", "from_stmt", "to_stmt", "n_stmts", "cc")))


def fragment_overlap_join(spark, sf_dir):
    """Edges of the reference overlap between fixed windows of the statements of each unit."""
    units = text.large_enough(materialise(_units(spark, sf_dir), "units"), P)
    w = units.select("unit_id", F.explode(F.sequence(F.lit(0), (F.col("n_stmts") - 1).cast("int"), F.lit(3))).alias("s")).select("unit_id", (F.col("unit_id") * 100000 + F.col("s")).alias("pair_id"), F.col("s").alias("from_stmt"), (F.col("s") + 2 + F.col("s") % 4).alias("to_stmt"))
    return merge.overlap_edges(w, P)


def clone_merge_components(spark, sf_dir):
    c = _clones(spark, sf_dir)
    return c.pairs.select("pair_id", "clone_id")


def clone_units(spark, sf_dir):
    u = _clones(spark, sf_dir).clone_units
    return u.select("clone_id", *(F.col(c).cast("bigint").alias(c) for c in ("unit_id", "max_weight", "max_sim", "max_level", "max_type", "from_stmt", "to_stmt", "cc")))


def global_units(spark, sf_dir):
    u = _clones(spark, sf_dir).global_units
    return u.select(*(F.col(c).cast("bigint").alias(c) for c in ("unit_id", "max_weight", "max_sim", "max_level", "max_type", "from_stmt", "to_stmt", "cc")))


def clone_global_grouping_sets(spark, sf_dir):
    s = _clones(spark, sf_dir).spans
    return s.groupBy(F.col("is_global").cast("bigint").alias("is_global")).agg(F.count("*").alias("n_rows"), F.sum("max_sim").alias("sum_sim"), F.sum("to_stmt").alias("sum_to"))


_RANKED = ("rank", "clone_id", "n_pairs", "n_units", "max_cc", "max_stmts", "max_weight", "max_sim", "max_level", "max_type", "weight")


def clones_ranked(spark, sf_dir):
    return _clones(spark, sf_dir).clones.select(*(F.col(c).cast("bigint").alias(c) for c in _RANKED))


def clones_ranked_alt(spark, sf_dir):
    return _clones(spark, sf_dir).by_complexity().select(*(F.col(c).cast("bigint").alias(c) for c in _RANKED))


def biggest_clones(spark, sf_dir):
    b = _clones(spark, sf_dir).biggest()
    return b.select(*(F.col(c).cast("bigint").alias(c) for c in ("rank", "n_units", "clone_cc")), "folder", "unit_id", F.col("cc").cast("bigint").alias("cc"))


def pair_export_csv_rows(spark, sf_dir):
    units, pairs = _pairs(spark, sf_dir)
    r = rollup.export_rows(pairs, units)
    return r.select("left_folder", "left_file", F.col("left_from").cast("bigint").alias("left_from"), F.col("left_to").cast("bigint").alias("left_to"), "right_folder", "right_file", F.col("right_from").cast("bigint").alias("right_from"), F.col("right_to").cast("bigint").alias("right_to"))


def stage_counters(spark, sf_dir):
    return _clones(spark, sf_dir).counters()


def clone_density(spark, sf_dir):
    c = _clones(spark, sf_dir)
    return rollup.density(c.clone_units, c.units)


def units_in_clones(spark, sf_dir):
    c = _clones(spark, sf_dir)
    return rollup.units_in_clones(c.units, c.clone_units).select("unit_id", "num_tokens")


def units_without_clones(spark, sf_dir):
    c = _clones(spark, sf_dir)
    return rollup.units_without_clones(c.units, c.clone_units).select("unit_id", "num_tokens")


def view_bins(spark, sf_dir):
    c = _clones(spark, sf_dir).clones
    b = views.bins(c, c.count(), 40)
    return b.select(*(F.col(x).cast("bigint").alias(x) for x in ("bar", "first", "last", "n_items", "max_weight")))


def view_edges(spark, sf_dir):
    e = _clones(spark, sf_dir).edges()
    return e.select(*(F.col(x).cast("bigint").alias(x) for x in ("clone_rank", "unit_rank", "level", "clone_type")))


def view_zoom_slice(spark, sf_dir):
    c = _clones(spark, sf_dir).clones
    return views.slice_of(c, 3, 10).select(*(F.col(x).cast("bigint").alias(x) for x in ("rank", "clone_id", "n_units")))


def view_labels(spark, sf_dir):
    return _clones(spark, sf_dir).labels()


def view_diff_groups(spark, sf_dir):
    d = _clones(spark, sf_dir).diff()
    return d.select("clone_id", F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["unit_id"].cast("string"), m["from_stmt"].cast("string"), m["to_stmt"].cast("string"))), ",").alias("members"), F.col("cost").cast("bigint").alias("cost"), "title")


# Alignment kernels: not in SQL; tests hold them against the plain recurrences.
def stmt_alignment(spark, sf_dir):
    return CloneEngine(spark, P).verified(_units(spark, sf_dir)).select("left_id", "right_id", "sim", "level", "weight", "clone_type", "a", "b")


def clone_type_distribution(spark, sf_dir):
    return stmt_alignment(spark, sf_dir).groupBy("clone_type", "level").agg(F.count("*").alias("n_pairs"))


def aligned_clones_ranked(spark, sf_dir):
    e = CloneEngine(spark, P)
    return e.search(text.large_enough(materialise(_units(spark, sf_dir), "units"), P)).clones


def token_alignment(spark, sf_dir):
    stmts = text.statements(_units(spark, sf_dir)).where(F.size("tokens") > 0)
    first = stmts.where("pos = 0").select("unit_id", F.col("tokens").alias("a"))
    second = stmts.where("pos = 1").select("unit_id", F.col("tokens").alias("b"))
    return verify.statement_similarities(first.join(second, "unit_id"), P).select("unit_id", "sim")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (scan_partitioned, newline_count, tokenize_units, stmt_explode, unit_size_filter, token_dictionary, kgram_shingles, shingle_set_size, minhash_signature, band_hashes, lsh_candidates, lsh_bucket_stats, lsh_candidates_partitioned, pair_lookup, pair_levels, near_dup_classes, exact_dup_classes, fragment_table, fragment_overlap_join, clone_merge_components, clone_units, global_units, clone_global_grouping_sets, clones_ranked, clones_ranked_alt, biggest_clones, pair_export_csv_rows, stage_counters, clone_density, units_in_clones, units_without_clones, view_bins, view_edges, view_zoom_slice, view_labels, view_diff_groups, token_alignment, stmt_alignment, clone_type_distribution, aligned_clones_ranked)
}

# ------------------------------------------------------------------ DuckDB
_R = coefficients()
_K, _B, _ROWS = P.shingle, P.bands, P.rows
_gram = sql_wrap_mod(" + ".join(f"{_R[i]} * tokens[i + {i + 1}]" for i in range(_K)))
_TOK = f"tok AS MATERIALIZED ({text.sql_tokens()})"
_GRAMS = f"grams AS MATERIALIZED (SELECT unit_id, tokens, list_transform(range(0, greatest(len(tokens) - {_K - 1}, 0)), lambda i: {_gram}) AS g FROM tok)"
_COEFF = f"coeff AS (SELECT unnest([{', '.join(map(str, _R[: _B * _ROWS]))}]) AS r, unnest(range({_B * _ROWS})) AS i)"
_SIG = f"s AS (SELECT DISTINCT unit_id, unnest(g) AS v FROM grams), sig AS MATERIALIZED (SELECT unit_id, i, min({sql_wrap_mod('r * v')}) AS value FROM s, coeff GROUP BY ALL)"
_BAND = f"bands AS MATERIALIZED (SELECT unit_id, i // {_ROWS} AS band, {sql_wrap_mod('sum(value * r4.r)::BIGINT')} AS h FROM sig JOIN (SELECT unnest([{', '.join(map(str, _R[:_ROWS]))}]) AS r, unnest(range({_ROWS})) AS j) r4 ON r4.j = i % {_ROWS} GROUP BY ALL)"
_LSH = f"WITH {_TOK}, {_GRAMS}, {_COEFF}, {_SIG}, {_BAND} "
_STMT = f"stmts AS MATERIALIZED ({text.sql_statements()})"
_UNIT = f"units AS MATERIALIZED (SELECT s.unit_id, any_value(partition_key) AS partition_key, any_value(folder) AS folder, any_value(nl) AS n_newlines, count(*)::BIGINT AS n_stmts, sum(n_tokens)::BIGINT AS num_tokens, sum(cc)::BIGINT AS cc, string_agg(s.text, chr(1) ORDER BY pos) AS whole FROM stmts s JOIN (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS nl FROM documents) d ON d.doc_id = s.unit_id GROUP BY s.unit_id HAVING n_stmts >= {P.min_stmts} AND num_tokens >= {P.min_tokens})"
_low, _range = int(P.min_sim * 100), 100 - int(P.min_sim * 100)


def _met(source: str) -> str:
    return f"ss AS MATERIALIZED (SELECT DISTINCT unit_id, unnest(g) AS v FROM grams JOIN {source} USING (unit_id)), sz AS (SELECT unit_id, count(*) AS n FROM ss GROUP BY 1), co AS (SELECT a.unit_id AS left_id, b.unit_id AS right_id, count(*) AS n_both FROM ss a JOIN ss b ON a.v = b.v AND a.unit_id < b.unit_id GROUP BY ALL), met AS MATERIALIZED (SELECT left_id, right_id, ((100 * n_both) // (x.n + y.n - n_both))::BIGINT AS sim FROM co JOIN sz x ON x.unit_id = left_id JOIN sz y ON y.unit_id = right_id WHERE 100 * n_both >= {PERCENT} * (x.n + y.n - n_both))"


_PAIRS = f"WITH RECURSIVE {_TOK}, {_GRAMS}, {_STMT}, {_UNIT}, {_met('units')}, pairs AS MATERIALIZED (SELECT left_id, right_id, sim, least({P.levels - 1}, (sim - {_low}) * {P.levels} // {_range})::BIGINT AS level, ((sim - {_low}) * 100 // {_range})::BIGINT AS weight, (CASE WHEN x.whole = y.whole THEN 0 ELSE 2 END)::BIGINT AS clone_type, x.n_stmts AS n_a, y.n_stmts AS n_b, x.cc AS cc_a, y.cc AS cc_b, ('0x' || substr(md5(concat_ws(':', left_id, right_id, 0, x.n_stmts - 1, 0, y.n_stmts - 1)), 1, 15))::BIGINT AS pair_id FROM met JOIN units x ON x.unit_id = left_id JOIN units y ON y.unit_id = right_id)"


def _reach(name: str, edges: str) -> str:
    return f"{name}_e AS (SELECT left_id AS a, right_id AS b FROM {edges} UNION SELECT right_id, left_id FROM {edges}), {name}_r(v, c) AS (SELECT a, a FROM {name}_e UNION SELECT e.b, r.c FROM {name}_r r JOIN {name}_e e ON e.a = r.v), {name} AS MATERIALIZED (SELECT v AS unit_id, min(c) AS root FROM {name}_r GROUP BY 1)"


_CLONES = f"{_PAIRS}, {_reach('lab', 'pairs')}, cl AS MATERIALIZED (SELECT root, min(pair_id) AS clone_id, count(*)::BIGINT AS n_pairs, max(weight) AS max_weight, max(sim) AS max_sim, max(level) AS max_level, max(clone_type) AS max_type FROM pairs JOIN lab ON lab.unit_id = left_id GROUP BY 1), fr AS MATERIALIZED (SELECT left_id AS unit_id, right_id AS partner_id, 0::BIGINT AS side, n_a AS n_stmts, cc_a AS cc, pairs.* EXCLUDE (n_a, n_b, cc_a, cc_b) FROM pairs UNION ALL SELECT right_id, left_id, 1::BIGINT, n_b, cc_b, pairs.* EXCLUDE (n_a, n_b, cc_a, cc_b) FROM pairs), cu AS MATERIALIZED (SELECT cl.clone_id, fr.unit_id, max(fr.weight)::BIGINT AS max_weight, max(fr.sim)::BIGINT AS max_sim, max(fr.level)::BIGINT AS max_level, max(fr.clone_type)::BIGINT AS max_type, 0::BIGINT AS from_stmt, (max(fr.n_stmts) - 1)::BIGINT AS to_stmt, max(fr.cc)::BIGINT AS cc, max(fr.n_stmts) AS n_stmts FROM fr JOIN lab ON lab.unit_id = fr.unit_id JOIN cl ON cl.root = lab.root GROUP BY ALL), clones AS MATERIALIZED (SELECT row_number() OVER (ORDER BY count(*) DESC, max(cu.cc) DESC, cl.clone_id) - 1 AS rank, cl.clone_id, cl.n_pairs, count(*)::BIGINT AS n_units, max(cu.cc)::BIGINT AS max_cc, max(cu.n_stmts)::BIGINT AS max_stmts, cl.max_weight, cl.max_sim, cl.max_level, cl.max_type, max(cu.cc)::BIGINT AS weight FROM cl JOIN cu ON cu.clone_id = cl.clone_id GROUP BY cl.clone_id, cl.n_pairs, cl.max_weight, cl.max_sim, cl.max_level, cl.max_type), ur AS (SELECT unit_id, row_number() OVER (ORDER BY unit_id) - 1 AS unit_rank FROM (SELECT DISTINCT unit_id FROM cu)) "

ORACLE_SQL: dict[str, str] = {
    "scan_partitioned": "SELECT lang AS partition_key, count(*)::BIGINT AS n_units, sum(length(text) - length(replace(text, chr(10), '')))::BIGINT AS n_newlines FROM documents WHERE text IS NOT NULL AND coalesce(lang, '') <> '' GROUP BY 1",
    "newline_count": "SELECT doc_id AS unit_id, (length(text) - length(replace(text, chr(10), '')))::BIGINT AS n_newlines FROM documents WHERE text IS NOT NULL",
    "tokenize_units": f"WITH {_TOK} SELECT unit_id, len(tokens)::BIGINT AS n_tokens, len(list_distinct(tokens))::BIGINT AS n_distinct, coalesce(list_sum(tokens), 0)::BIGINT AS token_sum FROM tok",
    "stmt_explode": f"WITH {_STMT} SELECT unit_id, pos::BIGINT AS pos, n_tokens::BIGINT AS n_tokens, text, cc::BIGINT AS cc FROM stmts",
    "unit_size_filter": f"WITH {_STMT}, {_UNIT} SELECT unit_id, n_stmts, num_tokens, cc FROM units",
    "token_dictionary": f"SELECT token, row_number() OVER (ORDER BY encode(token)) - 1 AS token_id FROM (SELECT DISTINCT unnest({text.sql_words('text')}) AS token FROM documents WHERE text IS NOT NULL)",
    "kgram_shingles": f"WITH {_TOK}, {_GRAMS} SELECT unit_id, len(g)::BIGINT AS n_grams, coalesce(list_sum(g), 0)::BIGINT AS gram_sum FROM grams",
    "shingle_set_size": f"WITH {_TOK}, {_GRAMS} SELECT unit_id, len(list_distinct(g))::BIGINT AS n_shingles FROM grams",
    "minhash_signature": f"{_LSH} SELECT unit_id, i::BIGINT AS i, value::BIGINT AS value FROM sig",
    "band_hashes": f"{_LSH} SELECT unit_id, band::BIGINT AS band, h::BIGINT AS h FROM bands",
    "lsh_candidates": f"{_LSH} SELECT DISTINCT a.unit_id AS left_id, b.unit_id AS right_id FROM bands a JOIN bands b ON a.band = b.band AND a.h = b.h AND a.unit_id < b.unit_id",
    "lsh_bucket_stats": f"{_LSH} SELECT bucket_size, count(*)::BIGINT AS n_buckets FROM (SELECT count(DISTINCT unit_id)::BIGINT AS bucket_size FROM bands GROUP BY band, h) WHERE bucket_size > 1 GROUP BY 1",
    "lsh_candidates_partitioned": f"{_LSH}, b AS (SELECT bands.*, coalesce(lang, '') AS partition_key FROM bands JOIN documents ON doc_id = unit_id) SELECT DISTINCT x.partition_key, x.unit_id AS left_id, y.unit_id AS right_id FROM b x JOIN b y ON x.partition_key = y.partition_key AND x.band = y.band AND x.h = y.h AND x.unit_id < y.unit_id",
    "pair_lookup": f"{_PAIRS} SELECT left_id, right_id, sim, x.folder AS left_folder, x.n_stmts AS left_stmts, y.folder AS right_folder, y.n_stmts AS right_stmts FROM pairs JOIN units x ON x.unit_id = left_id JOIN units y ON y.unit_id = right_id",
    "pair_levels": f"{_PAIRS} SELECT level, clone_type, count(*)::BIGINT AS n_pairs, min(weight) AS least_weight, max(weight) AS most_weight FROM pairs GROUP BY ALL",
    "near_dup_classes": f"WITH RECURSIVE {_TOK}, rep AS MATERIALIZED (SELECT tokens, min(unit_id) AS rep_id FROM tok WHERE len(tokens) > 0 GROUP BY 1), reps AS MATERIALIZED (SELECT unit_id, rep_id FROM tok JOIN rep ON rep.tokens = tok.tokens), own AS (SELECT DISTINCT rep_id AS unit_id FROM reps), {_GRAMS}, {_met('own')}, {_reach('lab', 'met')}, cls AS (SELECT reps.unit_id, coalesce(root, rep_id) AS class_id FROM reps LEFT JOIN lab ON lab.unit_id = rep_id), big AS (SELECT class_id, count(*)::BIGINT AS n_units FROM cls GROUP BY 1 HAVING n_units > 1), ln AS (SELECT root, count(*)::BIGINT AS n_links, max(sim) AS max_sim FROM met JOIN lab ON lab.unit_id = left_id GROUP BY 1) SELECT class_id, n_units, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(max_sim, 100)::BIGINT AS max_sim, row_number() OVER (ORDER BY n_units DESC, class_id) - 1 AS rank FROM big LEFT JOIN ln ON root = class_id",
    "exact_dup_classes": f"WITH {_TOK} SELECT min(unit_id) AS class_id, count(*)::BIGINT AS n_units FROM tok WHERE len(tokens) > 0 GROUP BY tokens HAVING n_units > 1",
    "fragment_table": f"{_CLONES} SELECT pair_id, side, unit_id, partner_id, 0::BIGINT AS from_stmt, (n_stmts - 1)::BIGINT AS to_stmt, n_stmts::BIGINT AS n_stmts, cc::BIGINT AS cc FROM fr",
    "fragment_overlap_join": f"WITH {_STMT}, {_UNIT}, w AS (SELECT unit_id, s AS f, s + 2 + s % 4 AS t, unit_id * 100000 + s AS id FROM (SELECT unit_id, unnest(range(0, n_stmts, 3)) AS s FROM units)) SELECT x.id AS a, y.id AS b FROM w x JOIN w y ON x.unit_id = y.unit_id AND (x.f, x.t) < (y.f, y.t) WHERE least(x.t, y.t) - greatest(x.f, y.f) >= 0 AND (least(x.t, y.t) - greatest(x.f, y.f)) * 100 >= greatest(y.t - x.t, y.f - x.f) * {P.overlap_percent}",
    "clone_merge_components": f"{_CLONES} SELECT pair_id, clone_id FROM pairs JOIN lab ON lab.unit_id = left_id JOIN cl ON cl.root = lab.root",
    "clone_units": f"{_CLONES} SELECT clone_id, unit_id, max_weight, max_sim, max_level, max_type, from_stmt, to_stmt, cc FROM cu",
    "global_units": f"{_CLONES} SELECT unit_id, max_weight, max_sim, max_level, max_type, from_stmt, to_stmt, cc FROM cu",
    "clone_global_grouping_sets": f"{_CLONES} SELECT g.g::BIGINT AS is_global, count(*)::BIGINT AS n_rows, sum(max_sim)::BIGINT AS sum_sim, sum(to_stmt)::BIGINT AS sum_to FROM cu, (SELECT unnest([0, 1]) AS g) g GROUP BY 1",
    "clones_ranked": f"{_CLONES} SELECT {', '.join(_RANKED)} FROM clones",
    "clones_ranked_alt": f"{_CLONES} SELECT row_number() OVER (ORDER BY max_cc DESC, n_units DESC, clone_id) - 1 AS rank, {', '.join(_RANKED[1:])} FROM clones",
    "biggest_clones": f"{_CLONES} SELECT rank, clones.n_units, clones.max_cc AS clone_cc, folder, cu.unit_id, cu.cc FROM clones JOIN cu USING (clone_id) JOIN units ON units.unit_id = cu.unit_id WHERE clones.n_units > {P.big_units} OR clones.max_cc > {P.big_cc}",
    "pair_export_csv_rows": f"{_PAIRS} SELECT x.folder AS left_folder, left_id::VARCHAR AS left_file, 1::BIGINT AS left_from, n_a::BIGINT AS left_to, y.folder AS right_folder, right_id::VARCHAR AS right_file, 1::BIGINT AS right_from, n_b::BIGINT AS right_to FROM pairs JOIN units x ON x.unit_id = left_id JOIN units y ON y.unit_id = right_id",
    "stage_counters": f"{_CLONES} SELECT (SELECT count(*) FROM units)::BIGINT AS n_units, (SELECT coalesce(sum(n_newlines), 0) FROM units)::BIGINT AS n_newlines, (SELECT count(*) FROM pairs)::BIGINT AS n_pairs, count(*)::BIGINT AS n_clones, count(*) FILTER (n_units > {P.big_units})::BIGINT AS n_many_units, count(*) FILTER (max_cc > {P.big_cc})::BIGINT AS n_high_cc, coalesce(max(max_cc), 0)::BIGINT AS max_weight FROM clones",
    "clone_density": f"{_CLONES} SELECT clone_id, count(*)::BIGINT AS n_units, count(DISTINCT folder)::BIGINT AS n_folders FROM cu JOIN units USING (unit_id) GROUP BY 1",
    "units_in_clones": f"{_CLONES} SELECT unit_id, num_tokens FROM units WHERE unit_id IN (SELECT unit_id FROM cu)",
    "units_without_clones": f"{_CLONES} SELECT unit_id, num_tokens FROM units WHERE unit_id NOT IN (SELECT unit_id FROM cu)",
    "view_bins": f"{_CLONES}, m AS (SELECT greatest(1, ceil(count(*) / 40))::BIGINT AS per FROM clones) SELECT (rank // per)::BIGINT AS bar, min(rank)::BIGINT AS first, max(rank)::BIGINT AS last, count(*)::BIGINT AS n_items, max(weight)::BIGINT AS max_weight FROM clones, m GROUP BY 1",
    "view_edges": f"{_CLONES} SELECT rank AS clone_rank, unit_rank, cu.max_level AS level, cu.max_type AS clone_type FROM cu JOIN clones USING (clone_id) JOIN ur ON ur.unit_id = cu.unit_id",
    "view_zoom_slice": f"{_CLONES} SELECT rank, clone_id, n_units FROM clones WHERE rank BETWEEN 3 AND 12",
    "view_labels": f"{_CLONES} SELECT rank, 'Clone #' || (rank + 1) || ' ' || max_sim || '% (Type ' || (max_type + 1) || ' - CC:' || max_cc || ' - #frag:' || n_units || ')' AS label FROM clones",
    "view_diff_groups": f"{_CLONES} SELECT clone_id, string_agg(concat_ws(':', cu.unit_id, from_stmt, to_stmt), ',' ORDER BY cu.unit_id) AS members, max(cu.cc)::BIGINT AS cost, CASE WHEN count(DISTINCT folder) = 1 THEN min(folder) END AS title FROM cu JOIN units USING (unit_id) GROUP BY 1",
}
