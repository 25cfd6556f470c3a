"""Operators over small frames, the Java adapter, and the contract queries against their SQL."""

import glob
import os
import random
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from kindred.functions.alignment import align
from kindred.operators import candidates, evaluate, merge, rollup, sinks, verify, views
from kindred.operators.components import components
from kindred.params import CODE, TEXT
from kindred.plans import java_queries, queries
from kindred.plans.engine import CloneEngine
from kindred.sources import files, java, text

HERE = os.path.dirname(os.path.abspath(__file__))
SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize(
    "f, g, forward, backward",
    [((0, 100), (0, 100), True, True), ((0, 100), (50, 120), True, True), ((0, 100), (90, 200), False, True), ((0, 100), (60, 80), False, True), ((0, 100), (100, 100), False, True), ((0, 100), (101, 150), False, False), ((0, 100), (40, 60), False, False)],
)
def test_overlap(spark, f, g, forward, backward):
    lits = [F.lit(x) for x in (*f, *g)]
    got = spark.range(1).select(merge.overlaps(*lits, CODE), merge.overlaps(*lits[2:], *lits[:2], CODE)).first()
    assert tuple(got) == (forward, backward)


def test_levels_and_weights(spark):
    df = spark.createDataFrame([(80,), (85,), (90,), (95,), (100,)], "sim int")
    assert rows(df, "sim", verify.level(F.col("sim"), CODE), verify.weight(F.col("sim"), CODE)) == [(80, 0, 0), (85, 1, 25), (90, 2, 50), (95, 3, 75), (100, 3, 100)]
    assert df.select(verify.weight(F.col("sim"), CODE.but(min_sim=1.0))).first()[0] is None


def test_components_match_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2040)] + [(7, 7)]
    parent = {x: x for p in pairs for x in p if p[0] != p[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(pairs, "a long, b long"))
    assert rows(got, "vertex", "component") == sorted((x, find(x)) for x in parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def unit_frame(spark, ids, n=3):
    stmts = [(0, [1, 2], "x", k + 1) for k in range(n)]
    return spark.createDataFrame([(i, "p", "f", 0, stmts) for i in ids], "unit_id long, partition_key string, folder string, n_newlines long, stmts array<struct<kind:int,tokens:array<bigint>,text:string,cc:int>>")


PAIR = "left_id long, right_id long, sim int, level int, weight int, clone_type int, a struct<from_stmt:int,to_stmt:int>, b struct<from_stmt:int,to_stmt:int>"


def test_merge_and_rank(spark):
    pair = lambda a, b, s=(0, 2): (a, b, 100, 3, 100, 0, s, (0, 2))
    units = unit_frame(spark, [1, 2, 3, 4, 5])
    c = CloneEngine(spark, TEXT).search(units, spark.createDataFrame([pair(1, 2), pair(1, 3), pair(2, 3), pair(4, 5)], PAIR))
    assert rows(c.clones, "rank", "n_units", "n_pairs", "max_cc") == [(0, 3, 3, 6), (1, 2, 1, 6)]
    assert rows(c.clone_units, "unit_id", "from_stmt", "to_stmt", "cc") == [(k, 0, 2, 6) for k in range(1, 6)]
    assert rows(c.global_units, "unit_id", "cc") == [(k, 6) for k in range(1, 6)]
    assert tuple(c.counters().first()) == (5, 0, 4, 2, 0, 0, 6)
    assert [r["members"] for r in c.diff(1).collect()][0][0]["unit_id"] == 4
    assert "Clone #1 100% (Type 1 - CC:6 - #frag:3)" in [r["label"] for r in c.labels().collect()]
    assert rows(rollup.units_without_clones(unit_frame(spark, [5, 6]), c.clone_units), "unit_id") == [(6,)]


def test_separate_spans_stay_apart(spark):
    units = unit_frame(spark, [1, 2, 3], 12)
    pairs = spark.createDataFrame([(1, 2, 90, 2, 50, 2, (0, 4), (0, 4)), (1, 3, 85, 1, 25, 1, (8, 11), (0, 3))], PAIR)
    assert CloneEngine(spark, TEXT).search(units, pairs).clones.count() == 2


def test_java_pipeline(spark, tmp_path):
    root = str(shutil.copytree(f"{HERE}/fixtures/java", tmp_path / "src"))  # a root below tests/ would be filtered as a whole
    found = files.scan_partitioned(spark, root)
    assert {r["path"].rsplit("/", 1)[1] for r in found.collect()} == {"A.java", "B.java", "Cc.java", "Crlf.java"}
    assert [tuple(r)[:2] for r in files.partition_sizes(found).collect()] == [("alpha", 2), ("beta", 2)]
    engine = CloneEngine(spark, CODE)
    units = engine.java_units(found)
    scores = {r["signature"].split("(")[0]: sum(s["cc"] for s in r["stmts"]) for r in units.collect()}
    assert scores["alpha.A.first"] == 3 and scores["beta.Cc.score"] == 15 and "beta.Cc.ANON1.run" in scores
    crlf = next(r for r in units.collect() if r["class"] == "Crlf")
    assert (crlf["from_line"], crlf["stmts"][2]["from_line"], crlf["n_newlines"]) == (2, 3, 4)
    c = engine.search(units)
    assert rows(c.clones, "n_units", "n_pairs", "max_sim", "max_type") == [(3, 3, 100, 1)]
    assert engine.export(units).count() == 3


def test_java_queries(spark):
    for name, query in java_queries.QUERIES.items():
        got = query(spark, SF)
        want = duckdb.sql(java_queries.ORACLE_SQL[name])
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()) and got.columns == want.columns, name


def test_java_package_and_anonymous_class_far_in(tmp_path):
    far = "/** doc */ @A " * 500 + "package far.off; class X { void m() { f(new Y(" + "1 + " * 500 + "1) { void inner() { return; } }); } }"
    assert {(u.package, u.cls, u.name) for u in java.Parser(far).parse()} == {("far.off", "X", "m"), ("far.off", "X.ANON1", "inner")}


def test_report_of_java_clones(spark, tmp_path):
    found = java_queries._search(spark)
    sinks.write_biggest(found.clones, found.clone_units, found.units, CODE.but(big_units=1), str(tmp_path / "big"))
    lines = sorted(line for part in (tmp_path / "big").glob("part-*") for line in part.read_text().splitlines())
    assert {x for x in lines} == {"CloneIdx,#Fragments,Max CC,Class,Method,CC", "0,2,4,alpha.Totals,add,4", "0,2,4,beta.Sums,total,4"}


def test_views(spark):
    items = spark.createDataFrame([(k, k % 4) for k in range(10)], "rank long, weight int")
    assert rows(views.bins(items, 10, 4), "bar", "first", "last", "n_items") == [(0, 0, 2, 3), (1, 3, 5, 3), (2, 6, 8, 3), (3, 9, 9, 1)]
    assert views.slice_of(items, 2, 3).count() == 3 and views.near(items, 5, 5).count() == 5 and views.zoom_size(1000) == 200
    assert [r["rank"] for r in views.hit(items, 5, 1.0, 1).collect()] == [5, 4, 6]
    assert items.select(views.height(F.lit(5), 0, 10, 100)).first()[0] == 60 and views.bar_width(10, 100) == 10
    assert items.select(views.colour(F.lit(0), F.lit(9))).first()[0] == views.PALETTE[0][3]
    assert views.random_graph(spark, 10, 5, 50).where("sim between 80 and 99").count() == 50


def test_recall_of_planted_clones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 800")
    planted = [evaluate.mutated(docs, kind) for kind in (0, 2)]
    every = docs.select("doc_id", "text", "lang", "source").unionByName(planted[0].select("doc_id", "text", "lang", "source")).unionByName(planted[1].select("doc_id", "text", "lang", "source"))
    engine = CloneEngine(spark, TEXT)
    found = engine.verified(text.large_enough(engine.text_units(every), TEXT))
    truth = docs.where("pmod(doc_id, 7) = 0").select(F.col("doc_id").alias("left_id"), F.explode(F.array(F.struct((-(F.col("doc_id") * 4 + 1)).alias("right_id"), F.lit(0).alias("kind")), F.struct((-(F.col("doc_id") * 4 + 3)).alias("right_id"), F.lit(2).alias("kind")))).alias("t")).select("left_id", "t.*")
    got = {r["kind"]: r["recall"] for r in evaluate.recall(found, truth, ["kind"]).collect()}
    assert got[0] == 1.0 and got[2] >= 0.8
    assert evaluate.precision(found, found).first()["precision"] == 1.0


def test_copies_are_aligned_once_and_listed_whole(spark):
    word = lambda k: f"alpha{k} beta{k} gamma{k} delta{k} epsilon{k}"
    one, two = ". ".join(map(word, range(6))), ". ".join([*map(word, range(5)), word(77)])
    docs = spark.createDataFrame([(k, one if k % 2 else two, "en", "s") for k in range(1, 9)], "doc_id long, text string, lang string, source string")
    engine = CloneEngine(spark, TEXT)
    units = engine.text_units(docs)
    pairs = spark.createDataFrame([(a, b) for a in range(1, 9) for b in range(a + 1, 9)], "left_id long, right_id long")
    plan = verify.verified(pairs, units, TEXT)
    stmts = {r["unit_id"]: [(s["kind"], tuple(s["tokens"]), s["text"]) for s in r["stmts"]] for r in units.collect()}
    want = []
    for a in range(1, 9):
        for b in range(a + 1, 9):
            g = align(stmts[a], stmts[b], TEXT)
            want.append((a, b, g.sim // 10, g.clone_type, (g.a_from, g.a_to), (g.b_from, g.b_to)))
    got = sorted((r["left_id"], r["right_id"], r["sim"], r["clone_type"], tuple(r["a"]), tuple(r["b"])) for r in plan.collect())
    assert got == want
    aligned = max(glob.glob(f"{spark.conf.get('spark.checkpoint.dir', '/tmp/checkpoints')}/aligned-*"), key=os.path.getmtime)
    assert spark.read.parquet(aligned).count() == 4  # of 28 pairs, as there are two texts in two orders


def test_no_nested_loop_in_candidates(spark):
    bands = spark.createDataFrame([(1, 0, 5), (2, 0, 5)], "unit_id long, band int, h long")
    plan = candidates.candidates(bands)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_streaming_matches_batch(spark, tmp_path):
    from kindred.streaming.near_dup import StreamingNearDuplicates

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(80)
    s = StreamingNearDuplicates(spark, str(tmp_path))
    for epoch, part in enumerate((docs.where("doc_id < 40"), docs.where("doc_id >= 40"), docs.where("doc_id >= 40"))):
        s.batch(part, min(epoch, 1))
    want = candidates.candidates(queries.sketch.bands(text.tokens(docs), TEXT))
    assert rows(s.pairs(), "left_id", "right_id") == rows(want, "left_id", "right_id")


SOME = ["scan_partitioned", "token_dictionary", "stmt_explode", "band_hashes", "lsh_candidates_partitioned", "near_dup_classes", "fragment_overlap_join", "clones_ranked", "view_edges"]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, SF), c.sql(queries.ORACLE_SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.select(*names).fetchall()))


def test_entry():
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
