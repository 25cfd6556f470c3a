"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Documents fall into cells of source x language x topic; their tokens are summed by cell first (partial sums, so a hot source
costs no more than its rows), and raking works on the cells alone: in each sweep the weights are scaled to the source, the
language and the topic marginals in turn.  A cell's factor is its raked weight over its tokens; a document is kept with
probability rate x factor, where the rate is lowered if need be so that no probability passes 1 (so none is cut and the
marginals hold in expectation).  With ``saturate`` the rate isn't lowered: cells whose probability would pass 1 are kept whole, and
one level for all others is set so that the expected tokens are ``rate`` of all (every cell with a factor is kept whole where even
that isn't enough).  Those others keep their raked proportions, and a rare value no longer thins out the rest.  The draw is a hash of the id and the seed: repeatable, and the same for every partitioning.

Targets are tables (value, share); without one, a marginal's target is its observed shares to the power ``TEMPERATURE``.  Shares
are scaled to the values present; a value without a share gets 0 and its documents go.  Topics are rules, the first that holds.

Null sources and languages are a value of their own (``NULL_NAME``).  Null and empty texts have no token: they don't move the
weights and are kept as their cell is (a cell without any token has factor 1, and with ``saturate`` the plain rate).  Rows that repeat draw alike; an empty table
gives an empty table; further columns stay in ``sample`` and are left out of ``probabilities``.

Everything here is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import WORD, materialise, table

TEMPERATURE = {"source": 0.5, "lang": 0.7, "topic": 1.0}
SWEEPS, RATE, SEED = 8, 0.5, "mix-1"
NULL_NAME = "(none)"
#: (topic, SQL condition on the text), in order; what meets none is ``prose``.
TOPICS = (
    ("empty", "text is null or length(text) = 0"),
    ("table", "locate(' | ', text) > 0"),
    ("contact", "locate('@', text) > 0"),
    ("long", "length(text) > 4000"),
)
OTHER_TOPIC = "prose"
MARGINS = ("source", "lang", "topic")
#: Pairs of language and topic whose factors the driver holds.
MOST_PAIRS = 4096


def topic_of(text: str = "text", rules: tuple[tuple[str, str], ...] = TOPICS) -> Column:
    out = F
    for name, condition in rules:
        out = out.when(F.expr(condition.replace("text", f"`{text}`")), name)
    return out.otherwise(OTHER_TOPIC)


def margins(docs: DataFrame, source: str = "source", lang: str = "lang", text: str = "text") -> list[Column]:
    """The three values a document counts under."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NULL_NAME))
    return [named(source).alias("source"), named(lang).alias("lang"), topic_of(text).alias("topic")]


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(NULL_NAME)))), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def _targets(observed: dict[str, float], name: str, targets: dict[str, DataFrame] | None, total: float, cells: DataFrame) -> dict[str, float]:
    """Token targets of a small marginal, from shares or tempered from what is observed."""
    if targets and name in targets:
        present = cells.select(F.col(name).alias("value")).distinct()
        named = targets[name].select(F.coalesce(F.col("value").cast("string"), F.lit(NULL_NAME)).alias("value"), "share")
        given = {r["value"]: float(r["share"] or 0) for r in named.join(present, "value", "left_semi").dropDuplicates(["value"]).collect()}
        share = {v: given.get(v, 0.0) for v in observed}
    else:
        share = {v: t ** TEMPERATURE[name] if t else 0.0 for v, t in observed.items()}
    whole = sum(share.values())
    return {v: s / whole * total if whole else 0.0 for v, s in share.items()}


def _saturating_level(raked: DataFrame, rate: float) -> float:
    """The level at which sum(tokens x min(1, level x factor)) is ``rate`` of all tokens, or the least that keeps every factor whole.

    Each round is one aggregation to a few numbers; the level only grows, and is exact once no further cell fills up."""
    goal = rate * (raked.agg(F.sum("tokens")).first()[0] or 0)
    weighed = raked.where("tokens > 0 and factor > 0")
    filled, level = -1, 0.0
    while True:
        full = F.col("factor") * F.lit(level) >= 1
        n, held, rest, most = weighed.agg(F.count_if(full), F.sum(F.when(full, F.col("tokens")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("factor"))), F.max(1 / F.col("factor"))).first()
        if not rest:
            return most or 0.0
        if n == filled:
            return level
        filled, level = n, (goal - held) / rest


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, sweeps: int = SWEEPS, rate: float = RATE, saturate: bool = False) -> DataFrame:
    """cells(source, lang, topic, tokens) with probability, after ``sweeps`` rounds over the three marginals.

    Sources may be many: each is one row with its few (language, topic) cells, and its factor is worked out in the row.
    Languages x topics are few (``MOST_PAIRS`` at most, checked): a sweep is one aggregation to these sums, from which their
    factors follow."""
    cells = materialise(cells, "cells")
    pairs = cells.groupBy("lang", "topic").agg(F.sum("tokens").cast("double").alias("t")).limit(MOST_PAIRS + 1).collect()
    if len(pairs) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} pairs of language and topic")
    total = sum(r["t"] for r in pairs)
    observed: dict[str, dict[str, float]] = {"lang": {}, "topic": {}}
    for r in pairs:
        for m in observed:
            observed[m][r[m]] = observed[m].get(r[m], 0.0) + r["t"]
    wanted = {m: _targets(observed[m], m, targets, total, cells) for m in observed}
    rows = cells.groupBy("source").agg(F.sum("tokens").cast("double").alias("tokens"), F.collect_list(F.struct("lang", "topic", F.col("tokens").cast("double").alias("w"))).alias("cells"))
    if targets and "source" in targets:
        rows = rows.join(targets["source"].select(F.col("value").cast("string").alias("source"), F.col("share").cast("double").alias("t")), "source", "left").withColumn("t", F.coalesce("t", F.lit(0.0)))
    else:
        rows = rows.withColumn("t", F.pow("tokens", F.lit(TEMPERATURE["source"])))
    rows = materialise(rows, "sources")
    whole = rows.agg(F.sum("t")).first()[0]
    share = F.col("t") * F.lit(total / whole if whole else 0.0)
    factor = {(r["lang"], r["topic"]): 1.0 for r in pairs}

    def in_row(factor: dict[tuple[str, str], float]) -> DataFrame:
        """(source, lang, topic, tokens, scale, g): scale is the source's own factor."""
        flat = [F.lit(x) for (lang, topic), v in sorted(factor.items()) for x in (f"{lang}\n{topic}", v)]
        table = F.create_map(*flat) if flat else F.create_map().cast("map<string,double>")
        weighed = F.transform("cells", lambda c: F.struct(c["lang"].alias("lang"), c["topic"].alias("topic"), c["w"].alias("w"), F.element_at(table, F.concat_ws("\n", c["lang"], c["topic"])).alias("g")))
        sums = rows.select("source", share.alias("t"), weighed.alias("cells")).withColumn("s", F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["w"] * c["g"]))
        return sums.select("source", F.coalesce(F.col("t") / F.nullif("s", F.lit(0.0)), F.lit(0.0)).alias("scale"), F.explode("cells").alias("c")).select("source", "c.lang", "c.topic", F.col("c.w").alias("tokens"), "scale", F.col("c.g").alias("g"))

    last = dict(factor)
    for _ in range(sweeps):
        last = dict(factor)
        got = in_row(factor).groupBy("lang", "topic").agg(F.sum(F.col("tokens") * F.col("scale") * F.col("g")).alias("w")).collect()
        sums = {(r["lang"], r["topic"]): r["w"] for r in got}
        for place, m in enumerate(("lang", "topic")):
            by: dict[str, float] = {}
            for pair, w in sorted(sums.items()):
                by[pair[place]] = by.get(pair[place], 0.0) + w
            ratio = {v: wanted[m][v] / w if w else 0.0 for v, w in by.items()}
            sums = {pair: w * ratio[pair[place]] for pair, w in sums.items()}
            factor = {pair: f * ratio[pair[place]] for pair, f in factor.items()}
    flat = [F.lit(x) for (lang, topic), v in sorted(factor.items()) for x in (f"{lang}\n{topic}", v)]
    final = F.element_at(F.create_map(*flat) if flat else F.create_map().cast("map<string,double>"), F.concat_ws("\n", "lang", "topic"))
    raked = materialise(in_row(last).select("source", "lang", "topic", "tokens", F.when(F.col("tokens") > 0, F.col("scale") * final).otherwise(1.0).alias("factor")), "raked")
    if saturate:
        kept = F.least(F.lit(1.0), F.col("factor") * F.lit(_saturating_level(raked, rate)))
        return raked.select(*MARGINS, F.round(F.when(F.col("tokens") > 0, kept).otherwise(F.lit(rate)), 9).alias("probability"))
    top = raked.agg(F.max("factor")).first()[0]
    level = min(rate, 1 / top) if top else rate
    return raked.select(*MARGINS, F.round(F.col("factor") * F.lit(level), 9).alias("probability"))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, source, lang, topic, tokens) of every row."""
    return docs.select(F.col(id_col).alias("id"), *margins(docs, text=text_col), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("tokens"))


def probabilities(docs: DataFrame, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text", saturate: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, source, lang, topic, tokens, probability and sampled."""
    rows = materialise(counted(docs, id_col, text_col), "counted")
    odds = rake(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), targets, saturate=saturate)
    return rows.join(odds, list(MARGINS)).withColumn("sampled", uniform(F.col("id")) < F.col("probability"))


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text", saturate: bool = False) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their columns."""
    cells = counted(docs, id_col, text_col).groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"))
    odds = rake(cells, targets, saturate=saturate).select(*(F.col(m).alias(f"__{m}") for m in MARGINS), F.col("probability").alias("__probability"))
    values = dict(zip(MARGINS, margins(docs, text=text_col), strict=True))
    keyed = docs.withColumns({f"__{m}": c for m, c in values.items()})
    return keyed.join(odds, [f"__{m}" for m in MARGINS]).where(uniform(F.col(id_col)) < F.col("__probability")).select(*docs.columns)


def sampling_sql(source: str = "documents", sweeps: int = SWEEPS, rate: float = RATE, saturate: bool = False) -> str:
    """The same in DuckDB's SQL: common table expressions that end in ``drawn``.

    The saturating level is read off the cells in order of their factors: with the cells before it kept whole, the first that isn't
    full itself sets it."""
    rules = " ".join(f"WHEN {c.replace('locate(', 'position_of(')} THEN '{n}'" for n, c in TOPICS)
    rules = rules.replace("position_of(' | ', text) > 0", "contains(text, ' | ')").replace("position_of('@', text) > 0", "contains(text, '@')")
    parts = [f"counted AS (SELECT doc_id AS id, coalesce(source, '{NULL_NAME}') AS source, coalesce(lang, '{NULL_NAME}') AS lang, CASE {rules} ELSE '{OTHER_TOPIC}' END AS topic, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS tokens FROM {source})"]
    parts.append("cells AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens, sum(tokens)::DOUBLE AS w FROM counted GROUP BY ALL)")
    for m in MARGINS:
        parts.append(f"share_{m} AS (SELECT {m}, pow(sum(tokens)::DOUBLE, {TEMPERATURE[m]}) AS t FROM cells GROUP BY 1)")
        parts.append(f"target_{m} AS (SELECT {m}, t / (SELECT sum(t) FROM share_{m}) * (SELECT sum(tokens)::DOUBLE FROM cells) AS target FROM share_{m})")
    last = "cells"
    for s in range(sweeps):
        for m in MARGINS:
            name = f"w_{s}_{m}"
            parts.append(f"{name} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.w * f.f AS w FROM {last} c JOIN (SELECT x.{m}, coalesce(t.target / nullif(sum(x.w), 0), 0) AS f FROM {last} x JOIN target_{m} t ON t.{m} = x.{m} GROUP BY x.{m}, t.target) f ON f.{m} = c.{m})")
            last = name
    parts.append(f"factors AS (SELECT source, lang, topic, tokens::DOUBLE AS tokens, coalesce(w / nullif(tokens::DOUBLE, 0), 1.0) AS factor FROM {last})")
    if saturate:
        order = "OVER (ORDER BY factor DESC, source, lang, topic ROWS BETWEEN"
        parts.append(f"weighed AS (SELECT factor, coalesce(sum(tokens) {order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held, sum(tokens * factor) {order} CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM factors WHERE tokens > 0 AND factor > 0)")
        parts.append(f"levels AS (SELECT factor, ({rate} * (SELECT sum(tokens) FROM factors) - held) / rest AS level FROM weighed)")
        parts.append("chosen AS (SELECT coalesce((SELECT level FROM levels WHERE level * factor < 1 ORDER BY factor DESC LIMIT 1), (SELECT max(1 / factor) FROM levels), 0) AS level)")
        parts.append(f"odds AS (SELECT source, lang, topic, round(CASE WHEN tokens > 0 THEN least(1.0::DOUBLE, factor * (SELECT level FROM chosen)) ELSE {rate} END, 9) AS probability FROM factors)")
    else:
        parts.append(f"odds AS (SELECT source, lang, topic, round(factor * (SELECT least({rate}, 1 / nullif(max(factor), 0)) FROM factors), 9) AS probability FROM factors)")
    parts.append(f"drawn AS (SELECT c.*, o.probability, (('0x' || substr(md5('{SEED}:' || coalesce(c.id::VARCHAR, '{NULL_NAME}')), 1, 13))::BIGINT)::DOUBLE / {float(1 << 52)!r} < o.probability AS sampled FROM counted c JOIN odds o ON o.source = c.source AND o.lang = c.lang AND o.topic = c.topic)")
    return ", ".join(parts)


def op10_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling probability and draw of every document, with tokens raked to tempered source, language and topic marginals; the
    saturating draw, as in the pipeline."""
    found = probabilities(table(spark, sf_dir, "documents"), saturate=True)
    return found.select(F.col("id").alias("doc_id"), "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "sampled")


ORACLE = f"WITH {sampling_sql(saturate=True)} SELECT id AS doc_id, source, lang, topic, tokens, round(probability, 6) AS probability, sampled FROM drawn"
