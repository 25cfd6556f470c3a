"""Fragments of verified pairs, their overlaps, and clone classes as connected components of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.operators.components import components
from kindred.params import CloneParams
from kindred.storage import materialise


def numbered_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with pair_id: a content key (its two units and spans), the same for every partitioning."""
    content = F.concat_ws(":", "left_id", "right_id", "a.from_stmt", "a.to_stmt", "b.from_stmt", "b.to_stmt")
    return pairs.withColumn("pair_id", F.conv(F.substring(F.md5(content), 1, 15), 16, 10).cast("bigint"))


def fragments(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Two rows for each pair: pair_id, side, unit_id, partner_id, from_stmt, to_stmt, n_stmts, cc.

    A fragment's score comes from the unit's own statements, in the row."""
    both = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left_id").alias("unit_id"), F.col("right_id").alias("partner_id"), F.col("a").alias("f")), F.struct(F.lit(1).alias("side"), F.col("right_id").alias("unit_id"), F.col("left_id").alias("partner_id"), F.col("b").alias("f")))).alias("s"))
    flat = both.select("pair_id", "s.side", "s.unit_id", "s.partner_id", "s.f.from_stmt", "s.f.to_stmt")
    scores = units.select("unit_id", F.transform("stmts", lambda s: s["cc"]).alias("ccs"))
    met = flat.join(scores, "unit_id")
    cc = F.aggregate(F.slice("ccs", F.col("from_stmt") + 1, F.col("to_stmt") - F.col("from_stmt") + 1), F.lit(0), lambda a, x: a + x)
    return met.select("pair_id", "side", "unit_id", "partner_id", "from_stmt", "to_stmt", (F.col("to_stmt") - F.col("from_stmt") + 1).alias("n_stmts"), cc.cast("int").alias("cc"))


def overlaps(f_from: Column, f_to: Column, g_from: Column, g_to: Column, p: CloneParams) -> Column:
    """Whether g overlaps f enough.  ``reference``: the shared length against how far g reaches beyond f (by its end or its
    start, whichever is more; it may be nothing), so the order of f and g matters; ``jaccard``: shared against joint length."""
    shared = F.least(f_to, g_to) - F.greatest(f_from, g_from)
    if p.overlap_mode == "jaccard":
        joint = F.greatest(f_to, g_to) - F.least(f_from, g_from) + 1
        return (shared + 1) * 100 >= joint * p.overlap_percent
    return (shared >= 0) & (shared * 100 >= F.greatest(g_to - f_to, g_from - f_from) * p.overlap_percent)


def overlap_edges(frags: DataFrame, p: CloneParams) -> DataFrame:
    """(a, b): pairs of pair ids whose fragments in one unit overlap.

    Equal spans of a unit are linked through the least pair (a star); only distinct spans meet in the range join, whose key is
    the unit."""
    ordered = frags.withColumn("hub", F.min("pair_id").over(Window.partitionBy("unit_id", "from_stmt", "to_stmt")))
    same = ordered.where("pair_id <> hub").select(F.col("pair_id").alias("a"), F.col("hub").alias("b"))
    spans = ordered.groupBy("unit_id", "from_stmt", "to_stmt").agg(F.min("pair_id").alias("pair_id"))
    f, g = spans.alias("f"), spans.alias("g")
    test = overlaps(F.col("f.from_stmt"), F.col("f.to_stmt"), F.col("g.from_stmt"), F.col("g.to_stmt"), p)
    if p.edge_mode == "either":
        test = test | overlaps(F.col("g.from_stmt"), F.col("g.to_stmt"), F.col("f.from_stmt"), F.col("f.to_stmt"), p)
    before = (F.col("f.from_stmt") < F.col("g.from_stmt")) | ((F.col("f.from_stmt") == F.col("g.from_stmt")) & (F.col("f.to_stmt") < F.col("g.to_stmt")))
    near = f.join(g, (F.col("f.unit_id") == F.col("g.unit_id")) & before & (F.col("g.from_stmt") <= F.col("f.to_stmt")) & test)
    return same.unionByName(near.select(F.col("f.pair_id").alias("a"), F.col("g.pair_id").alias("b"))).distinct()


def merged(pairs: DataFrame, units: DataFrame, p: CloneParams) -> tuple[DataFrame, DataFrame]:
    """(pairs with pair_id and clone_id, fragments with clone_id): clone_id is the least pair id of the class."""
    pairs = materialise(numbered_pairs(pairs), "pairs")
    frags = materialise(fragments(pairs, units), "fragments")
    labels = components(overlap_edges(frags, p)).withColumnRenamed("vertex", "pair_id")
    own = materialise(pairs.select("pair_id").join(labels, "pair_id", "left").select("pair_id", F.coalesce("component", "pair_id").alias("clone_id")), "clones")
    return pairs.join(own, "pair_id"), frags.join(own, "pair_id")
