"""Candidate pairs: a self equi-join by band and hash.  ``representatives`` finds one unit of each token sequence, for callers that
want classes rather than all pairs of copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidates(bands: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (left_id, right_id), left < right, of units that share a band hash (and, with ``keys``, these columns too)."""
    left = bands.select(*keys, "band", "h", F.col("unit_id").alias("left_id"))
    right = bands.select(*keys, "band", "h", F.col("unit_id").alias("right_id"))
    return left.join(right, [*keys, "band", "h"]).where("left_id < right_id").select(*keys, "left_id", "right_id").distinct()


def representatives(tokens: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(unit_id, rep_id): the least unit with the same token sequence (within the same ``keys``), found by content hash with
    partial aggregation."""
    hashed = tokens.select(*keys, "unit_id", F.xxhash64("tokens").alias("h1"), F.md5(F.array_join(F.col("tokens").cast("array<string>"), " ")).alias("h2"))
    least = hashed.groupBy(*keys, "h1", "h2").agg(F.min("unit_id").alias("rep_id"))
    return hashed.join(least, [*keys, "h1", "h2"]).select(*keys, "unit_id", "rep_id")


def bucket_stats(bands: DataFrame) -> DataFrame:
    """(bucket_size, n_buckets) over the buckets with more than one distinct unit."""
    sizes = bands.groupBy("band", "h").agg(F.countDistinct("unit_id").alias("bucket_size")).where("bucket_size > 1")
    return sizes.groupBy("bucket_size").agg(F.count("*").alias("n_buckets"))


def jaccard(pairs: DataFrame, shingle_sets: DataFrame) -> DataFrame:
    """Pairs with both sizes, their intersection and similarity in whole percent."""
    side = lambda n: shingle_sets.select(F.col("unit_id").alias(f"{n}_id"), F.col("shingles").alias(f"{n}_set"))
    met = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    both = F.size(F.array_intersect("left_set", "right_set")).cast("bigint")
    out = met.select("left_id", "right_id", both.alias("n_both"), (F.size("left_set") + F.size("right_set")).cast("bigint").alias("n_all"))
    return out.select("left_id", "right_id", "n_both", (F.col("n_all") - F.col("n_both")).alias("n_union"), F.expr("(100 * n_both) div nullif(n_all - n_both, 0)").alias("sim"))
