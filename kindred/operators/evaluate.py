"""Recall and precision of found pairs against labelled ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unordered(pairs: DataFrame, a: str = "left_id", b: str = "right_id") -> DataFrame:
    return pairs.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()


def recall(found: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """truth(left_id, right_id, by...): detected, total and recall (null where there is nothing) for each group and in all."""
    hit = truth.withColumns({"x": F.least("left_id", "right_id"), "y": F.greatest("left_id", "right_id")}).join(unordered(found).withColumn("hit", F.lit(1)), ["x", "y"], "left")
    out = hit.rollup(*by).agg(F.coalesce(F.sum("hit"), F.lit(0)).cast("bigint").alias("detected"), F.count("*").alias("total"))
    return out.withColumn("recall", F.col("detected") / F.nullif(F.col("total"), F.lit(0)))


def similarity_band(sim, step: int = 5):
    """Lower bound of the band of a whole percentage: 80, 85, ..."""
    return F.least(F.floor(sim / step) * step, F.lit(100 - step)).cast("int")


def precision(found: DataFrame, truth: DataFrame) -> DataFrame:
    f = unordered(found)
    good = f.join(unordered(truth), ["x", "y"], "left_semi").agg(F.count("*").alias("right"))
    return f.agg(F.count("*").alias("found")).join(F.broadcast(good)).withColumn("precision", F.col("right") / F.nullif(F.col("found"), F.lit(0)))


def mutated(docs: DataFrame, kind: int, every: int = 7) -> DataFrame:
    """Copies of documents with a known change: 0 none, 1 renamed words, 2 a sentence dropped.  Ids are negative."""
    text = F.col("text")
    changed = {0: text, 1: F.regexp_replace(text, r"(?<=\s)(\p{Ll}{4})(?=\p{Ll})", "qx$1"), 2: F.regexp_replace(text, r"^[^.]*\.[^.]*\.", "")}[kind]
    return docs.where(F.pmod("doc_id", F.lit(every)) == 0).withColumns({"text": changed, "doc_id": -(F.col("doc_id") * 4 + kind + 1)})
