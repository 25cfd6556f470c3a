"""Connected components of an edge table by alternating star contraction, all in DataFrame operations.

Large-star links each vertex's larger neighbours to the least vertex around it, small-star does so with the smaller ones; the
graph becomes a set of stars around the least vertex of each component in about log(diameter) rounds.  A round is two
aggregations with partial sums and two joins; nothing is gathered by vertex, so a hub costs no more than its rows.  Lineage is
cut after each round by a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.storage import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(a, b): b < a.  One star step; the result has b < a too."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
    met = both.join(least, both["a"] == least["v"])
    if large:  # every larger neighbour goes to the least vertex around
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # so does every smaller one, and the vertex itself
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(vertex, component) for every vertex that has an edge to another; component is the least vertex.

    Edges may repeat and stand in either direction; loops and nulls say nothing.
    """
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now = materialise(now, "edges")
    print_key = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
    key = print_key(now)
    if key[0] == 0:
        return now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    for _ in range(most_rounds):
        now = materialise(_star(_star(now, True), False), "edges")
        new = print_key(now)
        if new == key:
            break
        key = new
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("vertex")).distinct()
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(roots.select("vertex", F.col("vertex").alias("component")))
