"""View-ready tables of ranked clones and units: bins, heights, colours, edges, labels, slices, hits and diff groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Colour by clone type (rows) and level (columns).
PALETTE = (("#d8e8d0", "#b0d0a0", "#80b868", "#4f9c34"), ("#d0e0f0", "#a0c0e0", "#6898cc", "#3470b4"), ("#f4dcd0", "#e8b49c", "#dc8860", "#c85c28"))


def bins(items: DataFrame, n: int, width: int) -> DataFrame:
    """items(rank, weight) as bars of ``ceil(n / width)`` items: bar, first, last, n_items, max_weight."""
    per_bar = max(1, -(-n // width))
    return items.groupBy(F.expr(f"rank div {per_bar}").alias("bar")).agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.count("*").alias("n_items"), F.max("weight").alias("max_weight"))


def bar_width(n: int, width: int, most: int = 25) -> int:
    return min(most, width // max(1, n))


def height(weight: Column, low: int, high: int, pixels: int) -> Column:
    """Scaled height; null where no clone has any weight."""
    return F.floor(F.floor((weight - low) * 100 / F.nullif(F.lit(high), F.lit(0))) * (4 * pixels // 5) / 100) + pixels // 5


def colour(clone_type: Column, level: Column) -> Column:
    table = F.array(*(F.array(*map(F.lit, row)) for row in PALETTE))
    return F.get(F.get(table, clone_type), F.least(level, F.lit(len(PALETTE[0]) - 1)))


def edges(own: DataFrame, clones: DataFrame, unit_ranks: DataFrame) -> DataFrame:
    """(clone_rank, unit_rank, level, clone_type) of every clone and its units."""
    return own.join(clones.select("clone_id", F.col("rank").alias("clone_rank")), "clone_id").join(unit_ranks.select("unit_id", F.col("rank").alias("unit_rank")), "unit_id").select("clone_rank", "unit_rank", F.col("max_level").alias("level"), F.col("max_type").alias("clone_type"))


def slice_of(clones: DataFrame, first: int, n: int) -> DataFrame:
    return clones.where(F.col("rank").between(first, first + n - 1))


def zoom_size(n: int) -> int:
    return min(n, max(100, min(200, n // 5)))


def one_clone(clones: DataFrame, rank: int) -> DataFrame:
    return slice_of(clones, rank, 1)


def near(clones: DataFrame, rank: int, window: int = 17) -> DataFrame:
    """The neighbourhood that a fisheye shows around one rank."""
    return clones.where(F.abs(F.col("rank") - rank) <= window // 2)


def hit(items: DataFrame, pixel: int, per_pixel: float, magnet: int = 10) -> DataFrame:
    """Items within ``magnet`` pixels of a position, nearest first."""
    at = F.col("rank") / F.lit(per_pixel)
    return items.where(F.abs(at - pixel) <= magnet).orderBy(F.abs(at - pixel), "rank")


def labels(clones: DataFrame) -> DataFrame:
    return clones.select("rank", F.format_string("Clone #%d %d%% (Type %d - CC:%d - #frag:%d)", F.col("rank") + 1, F.col("max_sim").cast("int"), F.col("max_type") + 1, F.col("max_cc").cast("int"), F.col("n_units").cast("int")).alias("label"))


def unit_labels(own: DataFrame) -> DataFrame:
    return own.select("clone_id", "unit_id", F.format_string("%s: %d%% (Type %d - CC:%d)", F.col("unit_id").cast("string"), F.col("max_sim").cast("int"), F.col("max_type") + 1, F.col("cc").cast("int")).alias("label"))


def diff_groups(own: DataFrame, units: DataFrame) -> DataFrame:
    """Per clone its members (unit, from, to) in order, the cost, and a title where all are in one folder."""
    met = own.join(units.select("unit_id", "folder"), "unit_id")
    return met.groupBy("clone_id").agg(F.sort_array(F.collect_list(F.struct("unit_id", "from_stmt", "to_stmt"))).alias("members"), F.max("cc").alias("cost"), F.when(F.countDistinct("folder") == 1, F.min("folder")).alias("title"))


def random_graph(spark: SparkSession, n_units: int, n_clones: int, n_fragments: int, seed: int = 7, low: int = 80) -> DataFrame:
    """A synthetic clone graph: fragment, clone, unit and a similarity in [low, 100)."""
    return spark.range(n_fragments).select(F.col("id").alias("fragment_id"), F.floor(F.rand(seed) * n_clones).alias("clone_id"), F.floor(F.rand(seed + 1) * n_units).alias("unit_id"), (F.floor(F.rand(seed + 2) * (100 - low)) + low).cast("int").alias("sim"))
