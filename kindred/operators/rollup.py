"""Rollups, rankings and reports over merged pairs: clones, clone units and global units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.params import CloneParams
from kindred.storage import materialise


def pair_rollup(pairs: DataFrame, frags: DataFrame) -> DataFrame:
    """Pairs with max_cc and max_stmts of their two fragments."""
    both = frags.groupBy("pair_id").agg(F.max("cc").alias("max_cc"), F.max("n_stmts").alias("max_stmts"))
    return pairs.join(both, "pair_id")


def clone_rollup(pairs: DataFrame, frags: DataFrame) -> DataFrame:
    """(clone_id, n_pairs, n_units, max_cc, max_stmts, max_weight, max_sim, max_level, max_type)."""
    own = pair_rollup(pairs, frags).groupBy("clone_id").agg(F.count("*").alias("n_pairs"), *(F.max(c).alias(m) for c, m in (("max_cc", "max_cc"), ("max_stmts", "max_stmts"), ("weight", "max_weight"), ("sim", "max_sim"), ("level", "max_level"), ("clone_type", "max_type"))))
    return own.join(frags.groupBy("clone_id").agg(F.countDistinct("unit_id").alias("n_units")), "clone_id")


def unit_spans(pairs: DataFrame, frags: DataFrame) -> DataFrame:
    """Clone units and global units in one pass, GROUPING SETS ((clone_id, unit_id), (unit_id)); clone_id is null for global
    rows, which ``is_global`` tells."""
    joined = frags.join(pairs.select("pair_id", "weight", "sim", "level", "clone_type"), "pair_id")
    out = joined.groupingSets([["clone_id", "unit_id"], ["unit_id"]], "clone_id", "unit_id").agg(F.grouping("clone_id").cast("int").alias("is_global"), F.max("weight").alias("max_weight"), F.max("sim").alias("max_sim"), F.max("level").alias("max_level"), F.max("clone_type").alias("max_type"), F.min("from_stmt").alias("from_stmt"), F.max("to_stmt").alias("to_stmt"))
    return out


def clone_units(spans: DataFrame, units: DataFrame) -> DataFrame:
    """Clone units with the score of their span, by the unit's own statements."""
    scores = units.select("unit_id", F.transform("stmts", lambda s: s["cc"]).alias("ccs"))
    cc = F.aggregate(F.slice("ccs", F.col("from_stmt") + 1, F.col("to_stmt") - F.col("from_stmt") + 1), F.lit(0), lambda a, x: a + x)
    return spans.where("is_global = 0").drop("is_global").join(scores, "unit_id").withColumn("cc", cc.cast("int")).drop("ccs")


def global_units(spans: DataFrame, own: DataFrame, units: DataFrame) -> DataFrame:
    """Global units; their score is the larger of the unit's whole score and that of its clone spans."""
    most = own.groupBy("unit_id").agg(F.max("cc").alias("span_cc"))
    whole = units.select("unit_id", F.aggregate("stmts", F.lit(0), lambda a, s: a + s["cc"]).alias("unit_cc"))
    return spans.where("is_global = 1").drop("is_global", "clone_id").join(most, "unit_id").join(whole, "unit_id").withColumn("cc", F.greatest("span_cc", "unit_cc").cast("int")).drop("span_cc", "unit_cc")


def with_max_cc(clones: DataFrame, own: DataFrame) -> DataFrame:
    """Clones whose max_cc is that of their units' spans, and whose weight is that too."""
    most = own.groupBy("clone_id").agg(F.max("cc").alias("max_cc"))
    return clones.drop("max_cc").join(most, "clone_id").withColumn("weight", F.col("max_cc"))


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """0-based ranks in a total order, without gathering the rows in one task: range-partitioned and sorted, with each
    partition's rank offset by what stands before it (one number for each partition)."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = materialise(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()), "ranks")  # its bounds are sampled: fix them
    local = placed.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    return local.join(F.broadcast(before), "__p").withColumn(name, (F.col("__i") - 1 + F.col("__before")).cast("bigint")).drop("__p", "__i", "__before", "__n")


def clones_ranked(clones: DataFrame, by_units: bool = True) -> DataFrame:
    """By number of units, then score (or the other way round), then clone id."""
    first, second = ("n_units", "max_cc") if by_units else ("max_cc", "n_units")
    return ranked(clones, [F.desc(first), F.desc(second), F.asc("clone_id")])


def biggest(clones: DataFrame, own: DataFrame, units: DataFrame, p: CloneParams) -> DataFrame:
    """One row per clone and unit of clones with many units or a high score."""
    big = clones.where((F.col("n_units") > p.big_units) | (F.col("max_cc") > p.big_cc)).select("clone_id", "rank", "n_units", F.col("max_cc").alias("clone_cc"))
    return big.join(own.select("clone_id", "unit_id", "cc"), "clone_id").join(units.select("unit_id", "folder"), "unit_id").select("rank", "n_units", "clone_cc", "folder", "unit_id", "cc")


def named(report: DataFrame, units: DataFrame) -> DataFrame:
    """A report on units with the class and method of each: of a source file's unit its qualified class and its name, of another
    one its folder and id."""
    if "class" in units.columns:
        names = units.select("unit_id", F.concat_ws(".", F.when(F.col("package") != "", F.col("package")), "class").alias("class"), F.regexp_extract("signature", r"([^.()]+)\(", 1).alias("method"))
        return report.join(names, "unit_id")
    return report.withColumns({"class": F.col("folder"), "method": F.col("unit_id").cast("string")})


def counters(units: DataFrame, pairs: DataFrame, clones: DataFrame, p: CloneParams) -> DataFrame:
    """One row: units, lines, pairs, clones, and clones over each report threshold."""
    u = units.agg(F.count("*").alias("n_units"), F.coalesce(F.sum("n_newlines"), F.lit(0)).alias("n_newlines"))
    q = pairs.agg(F.count("*").alias("n_pairs"))
    c = clones.agg(F.count("*").alias("n_clones"), F.count_if(F.col("n_units") > p.big_units).alias("n_many_units"), F.count_if(F.col("max_cc") > p.big_cc).alias("n_high_cc"), F.coalesce(F.max("max_cc"), F.lit(0)).cast("bigint").alias("max_weight"))
    return u.join(F.broadcast(q)).join(F.broadcast(c))


def density(own: DataFrame, units: DataFrame) -> DataFrame:
    """Per clone: units and distinct folders."""
    return own.join(units.select("unit_id", "folder"), "unit_id").groupBy("clone_id").agg(F.count("*").alias("n_units"), F.countDistinct("folder").alias("n_folders"))


def units_in_clones(units: DataFrame, own: DataFrame) -> DataFrame:
    return units.join(own, "unit_id", "left_semi")


def units_without_clones(units: DataFrame, own: DataFrame) -> DataFrame:
    return units.join(own, "unit_id", "left_anti")


def fragments_ordered(frags: DataFrame) -> DataFrame:
    """Fragments with their rank in the order unit, partner, start, end, pair, side."""
    return ranked(frags, [F.asc(c) for c in ("unit_id", "partner_id", "from_stmt", "to_stmt", "pair_id", "side")], "ord")


def first_fragments(ordered: DataFrame) -> DataFrame:
    """The least rank of each unit's fragments."""
    return ordered.groupBy("unit_id").agg(F.min("ord").alias("first"))


def dense_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values with dense 0-based ids in their order."""
    return ranked(df.select(column).distinct(), [F.asc(column)], name)


def export_rows(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """The pair export: folder, file, first and last line of both sides.

    Units of source files give the last part of their folder, their file's name and lines of the source; units of text tables,
    which have neither, give folder, id and statement numbers."""
    source = "path" in units.columns
    last = lambda c: F.substring_index(F.regexp_replace(c, "/+$", ""), "/", -1)

    def side(n: str) -> DataFrame:
        own = [F.col("unit_id").alias(f"{n}_id"), (last("folder") if source else F.col("folder")).alias(f"{n}_folder")]
        if source:
            own += [last("path").alias(f"{n}_file"), F.transform("stmts", lambda s: s["from_line"]).alias(f"{n}_starts"), F.transform("stmts", lambda s: s["to_line"]).alias(f"{n}_ends")]
        else:
            own.append(F.col("unit_id").cast("string").alias(f"{n}_file"))
        return units.select(*own)

    def at(n: str, span: str, end: str) -> Column:
        number = F.col(f"{span}.{end}_stmt")
        return (F.get(f"{n}_starts" if end == "from" else f"{n}_ends", number) if source else number + 1).alias(f"{n}_{end}")

    met = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    return met.select(*(c for n, span in (("left", "a"), ("right", "b")) for c in (F.col(f"{n}_folder"), F.col(f"{n}_file"), at(n, span, "from"), at(n, span, "to"))))
