"""Contract queries over Java sources: a small tree of files that comes with this package, and what must be found in it."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import rollup
from kindred.params import CODE
from kindred.plans.engine import CloneEngine
from kindred.sources import files, java
from kindred.storage import materialise

ROOT = Path(__file__).parent / "fixture" / "java"


def _files(spark: SparkSession) -> DataFrame:
    return files.scan_partitioned(spark, ROOT.as_uri())


def _units(spark: SparkSession) -> DataFrame:
    return java.units(_files(spark), CODE)


def _name(column: str = "path"):
    return F.substring_index(column, "/", -1)


def java_files(spark, sf_dir):
    return _files(spark).select("partition_key", _name().alias("file"))


def java_partition_sizes(spark, sf_dir):
    return files.partition_sizes(_files(spark)).select("partition_key", "n_files", "n_newlines")


def java_units(spark, sf_dir):
    own = _units(spark)
    total = lambda f: F.aggregate("stmts", F.lit(0), lambda t, s: t + f(s)).cast("bigint")
    return own.select(_name().alias("file"), "package", "class", "signature", *(F.col(c).cast("bigint").alias(c) for c in ("from_line", "from_col", "to_line", "to_col")), F.size("stmts").cast("bigint").alias("n_stmts"), total(lambda s: F.size(s["tokens"])).alias("num_tokens"), total(lambda s: s["cc"]).alias("cc"), "n_newlines")


def java_statements(spark, sf_dir):
    kinds = F.array(*map(F.lit, java.STATEMENTS))
    rows = _units(spark).select("signature", F.posexplode("stmts").alias("pos", "s"))
    return rows.select("signature", F.col("pos").cast("bigint").alias("pos"), F.get(kinds, F.col("s.kind")).alias("kind"), "s.text", F.col("s.cc").cast("bigint").alias("cc"), F.col("s.from_line").cast("bigint").alias("from_line"), F.col("s.to_line").cast("bigint").alias("to_line"))


def java_packages(spark, sf_dir):
    return java.packages(_units(spark))


def java_classes(spark, sf_dir):
    return java.classes(_units(spark)).select("package", "class", "n_methods")


def _search(spark: SparkSession):
    return CloneEngine(spark, CODE).search(materialise(_units(spark), "units"))


def java_clone_pairs(spark, sf_dir):
    found = _search(spark)
    side = lambda n: found.units.select(F.col("unit_id").alias(f"{n}_id"), F.col("signature").alias(f"{n}_unit"))
    pairs = found.pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    first = F.col("left_unit") < F.col("right_unit")
    return pairs.select(F.least("left_unit", "right_unit").alias("one"), F.greatest("left_unit", "right_unit").alias("other"), *(F.col(c).cast("bigint").alias(c) for c in ("sim", "level", "weight", "clone_type")), F.when(first, F.col("a.to_stmt")).otherwise(F.col("b.to_stmt")).cast("bigint").alias("last_stmt"))


def java_pair_export(spark, sf_dir):
    found = _search(spark)
    rows = rollup.export_rows(found.pairs, found.units)
    sides = [F.struct(*(F.col(f"{n}_{c}").cast("string").alias(c) for c in ("folder", "file", "from", "to"))) for n in ("left", "right")]
    line = lambda s: F.concat_ws(",", s["folder"], s["file"], s["from"], s["to"])
    return rows.select(line(F.least(*sides)).alias("one"), line(F.greatest(*sides)).alias("other"))


def java_biggest(spark, sf_dir):
    found = _search(spark)
    return rollup.named(rollup.biggest(found.clones, found.clone_units, found.units, CODE.but(big_units=1)), found.units).select("rank", "n_units", "clone_cc", "class", "method", F.col("cc").cast("bigint").alias("cc"))


QUERIES = {f.__name__: f for f in (java_files, java_partition_sizes, java_units, java_statements, java_packages, java_classes, java_clone_pairs, java_pair_export, java_biggest)}

#: What the files of the fixture hold, read off them by eye.
ORACLE_SQL: dict[str, str] = {
    "java_files": """SELECT "partition_key", "file" FROM (VALUES
  ('alpha', 'Totals.java'),
  ('beta', 'Sums.java')
) AS t("partition_key", "file")""",
    "java_partition_sizes": """SELECT "partition_key", "n_files"::BIGINT AS "n_files", "n_newlines"::BIGINT AS "n_newlines" FROM (VALUES
  ('alpha', 1, 23),
  ('beta', 1, 26)
) AS t("partition_key", "n_files", "n_newlines")""",
    "java_units": """SELECT "file", "package", "class", "signature", "from_line"::BIGINT AS "from_line", "from_col"::BIGINT AS "from_col", "to_line"::BIGINT AS "to_line", "to_col"::BIGINT AS "to_col", "n_stmts"::BIGINT AS "n_stmts", "num_tokens"::BIGINT AS "num_tokens", "cc"::BIGINT AS "cc", "n_newlines"::BIGINT AS "n_newlines" FROM (VALUES
  ('Sums.java', 'beta', 'Sums', 'beta.Sums.has( int [ ] items , int one )', 20, 5, 25, 5, 8, 44, 2, 26),
  ('Sums.java', 'beta', 'Sums', 'beta.Sums.total( int [ ] items , int most )', 6, 5, 18, 5, 17, 83, 4, 26),
  ('Totals.java', 'alpha', 'Totals', 'alpha.Totals.add( int [ ] values , int limit )', 6, 5, 18, 5, 17, 83, 4, 23),
  ('Totals.java', 'alpha', 'Totals', 'alpha.Totals.none( )', 20, 5, 22, 5, 4, 9, 0, 23)
) AS t("file", "package", "class", "signature", "from_line", "from_col", "to_line", "to_col", "n_stmts", "num_tokens", "cc", "n_newlines")""",
    "java_statements": """SELECT "signature", "pos"::BIGINT AS "pos", "kind", "text", "cc"::BIGINT AS "cc", "from_line"::BIGINT AS "from_line", "to_line"::BIGINT AS "to_line" FROM (VALUES
  ('alpha.Totals.add( int [ ] values , int limit )', 0, 'SIGNATURE', 'int add ( int [ ] values , int limit )', 0, 6, 6),
  ('alpha.Totals.add( int [ ] values , int limit )', 1, 'BLOCK', '{', 0, 6, 6),
  ('alpha.Totals.add( int [ ] values , int limit )', 2, 'STATEMENT', 'int sum = 0 ;', 0, 7, 7),
  ('alpha.Totals.add( int [ ] values , int limit )', 3, 'STATEMENT', 'int skipped = 0 ;', 0, 8, 8),
  ('alpha.Totals.add( int [ ] values , int limit )', 4, 'FOR', 'for ( int k = 0 ; k < values . length ; k ++ )', 1, 9, 9),
  ('alpha.Totals.add( int [ ] values , int limit )', 5, 'BLOCK', '{', 0, 9, 9),
  ('alpha.Totals.add( int [ ] values , int limit )', 6, 'IF', 'if ( values [ k ] > limit ) else', 3, 10, 10),
  ('alpha.Totals.add( int [ ] values , int limit )', 7, 'BLOCK', '{', 0, 10, 10),
  ('alpha.Totals.add( int [ ] values , int limit )', 8, 'STATEMENT', 'skipped = skipped + 1 ;', 0, 11, 11),
  ('alpha.Totals.add( int [ ] values , int limit )', 9, 'BLOCK', '}', 0, 12, 12),
  ('alpha.Totals.add( int [ ] values , int limit )', 10, 'BLOCK', '{', 0, 12, 12),
  ('alpha.Totals.add( int [ ] values , int limit )', 11, 'STATEMENT', 'sum = sum + values [ k ] * 2 ;', 0, 13, 13),
  ('alpha.Totals.add( int [ ] values , int limit )', 12, 'BLOCK', '}', 0, 14, 14),
  ('alpha.Totals.add( int [ ] values , int limit )', 13, 'BLOCK', '}', 0, 15, 15),
  ('alpha.Totals.add( int [ ] values , int limit )', 14, 'STATEMENT', 'seen = seen + skipped ;', 0, 16, 16),
  ('alpha.Totals.add( int [ ] values , int limit )', 15, 'RETURN', 'return sum - skipped ;', 0, 17, 17),
  ('alpha.Totals.add( int [ ] values , int limit )', 16, 'BLOCK', '}', 0, 18, 18),
  ('alpha.Totals.none( )', 0, 'SIGNATURE', 'int none ( )', 0, 20, 20),
  ('alpha.Totals.none( )', 1, 'BLOCK', '{', 0, 20, 20),
  ('alpha.Totals.none( )', 2, 'RETURN', 'return 0 ;', 0, 21, 21),
  ('alpha.Totals.none( )', 3, 'BLOCK', '}', 0, 22, 22),
  ('beta.Sums.has( int [ ] items , int one )', 0, 'SIGNATURE', 'boolean has ( int [ ] items , int one )', 0, 20, 20),
  ('beta.Sums.has( int [ ] items , int one )', 1, 'BLOCK', '{', 0, 20, 20),
  ('beta.Sums.has( int [ ] items , int one )', 2, 'WHILE', 'while ( count > 0 && one != 0 )', 1, 21, 21),
  ('beta.Sums.has( int [ ] items , int one )', 3, 'BLOCK', '{', 0, 21, 21),
  ('beta.Sums.has( int [ ] items , int one )', 4, 'STATEMENT', 'count -- ;', 0, 22, 22),
  ('beta.Sums.has( int [ ] items , int one )', 5, 'BLOCK', '}', 0, 23, 23),
  ('beta.Sums.has( int [ ] items , int one )', 6, 'RETURN', 'return items . length > 0 ? items [ 0 ] == one : false ;', 1, 24, 24),
  ('beta.Sums.has( int [ ] items , int one )', 7, 'BLOCK', '}', 0, 25, 25),
  ('beta.Sums.total( int [ ] items , int most )', 0, 'SIGNATURE', 'int total ( int [ ] items , int most )', 0, 6, 6),
  ('beta.Sums.total( int [ ] items , int most )', 1, 'BLOCK', '{', 0, 6, 6),
  ('beta.Sums.total( int [ ] items , int most )', 2, 'STATEMENT', 'int all = 0 ;', 0, 7, 7),
  ('beta.Sums.total( int [ ] items , int most )', 3, 'STATEMENT', 'int left = 0 ;', 0, 8, 8),
  ('beta.Sums.total( int [ ] items , int most )', 4, 'FOR', 'for ( int i = 0 ; i < items . length ; i ++ )', 1, 9, 9),
  ('beta.Sums.total( int [ ] items , int most )', 5, 'BLOCK', '{', 0, 9, 9),
  ('beta.Sums.total( int [ ] items , int most )', 6, 'IF', 'if ( items [ i ] > most ) else', 3, 10, 10),
  ('beta.Sums.total( int [ ] items , int most )', 7, 'BLOCK', '{', 0, 10, 10),
  ('beta.Sums.total( int [ ] items , int most )', 8, 'STATEMENT', 'left = left + 1 ;', 0, 11, 11),
  ('beta.Sums.total( int [ ] items , int most )', 9, 'BLOCK', '}', 0, 12, 12),
  ('beta.Sums.total( int [ ] items , int most )', 10, 'BLOCK', '{', 0, 12, 12),
  ('beta.Sums.total( int [ ] items , int most )', 11, 'STATEMENT', 'all = all + items [ i ] * 3 ;', 0, 13, 13),
  ('beta.Sums.total( int [ ] items , int most )', 12, 'BLOCK', '}', 0, 14, 14),
  ('beta.Sums.total( int [ ] items , int most )', 13, 'BLOCK', '}', 0, 15, 15),
  ('beta.Sums.total( int [ ] items , int most )', 14, 'STATEMENT', 'count = count + left ;', 0, 16, 16),
  ('beta.Sums.total( int [ ] items , int most )', 15, 'RETURN', 'return all - left ;', 0, 17, 17),
  ('beta.Sums.total( int [ ] items , int most )', 16, 'BLOCK', '}', 0, 18, 18)
) AS t("signature", "pos", "kind", "text", "cc", "from_line", "to_line")""",
    "java_packages": """SELECT "package" FROM (VALUES
  ('alpha'),
  ('beta')
) AS t("package")""",
    "java_classes": """SELECT "package", "class", "n_methods"::BIGINT AS "n_methods" FROM (VALUES
  ('alpha', 'Totals', 2),
  ('beta', 'Sums', 2)
) AS t("package", "class", "n_methods")""",
    "java_clone_pairs": """SELECT "one", "other", "sim"::BIGINT AS "sim", "level"::BIGINT AS "level", "weight"::BIGINT AS "weight", "clone_type"::BIGINT AS "clone_type", "last_stmt"::BIGINT AS "last_stmt" FROM (VALUES
  ('alpha.Totals.add( int [ ] values , int limit )', 'beta.Sums.total( int [ ] items , int most )', 100, 3, 100, 1, 16)
) AS t("one", "other", "sim", "level", "weight", "clone_type", "last_stmt")""",
    "java_pair_export": """SELECT "one", "other" FROM (VALUES
  ('alpha,Totals.java,6,18', 'beta,Sums.java,6,18')
) AS t("one", "other")""",
    "java_biggest": """SELECT "rank"::BIGINT AS "rank", "n_units"::BIGINT AS "n_units", "clone_cc", "class", "method", "cc"::BIGINT AS "cc" FROM (VALUES
  (0, 2, 4, 'alpha.Totals', 'add', 4),
  (0, 2, 4, 'beta.Sums', 'total', 4)
) AS t("rank", "n_units", "clone_cc", "class", "method", "cc")""",
}
