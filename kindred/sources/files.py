"""Source trees: scans, path filters and partitions by folder."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def wanted_path(path: Column, extension: str = ".java") -> Column:
    """Files of the extension, but none named as tests or below a test folder."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return path.endswith(extension) & ~path.endswith(f"Test{extension}") & ~folder.rlike(r"/(test|tests|testData)(/|$)")


def scan(spark: SparkSession, roots: list[str], extension: str = ".java") -> DataFrame:
    """(path, folder, content, n_newlines) of the wanted files below any of the roots; name filters prune the listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{extension}").load(roots)
    content = F.decode("content", "UTF-8")
    return files.where(wanted_path(F.col("path"), extension)).select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), content.alias("content"), F.regexp_count(content, F.lit("\n")).cast("bigint").alias("n_newlines"))


def scan_partitioned(spark: SparkSession, root: str, extension: str = ".java") -> DataFrame:
    """As ``scan``, with partition_key: the immediate subfolder of the root; files of the root itself are left out."""
    at = re.escape(root.rstrip("/").removeprefix("file:").lstrip("/"))
    key = F.regexp_extract("path", rf"{at}/([^/]+)/", 1)
    return scan(spark, [root], extension).withColumn("partition_key", key).where("partition_key <> ''")


def partition_sizes(files: DataFrame) -> DataFrame:
    return files.groupBy("partition_key").agg(F.count("*").alias("n_files"), F.sum("n_newlines").alias("n_newlines")).orderBy(F.desc("n_files"), "partition_key")
