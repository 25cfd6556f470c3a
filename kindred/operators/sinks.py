"""Exports and stage metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kindred.operators.rollup import biggest, export_rows, named
from kindred.params import CloneParams


def write_pairs(pairs: DataFrame, units: DataFrame, path: str) -> None:
    """One line per pair, without a header, as many files as tasks."""
    export_rows(pairs, units).write.mode("overwrite").option("header", False).csv(path)


def write_biggest(clones: DataFrame, own: DataFrame, units: DataFrame, p: CloneParams, path: str) -> None:
    """The report of large and complex clones, with a header."""
    # The report's column names.
    names = {"rank": "CloneIdx", "n_units": "#Fragments", "clone_cc": "Max CC", "class": "Class", "method": "Method", "cc": "CC"}
    named(biggest(clones, own, units, p), units).select(*names).withColumnsRenamed(names).write.mode("overwrite").option("header", True).csv(path)


def observed(df: DataFrame, stage: str) -> tuple[DataFrame, Observation]:
    """``df`` with a row counter that fills while the stage runs, at no further cost."""
    watch = Observation(stage)
    return df.observe(watch, F.count(F.lit(1)).alias("rows")), watch
