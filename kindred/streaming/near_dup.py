"""Streaming extension: units that arrive in micro-batches are compared with all that came before.

State is a table of bands partitioned by band in the shared folder; each batch appends its own and joins both old and new by
(band, h).  Replayed batches overwrite their own folder, so results are exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.operators import sketch
from kindred.params import TEXT, CloneParams
from kindred.sources import text


class StreamingNearDuplicates:
    """Candidate pairs of a stream of documents(doc_id, text)."""

    def __init__(self, spark: SparkSession, folder: str, params: CloneParams = TEXT):
        self.spark, self.folder, self.params = spark, folder.rstrip("/"), params

    def batch(self, docs: DataFrame, epoch: int) -> None:
        bands = sketch.bands(text.tokens(docs), self.params).withColumn("epoch", F.lit(epoch))
        bands.write.mode("overwrite").parquet(f"{self.folder}/bands/batch={epoch}")
        new = self.spark.read.parquet(f"{self.folder}/bands/batch={epoch}")
        every = self.spark.read.parquet(f"{self.folder}/bands").where(F.col("epoch") <= epoch)
        met = new.alias("n").join(every.alias("o"), ["band", "h"]).where((F.col("n.unit_id") != F.col("o.unit_id")) & ((F.col("o.epoch") < epoch) | (F.col("o.unit_id") < F.col("n.unit_id"))))
        met.select(F.least("n.unit_id", "o.unit_id").alias("left_id"), F.greatest("n.unit_id", "o.unit_id").alias("right_id")).distinct().write.mode("overwrite").parquet(f"{self.folder}/pairs/batch={epoch}")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).start()

    def pairs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/pairs").select("left_id", "right_id")


def contamination(docs_bands: DataFrame, benchmark_bands: DataFrame) -> DataFrame:
    """Cross-table candidates: documents that share a band with a benchmark item."""
    other = benchmark_bands.select("band", "h", F.col("unit_id").alias("item_id"))
    return docs_bands.join(other, ["band", "h"]).select(F.col("unit_id").alias("doc_id"), "item_id").distinct()


