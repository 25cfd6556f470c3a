"""Quality classifier: nearest-neighbour voting among labelled documents in a latent-semantic space.

A text becomes log counts of its byte trigrams (case and punctuation kept) hashed to 4,096 buckets, then the coordinates along
the leading singular vectors of the labelled sample.  Labelled vectors are broadcast (at most ``SAMPLE`` x ``DIMENSIONS``
numbers); every document's cosine to each of them is computed exactly, in blocks, and the nearest ``NEIGHBOURS`` vote with
weights that grow with similarity.  The labelled sample is bounded by ``SAMPLE`` (the rows with the smallest hash of their
id); labels and folds are the only columns besides text and id that are read, and only for that sample.

Null and empty texts have no direction and get the sample's mean label; so does everything if all labels agree; without any
label the score is 0.5.  Labels other than 0 and 1 (null too) teach nothing; a document labelled more than once counts once, by
the mean of its labels (ties: 1).  Among neighbours that tie for the last place any may count.  Repeated rows and further columns need no care.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import fold, frugal, table, text_chunks

BUCKETS, DIMENSIONS, NEIGHBOURS, SAMPLE, SHARPNESS = 4096, 48, 25, 4096, 8.0


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows x BUCKETS) unit vectors of log trigram counts; zero for rows without a trigram."""
    n, n_rows = len(data), len(offsets) - 1
    if n < 3:
        return np.zeros((n_rows, BUCKETS), np.float32)
    wide = data.astype(np.uint32)
    packed = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    with np.errstate(over="ignore"):
        bucket = (packed * np.uint32(2654435761)) >> np.uint32(20)
    row = np.repeat(np.arange(n_rows), np.diff(offsets))
    keep = row[:-2] == row[2:]
    x = np.bincount(row[:-2][keep] * BUCKETS + bucket[keep], minlength=n_rows * BUCKETS).reshape(n_rows, BUCKETS)
    x = np.log1p(x.astype(np.float32))
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.maximum(norm, 1e-12)[:, None]


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(norm > 1e-9, norm, np.inf)[:, None]


class Voter:
    """Labelled vectors in the latent space, and how a new vector is scored."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.y = y
        self.single = len(y) == 0 or y.min() == y.max()
        if self.single:
            return
        self.centre = x.mean(0)
        around = x - self.centre
        basis = np.random.default_rng(5).standard_normal((x.shape[1], DIMENSIONS + 16)).astype(np.float32)
        for _ in range(4):  # subspace iteration: the leading right singular vectors
            basis = np.linalg.qr(around.T @ (around @ basis))[0]
        self.axes = np.ascontiguousarray(basis @ np.linalg.svd(around @ basis, full_matrices=False)[2][:DIMENSIONS].T)
        self.known = unit((x - self.centre) @ self.axes)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.single or not len(x):
            return np.full(len(x), self.prior)
        empty = ~x.any(1)
        cos = unit((x - self.centre) @ self.axes) @ self.known.T
        k = min(NEIGHBOURS, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k < cos.shape[1] else np.broadcast_to(np.arange(k), cos.shape)
        weight = np.exp(SHARPNESS * (np.take_along_axis(cos, near, 1).astype(np.float64) - 1))
        out = (weight * self.y[near]).sum(1) / weight.sum(1)
        out[empty] = self.prior
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Voter:
    """Learn from at most ``SAMPLE`` labelled rows."""
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "y").agg(F.min("text").alias("text"))  # of rows that repeat an id the least text counts

    @frugal
    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(2)):
                x = counts(data, offsets).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "y", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = texts.select("id", "y", "text").mapInArrow(featurise, f"id {kind}, y int, x binary").toPandas().sort_values("id")
    x = np.stack([np.frombuffer(b, np.float16) for b in got["x"]]).astype(np.float32) if len(got) else np.zeros((0, BUCKETS), np.float32)
    return Voter(x, got["y"].to_numpy(dtype=np.float64))


def classify(docs: DataFrame, voter: Voter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, score and predicted."""
    held = docs.sparkSession.sparkContext.broadcast(voter)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1), 1 << 21):
                score = np.concatenate([held.value.score(counts(data[offsets[k] : offsets[min(k + 512, end - first)]], offsets[k : min(k + 512, end - first) + 1] - offsets[k])) for k in range(0, end - first, 512)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int")


FOLDS, HELD_OUT = 3, 1


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text of documents, learned from labels of the folds that are not held out."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    found = classify(docs, fit(docs, labels))
    return found.select(F.col("id").alias("doc_id"), (fold(F.col("id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
