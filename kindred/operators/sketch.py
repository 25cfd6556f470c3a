"""Shingles, MinHash signatures and band hashes, one Arrow pass per unit without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.hashing import band_hashes, gram_hashes, minhash
from kindred.params import CloneParams


def _rows(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    column = batch.column(1)
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for k in range(len(column)):
        yield flat[offsets[k] : offsets[k + 1]]


def shingles(tokens: DataFrame, k: int) -> DataFrame:
    """(unit_id, n_grams, shingles): all windows counted, and the distinct window hashes in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [gram_hashes(t, k) for t in _rows(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(g) for g in grams], pa.int64()), pa.array([int(g.sum()) for g in grams], pa.int64()), pa.array([np.unique(g) for g in grams], pa.list_(pa.int64()))], names=["unit_id", "n_grams", "gram_sum", "shingles"])

    kind = tokens.schema["unit_id"].dataType.simpleString()
    return tokens.where("tokens is not null").select("unit_id", "tokens").mapInArrow(run, f"unit_id {kind}, n_grams bigint, gram_sum bigint, shingles array<bigint>")


def signatures(tokens: DataFrame, params: CloneParams) -> DataFrame:
    """(unit_id, signature, bands); units with fewer tokens than a shingle have no bands."""
    k, b, r = params.shingle, params.bands, params.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, band = [], []
            for t in _rows(batch):
                s = minhash(np.unique(gram_hashes(t, k)), b * r)
                sig.append(s)
                band.append(band_hashes(s, b, r) if len(t) >= k else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig, pa.list_(pa.int64())), pa.array(band, pa.list_(pa.int64()))], names=["unit_id", "signature", "bands"])

    kind = tokens.schema["unit_id"].dataType.simpleString()
    return tokens.where("tokens is not null").select("unit_id", "tokens").mapInArrow(run, f"unit_id {kind}, signature array<bigint>, bands array<bigint>")


def bands(tokens: DataFrame, params: CloneParams) -> DataFrame:
    """(unit_id, band, h)."""
    return signatures(tokens, params).select("unit_id", F.posexplode("bands").alias("band", "h"))
