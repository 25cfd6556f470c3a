"""Language identification as mixture inference.

Training counts byte 4-grams of letters by language over every labelled row of the training folds (pre-aggregated by task,
then by key; at most languages x 65,536 numbers reach the driver).  A document is a mixture: expectation-maximisation over
its n-grams estimates the proportion of each language, and the set of languages is the one with the best likelihood less a
penalty for each language, of the sets of its largest shares (two languages, three, ... above a least share) and the best single
language.  Texts without a whole window are read with blanks around them.

Null texts and texts without a letter are ``und`` with score 0, as is everything when nothing was learned.  Labels that are
null teach nothing.  Ties go to the language first in alphabetical order.  An empty table gives an empty table; repeated rows and
further columns need no care.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import fold, frugal, table, text_chunks

BUCKETS = 1 << 16
GRAM = 4
SMOOTHING = 0.05
ROUNDS = 12
#: A language needs this share to stay in a mixture, and each language of a set costs this many times ln(n-grams).
LEAST_SHARE, PENALTY = 0.08, 4.0
#: The model has languages x BUCKETS numbers; more languages than this are refused, not broadcast.
MOST_LANGUAGES = 512

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every 4-byte window that holds a letter in its middle; windows don't cross rows."""
    n = len(data)
    if n < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    low = _FOLD[data]
    if (data >= 128).any():  # capital letters of the Latin-1 block: the second byte is 32 less
        second = np.zeros(n, bool)
        second[1:] = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low = np.where(second, low + 32, low).astype(np.uint8)
    wide = low.astype(np.uint32)
    packed = (wide[:-3] << np.uint32(24)) | (wide[1:-2] << np.uint32(16)) | (wide[2:-1] << np.uint32(8)) | wide[3:]
    keep = (low[1:-2] != 32) | (low[2:-1] != 32)
    crosses = np.zeros(n + 1, bool)
    for back in range(1, GRAM):
        inner = offsets[1:-1] - back
        crosses[inner[inner >= 0]] = True
    keep &= ~crosses[: n - 3]
    at = np.flatnonzero(keep)
    with np.errstate(over="ignore"):
        bucket = (packed[at] * np.uint32(2654435761)) >> np.uint32(16)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(at, offsets)))
    return rows, bucket


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and the log-probability of each bucket under each; counts cover every row of ``docs``."""

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for first, end, data, offsets in text_chunks(batch.column(0)):
                rows, bucket = grams(data, offsets)
                names, code = np.unique(langs[first:end].astype(str), return_inverse=True)
                counts = np.bincount(code[rows] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for k, name in enumerate(names.tolist()):
                    totals[name] = totals.get(name, 0) + counts[k]
        for name, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    summed = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = summed.toPandas()
    names = sorted(got["lang"].unique().tolist())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"{len(names)} languages; the broadcast model is meant for {MOST_LANGUAGES} at most")
    counts = np.zeros((len(names), BUCKETS))
    counts[np.searchsorted(names, got["lang"].to_numpy()) if names else [], got["bucket"].to_numpy()] = got["n"].to_numpy()
    return names, np.log((counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS)).astype(np.float32)


def mixture(model: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x languages) proportions, zero outside the chosen set; and whether the row had an n-gram at all."""
    n_rows, n_langs = len(offsets) - 1, len(model)
    out = np.zeros((n_rows, n_langs))
    rows, bucket = grams(data, offsets)
    if not len(rows):
        return out, np.zeros(n_rows, bool)
    key = np.sort((rows.astype(np.uint64) << np.uint64(16)) | bucket) if n_rows >= 1 << 16 else np.sort((rows.astype(np.uint32) << np.uint32(16)) | bucket.astype(np.uint32))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n = np.diff(np.append(first, len(key))).astype(np.float32)
    key = key[first]
    row, bucket = (key >> 16).astype(np.int64), (key & 0xFFFF).astype(np.int64)
    has = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    which = row[has]
    span = np.diff(np.append(has, len(row)))
    logs = model[:, bucket]
    alone = np.add.reduceat(logs * n, has, axis=1)
    total = np.add.reduceat(n, has)
    top = logs.max(0)
    p = np.exp(logs - top)
    share = np.full((n_langs, len(has)), 1 / n_langs, np.float32)
    for _ in range(ROUNDS):
        joint = p * np.repeat(share, span, axis=1)
        joint *= n / joint.sum(0)
        new = np.add.reduceat(joint, has, axis=1) / total
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    out[which] = _chosen(share, alone, p, top, n, total, has, span).T
    seen = np.zeros(n_rows, bool)
    seen[which] = True
    return out, seen


def _chosen(share: np.ndarray, alone: np.ndarray, p: np.ndarray, top: np.ndarray, n: np.ndarray, total: np.ndarray, has: np.ndarray, span: np.ndarray) -> np.ndarray:
    """(languages x rows): the shares of the best set of each row, of the sets that hold its largest shares (each of
    ``LEAST_SHARE`` at least) and the best language alone, by likelihood less the penalty of its size; ties to the smaller set."""
    cost = PENALTY * np.log(total + 1)
    single = alone.argmax(0)
    at = np.arange(len(has))
    out = np.zeros_like(share)
    out[single, at] = share[single, at]
    best = alone.max(0) - cost
    rank = np.argsort(np.argsort(-share, axis=0, kind="stable"), axis=0)
    most = (share >= LEAST_SHARE).sum(0)
    for size in range(2, int(most.max(initial=0)) + 1):
        rows = np.flatnonzero(most >= size)
        kept = np.where(rank[:, rows] < size, share[:, rows], 0)
        kept /= kept.sum(0)
        inside = np.repeat(most >= size, span)
        ends = np.concatenate(([0], np.cumsum(span[rows])))[:-1]
        mixed = np.add.reduceat(n[inside] * (top[inside] + np.log(np.maximum((p[:, inside] * np.repeat(kept, span[rows], axis=1)).sum(0), 1e-30))), ends)
        better = mixed - cost[rows] * size > best[rows]
        best[rows[better]] = (mixed - cost[rows] * size)[better]
        out[:, rows[better]] = kept[:, better]
    return out


def _padded(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given rows of a chunk, with two blanks around each, so that even one letter stands in a window."""
    parts = [b"  " + data[offsets[k] : offsets[k + 1]].tobytes() + b"  " for k in rows.tolist()]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in parts])))


def predictions(texts: pa.Array, names: list[str], model: np.ndarray) -> Iterator[tuple[list[str], list[float], list[list[dict]]]]:
    """(languages, scores, mixtures) of the rows of a column, in runs of rows."""
    for first, end, data, offsets in text_chunks(texts, max(1 << 16, (1 << 23) // max(4, len(names)))):
        own = texts.slice(first, end - first)
        has_letter = np.logical_or.reduceat(np.append(((data | 32) >= 97) & ((data | 32) <= 122), False), np.minimum(offsets[:-1], len(data)))
        has_letter &= np.diff(offsets) > 0
        for k in np.flatnonzero(~has_letter & (np.diff(offsets) > 0)):
            has_letter[k] = any(map(str.isalpha, own[int(k)].as_py()))
        share, seen = mixture(model, data, offsets) if names else (np.zeros((end - first, 1)), has_letter)
        if (short := np.flatnonzero(has_letter & ~seen)).size:
            share[short] = mixture(model, *_padded(data, offsets, short))[0]
        best = share.argmax(1)
        pred, score, mixes = [], [], []
        for k in range(end - first):
            if not names or not has_letter[k]:
                pred.append("und"), score.append(0.0), mixes.append([])
                continue
            order = [j for j in np.argsort(-share[k], kind="stable").tolist() if share[k, j] > 0]
            pred.append(names[best[k]])
            score.append(min(1.0, float(share[k, best[k]])))
            mixes.append([{"lang": names[j], "share": float(share[k, j])} for j in order])
        yield pred, score, mixes


def identify(docs: DataFrame, names: list[str], model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score (the share of that language in the mixture) and mix, an array of
    (lang, share) of the chosen set, largest first."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    mix_type = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for pred, score, mixes in predictions(batch.column(1), names, held.value):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(pred)), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixes, mix_type)], names=["id", "lang_pred", "score", "mix"])
                first += len(pred)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, mix array<struct<lang:string,share:double>>")


def keep_identified(docs: DataFrame, names: list[str], model: np.ndarray, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language can't be told (``und``); a null language becomes the one identified.

    The columns stay as they are; rows keep their own label where they have one.  Rows leave run by run."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns
    at, lang_at = columns.index(text_col), columns.index(lang_col) if lang_col in columns else None

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for pred, _, _ in predictions(batch.column(at), names, held.value):
                keep = pa.array([p != "und" for p in pred], pa.bool_())
                arrays = list(batch.slice(first, len(pred)).columns)
                first += len(pred)
                if lang_at is not None and arrays[lang_at].null_count:
                    arrays[lang_at] = pa.array([old if old is not None else new for old, new in zip(arrays[lang_at].to_pylist(), pred, strict=True)], arrays[lang_at].type)
                yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(keep)

    return docs.mapInArrow(run, docs.schema)


FOLDS, HELD_OUT = 5, 0


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents, learned on the folds that are not held out."""
    docs = table(spark, sf_dir, "documents")
    names, model = learn(docs.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    found = identify(docs, names, model)
    return found.select(F.col("id").alias("doc_id"), (fold(F.col("id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", F.array_join(F.transform("mix", lambda m: m["lang"]), ",").alias("languages"))
