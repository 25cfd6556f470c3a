"""Language-model scoring: prediction by partial matching over bytes, and a smoothed word-count baseline.

Training counts every window of ``ORDER`` + 1 bytes of every training text (lower-cased, padded before its start, closed by an
end symbol); counts of shorter contexts are sums of these.  Together they are the context trie.  A symbol not seen after its
longest known context costs an escape (method D: of 2n observations of a context, each distinct successor gives one to escapes) and is looked for after the next
shorter context, where symbols of the longer one are excluded.  As successors of a context also succeed its suffixes, the
exclusion changes only each context's denominators, and a window's score is a function of the window alone.  ``gram_scores`` is
that static form; ``adaptive_bits`` codes one text with a model that starts empty and learns as it goes.

Size: the trie is whole and stays distributed, a table of nodes at each order.  Each distinct window of the scored texts gets its
score by joins with nodes and contexts, order by order.  The most frequent windows (``HEAD_GRAMS`` at most) are looked up in
place; all others meet their scores in a shuffle join by window.  How many are looked up in place doesn't change any score.

The word baseline joins each document's words with the training counts of all words.  The ``HEAD`` most frequent words are
looked up in place (bounded); all others meet their counts in a shuffle join by word.

Null reads as the empty text, which has only the end symbol.  Without training rows every byte costs log10(257) and the
baseline has V = N = 0.  An empty table gives an empty table.  Rows are scored one by one, whatever their ids (repeated, null);
further columns need no care.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import discard, fold, frugal, lowered, materialise, table, text_chunks

ORDER = 5
#: Windows and words looked up in place; the others are joined.
HEAD_GRAMS, HEAD = 1 << 19, 1 << 16
#: Neither byte occurs in UTF-8.
START, END = 0xFE, 0xFF


def windows(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, packed window of ``order`` context bytes and one symbol) for each byte and each row's end symbol."""
    sizes = np.diff(offsets)
    step = sizes + order + 1
    at = np.concatenate(([0], np.cumsum(step)))
    padded = np.full(at[-1], START, np.uint8)
    row = np.repeat(np.arange(len(sizes)), sizes)
    padded[np.arange(len(data)) + order * (row + 1) + row] = lowered(data)
    padded[at[1:] - 1] = END
    packed = np.zeros(len(padded) - order, np.uint64)
    for k in range(order + 1):
        packed = (packed << np.uint64(8)) | padded[k : k + len(packed)]
    rows = np.repeat(np.arange(len(sizes)), sizes + 1)
    place = np.arange(len(rows)) + order * rows
    return rows, packed[place]


def _mask(order: int) -> int:
    return (1 << (8 * (order + 1))) - 1


class _Table:
    """uint64 keys to row numbers, by open addressing in arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * len(keys) // 3 + 1).bit_length())
        size = 1 << self.bits
        self.keys = np.zeros(size, np.uint64)
        self.value = np.full(size, -1, np.int32)
        left = np.arange(len(keys))
        slot = self.slot(keys)
        while len(left):
            free = self.value[slot] < 0
            first = np.unique(slot[free], return_index=True)[1]
            chosen = np.flatnonzero(free)[first]
            self.keys[slot[chosen]] = keys[left[chosen]]
            self.value[slot[chosen]] = left[chosen]
            rest = np.ones(len(left), bool)
            rest[chosen] = False
            left, slot = left[rest], (slot[rest] + 1) & (size - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row number of each key, -1 where there is none."""
        slot = self.slot(keys)
        out = self.value[slot].copy()
        wrong = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (len(self.keys) - 1)
            out[wrong] = self.value[slot[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[slot[wrong]] != keys[wrong])]
        return out


class Model(NamedTuple):
    """The training counts: nodes(gram, n) has every distinct window of ``order`` context bytes and a symbol."""

    nodes: DataFrame
    order: int


_made: dict[str, _Table] = {}


def made(keys: np.ndarray, key: str) -> _Table:
    """The lookup table of some keys, kept for one broadcast at a time in each worker."""
    if key not in _made:
        _made.clear()
        _made[key] = _Table(keys)
    return _made[key]


def adaptive_bits(text: str, order: int = ORDER) -> float:
    """Code length in bits of one text under a model that starts empty and learns each symbol after coding it."""
    trie: dict[bytes, Counter] = {}
    data = bytes([START] * order) + text.encode().lower() + bytes([END])
    bits = 0.0
    for i in range(order, len(data)):
        symbol, excluded, done = data[i], set(), False
        for k in range(order, -1, -1):
            seen = trie.get(data[i - k : i])
            if not seen:
                continue
            left = {s: c for s, c in seen.items() if s not in excluded}
            total = 2 * sum(left.values())
            if symbol in left:
                bits -= math.log2((2 * left[symbol] - 1) / total)
                done = True
                break
            if left:
                bits -= math.log2(len(left) / total)
                excluded |= left.keys()
        if not done:
            bits += math.log2(max(1, 257 - len(excluded)))
        for k in range(order + 1):
            trie.setdefault(data[i - k : i], Counter())[symbol] += 1
    return bits


def _merge(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.add.reduceat(n, start) if len(start) else n


#: A bit above every window (of order 6 at most) that marks trained rows while windows are counted.
_TRAINED = np.uint64(1 << 60)


def count_windows(docs: DataFrame, trained: Column, order: int = ORDER, text_col: str = "text") -> DataFrame:
    """(gram, n, met): each distinct window of ``docs`` with its count in the trained rows and in all rows."""

    def out(keys: list[np.ndarray], n: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.concatenate(keys), np.concatenate(n)
        gram, at = key & ~_TRAINED, (key & _TRAINED) > 0
        by = np.argsort(gram, kind="stable")
        gram, n, at = gram[by], n[by], at[by]
        start = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, np.int64)
        sums = [np.add.reduceat(x, start) if len(start) else n for x in (n * at, n)]
        return pa.RecordBatch.from_arrays([pa.array(gram[start].view(np.int64)), *map(pa.array, sums)], names=["gram", "n", "met"])

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            flags = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for first, end, data, offsets in text_chunks(batch.column(0)):
                rows, packed = windows(data, offsets, order)
                packed[flags[first:end][rows]] |= _TRAINED
                k, c = np.unique(packed, return_counts=True)
                keys.append(k), n.append(c)
                if len(keys) > 8:
                    k, c = _merge(np.concatenate(keys), np.concatenate(n))
                    keys, n = [k], [c]
                    if len(k) > 1 << 21:
                        yield out(keys, n)
                        keys, n = [k[:0]], [c[:0]]
        yield out(keys, n)

    rows = docs.select(F.col(text_col).alias("text"), F.coalesce(trained, F.lit(False)).alias("trained"))
    counted = rows.mapInArrow(count, "gram bigint, n bigint, met bigint").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("met").alias("met"))
    return materialise(counted, "ppm-windows")


def train(docs: DataFrame, order: int = ORDER, text_col: str = "text") -> Model:
    """Count windows over all of ``docs``: the lowest level of the context trie, from which the others follow."""
    return Model(count_windows(docs, F.lit(True), order, text_col).select("gram", "n"), order)


def _suffix(gram: str, k: int) -> Column:
    """The node (of k context bytes) that a longer window ends in."""
    return F.col(gram).bitwiseAND(F.lit(_mask(k)))


def _context(gram: str, k: int) -> Column:
    """The k context bytes that come before a window's symbol."""
    return F.shiftrightunsigned(_suffix(gram, k), 8)


def gram_scores(grams: DataFrame, model: Model) -> DataFrame:
    """grams(gram, met) with score: the log10 probability of each window's symbol after its context."""
    nodes = {model.order: model.nodes}
    for k in range(model.order - 1, -1, -1):
        nodes[k] = materialise(nodes[k + 1].groupBy(_suffix("gram", k).alias("gram")).agg(F.sum("n").alias("n")), f"ppm-nodes-{k}")
    few = lambda df, k: F.broadcast(df) if k < 2 else df  # noqa: E731  at most 256 ** (k + 1) rows

    def contexts(k: int) -> DataFrame:
        """(context, total, size, taken): taken is the count of its successors after the context one shorter."""
        own = nodes[k].select("gram", "n", _context("gram", k).alias("context"))
        if not k:
            own = own.withColumn("m", F.lit(0))
        else:
            own = own.withColumn("gram", _suffix("gram", k - 1)).join(few(nodes[k - 1].withColumnRenamed("n", "m"), k - 1), "gram")
        return own.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("size"), F.sum("m").cast("bigint").alias("taken"))

    state = grams.select("gram", "met", F.lit(0.0).alias("score"), F.lit(False).alias("done"), F.lit(0).cast("bigint").alias("taken_before"), F.lit(0).cast("bigint").alias("size_before"))
    ended = []
    for k in range(model.order, -1, -1):
        here = state.withColumn("node", _suffix("gram", k)).withColumn("context", _context("gram", k))
        here = here.join(few(nodes[k].select(F.col("gram").alias("node"), "n"), k), "node", "left").join(few(contexts(k), k - 1), "context", "left")
        left, kinds = F.col("total") - F.col("taken_before"), F.col("size") - F.col("size_before")
        step = F.when(F.col("n").isNotNull(), F.log10((2 * F.col("n") - 1) / (2 * left))).when(kinds > 0, F.log10(kinds / (2 * left))).otherwise(0.0)
        after = here.select("gram", "met", (F.col("score") + step).alias("score"), F.col("n").isNotNull().alias("done"), F.coalesce("taken", F.lit(0)).alias("taken_before"), F.coalesce("size", F.lit(0)).alias("size_before"))
        after = materialise(after, f"ppm-order-{k}")
        ended.append(after.where("done"))
        state = after.where("not done")
    # below order 0: all 257 symbols (bytes and end) not seen at all, alike
    ended.append(state.withColumn("score", F.col("score") - F.log10(F.greatest(257 - F.col("size_before"), F.lit(1)))))
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    discard(*(nodes[k] for k in range(model.order)))
    return out.select("gram", "met", "score")


#: Steps in which an octave of counts is refined; up to 2 * STEPS each count is a step of its own.
STEPS = 1 << 12


def _least(scores: DataFrame, capacity: int) -> int:
    """The count from which on windows are looked up in place: the smallest (to a step) under which ``capacity`` holds them."""
    octaves = {r["o"]: r["c"] for r in scores.groupBy(F.floor(F.log2(F.col("met"))).alias("o")).agg(F.count("*").alias("c")).collect()}
    kept = 0
    for o in sorted(octaves, reverse=True):
        if kept + octaves[o] > capacity:
            first, width = 1 << o, max(1, (1 << o) // STEPS)
            inside = scores.where((F.col("met") >= first) & (F.col("met") < 2 * first)).groupBy(F.floor((F.col("met") - first) / width).alias("s")).agg(F.count("*").alias("c"))
            least = 2 * first
            for r in sorted(inside.collect(), key=lambda r: -r["s"]):
                kept += r["c"]
                if kept > capacity:
                    break
                least = first + r["s"] * width
            return least
        kept += octaves[o]
    return 1


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over every row; the end of each text counts as the token with a null word."""

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        ends = 0
        for batch in batches:
            ends += batch.num_rows
            for text in batch.column(0).to_pylist():
                if text:
                    total.update(text.encode().lower().split())
            if len(total) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], names=["word", "n"])
                total = Counter()
        yield pa.RecordBatch.from_arrays([pa.array([*total.keys(), None], pa.binary()), pa.array([*total.values(), ends], pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word binary, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def _parts(docs: DataFrame, order: int, scores: DataFrame, counts: DataFrame, ends: int) -> tuple[DataFrame, Column]:
    """What one pass over docs(id, text) finds, and which windows it looked up: for every row its own sums over frequent windows
    and words (``own``), then a row for each of its other distinct windows (gram) and words (word) with their number.

    ``row`` tells rows apart, whatever their ids."""
    least = _least(scores, HEAD_GRAMS)
    top = scores.where(F.col("met") >= least).select("gram", "score").toArrow()
    words = counts.where("word is not null").orderBy(F.desc("n"), "word").limit(HEAD).toPandas()
    held = docs.sparkSession.sparkContext.broadcast((top["gram"].to_numpy().astype(np.int64).view(np.uint64), top["score"].to_numpy().astype(np.float64), {bytes(w): math.log10(n + 1) for w, n in zip(words["word"], words["n"].tolist(), strict=True)}))
    del top, words
    key, end_log, end_known = uuid.uuid4().hex, math.log10(ends + 1), int(ends > 0)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = made(held.value[0], key)
        value, log = held.value[1:]
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1)):
                m = end - first
                rows, packed = windows(data, offsets, order)
                at = known.find(packed)
                hit = at >= 0
                ppm = np.bincount(rows[hit], value[at[hit]], m)
                rows, packed = rows[~hit], packed[~hit]
                by = np.lexsort((packed, rows))
                rows, packed = rows[by], packed[by]
                start = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (packed[1:] != packed[:-1])))) if len(rows) else np.zeros(0, np.int64)
                base, seen, tokens = np.full(m, end_log), np.full(m, end_known), np.ones(m, np.int64)
                word, n, of = [], [], []
                for k, text in enumerate(batch.column(1).slice(first, m).to_pylist()):
                    for w, c in Counter((text or "").encode().lower().split()).items():
                        tokens[k] += c
                        if (x := log.get(w)) is None:
                            word.append(w), n.append(c), of.append(k)
                        else:
                            base[k] += c * x
                            seen[k] += c
                g, w = len(start), len(word)
                row = np.concatenate((np.arange(m), rows[start], np.array(of, np.int64)))
                own = np.arange(m + g + w) < m
                of_own = lambda x, kind: pa.array(np.concatenate((x, np.zeros(g + w))), kind, mask=~own, safe=False)  # noqa: E731, B023
                ids = pa.concat_arrays([batch.column(0).slice(first, m), pa.nulls(g + w, batch.column(0).type)])
                grams = pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(packed[start].view(np.int64)), pa.nulls(w, pa.int64())])
                count = np.concatenate((np.zeros(m), np.diff(np.append(start, len(rows))), n)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(row + number), pa.array(own), ids, grams, pa.array([None] * (m + g) + word, pa.binary()), pa.array(count), of_own(ppm, pa.float64()), of_own(base, pa.float64()), of_own(seen, pa.int64()), of_own(tokens, pa.int64())], names=["row", "own", "id", "gram", "word", "n", "ppm", "base", "known", "tokens"])
                number += m

    kind = docs.schema["id"].dataType.simpleString()
    parts = docs.mapInArrow(run, f"row bigint, own boolean, id {kind}, gram bigint, word binary, n bigint, ppm double, base double, known bigint, tokens bigint")
    return materialise(parts, "lm-parts"), F.col("met") < least


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", grams: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, n_known, train_tokens, base_score and score.

    grams(gram, met) are the distinct windows of ``docs``, if they have been counted already."""
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0)).alias("ends")).first()
    if grams is None:
        grams = count_windows(docs, F.lit(False), model.order, text_col)
    scores = gram_scores(grams.select("gram", "met"), model)
    parts, joined = _parts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model.order, scores, counts, totals["ends"])
    own = parts.where("own").select("row", "id", "ppm", "base", "known", "tokens")
    none, nothing, zero = F.lit(None).cast(docs.schema[id_col].dataType), F.lit(0).cast("bigint"), F.lit(0.0)
    of_grams = parts.where("gram is not null").select("row", "gram", "n").join(scores.where(joined).select("gram", F.col("score").alias("each")), "gram")
    of_words = parts.where("word is not null").select("row", "word", "n").join(counts.where("word is not null").select("word", F.col("n").alias("seen")), "word")
    every = own.unionByName(of_grams.select("row", none.alias("id"), (F.col("n") * F.col("each")).alias("ppm"), zero.alias("base"), nothing.alias("known"), nothing.alias("tokens")))
    every = every.unionByName(of_words.select("row", none.alias("id"), zero.alias("ppm"), (F.col("n") * F.log10(F.col("seen") + 1)).alias("base"), F.col("n").alias("known"), nothing.alias("tokens")))
    summed = every.groupBy("row").agg(F.first("id", ignorenulls=True).alias("id"), F.sum("tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("log_sum"), F.sum("ppm").alias("score"))
    total = totals["n"] + totals["v"] + 1
    return summed.select("id", "n_tokens", "n_known", F.lit(totals["n"]).cast("bigint").alias("train_tokens"), (F.col("log_sum") - F.col("n_tokens") * F.lit(math.log10(total))).alias("base_score"), "score")


FOLDS, HELD_OUT = 7, 2


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text of documents with models of the folds that are not held out."""
    docs = table(spark, sf_dir, "documents")
    trained = fold(F.col("doc_id"), FOLDS) != HELD_OUT
    counts = materialise(word_counts(docs.where(trained)), "word-counts")
    grams = count_windows(docs, trained)
    found = score(docs, Model(grams.where("n > 0").select("gram", "n"), ORDER), counts, grams=grams)
    return found.select(F.col("id").alias("doc_id"), (fold(F.col("id"), FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
