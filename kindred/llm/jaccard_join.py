"""N-gram Jaccard join by parity sketches: every link between word-shingle sets with Jaccard of at least a threshold.

A text is the set of its distinct shingles (64-bit hashes).  Equal sets are one vertex, known by a fingerprint of the set.

Sketches.  Hashes are dealt over blocks and XOR-folded in each; two sets whose fold of a block agrees have (but for hash
collisions) no differing shingle there.  As sets that link differ in at most d shingles (d follows from the sizes of a band),
of more than d blocks one agrees at least: the pigeonhole join on (band, block, fold) misses no link.  Blocks that are empty
say nothing and are left out, which is made up for by a few more blocks; a set with so many empty blocks that the count no
longer reaches also gives its empty blocks, so the join is exact in every case.  A second sketch of 1,024 parity bits has a
Hamming distance that is at most the symmetric difference, and drops most false candidates within buckets; a finer one, of at least
8 bits for each difference that a link allows, drops most of the others.  What is left is verified on whole sets.

Work within a bucket stays linear where copies are many: a set is compared first with the bucket's least member it meets most
often; members already in one component need no more comparison.  Only buckets that still hold several components are searched
further, in tiles of bounded size: first along a few spanning forests of nearest pairs, of each set's fullest buckets and then of
all, then all that is left between components.
So all classes are exact while pairs inside a class are not expanded.

Null, empty and blank texts have no shingle and link with nothing; texts with fewer words than a shingle are one shingle.  Rows
that repeat an id, or have none, are rows of their own; component ids are the least ids that are not null (null where a component
has none).  Further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.llm.common import discard, frugal, hash_spans, lowered, materialise, mix, shingles, table, text_chunks, word_spans
from kindred.operators.components import components

BITS = 1024
TILE = 2048
#: Spanning forests of a tile's components that are verified before all pairs between what is left.
FORESTS = 3
#: Buckets of each set, the fullest, that are searched before all are.
FULLEST = 4
#: Rows of a bucket up to which all its pairs are compared in one step.
AT_ONCE = 64
#: Keys that a task holds before it gives them out, and how many sets it must then hold of a key to lead them itself.
HELD, HOT = 1 << 19, 64
#: Ids that are broadcast to pick texts (16 bytes each); more meet the texts in a shuffle join.
BROADCAST_IDS = 1 << 20
#: Chance, at most, that a set has more empty blocks than its band provides for (it then gives those too).
SPARE = 1e-4


class Bands:
    """Size bands for a threshold of ``num`` in 100: bounds, allowed differences and blocks.  Sizes of linked sets lie in the
    same band or in neighbouring ones; group i has the pairs whose smaller set is in band i."""

    def __init__(self, num: int):
        self.num = num
        self.low, self.diff, self.blocks = [1], [], []
        self._grow(1 << 12)

    def _grow(self, size: int) -> None:
        while self.low[-1] <= size:
            least = self.low[-1]
            nxt = least * 100 // self.num + 1
            a = nxt - 1
            d = self.allowed(a, a * 100 // self.num)
            spare = 0
            while spare < 200 and (d + 1 + spare) > spare + 1 and math.exp(math.lgamma(d + 2 + spare) - math.lgamma(spare + 2) - math.lgamma(d + 1) + least * math.log1p(-(spare + 1) / (d + 1 + spare))) > SPARE:
                spare += 1
            self.low.append(nxt), self.diff.append(d), self.blocks.append(d + 1 + spare)

    def allowed(self, a: int, b: int) -> int:
        """The largest symmetric difference of linked sets of these sizes."""
        return (100 - self.num) * (a + b) // (100 + self.num)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        if len(sizes):
            self._grow(int(sizes.max()))
        return np.searchsorted(self.low, sizes, side="right") - 1


def _salt(x: np.ndarray | int) -> np.ndarray:
    return mix(np.asarray(x, np.uint64) + np.uint64(0x51ED270B))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of a chunk, and the size of each row's set."""
    low = lowered(data)
    start, end, rows = word_spans(low, offsets)
    row, value = shingles(hash_spans(low, start, end), rows, len(offsets) - 1, width)
    return row, value, np.bincount(row, minlength=len(offsets) - 1)


def fold(at: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """XOR of the values at each index."""
    out = np.zeros(size, np.uint64)
    if len(at):
        order = np.argsort(at, kind="stable")
        at, value = at[order], value[order]
        start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        out[at[start]] = np.bitwise_xor.reduceat(value, start)
    return out


def fingerprints(row: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    start = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    out = np.zeros(len(sizes), np.uint64)
    some = sizes > 0
    if some.any():
        out[some] = np.bitwise_xor.reduceat(mix(value ^ np.uint64(0xA0761D6478BD642F)), start[some])
    return mix(out + sizes.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)).view(np.int64)


def parity(row: np.ndarray, value: np.ndarray, n_rows: int) -> np.ndarray:
    bit = (mix(value ^ np.uint64(0x8EBC6AF09C88C6E3)) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(row * BITS + bit, minlength=n_rows * BITS) & 1).astype(bool).reshape(n_rows, BITS), axis=1)


def block_keys(row: np.ndarray, value: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every block a row gives, in its own group and in the one below."""
    out_row, out_key = [], []
    own = bands.of(sizes)
    for below in (0, 1):
        band = own - below
        valid = (sizes > 0) & (band >= 0)
        band = np.where(valid, band, 0)
        blocks, diff = np.array(bands.blocks)[band], np.array(bands.diff)[band]
        m = np.where(valid, blocks, 0)
        base = np.concatenate(([0], np.cumsum(m)))
        keep = valid[row]
        r, h = row[keep], mix(value[keep] ^ _salt(band)[row[keep]])
        block = ((h >> np.uint64(32)) * m[r].astype(np.uint64)) >> np.uint64(32)
        at = base[r] + block.astype(np.int64)
        filled = np.bincount(at, minlength=base[-1]) > 0
        folded = fold(at, mix(h), base[-1])
        of_row = np.repeat(np.arange(len(sizes)), m)
        number = np.arange(base[-1]) - np.repeat(base[:-1], m)
        empty = m - np.bincount(of_row[filled], minlength=len(sizes))
        give = filled | (empty >= m - diff)[of_row]
        place = mix(_salt(band)[of_row] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        with np.errstate(over="ignore"):
            out_key.append(mix(np.where(filled, folded, np.uint64(0)) ^ place)[give])
        out_row.append(of_row[give])
    return np.concatenate(out_row), np.concatenate(out_key)


def vertices(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, fp, sketch) of every row of docs(id, text)."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1)):
                row, value, sizes = shingle_sets(data, offsets, width)
                bits = parity(row, value, len(sizes))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(sizes, pa.int64()), pa.array(fingerprints(row, value, sizes)), pa.array([b.tobytes() for b in bits], pa.binary())], names=["id", "n", "fp", "sketch"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n bigint, fp bigint, sketch binary")


def _dealt(key: np.ndarray, fp: np.ndarray, hot: int) -> pa.RecordBatch:
    """(key, fp, leader, leads): leader is null but for keys that ``hot`` sets of one task share, of which the least leads the others."""
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    led, leads = np.repeat(size >= hot, size), np.zeros(len(key), bool)
    led[start], leads[start] = False, size >= hot
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp), pa.array(np.repeat(fp[start], size), mask=~led), pa.array(leads)], names=["key", "fp", "leader", "leads"])


def keyed(docs: DataFrame, width: int, num: int) -> DataFrame:
    """The blocks of every set, as ``_dealt`` gives them; a set that repeats within a task gives its blocks once."""
    hot, most = HOT, HELD

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, known = Bands(num), set()
        keys, fps, held = [], [], 0
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(1)):
                row, value, sizes = shingle_sets(data, offsets, width)
                fp = fingerprints(row, value, sizes)
                new = np.zeros(len(fp), bool)
                for k, f in enumerate(fp.tolist()):
                    if f not in known:
                        known.add(f)
                        new[k] = True
                if len(known) > 1 << 18:
                    known.clear()
                keep = new[row]
                of_row, key = block_keys(row[keep], value[keep], np.where(new, sizes, 0), bands)
                keys.append(key), fps.append(fp[of_row])
                held += len(key)
                if held > most:
                    yield _dealt(np.concatenate(keys), np.concatenate(fps), hot)
                    keys, fps, held = [], [], 0
        if held:
            yield _dealt(np.concatenate(keys), np.concatenate(fps), hot)

    return docs.mapInArrow(run, "key bigint, fp bigint, leader bigint, leads boolean")


def buckets(docs: DataFrame, width: int, num: int) -> DataFrame:
    """(key, fp, leader) of the sets that share a key with another one.  Sets that a task has led already are dealt apart from their
    key, so a hot key costs one window a few rows for each task, not one for each set."""
    rows = keyed(docs, width, num).withColumn("part", F.when(F.col("leader").isNull(), F.col("key")).otherwise(F.xxhash64("key", "fp")))
    by_part = Window.partitionBy("part")
    met = rows.withColumn("least", F.min("fp").over(by_part)).withColumn("last", F.max("fp").over(by_part))
    return met.where("leads or leader is not null or least != last").select("key", "fp", F.coalesce("leader", "least").alias("leader"))


def fine_bits(sizes: np.ndarray, bands: Bands) -> np.ndarray:
    """Bits of a set's fine sketch: a power of two of at least 8 times the differences that a link allows."""
    allowed = (100 - bands.num) * (sizes + sizes * 100 // bands.num) // (100 + bands.num)
    return 1 << np.maximum(10, np.ceil(np.log2(np.maximum(1, 8 * allowed)))).astype(np.int64)


def fine_parity(row: np.ndarray, value: np.ndarray, bits: np.ndarray) -> list[bytes]:
    """Each row's parity sketch of so many bits; one half XOR the other is the sketch of half as many."""
    base = np.concatenate(([0], np.cumsum(bits)))
    bit = (mix(value ^ np.uint64(0xC2B2AE3D27D4EB4F)) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(base[row] + bit, minlength=base[-1]) & 1).astype(bool))
    return [packed[lo // 8 : hi // 8].tobytes() for lo, hi in zip(base[:-1], base[1:], strict=True)]


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """Hamming distance of two fine sketches (as 64-bit words): at most the symmetric difference of their sets."""
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def may_link(na: int, nb: int, x: np.ndarray, y: np.ndarray, num: int) -> bool:
    return min(na, nb) * 100 >= max(na, nb) * num and apart(x, y) <= (100 - num) * (na + nb) // (100 + num)


def sets_of(docs: DataFrame, wanted: DataFrame, width: int, num: int, unique: bool) -> DataFrame:
    """(fp, n, fine, shingles) of each set in wanted(id, fp), where id names a row of docs(id, text) that has it."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                row, value, sizes = shingle_sets(data, offsets, width)
                cut = np.concatenate(([0], np.cumsum(sizes)))
                sets = pa.array([value[cut[k] : cut[k + 1]].tobytes() for k in range(len(sizes))], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(fingerprints(row, value, sizes)), pa.array(sizes, pa.int64()), pa.array(fine_parity(row, value, fine_bits(sizes, bands)), pa.binary()), sets], names=["fp", "n", "fine", "shingles"])

    ids = wanted.select(F.col("id").alias("__id")).distinct()
    made = docs.join(_small(ids), F.col("id").eqNullSafe(F.col("__id")), "left_semi").select("text").mapInArrow(run, "fp bigint, n bigint, fine binary, shingles binary")
    if unique:
        return made
    # an id that repeats may name texts that are not wanted, and the same text more than once
    return made.join(wanted.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])


def _small(ids: DataFrame) -> DataFrame:
    """Marked for broadcast if there are at most ``BROADCAST_IDS``, so that texts need not move; else as it is, for a shuffle join."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def near_enough(pairs: DataFrame, sets: DataFrame, num: int) -> DataFrame:
    """Pairs (a, b) whose sizes and fine sketches allow a link."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, xa, xb = (batch.column(k) for k in range(2, 6))
            keep = pa.array([may_link(na[k].as_py(), nb[k].as_py(), _words(xa[k]), _words(xb[k]), num) for k in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    side = lambda c: sets.select(F.col("fp").alias(c), F.col("n").alias(f"n{c}"), F.col("fine").alias(f"x{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a bigint, b bigint")


def _words(cell: pa.Scalar) -> np.ndarray:
    """A binary value as 64-bit words, without a copy."""
    return np.frombuffer(cell.as_buffer(), np.uint64)


def verified(pairs: DataFrame, sets: DataFrame, num: int) -> DataFrame:
    """Pairs (a, b) whose whole sets have 100 x intersection >= num x union."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                x, y = _words(batch.column(2)[k]), _words(batch.column(3)[k])
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= num * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    ends = _small(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct())
    needed = sets.select("fp", "shingles").join(ends, "fp", "left_semi")
    side = lambda c: needed.select(F.col("fp").alias(c), F.col("shingles").alias(f"x{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "xa", "xb").mapInArrow(run, "a bigint, b bigint")


def forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Row numbers of the edges (a, b) between ``n`` vertices that make a lightest spanning forest."""
    order = np.argsort(weight, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    label, chosen = np.arange(n), np.zeros(len(a), bool)
    while True:
        x, y = label[a], label[b]
        open_edges = np.flatnonzero(x != y)
        if not len(open_edges):
            return np.flatnonzero(chosen)
        best = np.full(n, len(order))
        np.minimum.at(best, x[open_edges], rank[open_edges])
        np.minimum.at(best, y[open_edges], rank[open_edges])
        vertex = np.flatnonzero(best < len(order))
        edge = order[best[vertex]]
        chosen[edge] = True
        parent = np.arange(n)
        parent[vertex] = np.where(x[edge] == vertex, y[edge], x[edge])
        both = (parent[parent[vertex]] == vertex) & (vertex < parent[vertex])
        parent[vertex[both]] = vertex[both]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def between_components(rows: DataFrame, num: int, nearest: bool) -> DataFrame:
    """rows(key, ti, tj, tile, fp, comp, n, sketch), a tile pair's rows together: candidate pairs across components.

    ``nearest``: only ``FORESTS`` lightest spanning forests of the graph of components, joined where they are nearest, so a few
    pairs for each component; else all pairs that sizes and sketches allow.  A task gives each pair once, in whichever of its
    buckets it comes up."""
    far = np.int64(1 << 40)
    forests = FORESTS

    def search(g: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        comp, n, tile, fp = g["comp"], g["n"], g["tile"], g["fp"]
        if (comp == comp[0]).all():
            return
        x = np.frombuffer(b"".join(g["sketch"]), np.uint64).reshape(len(n), -1)
        same = g["ti"][0] == g["tj"][0]
        if same and len(n) <= AT_ONCE:
            yield from few(comp, n, fp, x)
            return
        by_comp = lambda rows: rows[np.argsort(comp[rows], kind="stable")]
        cuts = lambda rows: np.flatnonzero(np.concatenate(([True], comp[rows][1:] != comp[rows][:-1])))
        left, right = by_comp(np.flatnonzero(tile == g["ti"][0])), by_comp(np.flatnonzero(tile == g["tj"][0]))
        if not len(left) or not len(right):
            return
        start, xr, nr, cr = cuts(right), x[right], n[right], comp[right]
        size = np.diff(np.append(start, len(right)))
        ends = np.append(cuts(left), len(left))
        joints: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            own = comp[left[lo]]
            since = np.searchsorted(cr, own, side="right") if same else 0  # within a tile, each pair of components once
            xo, no, other = xr[since:], nr[since:], cr[since:] != own
            if not other.any():
                continue
            best, which = np.full(len(right), far), np.zeros(len(right), np.int64)
            late_best, late_which = best[since:], which[since:]
            for k in range(lo, hi, 16):
                rows = left[k : min(k + 16, hi)]
                apart = np.bitwise_count(xo[None] ^ x[rows][:, None]).sum(2, dtype=np.int64)
                ok = other[None] & allowed(apart, no[None], n[rows][:, None])
                if nearest:
                    apart = np.where(ok, apart, far)
                    at = apart.argmin(0)
                    least = apart[at, np.arange(len(no))]
                    better = least < late_best
                    late_best[better], late_which[better] = least[better], rows[at[better]]
                elif ok.any():
                    i, j = np.nonzero(ok)
                    yield fp[rows[i]], fp[right[since + j]]
            if nearest and (best < far).any():
                hit = np.flatnonzero((best == np.repeat(np.minimum.reduceat(best, start), size)) & (best < far))
                hit = hit[np.unique(np.repeat(np.arange(len(start)), size)[hit], return_index=True)[1]]
                joints.append((which[hit].astype(np.int32), right[hit].astype(np.int32), best[hit].astype(np.int32)))
        if joints:
            yield from spanning(comp, fp, *(np.concatenate(part) for part in zip(*joints, strict=True)))

    def allowed(apart: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        return (apart <= (100 - num) * (na + nb) // (100 + num)) & (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * num)

    def few(comp: np.ndarray, n: np.ndarray, fp: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The search of a bucket of few rows."""
        a, b = np.nonzero(comp[:, None] < comp[None])
        apart = np.bitwise_count(x[a] ^ x[b]).sum(1, dtype=np.int64)
        ok = allowed(apart, n[a], n[b])
        if not ok.any():
            return
        a, b, apart = a[ok], b[ok], apart[ok]
        if not nearest:
            yield fp[a], fp[b]
            return
        order = np.lexsort((apart, comp[b], comp[a]))
        a, b, apart = a[order], b[order], apart[order]
        new = np.concatenate(([True], (comp[a][1:] != comp[a][:-1]) | (comp[b][1:] != comp[b][:-1])))
        yield from spanning(comp, fp, a[new], b[new], apart[new])

    def spanning(comp: np.ndarray, fp: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        vertex = np.unique(comp, return_inverse=True)[1]
        for _ in range(forests):
            kept = forest(vertex[a], vertex[b], weight, len(vertex))
            yield fp[a[kept]], fp[b[kept]]
            a, b, weight = (np.delete(part, kept) for part in (a, b, weight))
            if not len(a):
                break

    @frugal
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        given: set[tuple[int, int]] = set()
        for pdf in frames:
            if held is not None and len(held):
                pdf = pd.concat((held, pdf), ignore_index=True)
            place = pdf[["key", "ti", "tj"]].to_numpy()
            cut = np.concatenate(([0], np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1, [len(pdf)])) if len(pdf) else np.array([0])
            yield from done(pdf, cut[:-1], given)
            held = pdf.iloc[cut[-2] :] if len(pdf) else None
        if held is not None and len(held):
            yield from done(held, np.array([0, len(held)]), given)

    def done(pdf: pd.DataFrame, cut: np.ndarray, given: set[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        out = []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            for a, b in search({c: v[lo:hi] for c, v in columns.items()}):
                place = hash((int(columns["key"][lo]), int(columns["ti"][lo]), int(columns["tj"][lo])))
                for pair in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True):
                    if pair not in given:
                        given.add(pair)
                        out.append((*pair, place))
            if len(given) > 1 << 16:
                given.clear()
        if out:
            yield pd.DataFrame(out, columns=["a", "b", "place"])

    return rows.mapInPandas(run, "a bigint, b bigint, place bigint").groupBy("a", "b").agg(F.min("place").alias("place"))


def near_in_place(pairs: DataFrame, sets: DataFrame, num: int) -> DataFrame:
    """pairs(a, b, place) as ``near_enough``, but a sketch travels once to each place (a tile pair, so of bounded size) where it
    has pairs, not once for each pair."""
    ends = pairs.select("place", F.explode(F.array("a", "b")).alias("fp")).distinct()
    there = ends.join(sets.select("fp", "n", "fine"), "fp").select("place", F.col("fp").alias("a"), F.lit(None).cast("bigint").alias("b"), "n", "fine")
    rows = there.unionByName(pairs.select("place", "a", "b", F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("binary").alias("fine")))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for batch in batches:
            good: list[tuple[int, int]] = []
            for place, a, b, n, x in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if place != now:
                    now, known = place, {}
                if b is None:  # sketches come before the pairs of their place
                    known[a] = n, np.frombuffer(x, np.uint64)
                elif may_link(known[a][0], known[b][0], known[a][1], known[b][1], num):
                    good.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in good], pa.int64()), pa.array([g[1] for g in good], pa.int64())], names=["a", "b"])

    dealt = rows.repartition("place").sortWithinPartitions("place", F.col("b").asc_nulls_first())
    return dealt.select("place", "a", "b", "n", "fine").mapInArrow(run, "a bigint, b bigint")


def set_classes(docs: DataFrame, width: int, num: int) -> tuple[DataFrame, DataFrame]:
    """For docs(id, text): (id, n, fp) of every row, and (fp, comp, least) of every set, under links with 100 x intersection >=
    num x union; least is the least id of a component."""
    every = materialise(vertices(docs, width), "sets")
    some = every.where("n > 0")
    distinct = materialise(some.groupBy("fp").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "distinct-sets")
    unique = some.groupBy("id").agg(F.count("*").alias("c")).where("c > 1 or id is null").isEmpty()
    met = materialise(buckets(docs, width, num), "buckets")
    members = met.select("fp").distinct()
    wanted = materialise(distinct.join(members, "fp").select(F.col("rep").alias("id"), "fp"), "wanted")
    sets = materialise(sets_of(docs, wanted, width, num, unique), "shingles")
    often = met.where("fp != leader").groupBy("fp", "leader").agg(F.count("*").alias("c"))
    first = often.groupBy("fp").agg(F.max_by("leader", F.struct("c", "leader")).alias("leader")).select(F.least("fp", "leader").alias("a"), F.greatest("fp", "leader").alias("b")).distinct()
    labels = _linked(wanted.select("fp", F.col("fp").alias("comp")), near_enough(first, sets, num), sets, num)
    # A large family meets in as many buckets as its sets share blocks: most of it is joined in a few, so the others find little anew.
    for fullest, nearest in ((True, True), (False, True), (False, False)):
        rows = _open_buckets(met, labels)
        pairs = materialise(between_components(_tiled(_fullest(rows) if fullest else rows, distinct), num, nearest), "pairs")
        labels = _linked(labels, near_in_place(pairs, sets, num), sets, num)
        discard(pairs)
    classes = materialise(distinct.select("fp", "rep").join(labels, "fp", "left").select("fp", "rep", F.coalesce("comp", "fp").alias("comp")), "classes")
    discard(met, wanted, sets)
    least = classes.groupBy("comp").agg(F.min("rep").alias("least"))
    return every.select("id", "n", "fp"), classes.join(least, "comp").select("fp", "comp", "least")


def _linked(labels: DataFrame, near: DataFrame, sets: DataFrame, num: int) -> DataFrame:
    """labels after those of the pairs ``near`` that whole sets confirm."""
    near = materialise(near, "near")
    links = materialise(verified(near, sets, num), "links")
    out = labels if links.isEmpty() else _relabelled(labels, links)
    discard(near, links)
    return out


def jaccard_classes(docs: DataFrame, width: int, num: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles and component_id, under links with 100 x intersection >= num x union."""
    every, classes = set_classes(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), width, num)
    alone = every.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return every.where("n > 0").join(classes, "fp").select("id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id")).unionByName(alone)


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(fp, comp) after links(a, b) between sets: only their components meet, so what is settled isn't walked again."""
    of = lambda c: labels.select(F.col("fp").alias(c), F.col("comp").alias(f"{c}_comp"))
    joined = components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")))
    return materialise(labels.join(joined, F.col("comp") == F.col("vertex"), "left").select("fp", F.coalesce("component", "comp").alias("comp")), "labels")


def _open_buckets(met: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, fp, comp) of the buckets that hold more than one component; the least member is in its bucket's rows too."""
    rows = met.join(labels, "fp").select("key", "fp", "comp")
    several = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size")).where("x != y").select("key", "size")
    return rows.join(several, "key")


def _fullest(rows: DataFrame) -> DataFrame:
    """Of rows(key, fp, comp, size), each set in the ``FULLEST`` buckets only that hold most rows."""
    own = rows.groupBy("fp", "comp").agg(F.slice(F.sort_array(F.collect_set(F.struct("size", "key")), asc=False), 1, FULLEST).alias("own"))
    return own.select("fp", "comp", F.explode("own").alias("own")).select("own.key", "fp", "comp", "own.size")


def _tiled(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """Each row once for every pair of tiles that its tile is part of, pairs together and sorted."""
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    dealt = rows.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = spread.select("key", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"), "tile", "fp", "comp").join(sketches.select("fp", "n", "sketch"), "fp")
    place = ["key", "ti", "tj"]
    return placed.select(*place, "tile", "fp", "comp", "n", "sketch").repartition(*place).sortWithinPartitions(*place)


def drop_copies(docs: DataFrame, width: int, num: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, that of the least id; rows without a shingle stay.

    Of rows that share the least id one stays, and of rows without an id one where their class has no other."""
    every, classes = set_classes(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), width, num)
    found = materialise(every.where("n > 0").join(classes, "fp"), "found")
    odd = found.groupBy("id").agg(F.count("*").alias("c")).where("c > 1 or id is null").select(F.col("id").alias("__odd"))
    gone = found.where("id is not null and id != least").select(F.col("id").alias("__gone"))
    if odd.isEmpty():
        return docs.join(_small(materialise(gone, "gone")), docs[id_col] == F.col("__gone"), "left_anti")
    # ids that repeat or are null don't name a row: these rows are known by their sets again
    odd = _small(materialise(odd, "odd"))
    own = F.col(id_col).eqNullSafe(F.col("__odd"))
    plain = docs.join(odd, own, "left_anti").join(_small(materialise(gone, "gone")), F.col(id_col) == F.col("__gone"), "left_anti")
    rows = docs.join(odd, own, "left_semi").withColumn("__row", F.struct(id_col, text_col))
    known = vertices(rows.select(F.col("__row").alias("id"), F.col(text_col).alias("text")), width).select(F.col("id").alias("__row"), "n", "fp").distinct()
    marked = rows.join(known, rows["__row"].eqNullSafe(known["__row"])).drop(known["__row"]).withColumnsRenamed({"n": "__n", "fp": "__fp"})
    marked = marked.join(classes.select(F.col("fp").alias("__fp"), F.col("comp").alias("__comp"), F.col("least").alias("__least")), "__fp", "left")
    first = F.row_number().over(Window.partitionBy("__comp").orderBy(F.col(text_col)))
    kept = marked.where(f"__n > 0 and `{id_col}` <=> __least").withColumn("__first", first).where("__first = 1")
    return plain.unionByName(kept.select(*docs.columns)).unionByName(marked.where("__n = 0").select(*docs.columns))


WIDTH, NUM = 4, 85


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents under four-word shingles and Jaccard of at least 0.85."""
    found = jaccard_classes(table(spark, sf_dir, "documents"), WIDTH, NUM)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
