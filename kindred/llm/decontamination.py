"""Benchmark decontamination by template canonicalisation.

Both sides become sequences of typed tokens: words in lower case without punctuation, and placeholders for numbers (a token
with a digit), names (a capitalised word that does not begin a sentence) and units (a unit word right after a number).  Windows of
``WINDOW`` typed tokens are hashed and joined; so a question whose numbers, names or units were changed still meets its
template.  Windows are also joined without regard to case (names as plain words), for texts in capitals, and with capitalised words
that begin a sentence as names too: what leaks no item without these windows is judged again with them, with such words as
slots where they differ.  Matched windows are aligned: for each document and item the windows on one diagonal (document position less item
position) form runs, in which slots are checked for consistency: each value of the item's slots must stand for one value of the
document's, throughout the run, and the other way round.  A document leaks an item when consistent runs cover at least
``LEAST_SHARE`` of the item's windows or one run spans ``LEAST_RUN`` tokens.

The item side is broadcast (a map-side hash join: documents don't move) after a check of its rows and bytes; a benchmark beyond
``BROADCAST_ITEMS`` or ``BROADCAST_BYTES`` is dealt by hash into parts that fit, each joined in its own pass.  Items shorter than a window are one window of their own length.  Windows that consist of placeholders only say
nothing, unless an item has no others: then its full windows are matched by their own tokens, as verbatim copies.  Null or empty texts on either side match nothing; repeated items each get their own row, ids may be of any type;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kindred.llm.common import frugal, hash_spans, mix, table, text_chunks

WINDOW = 8
#: Bytes of text worked on at once: a worker's arrays are about 35 times as large.
RUN_BYTES = 1 << 18
LEAST_SHARE, LEAST_RUN = 0.5, 13
BROADCAST_ITEMS, BROADCAST_BYTES = 200_000, 1 << 26
#: Unit words that become a placeholder after a number.
UNITS = (
    "%", "percent", "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "mile", "miles", "mg", "g",
    "kg", "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "lb", "lbs", "ounce", "ounces", "ton", "tons", "ml", "l",
    "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day",
    "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros", "degree",
    "degrees", "mph", "kmh", "meter", "meters", "metre", "metres", "centimeter", "centimeters", "kilometer", "kilometers",
)
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 13, 33, 46, 63]] = True
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x6E756D0000000001, 0x6E616D0000000002, 0x756E690000000003))
#: Kinds of windows.
PLAIN, OPENED, LITERAL = range(3)
_STEP = np.random.default_rng(6).integers(1, 1 << 62, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _lower(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case of ASCII and of the Latin-1 block, and where a capital stood."""
    out = data.copy()
    capital = (data >= 65) & (data <= 90)
    out[capital] += 32
    if len(data) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][second] += 32
        capital[:-1] |= second
    return out, capital


def _spans(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.zeros(len(flags) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(flags), bool), np.zeros(len(flags), bool)
    before[1:], after[:-1] = flags[:-1], flags[1:]
    return np.flatnonzero(flags & (~before | edge[:-1])), np.flatnonzero(flags & (~after | edge[1:])) + 1


def _unit_hashes() -> np.ndarray:
    words = [u.encode() for u in UNITS if u != "%"]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    return np.sort(hash_spans(data, end - np.array([len(w) for w in words]), end))


_UNITS = _unit_hashes()


def typed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, template token, own token, is placeholder, is a capitalised word that opens a sentence) of every token of a chunk.

    A number keeps inner points and commas as part of its own value: 1,000.5 is one token."""
    if not len(data):
        z = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), z, z, np.zeros(0, bool), np.zeros(0, bool)
    low, capital = _lower(data)
    inside = _INSIDE[data]
    joint = np.zeros(len(data), bool)  # a point or comma between digits
    joint[1:-1] = ((data[1:-1] == 44) | (data[1:-1] == 46)) & _DIGIT[data[:-2]] & _DIGIT[data[2:]]
    start, end = _spans(inside | joint, offsets)
    if not len(start):
        z = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), z, z, np.zeros(0, bool), np.zeros(0, bool)
    row = np.searchsorted(offsets, start, side="right") - 1
    own = hash_spans(low, start, end)
    digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
    number = digits[end] > digits[start]
    stops = np.concatenate(([0], np.cumsum(_STOP[data])))
    last_end = np.concatenate(([0], end[:-1]))
    first = np.concatenate(([True], row[1:] != row[:-1]))
    opens = first | (stops[start] > stops[np.minimum(last_end, start)])
    name = capital[start] & ~opens & ~number
    after_number = np.concatenate(([False], number[:-1])) & ~first
    unit = after_number & ~number & np.isin(own, _UNITS)
    token = own.copy()
    token[number], token[name], token[unit] = NUMBER, NAME, UNIT
    return row, token, own, number | name | unit, capital[start] & opens & ~number & ~unit


def window_hashes(token: np.ndarray, own: np.ndarray, slot: np.ndarray, opener: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the first token, hash, kind) of each window that lies in one row: of its template, if it has a token that is no
    placeholder, and of its words with names as they are, if it has a name (``PLAIN``); of its template with openers as names
    (``OPENED``); of its own tokens, if it is a full window of placeholders only (``LITERAL``)."""
    n = len(token) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8)
    plain = np.where(token == NAME, own, token)
    renamed = np.where(opener, NAME, token)
    with np.errstate(over="ignore"):
        value = np.full(n, width, np.uint64)
        for k in range(width):
            value += token[k : k + n] * _STEP[k]
        blind = np.full(n, width, np.uint64)
        for k in range(width):
            blind += plain[k : k + n] * _STEP[k]
        opened = np.full(n, width, np.uint64)
        for k in range(width):
            opened += renamed[k : k + n] * _STEP[k]
        literal = np.full(n, width, np.uint64) ^ NUMBER
        for k in range(width):
            literal += own[k : k + n] * _STEP[k]
    slots = np.concatenate(([0], np.cumsum(slot)))
    whole = row[:n] == row[width - 1 :]
    at = np.flatnonzero(whole & (slots[width:] - slots[:n] < width))
    named = np.flatnonzero(whole & (value != blind))
    filled = np.concatenate(([0], np.cumsum(slot | opener)))
    begun = np.flatnonzero(whole & (value != opened) & (filled[width:] - filled[:n] < width))
    only = np.flatnonzero(whole & (slots[width:] - slots[:n] == width)) if width == WINDOW else np.zeros(0, np.int64)
    kind = np.repeat(np.array([PLAIN, OPENED, LITERAL], np.int8), [len(at) + len(named), len(begun), len(only)])
    return np.concatenate((at, named, begun, only)), np.concatenate((mix(value[at]), mix(blind[named]), mix(opened[begun]), mix(literal[only]))), kind


def _extend(there: dict, back: dict, pairs: list[tuple[int, int]]) -> bool:
    """Add the pairs to a one-to-one mapping if they agree with it and with one another."""
    new_there: dict = {}
    new_back: dict = {}
    for x, y in pairs:
        if there.get(x, new_there.get(x, y)) != y or back.get(y, new_back.get(y, x)) != x:
            return False
        new_there[x], new_back[y] = y, x
    there |= new_there
    back |= new_back
    return True


class Items:
    """Benchmark items as typed tokens, and an index from window hashes to places in them."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        self.tokens, self.own, self.slot, self.opener, self.width, self.windows = [], [], [], [], [], []
        hashes, item, place, opened = [], [], [], []
        for _, _, data, offsets in text_chunks(pa.array(texts, pa.string())):
            row, token, own, slot, opener = typed(data, offsets)
            cut = np.searchsorted(row, np.arange(len(offsets)))
            for k in range(len(offsets) - 1):
                t, o, s, p = (x[cut[k] : cut[k + 1]] for x in (token, own, slot, opener))
                width = min(WINDOW, len(t))
                at, h, b = window_hashes(t, o, s, p, np.zeros(len(t), np.int64), width) if width else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8))
                if (b != LITERAL).any():
                    at, h, b = at[b != LITERAL], h[b != LITERAL], b[b != LITERAL]
                self.tokens.append(t), self.own.append(o), self.slot.append(s), self.opener.append(p), self.width.append(width), self.windows.append(len(np.unique(at)))
                hashes.append(h), place.append(at), opened.append(b == OPENED), item.append(np.full(len(at), len(self.width) - 1))
        hashes = np.concatenate([np.zeros(0, np.uint64), *hashes])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.concatenate([np.zeros(0, np.int64), *item])[order]
        self.place = np.concatenate([np.zeros(0, np.int64), *place])[order]
        self.opened = np.concatenate([np.zeros(0, bool), *opened])[order]
        self.widths = sorted({w for w in self.width if w})
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into h, index into the windows) of every match."""
        maybe = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hashes, h[maybe], "left"), np.searchsorted(self.hashes, h[maybe], "right")
        count = hi - lo
        first = np.cumsum(count) - count
        return np.repeat(maybe, count), np.arange(count.sum()) - np.repeat(first - lo, count)

    def judge(self, k: int, own: np.ndarray, slot: np.ndarray, opener: np.ndarray | None, at: np.ndarray, place: np.ndarray) -> dict | None:
        """Runs of matched windows of item k in one document (its own tokens), or None if it does not leak.

        Openers are slots where they stand against another name; where ``opener`` is None they are plain words."""
        doc_slot, item_slot = (slot, self.slot[k]) if opener is None else (slot | opener, self.slot[k] | self.opener[k])
        width = self.width[k]
        covered, best, slots, swapped, where = set(), 0, 0, 0, None
        diagonal = at - place
        order = np.lexsort((place, diagonal))
        order = order[np.concatenate(([True], (np.diff(diagonal[order]) != 0) | (np.diff(place[order]) != 0)))]
        at, place, diagonal = at[order], place[order], diagonal[order]
        cut = np.concatenate(([0], np.flatnonzero((diagonal[1:] != diagonal[:-1]) | (place[1:] > place[:-1] + width)) + 1, [len(at)]))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            there: dict = {}
            back: dict = {}
            run: list[int] = []
            pieces = []
            for q in range(a, b):
                pairs = [(int(self.own[k][place[q] + j]), int(own[at[q] + j])) for j in range(width) if item_slot[place[q] + j] and doc_slot[at[q] + j] and ((self.slot[k][place[q] + j] and slot[at[q] + j]) or self.own[k][place[q] + j] != own[at[q] + j])]
                if not _extend(there, back, pairs):  # the slots contradict what came before: a new run, with slots of its own
                    pieces.append((run, there))
                    run, there, back = [], {}, {}
                    if not _extend(there, back, pairs):
                        continue
                run.append(q)
            pieces.append((run, there))
            for run, mapping in pieces:
                if not run:
                    continue
                covered |= {int(place[q]) for q in run}
                length = int(place[run[-1]] - place[run[0]]) + width
                if length > best:
                    best, slots, swapped, where = length, len(mapping), sum(x != y for x, y in mapping.items()), int(at[run[0]])
        share = len(covered) / max(1, self.windows[k])
        if share < LEAST_SHARE and best < LEAST_RUN:
            return None
        return {"item": k, "matched": len(covered), "share": share, "longest": best, "slots": slots, "swapped": swapped, "position": where}


LEAK = pa.struct([("item", pa.int64()), ("matched", pa.int64()), ("windows", pa.int64()), ("share", pa.float64()), ("longest", pa.int64()), ("slots", pa.int64()), ("swapped", pa.int64()), ("position", pa.int64())])


def leaks_of(items: Items, data: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
    """What each row of a chunk leaks."""
    out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    row, token, own, slot, opener = typed(data, offsets)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for width in items.widths:
        at, h, b = window_hashes(token, own, slot, opener, row, width)
        i, w = items.look_up(h)
        right = np.array(items.width)[items.item[w]] == width if len(w) else np.zeros(0, bool)
        found.append((at[i[right]], w[right], (b[i[right]] == OPENED) | items.opened[w[right]]))
    at, w, begun = (np.concatenate([f[k] for f in found] or [np.zeros(0, kind)]) for k, kind in enumerate((np.int64, np.int64, bool)))
    if not len(at):
        return out
    item, place, doc = items.item[w], items.place[w], row[at]
    order = np.lexsort((place, item, doc))
    at, item, place, doc, begun = at[order], item[order], place[order], doc[order], begun[order]
    cut = np.concatenate(([0], np.flatnonzero((doc[1:] != doc[:-1]) | (item[1:] != item[:-1])) + 1, [len(at)]))
    first = np.searchsorted(row, np.arange(len(offsets)))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        base = first[doc[a]]
        end = first[doc[a] + 1]
        k, o, t, plain = int(item[a]), own[base:end], slot[base:end], ~begun[a:b]
        leak = items.judge(k, o, t, None, at[a:b][plain] - base, place[a:b][plain]) if plain.any() else None
        if leak is None and not plain.all():
            leak = items.judge(k, o, t, opener[base:end], at[a:b] - base, place[a:b])
        if leak is not None:
            out[doc[a]].append(leak | {"windows": items.windows[item[a]]})
    return out


def benchmark_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Items:
    """The items, after a check that they are few and small enough to broadcast."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if n > BROADCAST_ITEMS or size > BROADCAST_BYTES:
        raise ValueError(f"{n} items of {size} bytes in one part")
    got = sorted(rows.collect(), key=lambda r: (r["id"] is None, r["id"]))
    return Items([r["id"] for r in got], [r["text"] for r in got])


def parts_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[DataFrame]:
    """The benchmark as parts that each fit a broadcast: one as a rule, more (dealt by hash of the row, so items of one id
    spread) where it is large."""
    n, size = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    parts = max(1, -(-2 * n // BROADCAST_ITEMS), -(-2 * size // BROADCAST_BYTES)) if n > BROADCAST_ITEMS or size > BROADCAST_BYTES else 1
    return [benchmark] if parts == 1 else [benchmark.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(parts)) == k) for k in range(parts)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item it leaks: id, item_id, matched and all windows of the item, share, longest run in tokens,
    slots checked, slots that hold another value than the item's, and the token position of that run."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    out = None
    for part in parts_of(benchmark, item_col, item_text):
        held = spark.sparkContext.broadcast(benchmark_items(part, item_col, item_text))

        @frugal
        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = held.value
            for batch in batches:
                for first, _, data, offsets in text_chunks(batch.column(1), RUN_BYTES):
                    found = [(first + k, leak) for k, leaks in enumerate(leaks_of(items, data, offsets)) for leak in leaks]
                    take = pa.array([k for k, _ in found], pa.int64())
                    cols = [pa.array([leak[f.name] for _, leak in found], f.type) for f in LEAK]
                    cols[0] = pa.array([items.ids[leak["item"]] for _, leak in found], item_arrow)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), *cols], names=["id", "item_id", *[f.name for f in LEAK][1:]])

        item_arrow = to_arrow_type(benchmark.schema[item_col].dataType)
        found = rows.mapInArrow(run, f"id {id_type}, item_id {item_type}, matched bigint, windows bigint, share double, longest bigint, slots bigint, swapped bigint, position bigint")
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that leak an item; the columns stay.  Rows leave run by run, so no worker holds a second batch."""
    names = docs.columns
    at = names.index(text_col)
    spark = docs.sparkSession
    out = docs
    for part in parts_of(benchmark):
        held = spark.sparkContext.broadcast(benchmark_items(part))

        @frugal
        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, end, data, offsets in text_chunks(batch.column(at), RUN_BYTES):
                    clean = [not leaks for leaks in leaks_of(held.value, data, offsets)]
                    yield batch.slice(first, end - first).filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of benchmark items, whatever their numbers, names and units."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "matched", "windows", "share", "longest", "slots", "swapped", "position")
