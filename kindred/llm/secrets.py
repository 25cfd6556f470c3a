"""Secret scan: Aho-Corasick keyword prefilter, anchored expressions only at hits, then checksum or structure validation.

Base kinds: assign (a credential word, a separator, 12 or more value characters), access (AKIA keys of 18 or more characters)
and hex (16 or more lower-case hexadecimal digits; a keyword-less kind, found as maximal runs of its character class).
Added kinds, all validated: github and npm tokens (base-62 CRC-32 of their own random part), jwt (its header must decode to
JSON with an algorithm) and pem (a private-key block whose body decodes).  Each kind is scanned from the left without overlap;
kinds may overlap one another.

Null and empty texts have no spans.  Offsets are in code points, end exclusive.  Spans are ordered by start, then by kind as
listed.  The operator is row by row, so repeated rows, ties, very long texts and further columns need no care; an empty table
gives an empty table.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import frugal, table, text_chunks

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "jwt", "pem")
#: Keywords (lower case) and the expression anchored at each.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "pem": ("-----begin ",),
}
_ANCHORED = {
    "assign": re.compile(rb"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "jwt": re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*"),
    "pem": re.compile(rb"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----"),
}
_HEX = np.zeros(256, dtype=bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(part: bytes) -> bytes:
    """The CRC-32 of ``part`` as six base-62 digits."""
    n, digits = zlib.crc32(part), []
    for _ in range(6):
        n, d = divmod(n, 62)
        digits.append(_BASE62[d])
    return "".join(reversed(digits)).encode()


def _decodes(part: bytes) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
    except (ValueError, binascii.Error):
        return False
    return isinstance(head, dict) and "alg" in head


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return m.end(1) - m.start(1) >= MIN_ASSIGN
    if kind == "access":
        return m.end() - m.start() >= MIN_ACCESS
    if kind in ("github", "npm"):
        return base62_crc(m[1]) == m[2]
    if kind == "jwt":
        return _decodes(m[1])
    try:
        return len(base64.b64decode(re.sub(rb"\s", b"", m[2]), validate=True)) >= 32
    except binascii.Error:
        return False


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def scan(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[str, int, int]]]:
    """Spans (kind, start, end) in code points of each row of a chunk of UTF-8 bytes."""
    n_rows = len(offsets) - 1
    raw = data.tobytes()
    found: list[tuple[int, int, int, int]] = []  # row, start, kind, end; in bytes
    hits: dict[str, list[int]] = {}
    for end, (kind, length) in _automaton().iter(raw.lower().decode("latin-1")):
        hits.setdefault(kind, []).append(end + 1 - length)
    for kind, starts in hits.items():
        starts = np.sort(np.array(starts))
        rows = np.searchsorted(offsets, starts, side="right") - 1
        past, order, expression = -1, KINDS.index(kind), _ANCHORED[kind]
        for start, row in zip(starts.tolist(), rows.tolist(), strict=True):
            if start >= past and (m := expression.match(raw, start, int(offsets[row + 1]))):
                past = m.end()
                if _valid(kind, m):
                    found.append((row, start, order, past))
    if len(data):
        inside = _HEX[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        long = end - start >= MIN_HEX
        for s, e, row in zip(start[long].tolist(), end[long].tolist(), (np.searchsorted(offsets, start[long], side="right") - 1).tolist(), strict=True):
            found.append((row, s, KINDS.index("hex"), e))
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(n_rows)]
    for row, start, order, end in sorted(found):
        base = int(offsets[row])
        lead = start - base - np.count_nonzero((data[base:start] & 0xC0) == 0x80)
        out[row].append((KINDS[order], int(lead), int(lead + end - start - np.count_nonzero((data[start:end] & 0xC0) == 0x80))))
    return out


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and spans, an array of (kind, start, end)."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1)):
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in row] for row in scan(data, offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(spans, SPANS)], names=["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def mask_text(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span (overlapping ones merged) replaced by ``[kind]``."""
    if not spans:
        return text
    parts, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def mask_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret masked in its text; all rows and columns stay, and the length column follows the text.  Rows leave
    run by run."""
    names = docs.columns
    at = names.index(text_col)
    length_at = names.index(length_col) if length_col in names else None

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(at)):
                columns = batch.slice(first, end - first).columns
                changed = {k: mask_text(columns[at][k].as_py(), spans) for k, spans in enumerate(scan(data, offsets)) if spans}
                if changed:
                    texts = columns[at].to_pylist()
                    for k, text in changed.items():
                        texts[k] = text
                    columns[at] = pa.array(texts, columns[at].type)
                    if length_at is not None:
                        lengths = columns[length_at].to_pylist()
                        for k, text in changed.items():
                            lengths[k] = len(text)
                        columns[length_at] = pa.array(lengths, columns[length_at].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(F.col("id").alias("doc_id"), *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
