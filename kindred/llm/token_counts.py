"""Exact BPE token counts at every prefix of a text, by dynamic programming over prefixes.

For a fixed merge list, the encoding of a prefix ends in exactly one token ``t`` such that the encoding of what stands
before ``t`` ends in a token that does not merge across into ``t``.  So count[i] = count[i - len(t)] + 1, and one pass over
the prefixes of a word gives the count of each of them.  Words recur, so the tables are kept by word; the table of a text
is made of its words' tables, each on top of the count up to it, and holds the count at every prefix.

Null reads as the empty text (0 tokens).  Prefixes are those of the text as the vocabulary normalises it (for a text that
is already in normal form: of the text itself).  Special strings inside a text count as one token each, as the library's
default has it.  Rows that repeat, tie or carry further columns need no care: the operator is row by row and its output has
only the columns it names.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, pairwise
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import frugal, table, text_chunks

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Words kept per worker in each memo (bounds memory only; results don't depend on it).
MEMO_WORDS = 400_000
#: Pairs of neighbouring tokens kept likewise.
MEMO_FITS = 1 << 20
#: In these ranges Python's NFC, lower case and white space agree with the library's, character by character.
_PLAIN = regex.compile("[\x00-\x1b\x20-\x7f¡-įĲ-ňŊ-ž]*+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> list[str]:
    """The printable stand-in for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Memo(dict):
    """Made values by key.  When half of ``MEMO_WORDS`` are held they become the old half, from which words in use come back."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        if len(self) >= MEMO_WORDS // 2:
            self.old = dict(self)
            self.clear()
        known = self.old.get(key)
        self[key] = value = self.make(key) if known is None else known
        return value


class PrefixCounter:
    """Token counts of every prefix under one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab = set(model["vocab"])
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        # what tokens begin with: 1 where it is a token within a word, 2 where it is one that ends a word (without the suffix).
        kinds: dict[str, int] = {}
        for token in self.vocab:
            ends = token.endswith(self.suffix)
            body = token[: len(token) - len(self.suffix)] if ends else token
            for k in range(1, len(body)):
                kinds.setdefault(body[:k], 0)
            kinds[body] = kinds.get(body, 0) | (2 if ends and self.suffix else 3 if ends else 1)
        #: These as a trie: by character, the kind, what may follow, and the token within a word and at its end.
        self.trie: dict[str, tuple[int, dict, str, str]] = {}
        follow = {"": self.trie}
        for body in sorted(kinds, key=len):
            if body:
                follow[body] = {}
                follow[body[:-1]][body[-1]] = kinds[body], follow[body], body, body + self.suffix
        self.library = Tokenizer.from_file(path)
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special_split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        piece = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(piece)
        #: A piece and the blanks before it: as these cover the text, their lengths add up to where pieces end.
        self.spaced = regex.compile(rf"\s*+(?:{piece})")
        #: No piece that is longer is one of the pattern's literals, so it is a run of one class and so are its prefixes.
        self.literal = max(map(len, literals[1].split("|"))) if (literals := regex.fullmatch(r"((?:'\w+\|)*)(?:\[[^\[\]]*\]\+?\|?)+", piece)) else 1 << 62
        self.chars = dict(enumerate(_byte_chars()))
        self.fits: dict[tuple[str, str], bool] = {}
        self.piece_count = _Memo(lambda piece: self.table(self.spelled(piece))[-1])
        self.piece_steps = _Memo(self._inside)
        self.spaced_steps = _Memo(self._spaced)
        self.mapped_count = _Memo(lambda word: self.table(word)[-1])

    def spelled(self, piece: str) -> str:
        """The bytes of a piece as the vocabulary writes them."""
        return piece.encode().decode("latin-1").translate(self.chars)

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE: apply the lowest-ranked merge until none applies."""
        rank, none = self.rank, len(self.rank)
        while len(symbols) > 1:
            ranks = [rank.get(x, none) for x in pairwise(symbols)]
            least = min(ranks)
            if least == none:
                break
            if ranks.count(least) == 1:
                k = ranks.index(least)
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
                continue
            best = ranks.index(least)
            pair = (symbols[best], symbols[best + 1])
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def follows(self, left: str, right: str) -> bool:
        """Whether ``right`` may stand after ``left`` in an encoding (after nothing: whether its bytes encode to just it)."""
        key = (left, right)
        if len(self.fits) >= MEMO_FITS:
            self.fits.clear()
        known = self.fits[key] = self.merged((self.symbols(left) if left else []) + self.symbols(right)) == ([left, right] if left else [right])
        return known

    def table(self, word: str) -> list[int]:
        """table[i]: tokens of the first i bytes of ``word`` standing as a word of its own (table[0] = 0)."""
        # last, counts: of each prefix that is not a word of its own, the last token and the count
        last, counts, out, open_at = [""], [0], [0], []
        trie, fits = self.trie, self.fits
        for end, char in enumerate(word, 1):
            open_at.append((end - 1, trie))
            still, found, whole = [], False, 0
            for start, node in open_at:
                step = node.get(char)
                if step is None:
                    continue
                kind, more, token, ended = step
                if more:
                    still.append((start, more))
                if kind & 1 and not found:
                    fit = fits.get((last[start], token))
                    if fit or fit is None and self.follows(last[start], token):
                        last.append(token)
                        counts.append(counts[start] + 1)
                        found = True
                if kind & 2 and not whole:
                    fit = fits.get((last[start], ended))
                    if fit or fit is None and self.follows(last[start], ended):
                        whole = counts[start] + 1
            if not whole:
                raise ValueError(f"the vocabulary can't spell {word[:end]!r}")
            out.append(whole)
            open_at = still
        return out

    def _segments(self, text: str) -> Iterator[str | None]:
        """The text between special strings; None for each of these."""
        if self.special_split is None or not any(s in text for s in self.special):
            yield text
            return
        at = 0
        for m in self.special_split.finditer(text):
            yield text[at : m.start()]
            yield None
            at = m.end()
        yield text[at:]

    def _normal(self, text: str) -> str | None:
        """The normalised text, or None where only the library's own rules will do."""
        return text.lower() if text.isascii() and "\x1c" not in text and not regex.search("[\x1c-\x1f]", text) else unicodedata.normalize("NFC", text).lower() if _PLAIN.fullmatch(text) else None

    def count(self, text: str | None) -> int:
        total = 0
        for segment in self._segments(text or ""):
            if segment is None:
                total += 1
            elif (normal := self._normal(segment)) is not None:
                total += sum(map(self.piece_count.__getitem__, self.pieces.findall(normal)))
            else:
                normal = self.library.normalizer.normalize_str(segment)
                total += sum(self.mapped_count[p] for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal))
        return total

    def _spaced(self, found: str) -> bytes | list[int]:
        """As ``_inside`` for a piece with the blanks before it, which add nothing."""
        piece = self.pieces.search(found)[0]
        own, blanks = self.piece_steps[piece], len(found) - len(piece)
        return bytes(blanks) + own if isinstance(own, bytes) else [0] * blanks + own

    def _inside(self, piece: str) -> bytes | list[int]:
        """What each character of a piece adds to the count of the prefix that it ends (less than 0 where it completes a longer
        token): signed bytes, or a list where these are too small."""
        word = self.spelled(piece)
        table, at = self.table(word), 0
        if len(piece) > self.literal:
            counts = table if len(word) == len(piece) else [table[k] for k in accumulate((len(c.encode()) for c in piece), initial=0)]
        else:
            counts = [0]
            for k, c in enumerate(piece, 1):
                at += len(c.encode())
                parts = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(piece[:k])]
                counts.append(table[at] if parts == [word[:at]] else sum(map(self.mapped_count.__getitem__, parts)))
        steps = list(map(sub, counts[1:], counts))
        try:
            return struct.pack(f"{len(steps)}b", *steps)
        except struct.error:
            return steps

    def _cut(self, before: str, special: str) -> list[int]:
        """As ``_inside`` for a special string after ``before``: a prefix that ends within it is plain text."""
        own = self.count(before)
        return np.diff([0, *(self.count(before + special[:k]) - own for k in range(1, len(special))), 1]).tolist()

    def filled(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The prefix table: the count of each prefix of 1, 2, ... characters of the normalised text, and where each piece ends."""
        ends: list[np.ndarray] = []
        steps: list[bytes | list[int]] = []
        base = at = 0
        text, last = text or "", ""
        for segment in self._segments(text):
            if segment is None:
                special = next(s for s in self.special if text.startswith(s, at))
                steps.append(self._cut(last, special)), ends.append(np.array([base + len(special)]))
                base, at, last = base + len(special), at + len(special), ""
                continue
            at += len(segment)
            normal = self._normal(segment)
            if normal is not None:
                found = self.spaced.findall(normal)
                own = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
                done = int(own[-1]) if len(own) else 0
                spans = [m.span() for m in self.pieces.finditer(normal)] if normal[done:].strip() else None  # something that is neither a blank nor a piece
            else:
                normal = self.library.normalizer.normalize_str(segment)
                spans = [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(normal)]
            if spans is None:
                steps += map(self.spaced_steps.__getitem__, found)
                last = found[-1] + normal[done:] if found else ""
            else:
                done = 0
                for lo, hi in spans:
                    steps += bytes(lo - done), self.piece_steps[normal[lo:hi]]
                    done = hi
                own = np.array([hi for _, hi in spans], np.int64)
                last = normal[spans[-1][0] :] if spans else ""
            steps.append(bytes(len(normal) - done))
            ends.append(base + own)
            base += len(normal)
        try:
            each = np.frombuffer(b"".join(steps), np.int8)
        except TypeError:
            each = np.concatenate([np.frombuffer(x, np.int8) if isinstance(x, bytes) else np.array(x, np.int64) for x in steps])
        return np.cumsum(each, dtype=np.int64), np.concatenate(ends or [np.zeros(0, np.int64)])

    def stored(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Of the prefix table: where each piece ends, the count of the prefix up to there, and the length of the normalised text."""
        counts, ends = self.filled(text)
        return ends, counts[ends - 1], len(counts)

    def prefixes(self, text: str | None) -> list[int]:
        """The count of each prefix of 0, 1, ... characters of the normalised text."""
        return [0, *self.filled(text)[0].tolist()]

    def normalised(self, text: str | None) -> str:
        """The text whose prefixes are counted: each segment in normal form, special strings as they are."""
        out, at = [], 0
        for segment in self._segments(text or ""):
            if segment is None:
                segment = next(s for s in self.special if (text or "").startswith(s, at))
                out.append(segment)
            else:
                normal = self._normal(segment)
                out.append(self.library.normalizer.normalize_str(segment) if normal is None else normal)
            at += len(segment)
        return "".join(out)

    def longest_within(self, text: str | None, budget: int) -> int:
        """Characters of the longest prefix of the normalised text with at most ``budget`` tokens, without a new encoding."""
        return within(self.filled(text)[0], budget)


def within(counts: np.ndarray, budget: int) -> int:
    """As ``longest_within``, from the prefix table."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers as their steps: a byte with the width of a step, then the steps, little-endian."""
    steps = np.diff(numbers, prepend=0)
    width = next(w for w in (1, 2, 4, 8) if not len(steps) or int(steps.max()) < 1 << (8 * w))
    return bytes([width]) + steps.astype(f"<u{width}").tobytes()


def unpacked(stored: bytes) -> np.ndarray:
    """The numbers that ``packed`` wrote."""
    return np.cumsum(np.frombuffer(stored, f"<u{stored[0]}", offset=1).astype(np.int64))


def packed_table(counts: np.ndarray) -> bytes:
    """As ``packed`` for a prefix table, whose steps may be negative."""
    steps = np.diff(counts, prepend=0)
    width = next(w for w in (1, 2, 4, 8) if not len(steps) or int(np.abs(steps).max()) < 1 << (8 * w - 1))
    return bytes([width]) + steps.astype(f"<i{width}").tobytes()


def unpacked_table(stored: bytes) -> np.ndarray:
    """The table that ``packed_table`` wrote: the count of each prefix of 1, 2, ... characters."""
    return np.cumsum(np.frombuffer(stored, f"<i{stored[0]}", offset=1), dtype=np.int64)


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_prefixes(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, within (characters of the longest prefix of at most ``limit`` tokens),
    piece_ends and piece_counts (``packed``: where each piece ends and the count of the prefix up to there), and prefix_counts
    (``packed_table``): the count of every prefix, a step for each character of the normalised text.  The other counts are entries of it.

    An empty table gives an empty table.  ``tokenizer`` is a path that every executor has (the vocabulary package's by default).
    """
    path = tokenizer or vocabulary_path()

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for first, end, _, offsets in text_chunks(batch.column(1)):
                rows: list[tuple[int, int, bytes, bytes, bytes]] = []
                for text in batch.column(1).slice(first, end - first).to_pylist():
                    counts, ends = c.filled(text)
                    rows.append((int(counts[-1]) if len(counts) else 0, within(counts, limit), packed(ends), packed(counts[ends - 1]), packed_table(counts)))
                tokens, fits, ends, counts, tables = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(np.diff(offsets)), pa.array(tokens, pa.int64()), pa.array(fits, pa.int64()), *(pa.array(x, pa.binary()) for x in (ends, counts, tables))], names=["id", "n_bytes", "n_tokens", "within", "piece_ends", "piece_counts", "prefix_counts"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, within bigint, piece_ends binary, piece_counts binary, prefix_counts binary")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text, from its stored prefix table, which comes along; ``within`` answers the truncation question."""
    out = token_prefixes(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "within", "piece_ends", "piece_counts", "prefix_counts")
