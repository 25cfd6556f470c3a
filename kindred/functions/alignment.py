"""Alignment kernels: tokens of two statements (global, affine gaps), and statements of two units (local, affine gaps).

Both work on many pairs at a time, a whole row of every pair's matrix in each step.  Down and diagonal moves of a row depend on the
row above alone.  A gap across never pays to open from another gap across, so its scores are a running maximum of the other scores,
each raised by its place.  Cells that end a gap across take the start of the last cell before it that doesn't: a forward fill.

All scores are integers in thousandths.  Ties matter and are fixed: a gap down beats a gap across beats the diagonal.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

from kindred.params import CloneParams

#: Matrix cells that are worked on at a time.
CELLS = 1 << 20

Statement = tuple[int, tuple, object]


def _batches(sizes: Sequence[tuple[int, int]]) -> Iterator[list[int]]:
    """Numbers of pairs of matrices of these sizes, alike in size and together of bounded size when padded to the largest."""
    now: list[int] = []
    rows = columns = 0
    for k in sorted(range(len(sizes)), key=lambda k: (max(sizes[k]), sizes[k])):
        wider = max(rows, sizes[k][0]), max(columns, sizes[k][1])
        if now and (len(now) + 1) * (wider[0] + 1) * (wider[1] + 1) > CELLS:
            yield now
            now, wider = [], sizes[k]
        rows, columns = wider
        now.append(k)
    if now:
        yield now


def _padded(rows: Sequence[Sequence[int]], width: int, fill: int) -> np.ndarray:
    out = np.full((len(rows), width), fill, np.int64)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def token_similarities(pairs: Sequence[tuple[tuple, tuple]], p: CloneParams = CloneParams()) -> np.ndarray:
    """Per-mille similarity of each two token sequences under global alignment; 0 where either is empty."""
    out = np.zeros(len(pairs), np.int64)
    name: dict = {}
    number = lambda t: [name.setdefault(x, len(name)) for x in t]
    for batch in _batches([(len(a), len(b)) for a, b in pairs]):
        m, n = (np.array([len(pairs[k][side]) for k in batch]) for side in (0, 1))
        if not m.max() or not n.max():
            continue
        a, b = _padded([number(pairs[k][0]) for k in batch], m.max(), -1), _padded([number(pairs[k][1]) for k in batch], n.max(), -2)
        ramp = p.gap_extend * np.arange(n.max() + 1)
        score = np.broadcast_to(-p.gap_open - ramp, (len(batch), n.max() + 1)).copy()
        score[:, 0] = 0
        down = np.broadcast_to(-p.gap_open - ramp, score.shape).copy()
        last = np.zeros(len(batch), np.int64)
        for i in range(m.max()):
            edge = -p.gap_open - p.gap_extend * (i + 1)
            down = np.maximum(score - p.gap_open, down) - p.gap_extend
            best = np.empty_like(score)
            best[:, 0] = edge
            best[:, 1:] = np.maximum(score[:, :-1] + np.where(a[:, i, None] == b, p.reward, -p.penalty), down[:, 1:])
            across = np.maximum.accumulate(best + ramp, axis=1)[:, :-1] - p.gap_open - ramp[1:]
            best[:, 1:] = np.maximum(best[:, 1:], np.maximum(across, edge - ramp[1:]))
            down[:, 0] = edge
            score = best
            ends = np.flatnonzero(m == i + 1)
            last[ends] = score[ends, n[ends]]
        some = (m > 0) & (n > 0)
        out[batch] = np.where(some, np.maximum(last, 0) * 1000 // np.maximum(1, p.reward * np.minimum(m, n)), 0)
    return out


def token_similarity(a: tuple, b: tuple, p: CloneParams = CloneParams()) -> int:
    return int(token_similarities([(tuple(a), tuple(b))], p)[0])


class TokenMemo:
    """Similarities of statement pairs, each worked out once."""

    def __init__(self, p: CloneParams, capacity: int = 200_000):
        self.p, self.capacity = p, capacity
        self.known: dict[tuple[tuple, tuple], int] = {}

    def learn(self, pairs: set[tuple[tuple, tuple]]) -> dict[tuple[tuple, tuple], int]:
        """The similarities of these pairs."""
        new = [x for x in pairs if x not in self.known]
        found = dict(zip(new, token_similarities(new, self.p).tolist(), strict=True))
        out = {x: self.known[x] if x in self.known else found[x] for x in pairs}
        if len(self.known) + len(found) > self.capacity:
            self.known.clear()
        self.known |= found if len(found) <= self.capacity else {}
        return out


def _shared(a: Sequence[tuple[int, tuple]], b: Sequence[tuple[int, tuple]]) -> np.ndarray:
    """How many tokens each two statements share, repeats counted: the k-th of a token meets the other's k-th of it."""
    name: dict = {}

    def marks(unit: Sequence[tuple[int, tuple]]) -> list[list[int]]:
        out = []
        for _, tokens, *_ in unit:
            if len(set(tokens)) == len(tokens):
                out.append([name.setdefault((t, 0), len(name)) for t in tokens])
                continue
            seen: Counter = Counter()
            own = []
            for t in tokens:
                own.append(name.setdefault((t, seen[t]), len(name)))
                seen[t] += 1
            out.append(own)
        return out

    both = [marks(a), marks(b)]
    rows = []
    for unit in both:
        x = np.zeros((len(unit), len(name)), np.float32)
        for k, own in enumerate(unit):
            x[k, own] = 1
        rows.append(x)
    return (rows[0] @ rows[1].T).astype(np.int64)


def _hopeful(a: Sequence[tuple[int, tuple]], b: Sequence[tuple[int, tuple]], p: CloneParams) -> np.ndarray:
    """Where statements are of one kind and no bound rules out that they are similar enough."""
    m, n = (np.array([len(s[1]) for s in unit]) for unit in (a, b))
    low, apart = np.minimum(m[:, None], n), np.abs(m[:, None] - n)
    shared = _shared(a, b)
    best = p.reward * shared - p.penalty * (low - shared) - np.where(apart > 0, p.gap_open + p.gap_extend * apart, 0)
    kind = [np.array([s[0] for s in unit]) for unit in (a, b)]
    return (kind[0][:, None] == kind[1]) & (low > 0) & (np.maximum(best, 0) * 1000 // np.maximum(1, p.reward * low) >= int(p.min_stmt_sim * 1000))


def _distinct(unit: Sequence[Statement]) -> tuple[list[tuple[int, tuple]], np.ndarray]:
    """The distinct (kind, tokens) of a unit, and which of them each statement is."""
    number: dict[tuple[int, tuple], int] = {}
    at = np.array([number.setdefault(s[:2], len(number)) for s in unit])
    return list(number), at


@dataclass(frozen=True)
class Alignment:
    """The best local alignment of two units: statement spans (inclusive), per-mille similarity and clone type (0, 1, 2)."""

    a_from: int
    a_to: int
    b_from: int
    b_to: int
    sim: int
    clone_type: int


def _taken(enough: np.ndarray, statements: np.ndarray, length: np.ndarray, sim: np.ndarray, held: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pairs, places) of cells that replace the best of their pair as a row is read from left to right, the last of each pair
    last; ``held`` follows.  A cell replaces it that has no fewer statements and tokens, or no smaller similarity.

    One that does so against all cells since the held one, taken or not, is sure to be taken, so those before it need no look."""
    rows = np.flatnonzero(enough.any(axis=1))
    open_cells = enough[rows]
    while len(rows):
        values = [np.where(open_cells, x[rows], -1) for x in (statements, length, sim)]
        own = [held[rows, c, None] for c in range(3)]
        most = [np.maximum.accumulate(np.concatenate((h, x[:, :-1]), axis=1), axis=1) for h, x in zip(own, values, strict=True)]
        better = lambda than: open_cells & (((values[0] >= than[0]) & (values[1] >= than[1])) | (values[2] >= than[2]))  # noqa: B023, E731
        sure = better(most)
        at = sure.shape[1] - 1 - sure[:, ::-1].argmax(axis=1)
        unsure = np.flatnonzero(~sure.any(axis=1))
        goes = np.ones(len(rows), bool)
        if len(unsure):
            first = better(own)[unsure]
            at[unsure], goes[unsure] = first.argmax(axis=1), first.any(axis=1)
        rows, at, open_cells = rows[goes], at[goes], open_cells[goes]
        held[rows] = np.stack([x[goes][np.arange(len(rows)), at] for x in values], axis=1)
        if len(rows):
            yield rows, at
        open_cells &= np.arange(enough.shape[1]) > at[:, None]
        some = open_cells.any(axis=1)
        rows, open_cells = rows[some], open_cells[some]


def _best_spans(gain: np.ndarray, size: tuple[np.ndarray, np.ndarray], tokens: tuple[np.ndarray, np.ndarray], p: CloneParams) -> list[tuple | None]:
    """The best span of each pair: (first in a, last in a, first in b, last in b, per-mille similarity, gap seen).

    gain (pairs x statements of a x statements of b) is what each two statements add on the diagonal, tokens their numbers of
    tokens; beyond a unit's size all is padding, which no cell before it looks at."""
    count, rows, width = gain.shape
    places = np.arange(width)
    ramp = p.gap_extend * (places + 1)
    before = np.cumsum(tokens[1], axis=1) - tokens[1]
    zero = np.zeros((count, width + 1), np.int64)
    score, down, own_tokens = zero, zero, zero[:, 1:]
    begin = [zero, zero]
    gap = zero > 0
    best: list[tuple | None] = [None] * count
    held = np.full((count, 3), -1, np.int64)  # statements, tokens and similarity of the best so far
    shifted = lambda x: np.concatenate((np.zeros((count, 1), x.dtype), x), axis=1)
    for i in range(rows):
        fall = np.maximum(score[:, 1:] - p.gap_open, down[:, 1:]) - p.gap_extend
        cross = score[:, :-1] + gain[:, i]
        settled = np.maximum(np.maximum(fall, cross), 0)
        drift = np.maximum.accumulate(shifted(settled + ramp), axis=1)[:, :-1] - p.gap_open - ramp
        falls = fall > 0
        drifts = drift > np.maximum(fall, 0)
        crosses = (cross > np.maximum(np.maximum(fall, drift), 0)) & (score[:, :-1] > 0)
        drifts &= ~crosses
        source = np.maximum.accumulate(np.where(drifts, 0, places), axis=1)
        start = []
        for side, fresh in enumerate((i, places)):
            at = np.where(crosses, begin[side][:, :-1], np.where(falls, begin[side][:, 1:], fresh))
            start.append(np.take_along_axis(at, source, axis=1))
        seen = np.where(crosses, gap[:, :-1], falls | drifts | (gain[:, i] < 0))
        own_tokens = tokens[0][:, i, None] + np.where(start[0] < i, own_tokens, 0)
        other_tokens = before + tokens[1] - np.maximum.accumulate(np.where(start[1] < places, 0, before), axis=1)
        top = np.maximum(settled, drift)
        statements = np.minimum(i + 1 - start[0], places + 1 - start[1])
        length = np.minimum(own_tokens, other_tokens)
        sim = top * 1000 // (p.reward * np.maximum(statements, 1))
        enough = (statements >= p.min_stmts) & (length >= p.min_tokens) & (sim >= int(p.min_sim * 1000)) & (i < size[0][:, None]) & (places < size[1][:, None])
        for k, j in _taken(enough, statements, length, sim, held):
            for pair, at in zip(k.tolist(), j.tolist(), strict=True):
                best[pair] = (int(start[0][pair, at]), i, int(start[1][pair, at]), at, int(sim[pair, at]), bool(seen[pair, at]))
        score, down, gap = shifted(top), shifted(fall), shifted(seen)
        begin = [shifted(x) for x in start]
    return best


def align_many(pairs: Sequence[tuple[Sequence[Statement], Sequence[Statement]]], p: CloneParams, memo: TokenMemo | None = None) -> list[Alignment | None]:
    """Align each two units, given as statements (kind, tokens, text).  None where no span is long and similar enough."""
    memo = memo or TokenMemo(p)
    out: list[Alignment | None] = [None] * len(pairs)
    whole = lambda unit: sum(len(s[1]) for s in unit)
    chosen = [k for k, (a, b) in enumerate(pairs) if a and b and min(whole(a), whole(b)) >= p.min_tokens]
    least = int(p.min_stmt_sim * 1000)
    for batch in _batches([(len(pairs[k][0]), len(pairs[k][1])) for k in chosen]):
        own = [pairs[chosen[k]] for k in batch]
        size = tuple(np.array([len(pair[side]) for pair in own]) for side in (0, 1))
        tokens = tuple(_padded([[len(s[1]) for s in pair[side]] for pair in own], size[side].max(), 0) for side in (0, 1))
        kinds = [(_distinct(a), _distinct(b)) for a, b in own]  # a unit may repeat a statement as often as it likes
        places = [np.argwhere(_hopeful(x, y, p)).tolist() for (x, _), (y, _) in kinds]
        known = memo.learn({(x[i][1], y[j][1]) for ((x, _), (y, _)), at in zip(kinds, places, strict=True) for i, j in at if x[i][1] != y[j][1]})
        gain = np.full((len(own), size[0].max(), size[1].max()), -p.penalty, np.int64)
        for k, ((x, of_x), (y, of_y)) in enumerate(kinds):
            each = np.full((len(x), len(y)), -p.penalty, np.int64)
            for i, j in places[k]:
                sim = 1000 if x[i][1] == y[j][1] else known[x[i][1], y[j][1]]
                if sim >= least:
                    each[i, j] = sim * p.reward // 1000
            gain[k, : len(of_x), : len(of_y)] = each[of_x[:, None], of_y]
        for k, (a, b), span in zip(batch, own, _best_spans(gain, size, tokens, p), strict=True):
            if span:
                a0, a1, b0, b1, sim, gap = span
                same = a1 - a0 == b1 - b0 and all(x[2] == y[2] for x, y in zip(a[a0 : a1 + 1], b[b0 : b1 + 1], strict=True))
                out[chosen[k]] = Alignment(a0, a1, b0, b1, sim, 2 if gap else 0 if same else 1)
    return out


def align(a: Sequence[Statement], b: Sequence[Statement], p: CloneParams, memo: TokenMemo | None = None) -> Alignment | None:
    return align_many([(a, b)], p, memo)[0]
