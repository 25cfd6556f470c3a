"""Alignment and hash kernels against hand-checked values and plain recurrences."""

import random
from functools import lru_cache

import numpy as np
import pytest

from kindred.functions.alignment import TokenMemo, _hopeful, _taken, align, align_many, token_similarities, token_similarity
from kindred.functions.hashing import coefficients, gram_hashes, minhash, wrap_mod
from kindred.params import CODE, CloneParams

U = [(i, tuple(range(10 * i, 10 * i + 9)), " ".join(map(str, range(10 * i, 10 * i + 9)))) for i in range(6)]
NEW = (99, tuple(range(900, 909)), "new")


@pytest.mark.parametrize(
    "x, y, sim",
    [([1, 2, 3], [1, 2, 3], 1000), ([1, 2, 3], [1, 9, 3], 611), ([1, 2, 3, 4], [1, 2, 4], 777), ([1, 2, 3, 4, 5], [1, 2, 3, 4], 833), (list(range(1, 11)), [*range(1, 10), 11], 883), ([1], [2], 0), ([], [1], 0)],
)
def test_token_similarity(x, y, sim):
    assert token_similarity(tuple(x), tuple(y)) == sim


def test_bound_rules_out_nothing_similar():
    rng, p = random.Random(1), CloneParams(min_stmt_sim=0.5)
    for _ in range(200):
        x, y = ([(0, tuple(rng.randrange(5) for _ in range(rng.randint(0, 9))), "") for _ in range(3)] for _ in range(2))
        hopeful = _hopeful(x, y, p)
        assert all(hopeful[i, j] or token_similarity(x[i][1], y[j][1], p) < 500 for i in range(3) for j in range(3))


def test_align_many_in_small_batches(monkeypatch):
    monkeypatch.setattr("kindred.functions.alignment.CELLS", 60)
    rng, p = random.Random(9), CloneParams(min_tokens=3, min_stmts=1)
    draw = lambda: [(rng.randrange(2), tuple(rng.randrange(3) for _ in range(rng.randint(0, 4))), str(rng.randrange(2))) for _ in range(rng.randint(0, 7))]
    pairs = [(draw(), draw()) for _ in range(120)]
    assert align_many(pairs, p) == [align(a, b, p) for a, b in pairs]


@pytest.mark.parametrize(
    "a, b, spans, sim, kind",
    [
        (U, U, (0, 5, 0, 5), 1000, 0),
        (U, [(k, t, x + "!") for k, t, x in U], (0, 5, 0, 5), 1000, 1),
        (U, U[:3] + [NEW] + U[3:], (0, 5, 0, 6), 888, 2),
        (U, U[:3] + U[4:], (0, 5, 0, 4), 866, 2),
        (U, U[:3] + [NEW] + U[4:], (0, 5, 0, 5), 805, 1),
        ([NEW, *U], U, (1, 6, 0, 5), 1000, 0),
    ],
)
def test_alignment(a, b, spans, sim, kind):
    got = align(a, b, CODE)
    assert ((got.a_from, got.a_to, got.b_from, got.b_to), got.sim, got.clone_type) == (spans, sim, kind)


def test_alignment_rejects_short_units():
    assert align(U[:4], U[:4], CODE) is None


def by_definition(one, two, p):
    """The best span, each cell's score and state worked out from the definition by memoised recursion from the end."""
    open_, more = p.gap_open + p.gap_extend, p.gap_extend

    @lru_cache(None)
    def fall(i, j):
        return 0 if i < 1 or j < 1 else max(score(i - 1, j) - open_, fall(i - 1, j) - more)

    @lru_cache(None)
    def drift(i, j):
        return 0 if i < 1 or j < 1 else max(score(i, j - 1) - open_, drift(i, j - 1) - more)

    @lru_cache(None)
    def gain(i, j):
        (kind, x, _), (other, y, _) = one[i - 1], two[j - 1]
        sim = alike(x, y, p) if kind == other else -1
        return sim * p.reward // 1000 if sim >= int(p.min_stmt_sim * 1000) else -p.penalty

    @lru_cache(None)
    def score(i, j):
        return 0 if i < 1 or j < 1 else max(0, fall(i, j), drift(i, j), score(i - 1, j - 1) + gain(i, j))

    @lru_cache(None)
    def state(i, j):
        """(start in one, start in two, gap seen)"""
        gaps = max(0, fall(i, j), drift(i, j))
        if score(i - 1, j - 1) + gain(i, j) > gaps and score(i - 1, j - 1) > 0:
            return state(i - 1, j - 1)
        if gaps == 0:
            return i - 1, j - 1, gain(i, j) < 0
        return (*(state(i - 1, j) if fall(i, j) == gaps else state(i, j - 1))[:2], True)

    @lru_cache(None)
    def tokens(i, j, side):
        unit, at, back = ((one, i, (i - 1, j)), (two, j, (i, j - 1)))[side]
        return len(unit[at - 1][1]) + (tokens(*back, side) if min(i, j) > 0 and min(back) > 0 and state(i, j)[side] < at - 1 else 0)

    best, held = None, (0, 0, 0)
    for i in range(1, len(one) + 1):
        for j in range(1, len(two) + 1):
            s, t, gap = state(i, j)
            now = min(i - s, j - t), min(tokens(i, j, 0), tokens(i, j, 1)), 0
            if now[0] < p.min_stmts or now[1] < p.min_tokens:
                continue
            now = (*now[:2], score(i, j) * 1000 // (p.reward * now[0]))
            if now[2] >= int(p.min_sim * 1000) and (now[2] >= held[2] or (now[0] >= held[0] and now[1] >= held[1])):
                best, held = (s, i - 1, t, j - 1, now[2], gap), now
    return best


def alike(x, y, p):
    """Global similarity, by memoised recursion over what is left of both sequences and the move that came before."""

    @lru_cache(None)
    def rest(i, j, move):
        if i == len(x) and j == len(y):
            return 0
        ways = []
        if i < len(x) and j < len(y):
            ways.append((p.reward if x[i] == y[j] else -p.penalty) + rest(i + 1, j + 1, ""))
        for name, di, dj in (("down", 1, 0), ("across", 0, 1)):
            if i + di <= len(x) and j + dj <= len(y):
                edge = min(i, j) == 0 < i + j  # a gap that opens the alignment goes on in either direction
                ways.append(rest(i + di, j + dj, name) - p.gap_extend - (0 if move == name or edge else p.gap_open))
        return max(ways)

    return max(0, rest(0, 0, "")) * 1000 // (p.reward * min(len(x), len(y))) if x and y else 0


def test_token_similarities_match_the_definition():
    rng, p = random.Random(7), CloneParams()
    draw = lambda: tuple(rng.randrange(4) for _ in range(rng.randint(0, 9)))
    pairs = [(draw(), draw()) for _ in range(400)] + [(t := draw(), t), ((), ()), ((1,) * 70, (1,) * 80)]
    assert token_similarities(pairs, p).tolist() == [alike(x, y, p) for x, y in pairs]


def test_alignment_matches_the_definition():
    rng, p = random.Random(5), CloneParams(min_tokens=4, min_stmts=2)
    for _ in range(300):
        one = [(rng.randrange(2), tuple(rng.randrange(3) for _ in range(rng.randint(1, 4))), str(rng.randrange(3))) for _ in range(rng.randint(2, 9))]
        two = [s if rng.random() < 0.7 else (rng.randrange(2), (rng.randrange(3),) * rng.randint(1, 3), "x") for s in one if rng.random() < 0.85] or one
        got, want = align(one, two, p, TokenMemo(p)), by_definition(one, two, p)
        assert (got is None) == (want is None)
        if got:
            assert (got.a_from, got.a_to, got.b_from, got.b_to, got.sim, got.clone_type == 2) == want


def test_hash_values():
    r = coefficients()
    assert r[:6].tolist() == [19392144, 94239974, 24949909, 10177971, 75006983, 87883152]
    assert (r[111], r[10239], len(r)) == (7827722, 25723159, 10240)
    for grams, value in (([1, 2, 3], 82721841), ([2, 3, 4], 21303890), ([0, 0, 0], 0), ([2416005272, 1, 2], 84125873)):
        assert gram_hashes(np.array(grams), 3).tolist() == [value]
    assert wrap_mod(r[:4] * 1000).tolist() == [17307289, 50693455, 80105125, 88036573]
    assert wrap_mod(r[:4] * 99999988).tolist() == [73412124, 3073647, 48681853, 97862187]
    assert minhash(np.array([1, 1000]), 4).tolist() == [17307289, 50693455, 24949909, 10177971]
    assert minhash(np.zeros(0, np.int64), 2).tolist() == [2**31 - 1] * 2 and not len(gram_hashes(np.array([1, 2]), 3))


def test_params():
    with pytest.raises(ValueError):
        CloneParams(min_sim=2)
    assert CODE.but(levels=2).levels == 2


def test_taken_is_the_fold_over_cells():
    rng = np.random.default_rng(3)
    for most in (3, 20):
        enough = rng.random((40, 30)) < 0.6
        statements, length, sim = (rng.integers(0, most, enough.shape) for _ in range(3))
        held = np.full((40, 3), -1, np.int64)
        held[::2] = rng.integers(0, most, (20, 3))
        want, last = held.copy(), np.full(40, -1)
        for k, j in zip(*np.nonzero(enough), strict=True):
            new = statements[k, j], length[k, j], sim[k, j]
            if (want[k, 0] <= new[0] and want[k, 1] <= new[1]) or new[2] >= want[k, 2]:
                want[k], last[k] = new, j
        found = np.full(40, -1)
        for rows, at in _taken(enough, statements, length, sim, held):
            found[rows] = at
        assert (found == last).all() and (held == want).all()


def test_minhash_wraps_and_reduces_as_whole_numbers_do():
    modulus = 99999989
    plain = lambda x: ((x + (1 << 31)) % (1 << 32) - (1 << 31)) % modulus
    edges = [0, 1, -1, modulus, -modulus, (1 << 31) - 1, -(1 << 31), 1 << 31, (1 << 62) + 7]
    assert wrap_mod(np.array(edges)).tolist() == [plain(x) for x in edges]
    shingles = [random.Random(k).randrange(modulus) for k in range(1100)]
    got = minhash(np.array(shingles), 20)
    assert got.dtype == np.int64 and got.tolist() == [min(plain(r * s) for s in shingles) for r in coefficients()[:20].tolist()]
