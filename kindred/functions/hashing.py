"""Hash functions of the sketch: a fixed coefficient table, 32-bit wrap-around sums and a prime modulus.

The table is what a 48-bit linear congruential generator gives from a fixed seed, so it is made by that rule.  Each function
has a NumPy form (the production path) and, where useful, a SQL expression of the same value.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modulus, seed and size of the coefficient table.
MODULUS, SEED, COEFFICIENTS = 99999989, 20250315, 10240


@lru_cache(maxsize=1)
def coefficients() -> np.ndarray:
    state, out = (SEED ^ 0x5DEECE66D) & ((1 << 48) - 1), []
    while len(out) < COEFFICIENTS:
        state = (state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        bits = state >> 17
        value = bits % MODULUS
        if bits - value + MODULUS - 1 < 1 << 31:  # else the last, partial run of residues: draw again
            out.append(value)
    return np.array(out, dtype=np.int64)


def _residues(w: np.ndarray) -> np.ndarray:
    """Non-negative remainders of 32-bit integers, which stay 32-bit: the product may wrap around, and the difference back."""
    with np.errstate(over="ignore"):
        return w - w // np.int32(MODULUS) * np.int32(MODULUS)


def wrap_mod(x: np.ndarray) -> np.ndarray:
    """Wrap to a signed 32-bit integer, then the non-negative remainder."""
    return _residues(x.astype(np.int64).astype(np.int32)).astype(np.int64)


def gram_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k token ids, in order (none if there are fewer)."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    r = coefficients()
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.int64)
        for i in range(k):
            total += r[i] * tokens[i : i + n]
    return wrap_mod(total)


def minhash(shingles: np.ndarray, n: int) -> np.ndarray:
    """n minima over the distinct shingles; an empty set gives the largest 32-bit integer throughout."""
    if not len(shingles):
        return np.full(n, (1 << 31) - 1, np.int64)
    # only the lower halves of the factors tell in a product's lower half
    r, own = coefficients()[:n].astype(np.int32), np.asarray(shingles).astype(np.int64).astype(np.int32)
    out = np.full(n, (1 << 31) - 1, np.int32)
    for k in range(0, len(own), 512):
        with np.errstate(over="ignore"):
            out = np.minimum(out, _residues(r[:, None] * own[None, k : k + 512]).min(1))
    return out.astype(np.int64)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return wrap_mod((signature.reshape(bands, rows) * coefficients()[:rows]).sum(1))


def token_id(token: Column) -> Column:
    """32 bits of a content hash, as a long: the same everywhere, no dictionary."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint")


# SQL forms for DuckDB
def sql_wrap_mod(x: str) -> str:
    wrapped = f"(((({x}) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)"
    return f"(({wrapped} % {MODULUS} + {MODULUS}) % {MODULUS})"


def sql_token_id(token: str) -> str:
    return f"(('0x' || substr(md5({token}), 1, 8))::BIGINT)"
