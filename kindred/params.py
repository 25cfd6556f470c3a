"""Engine parameters and their defaults."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class CloneParams:
    """Sizes, thresholds and costs of clone search.  Costs are fixed-point thousandths, so results are exact integers."""

    min_sim: float = 0.8
    min_stmt_sim: float = 0.8
    min_tokens: int = 40
    min_stmts: int = 5
    levels: int = 4
    overlap_percent: int = 60
    min_weight: int = 0
    shingle: int = 27
    bands: int = 28
    rows: int = 4
    any_identifier: bool = True
    any_literal: bool = True
    max_stmt_tokens: int = 64
    overlap_mode: str = "reference"
    edge_mode: str = "forward"
    big_units: int = 5
    big_cc: int = 15
    gap_open: int = 1000
    gap_extend: int = 333
    reward: int = 2000
    penalty: int = 333

    def __post_init__(self):
        if not (0 <= self.min_sim <= 1 and 0 <= self.min_stmt_sim <= 1):
            raise ValueError("similarities lie between 0 and 1")
        if min(self.levels, self.shingle, self.bands, self.rows, self.max_stmt_tokens) < 1:
            raise ValueError("levels, shingle, bands, rows and max_stmt_tokens are 1 at least")
        if self.overlap_mode not in ("reference", "jaccard") or self.edge_mode not in ("forward", "either"):
            raise ValueError("overlap_mode: reference or jaccard; edge_mode: forward or either")

    def but(self, **changes) -> CloneParams:
        return replace(self, **changes)


CODE = CloneParams()
INTERACTIVE = CloneParams(min_tokens=100, min_stmts=15)
TEXT = CloneParams(min_tokens=10, min_stmts=3, shingle=5)
