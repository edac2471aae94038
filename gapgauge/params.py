"""Constants of the analysis, as plain immutable values."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class KindParams:
    """How one kind of entity is calibrated.

    ``direction`` is +1 when a positive gap means improvement is expected and
    -1 when it means the opposite.
    """

    kind: str
    min_pa: int
    shrink_pa: int
    direction: int


# Sample gate, shrinkage constant (both in appearances), sign.
BATTER = KindParams(kind="batter", min_pa=150, shrink_pa=200, direction=1)
PITCHER = KindParams(kind="pitcher", min_pa=150, shrink_pa=250, direction=-1)


@dataclass(frozen=True)
class SignalParams:
    batter: KindParams = BATTER
    pitcher: KindParams = PITCHER
    flag_z: float = 1.5
    small_pool: int = 5  # a pool must hold more rows than this to be used

    @property
    def kinds(self) -> tuple[KindParams, ...]:
        return (self.batter, self.pitcher)

    def with_min_pa(self, batter: int | None = None, pitcher: int | None = None) -> "SignalParams":
        return replace(
            self,
            batter=replace(self.batter, min_pa=self.batter.min_pa if batter is None else batter),
            pitcher=replace(self.pitcher, min_pa=self.pitcher.min_pa if pitcher is None else pitcher),
        )


# The study's default windows, gates, replicates and seed.
@dataclass(frozen=True)
class StudyParams:
    """Out-of-sample study: window lengths in days, gates and replicates."""

    windows: tuple[int, ...] = (15, 30, 45, 60)
    min_pa: int = 40
    min_pairs: int = 20
    bootstrap: int = 1000
    permutations: int = 500
    seed: int = 20260829
    few_blocks: int = 3
    # Count pairs a Poisson(1) number of times instead of drawing rows.
    poisson: bool = False


# Source-side minimum samples of the two leaderboards.
EXPECTED_BOARD_MINIMUM = 50
CONTACT_BOARD_MINIMUM = 30

# First day of each season; other years start on 28 March.
SEASON_START = {2024: "2024-03-28", 2025: "2025-03-27", 2026: "2026-03-26"}
SEASON_START_DEFAULT = "03-28"
SEASON_LAST_DAY = "11-05"

# Lengths of the report's lists and of the trend selection.
REPORT_TOP_N = 25
REPORT_TREND_N = 10


# Appearances per frame, days looked back, points per series.
@dataclass(frozen=True)
class TrendParams:
    window: int = 50
    days: int | None = 120
    points: int = 60
    contact_minimum: int = 10

    def __post_init__(self) -> None:
        if self.window < 15:
            raise ValueError(f"window must be at least 15 appearances, got {self.window}")

    @property
    def warmup(self) -> int:
        return max(15, self.window // 3)


@dataclass(frozen=True)
class ReportParams:
    signals: SignalParams = field(default_factory=SignalParams)
    top_n: int = REPORT_TOP_N
    trend_n: int = REPORT_TREND_N
    trend: TrendParams = field(default_factory=TrendParams)
