"""Parameters of the rules and of the time split."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal


@dataclass(frozen=True)
class FanParams:
    min_counterparties: int = 6
    window_hours: int = 6


@dataclass(frozen=True)
class StructuringParams:
    threshold_usd: float = 10_000
    band_pct: float = 0.30
    min_txns: int = 4
    window_hours: int = 72

    def __post_init__(self) -> None:
        if self.min_txns < 3:
            raise ValueError("min_txns must be at least 3: two payments are no structuring")

    @property
    def floor_usd(self) -> float:
        """The band's lower bound, computed in decimals."""
        return float(Decimal(str(self.threshold_usd)) * (1 - Decimal(str(self.band_pct))))


@dataclass(frozen=True)
class PassThroughParams:
    min_amount_usd: float = 5_000
    forward_ratio: float = 0.8
    window_hours: int = 1


@dataclass(frozen=True)
class CycleParams:
    min_hops: int = 3
    max_hops: int = 6
    min_amount_usd: float = 500
    window_hours: int = 168
    max_degree: int = 50
    row_budget: int | None = 200_000_000  # walks of one length in a search that stores nothing; None: no level is counted


@dataclass(frozen=True)
class BaselineParams:
    ratio: float = 3
    min_history_days: int = 2
    min_usd: float = 5_000


@dataclass(frozen=True)
class Params:
    tune_last_day: int = 7
    fan: FanParams = field(default_factory=FanParams)
    structuring: StructuringParams = field(default_factory=StructuringParams)
    pass_through: PassThroughParams = field(default_factory=PassThroughParams)
    cycles: CycleParams = field(default_factory=CycleParams)
    baseline: BaselineParams = field(default_factory=BaselineParams)
