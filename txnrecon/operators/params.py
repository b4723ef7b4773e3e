"""Thresholds of the reconciler."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal


@dataclass(frozen=True)
class ReconcileParams:
    date_window_days: int = 5
    merchant_threshold: float = 0.85
    merchant_gray: float = 0.70
    amount_tolerance: Decimal = Decimal("0.01")
    score_epsilon: float = 0.03

    def __post_init__(self) -> None:
        if self.merchant_gray > self.merchant_threshold:
            raise ValueError("merchant_gray must not exceed merchant_threshold")
        if self.score_epsilon < 0:
            raise ValueError("score_epsilon must not be negative")
