"""Thresholds of the analysis, with the defaults that reports are compared on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    stat_alpha: float = 0.01
    var_alpha: float = 0.01
    corr_alpha: float = 0.01
    consensus: float = 1.0
    shift: float = 1.0
    arl0: float = 5000.0
    missing_critical: float = 0.5
    missing_warning: float = 0.02
    tau_max: int = 3
    pc_alpha: float = 0.01
    link_alpha: float = 0.01


#: Upper bounds of the anomaly score's bands, and the score's weights.
BANDS = ((0.15, "good"), (0.35, "warning"), (0.6, "serious"), (None, "critical"))
WEIGHTS = {"mean": 0.3, "var": 0.15, "corr": 0.25, "onset": 0.3}
