"""Thresholds of the signal rules. Variants of one rule are parameters, never picked silently."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    min_cases: int = 3
    prr: float = 2.0
    ror: float = 2.0
    chi2: float = 4.0
    chi2_cap: float = 1e9
    chi2_sentinel: float = 999_999.0  # from here a statistic stored by a narrower engine stands for its cap


@dataclass(frozen=True)
class QualityRules:
    min_cases: int = 5
    min_sources: int = 3
    min_serious: float = 0.01
    max_ratio: float = 1e5
    variant: str = "strict"  # or "sql": first failing rule by SQL comparisons, flag by inclusive bounds


@dataclass(frozen=True)
class Shrinkage:
    ic_alpha: float = 1.0
    ic_beta: float = 1.0
    eb_alpha: float = 0.5
    eb_beta: float = 0.5
    z: float = 1.96
