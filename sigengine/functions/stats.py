"""Column expressions of the disproportionality statistics. Counts become doubles before they are multiplied."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from sigengine.params import QualityRules, Thresholds


def _d(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def prr(a="a", b="b", c="c", d="d", null_rule: str = "standard") -> Column:
    a, b, c, d = map(_d, (a, b, c, d))
    bad = (a + b == 0) | (c == 0) | (c + d == 0)
    if null_rule == "trend":
        bad = bad | (b == 0)
    return F.when(~bad, (a / (a + b)) / (c / (c + d)))


def ror(a="a", b="b", c="c", d="d") -> Column:
    a, b, c, d = map(_d, (a, b, c, d))
    return F.when((b != 0) & (c != 0), (a * d) / (b * c))


def yates_chi2(a="a", b="b", c="c", d="d", n="grand_total") -> Column:
    a, b, c, d, n = map(_d, (a, b, c, d, n))
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(margins != 0, F.pow(F.abs(a * d - b * c) - n / 2, F.lit(2)) * n / margins)


def signal_status(a="case_count", p="prr", r="ror", x="chi2", t: Thresholds = Thresholds()) -> Column:
    enough = F.col(a) >= t.min_cases
    strong = enough & (F.col(p) > t.prr) & (F.col(r) > t.ror) & (F.col(x) > t.chi2)
    return F.when(strong, "STRONG_SIGNAL").when(enough & ((F.col(p) > t.prr) | (F.col(r) > t.ror)), "SIGNAL").otherwise("NONE")


def confidence(a="case_count", p="prr", r="ror", variant: str = "analytic") -> Column:
    a, p, r = F.col(a), F.col(p), F.col(r)
    if variant == "serving":
        return F.when((a >= 10) & (p >= 4) & (r >= 4), "HIGH").when(a >= 5, "MEDIUM").otherwise("LOW")
    return F.when((p > 4) & (r > 4) & (a >= 10), "HIGH").when((p > 2) & (r > 2) & (a >= 5), "MEDIUM").otherwise("LOW")


def capped(x="chi2", cap: float = 1e9) -> Column:
    """Whether a statistic reaches the cap, so that its capped value is a mark rather than a figure."""
    return F.coalesce(F.col(x) >= cap, F.lit(False))


def artifact_reason(q: QualityRules = QualityRules(), t: Thresholds = Thresholds()) -> Column:
    """The first failing rule; in the strict variant a null fails its rule."""
    p, r, x = F.col("prr"), F.col("ror"), F.col("chi2")
    ratio = lambda c: (c > t.prr) if q.variant == "sql" else (c >= t.prr)
    fails = lambda ok: ~F.coalesce(ok, F.lit(q.variant == "sql"))
    return (
        F.when(fails(ratio(p) & ratio(r) & (x >= t.chi2)), "not_prr_ror_signal")
        .when(fails(F.col("case_count") >= q.min_cases), "too_few_cases")
        .when(fails(F.col("countries_count") >= q.min_sources), "low_source_diversity_proxy")
        .when(fails(F.col("serious_ratio") >= q.min_serious), "low_seriousness_ratio")
        .when(fails((p <= q.max_ratio) & (r <= q.max_ratio)), "extreme_ratio_artifact")
        .when(fails(x >= 0), "invalid_negative_chi_square")
        .otherwise("passes_robust_filter")
    )


def passes_robust(q: QualityRules = QualityRules(), t: Thresholds = Thresholds()) -> Column:
    return F.coalesce(
        (F.col("case_count") >= q.min_cases)
        & (F.col("countries_count") >= q.min_sources)
        & (F.col("serious_ratio") >= q.min_serious)
        & F.col("prr").between(t.prr, q.max_ratio)
        & F.col("ror").between(t.ror, q.max_ratio)
        & (F.col("chi2") >= t.chi2),
        F.lit(False),
    )


def robust_score() -> Column:
    unit = lambda c: F.least(F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    value = F.log1p("case_count") * F.log1p("countries_count") * (1 + unit("serious_ratio") + 2 * unit("death_ratio")) * F.log1p("prr") * F.log1p("ror")
    return F.when(F.col("passes_robust_filter"), value).otherwise(0.0)


def expected() -> Column:
    return F.coalesce(F.try_divide(_d("drug_total") * _d("reaction_total"), _d("grand_total")), F.lit(0.0))


def information_component(alpha: float = 1.0, beta: float = 1.0) -> Column:
    return F.ln((_d("case_count") + alpha) / (expected() + beta)) / F.ln(F.lit(2.0))


def ic_lower(alpha: float = 1.0, beta: float = 1.0, z: float = 1.96) -> Column:
    var = (1 / (F.ln(F.lit(2.0)) * F.ln(F.lit(2.0)))) * (1 / (_d("case_count") + alpha) + 1 / (expected() + beta))
    return information_component(alpha, beta) - z * F.sqrt(var)


def ebgm(alpha: float = 0.5, beta: float = 0.5) -> Column:
    return (_d("case_count") + alpha) / (expected() + beta)


def age_band(age: str = "age_years") -> Column:
    """Bands by whole years; fractional ages between two bands fall to the last one."""
    a = F.col(age)
    return F.when(a.isNull(), "unknown").when(a < 18, "<18").when(a.between(18, 39), "18-39").when(a.between(40, 64), "40-64").when(a.between(65, 84), "65-84").otherwise("85+")


def sex_label(sex: str = "patient_sex_int") -> Column:
    return F.when(F.col(sex) == 1, "male").when(F.col(sex) == 2, "female").otherwise("unknown")


@lru_cache(8)
def _gamma_quantiles(alpha: float, size: int, share: float = 0.05) -> tuple[float, ...]:
    """Quantiles of Gamma(alpha + n, rate 1) for n under ``size``, by bisection on the series of the lower incomplete gamma function.

    Quantiles of a share under one half lie below the shape, where the terms of the series only fall.
    """
    s = np.arange(size) + alpha
    lo, hi = np.zeros(size), s + 1.0
    scale = np.array([math.lgamma(v + 1) for v in s])
    steps = np.arange(1, 60 + int(12 * math.sqrt(size)))
    for _ in range(80):
        x = (lo + hi) / 2
        series = 1 + np.exp(np.cumsum(np.log(x[:, None] / (s[:, None] + steps)), axis=1)).sum(1)
        below = np.exp(s * np.log(x) - x - scale) * series < share
        lo, hi = np.where(below, x, lo), np.where(below, hi, x)
    return tuple(((lo + hi) / 2).tolist())


def _cornish_fisher(s: Column, z: float) -> Column:
    """The quantile of Gamma(s, rate 1) at the standard normal quantile ``z``; from a shape of 1,000 its relative error is under 1e-9."""
    r = F.sqrt(s)
    return s + z * r + (z**2 - 1) / 3 + (z**3 - 7 * z) / (36 * r) - (3 * z**4 + 7 * z**2 - 16) / (810 * s) + (9 * z**5 + 256 * z**3 - 433 * z) / (38880 * s * r)


def eb05(alpha: float = 0.5, beta: float = 0.5, cases: str = "case_count", exp: Column | None = None, table: int = 1000) -> Column:
    """The 5 % quantile of Gamma(alpha + cases, rate beta + expected); ``cases`` are whole numbers.

    Counts under ``table`` are looked up in quantiles that the driver works out once, larger ones follow an expansion, so
    rows cost the same whatever their counts.
    """
    n = F.col(cases).cast("long")
    small = F.get(F.array(*map(F.lit, _gamma_quantiles(alpha, table))), n.cast("int"))
    shape = F.when(n < table, small).otherwise(_cornish_fisher(_d(cases) + alpha, -1.6448536269514729))
    return shape / ((expected() if exp is None else exp) + beta)
