"""Pair counts, contingency cells, signals, quality, trends, first crossings and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigengine.functions import stats as S
from sigengine.params import QualityRules, Shrinkage, Thresholds

PAIR = ["drug_name", "reaction_term"]
QUARTER = ["report_year", "report_quarter"]


def clean(facts: DataFrame) -> DataFrame:
    """Sane ages, filled-in countries and sexes, one row for each report and pair with a fixed survivor."""
    d = facts.filter(F.col("drug_name").isNotNull() & F.col("reaction_term").isNotNull() & (F.length("drug_name") > 1)).withColumns(
        {"age_years": F.when(F.col("age_years").between(0, 120), F.col("age_years")), "country": F.coalesce("country", F.lit("UNK")), "patient_sex_int": F.coalesce("patient_sex_int", F.lit(0))}
    )
    w = Window.partitionBy("safetyreportid", *PAIR).orderBy(F.col("report_date").asc_nulls_last(), "country", F.col("drug_role").asc_nulls_last())
    return d.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def role_filter(facts: DataFrame, role_policy: str = "suspect") -> DataFrame:
    return facts.filter("drug_role = '1' OR drug_role IS NULL") if role_policy == "suspect" else facts


def until(facts: DataFrame, cutoff: str | None) -> DataFrame:
    """Reports received up to a date; the comparison with a literal reaches a Parquet scan."""
    return facts.filter(F.col("report_date") <= F.lit(cutoff).cast("date")) if cutoff else facts


def pair_counts(facts: DataFrame, role_policy: str = "suspect", cutoff: str | None = None) -> DataFrame:
    d = role_filter(until(facts, cutoff), role_policy).filter("drug_name IS NOT NULL AND reaction_term IS NOT NULL")
    return d.groupBy(*PAIR).agg(
        F.count_distinct("safetyreportid").alias("case_count"),
        *[F.sum(F.col(f"{k}_int").cast("long")).alias(f"{k}_count") for k in ("serious", "death", "hosp")],
        F.count_distinct("country").alias("countries_count"),
        F.min("report_date").alias("first_date"),
        F.max("report_date").alias("last_date"),
    )


def with_margins(pairs: DataFrame) -> DataFrame:
    """Margins as sums over pairs. Totals by key are aggregated before they are joined, so a frequent key is no hot task."""
    by = lambda k, n: pairs.groupBy(k).agg(F.sum("case_count").alias(n))
    total = pairs.agg(F.sum("case_count").alias("grand_total"))
    return pairs.join(by("drug_name", "drug_total"), "drug_name").join(by("reaction_term", "reaction_total"), "reaction_term").crossJoin(F.broadcast(total))  # one row


def cells(counted: DataFrame) -> DataFrame:
    a = F.col("case_count")
    return counted.withColumns({"a": a, "b": F.col("drug_total") - a, "c": F.col("reaction_total") - a, "d": F.col("grand_total") - F.col("drug_total") - F.col("reaction_total") + a})


def scored(pairs: DataFrame) -> DataFrame:
    n = F.col("case_count").cast("double")
    return cells(with_margins(pairs)).withColumns({"prr": S.prr(), "ror": S.ror(), "chi2": S.yates_chi2(), **{f"{k}_ratio": F.col(f"{k}_count") / n for k in ("serious", "death", "hosp")}})


def signals(facts: DataFrame, role_policy: str = "suspect", t: Thresholds = Thresholds(), q: QualityRules = QualityRules()) -> DataFrame:
    """The signal table, unrounded."""
    return signals_of(pair_counts(facts, role_policy), t, q)


def signals_of(pairs: DataFrame, t: Thresholds = Thresholds(), q: QualityRules = QualityRules()) -> DataFrame:
    """The signal table of counted pairs."""
    d = scored(pairs).withColumns({"signal_status": S.signal_status(t=t), "confidence": S.confidence(), "chi2_capped": F.when(F.col("chi2").isNotNull(), F.least("chi2", F.lit(t.chi2_cap))), "capped": S.capped("chi2", t.chi2_cap), "chi2_sentinel": S.capped("chi2", t.chi2_sentinel)})
    d = d.withColumns({"artifact_reason": S.artifact_reason(q, t)})
    flag = S.passes_robust(q, t) if q.variant == "sql" else F.col("artifact_reason") == "passes_robust_filter"
    d = d.withColumn("passes_robust_filter", flag)
    return d.withColumns(
        {"passes_structural_filter": F.col("passes_robust_filter") & (F.col("drug_total") > F.col("case_count")) & (F.col("reaction_total") > F.col("case_count")), "is_single_source_proxy": F.col("countries_count") <= 1, "robust_signal_score": S.robust_score()}
    )


def bayes(sig: DataFrame, p: Shrinkage = Shrinkage()) -> DataFrame:
    """Shrunk scores; a pair whose margins give no expectation scores 0."""
    scores = {"ic": S.information_component(p.ic_alpha, p.ic_beta), "ic025": S.ic_lower(p.ic_alpha, p.ic_beta, p.z), "ebgm": S.ebgm(p.eb_alpha, p.eb_beta), "eb05": S.eb05(p.eb_alpha, p.eb_beta)}
    return sig.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in scores.items()})


def quality_summary(sig: DataFrame) -> DataFrame:
    """(metric, value): counts, the share of raw signals that are robust, and the pairs by artifact reason, in one pass."""
    by = sig.groupBy("artifact_reason").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.expr("prr > 2 AND ror > 2 AND case_count >= 3")).alias("raw_signals"),
        F.count_if(F.expr("passes_robust_filter")).alias("robust_signals"),
        F.count_if(F.expr("passes_structural_filter")).alias("structural_signals"),
        F.count_if(F.expr("is_single_source_proxy")).alias("proxy_only"),
    )
    # half a dozen rows from here on
    whole = ("rows", "raw_signals", "robust_signals", "structural_signals", "proxy_only")
    one = by.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in whole], F.collect_list(F.struct(F.concat(F.lit("reason:"), "artifact_reason").alias("metric"), F.col("rows").cast("double").alias("value"))).alias("reasons"))
    rate = F.struct(F.lit("robust_rate").alias("metric"), F.try_divide("robust_signals", "raw_signals").alias("value"))
    each = [F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in whole]
    return one.select(F.explode(F.concat(F.array(*each, rate), "reasons")).alias("x")).select("x.*")


def quarter_counts(facts: DataFrame) -> DataFrame:
    """Of each pair and quarter the distinct reports (``n``) and those that the pair alone counts for its drug, its reaction and all.

    A report's rows are brought together once; the first row of a report for a drug, for a reaction and at all is marked
    there. So the distinct reports of a drug and quarter are a sum of ``of_drug`` over its pairs, and so on: all margins
    come from this table, which is as small as the pairs and quarters.
    """
    own = ["safetyreportid", *QUARTER]
    d = facts.select(*own, *PAIR).repartition("safetyreportid").dropDuplicates([*own, *PAIR])
    first = lambda *k: (F.row_number().over(Window.partitionBy(*own, *k).orderBy(*PAIR)) == 1).cast("long")
    d = d.withColumns({"__d": first("drug_name"), "__r": first("reaction_term"), "__a": first()})
    return d.groupBy(*PAIR, *QUARTER).agg(F.count(F.lit(1)).alias("n"), F.sum("__d").alias("of_drug"), F.sum("__r").alias("of_reaction"), F.sum("__a").alias("of_all"))


def _margins(q: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct reports by drug, by reaction and of all, by quarter."""
    by = lambda c, *k: q.groupBy(*k, *QUARTER).agg(F.sum(c).alias("n"))
    return by("of_drug", "drug_name"), by("of_reaction", "reaction_term"), by("of_all")


def trends(facts: DataFrame | None, counts: DataFrame | None = None) -> DataFrame:
    """PRR and ROR of each pair by quarter; margins are distinct reports of that quarter. ``counts``: quarter counts kept by the caller."""
    q = quarter_counts(facts) if counts is None else counts
    drug, reaction, every = _margins(q)
    d = q.select(*PAIR, *QUARTER, F.col("n").alias("case_count")).join(drug.withColumnRenamed("n", "drug_total"), ["drug_name", *QUARTER]).join(reaction.withColumnRenamed("n", "reaction_total"), ["reaction_term", *QUARTER])
    d = d.join(F.broadcast(every.withColumnRenamed("n", "grand_total")), QUARTER)  # a row a quarter
    return cells(d).withColumns({"prr": S.prr(null_rule="trend"), "ror": S.ror()})


def timeline(facts: DataFrame | None, counts: DataFrame | None = None, reference: DataFrame | None = None) -> DataFrame:
    """Cumulative counts of each pair, drug, reaction and all by quarter, over the quarters in which the pair was reported.

    With ``reference`` (pairs) only those pairs are followed, and only their drugs and reactions are summed.
    """
    q = quarter_counts(facts) if counts is None else counts
    drug, reaction, every = _margins(q)
    pairs = q.select(*PAIR, *QUARTER, "n")
    if reference is not None:
        ref = reference.select(*PAIR).distinct()
        pairs = pairs.join(ref, PAIR, "left_semi")
        drug, reaction = drug.join(ref.select("drug_name"), "drug_name", "left_semi"), reaction.join(ref.select("reaction_term"), "reaction_term", "left_semi")
    run = lambda d, keys, out: d.withColumn(out, F.sum("n").over(Window.partitionBy(*keys).orderBy(*QUARTER).rowsBetween(Window.unboundedPreceding, 0))).drop("n")
    # the grand total runs over one row a quarter
    total = run(every.withColumn("__all", F.lit(1)), ["__all"], "grand_total").drop("__all")
    d = run(pairs, PAIR, "case_count").join(run(drug, ["drug_name"], "drug_total"), ["drug_name", *QUARTER]).join(run(reaction, ["reaction_term"], "reaction_total"), ["reaction_term", *QUARTER]).join(F.broadcast(total), QUARTER)
    return cells(d).withColumns({"prr": S.prr(), "ror": S.ror()})


def first_crossing(facts: DataFrame | None, t: Thresholds = Thresholds(), counts: DataFrame | None = None, reference: DataFrame | None = None) -> DataFrame:
    """The first quarter in which a pair's cumulative figures pass the thresholds."""
    hit = timeline(facts, counts, reference).filter((F.col("case_count") >= t.min_cases) & (F.col("prr") > t.prr) & (F.col("ror") > t.ror))
    first = hit.groupBy(*PAIR).agg(F.min_by(F.struct("case_count", "prr", "ror", *QUARTER), F.col("report_year") * 4 + F.col("report_quarter")).alias("x")).select(*PAIR, "x.*")
    return first.withColumn("signal_first_detected_date", F.last_day(F.make_date("report_year", 3 * F.col("report_quarter"), F.lit(1))))


def growth(facts: DataFrame | None, counts: DataFrame | None = None) -> DataFrame:
    """Mean change from one reported quarter to the next reported one."""
    q = facts.groupBy(*PAIR, *QUARTER).agg(F.count_distinct("safetyreportid").alias("n")) if counts is None else counts.select(*PAIR, *QUARTER, "n")
    before = F.lag("n").over(Window.partitionBy(*PAIR).orderBy(*QUARTER))
    return q.withColumn("g", F.when(before > 0, (F.col("n") - before) / before)).groupBy(*PAIR).agg(F.avg("g").alias("qoq_growth"))


def pair_quarters(facts: DataFrame) -> DataFrame:
    """All that features need of the facts, by pair and quarter: one pass, after which only this small table is read."""
    one = facts.filter("drug_name IS NOT NULL AND reaction_term IS NOT NULL")
    return one.groupBy(*PAIR, *QUARTER).agg(
        F.count_distinct("safetyreportid").alias("n"),
        *[F.sum(F.col(f"{k}_int").cast("long")).alias(f"{k}_count") for k in ("serious", "death", "hosp")],
        F.collect_set("country").alias("countries"),  # no longer than the list of countries
        F.min("report_date").alias("first_date"),
        F.max("report_date").alias("last_date"),
        F.count(F.lit(1)).alias("rows"),
        F.count("age_years").alias("ages"),
        F.sum("age_years").alias("age_sum"),
        F.sum(F.col("age_years") * F.col("age_years")).alias("age_squares"),
        F.count_if(F.col("patient_sex_int") == 2).alias("females"),
    )


def features(facts: DataFrame | None, warnings: DataFrame, as_of: str, cutoff: str | None = None, quarters: DataFrame | None = None) -> DataFrame:
    """The feature matrix over all roles, of reports up to ``cutoff``; dates count to ``as_of``. ``quarters``: pair quarters kept by the caller.

    A report has one quarter, so distinct reports add up over quarters.
    """
    q = pair_quarters(until(facts, cutoff)) if quarters is None else quarters
    var = F.try_divide(F.sum("age_squares") - F.try_divide(F.sum("age_sum") * F.sum("age_sum"), F.sum("ages")), F.sum("ages") - 1)
    pairs = q.groupBy(*PAIR).agg(
        F.sum("n").alias("case_count"),
        *[F.sum(f"{k}_count").alias(f"{k}_count") for k in ("serious", "death", "hosp")],
        F.size(F.array_distinct(F.flatten(F.collect_list("countries")))).cast("long").alias("countries_count"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.try_divide(F.sum("age_sum"), F.sum("ages")).alias("mean_age"),
        F.sqrt(F.when(F.sum("ages") > 1, F.greatest(F.lit(0.0), var))).alias("std_age"),
        F.try_divide(F.sum("females"), F.sum("rows")).alias("female_ratio"),
    )
    sig = scored(pairs)
    is_signal = F.coalesce((F.col("case_count") >= 3) & (F.col("prr") > 2), F.lit(False))
    by_drug = sig.filter(is_signal).groupBy("drug_name").agg(F.count(F.lit(1)).alias("n_concurrent_signals"))
    d = sig.join(growth(None, q), PAIR, "left").join(by_drug, "drug_name", "left").join(warnings.withColumn("__w", F.lit(1)), PAIR, "left")
    return d.withColumns(
        {"qoq_growth": F.coalesce("qoq_growth", F.lit(0.0)), "n_concurrent_signals": F.coalesce("n_concurrent_signals", F.lit(0)), "days_since_first_report": F.datediff(F.lit(as_of).cast("date"), "first_date"), "label": F.coalesce("__w", F.lit(0))}
    ).drop("__w")
