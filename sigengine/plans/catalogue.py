"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigengine.functions import stats as S
from sigengine.functions.names import SYNONYMS, normalize_name
from sigengine.operators import evaluation as E
from sigengine.operators import model as M
from sigengine.operators import serving
from sigengine.operators import signals as G
from sigengine.params import QualityRules
from sigengine.sources import query as Q
from sigengine.sources import reports as R
from sigengine.sources.shared import shared_folder
from sigengine.sources.star import fact_events, warnings_ref

CUTOFFS = ["1998-12-31", "1999-12-31", "2000-12-31", "2001-06-30", "2003-12-31"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_KEPT: list[DataFrame] = []  # by the query called last

FACT = """fact AS (SELECT CAST(l_orderkey AS STRING) AS safetyreportid, concat(p_brand, '/', CAST(p_size AS STRING)) AS drug_name, concat(p_type, '-', c_mktsegment) AS reaction_term,
 MIN(CASE WHEN l_linenumber % 4 = 0 THEN '2' WHEN l_linenumber % 5 = 0 THEN NULL ELSE '1' END) AS drug_role, MAX(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS serious_int,
 MAX(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 ELSE 0 END) AS death_int, MAX(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS hosp_int, CAST(MAX(c_custkey % 3) AS INT) AS patient_sex_int,
 CAST(MAX((c_custkey * 7) % 135) AS DOUBLE) AS age_years, MAX(n_name) AS country, CAST(MAX(o_orderdate) AS DATE) AS report_date, CAST(year(MAX(o_orderdate)) AS INT) AS report_year, CAST(quarter(MAX(o_orderdate)) AS INT) AS report_quarter
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)"""
WARN = """warn AS (SELECT drug_name, reaction_term, MIN(wd) AS warning_date FROM (SELECT concat(p_brand, '/', CAST(p_size AS STRING)) AS drug_name,
 concat(p_type, '-', CASE CAST(floor(p_partkey / 37) AS INT) % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END) AS reaction_term,
 DATE '1997-06-30' + CAST((p_partkey * 17) % 1500 AS INT) AS wd FROM part WHERE p_partkey % 37 = 0) t GROUP BY 1, 2)"""


def _pairs(where: str) -> str:
    return f"""pairs AS (SELECT drug_name, reaction_term, count(DISTINCT safetyreportid) AS case_count, CAST(sum(serious_int) AS BIGINT) AS serious_count, CAST(sum(death_int) AS BIGINT) AS death_count,
 CAST(sum(hosp_int) AS BIGINT) AS hosp_count, count(DISTINCT country) AS countries_count, min(report_date) AS first_date, max(report_date) AS last_date FROM fact WHERE {where} GROUP BY 1, 2),
margins AS (SELECT *, CAST(sum(case_count) OVER (PARTITION BY drug_name) AS BIGINT) AS drug_total, CAST(sum(case_count) OVER (PARTITION BY reaction_term) AS BIGINT) AS reaction_total, CAST(sum(case_count) OVER () AS BIGINT) AS grand_total FROM pairs)"""


def _stat(source: str, trend: bool = False) -> str:
    return f"""SELECT *, CASE WHEN {'b = 0 OR ' if trend else ''}a + b = 0 OR c = 0 OR c + d = 0 THEN NULL ELSE (a / (a + b)) / (c / (c + d)) END AS prr, CASE WHEN b = 0 OR c = 0 THEN NULL ELSE (a * d) / (b * c) END AS ror,
 CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) = 0 THEN NULL ELSE power(abs(a * d - b * c) - grand_total / 2.0, 2) * grand_total / ((a + b) * (c + d) * (a + c) * (b + d)) END AS chi2
 FROM (SELECT *, CAST(case_count AS DOUBLE) AS a, CAST(drug_total - case_count AS DOUBLE) AS b, CAST(reaction_total - case_count AS DOUBLE) AS c, CAST(grand_total - drug_total - reaction_total + case_count AS DOUBLE) AS d FROM {source}) z"""


SIG = f"""stat AS (SELECT *, serious_count / a AS serious_ratio, death_count / a AS death_ratio, hosp_count / a AS hosp_ratio FROM ({_stat('margins')}) y),
sig0 AS (SELECT *, CASE WHEN case_count >= 3 AND prr > 2 AND ror > 2 AND chi2 > 4 THEN 'STRONG_SIGNAL' WHEN case_count >= 3 AND (prr > 2 OR ror > 2) THEN 'SIGNAL' ELSE 'NONE' END AS signal_status,
 CASE WHEN prr > 4 AND ror > 4 AND case_count >= 10 THEN 'HIGH' WHEN prr > 2 AND ror > 2 AND case_count >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
 CASE WHEN chi2 IS NULL THEN NULL ELSE least(chi2, 1e9) END AS chi2_capped,
 CASE WHEN NOT coalesce(prr >= 2 AND ror >= 2 AND chi2 >= 4, false) THEN 'not_prr_ror_signal' WHEN case_count < 5 THEN 'too_few_cases' WHEN countries_count < 3 THEN 'low_source_diversity_proxy'
 WHEN serious_ratio < 0.01 THEN 'low_seriousness_ratio' WHEN prr > 1e5 OR ror > 1e5 THEN 'extreme_ratio_artifact' WHEN chi2 < 0 THEN 'invalid_negative_chi_square' ELSE 'passes_robust_filter' END AS artifact_reason FROM stat),
sig1 AS (SELECT *, artifact_reason = 'passes_robust_filter' AS passes_robust_filter, countries_count <= 1 AS is_single_source_proxy FROM sig0),
sig AS (SELECT *, passes_robust_filter AND drug_total > case_count AND reaction_total > case_count AS passes_structural_filter,
 CASE WHEN passes_robust_filter THEN ln(1.0 + case_count) * ln(1.0 + countries_count) * (1 + least(greatest(serious_ratio, 0), 1) + 2 * least(greatest(death_ratio, 0), 1)) * ln(1 + prr) * ln(1 + ror) ELSE 0.0 END AS robust_signal_score FROM sig1)"""
_E = "(CAST(drug_total AS DOUBLE) * reaction_total / grand_total)"
#: The 5 % quantile by Newton's method on the logarithm, the distribution function being Simpson's integral of the density: another way than the engine's
_W = "(30 / s + 12 / sqrt(s))"
_AT = f"(t - {_W} + {_W} * k / 1000.0)"
_CDF = f"{_W} / 3000 * list_sum(list_transform(range(0, 1001), lambda k: CASE WHEN k IN (0, 1000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(s * {_AT} - exp({_AT}) - lgamma(s))))"
_NEWTON = f"list_reduce(list_prepend(ln(s) + 3 * ln(greatest(1 - 1 / (9 * s) - 1.6448536 / (3 * sqrt(s)), 0.2)), list_transform(range(0, 12), lambda i: CAST(0 AS DOUBLE))), lambda t, e: t - ({_CDF} - 0.05) / exp(s * t - exp(t) - lgamma(s)))"
BAYES = f"""quantiles AS (SELECT s, exp({_NEWTON}) AS x FROM (SELECT DISTINCT a + 0.5 AS s FROM sig) shapes),
bayes AS (SELECT sig.*, ln((a + 1) / ({_E} + 1)) / ln(2) AS ic, ln((a + 1) / ({_E} + 1)) / ln(2) - 1.96 * sqrt((1 / (ln(2) * ln(2))) * (1 / (a + 1) + 1 / ({_E} + 1))) AS ic025, (a + 0.5) / ({_E} + 0.5) AS ebgm, x / ({_E} + 0.5) AS eb05
 FROM sig JOIN quantiles ON s = a + 0.5)"""
_SUSPECT = "drug_role = '1' OR drug_role IS NULL"
A, ALL = _pairs(_SUSPECT), _pairs("true")
SIGNALS = f"WITH {FACT}, {A}, {SIG}"
RANK = """long AS (SELECT 'case_count' AS method, drug_name, reaction_term, a AS score FROM bayes UNION ALL SELECT 'prr', drug_name, reaction_term, prr FROM bayes WHERE case_count >= 3 AND prr > 2
 UNION ALL SELECT 'ror', drug_name, reaction_term, ror FROM bayes WHERE case_count >= 3 AND ror > 2 UNION ALL SELECT 'prr_ror', drug_name, reaction_term, least(prr, ror) FROM bayes WHERE case_count >= 3 AND prr > 2 AND ror > 2
 UNION ALL SELECT 'prr_ror_chi_square', drug_name, reaction_term, chi2 FROM bayes WHERE case_count >= 3 AND prr > 2 AND ror > 2 AND chi2 > 4 UNION ALL SELECT 'robust', drug_name, reaction_term, robust_signal_score FROM bayes WHERE passes_robust_filter
 UNION ALL SELECT 'ic025', drug_name, reaction_term, ic025 FROM bayes WHERE ic025 > 0 UNION ALL SELECT 'eb05', drug_name, reaction_term, eb05 FROM bayes WHERE eb05 > 2)"""
CUT = "cutoffs AS (SELECT unnest(['1998-12-31', '1999-12-31', '2000-12-31', '2001-06-30', '2003-12-31']) AS cutoff)"
TREND = "q AS (SELECT drug_name, reaction_term, report_year, report_quarter, count(DISTINCT safetyreportid) AS n FROM fact GROUP BY 1, 2, 3, 4), qd AS (SELECT drug_name, report_year, report_quarter, count(DISTINCT safetyreportid) AS n FROM fact GROUP BY 1, 2, 3), qr AS (SELECT reaction_term, report_year, report_quarter, count(DISTINCT safetyreportid) AS n FROM fact GROUP BY 1, 2, 3), qt AS (SELECT report_year, report_quarter, count(DISTINCT safetyreportid) AS n FROM fact GROUP BY 1, 2)"
_RUN = lambda t, part, out: f"(SELECT *, CAST(sum(n) OVER ({part} ORDER BY report_year, report_quarter ROWS UNBOUNDED PRECEDING) AS BIGINT) AS {out} FROM {t})"
LINE = f"""{TREND}, line0 AS (SELECT drug_name, reaction_term, report_year, report_quarter, case_count, drug_total, reaction_total, grand_total FROM {_RUN('q', 'PARTITION BY drug_name, reaction_term', 'case_count')} x
 JOIN {_RUN('qd', 'PARTITION BY drug_name', 'drug_total')} d USING (drug_name, report_year, report_quarter) JOIN {_RUN('qr', 'PARTITION BY reaction_term', 'reaction_total')} r USING (reaction_term, report_year, report_quarter) JOIN {_RUN('qt', '', 'grand_total')} t USING (report_year, report_quarter)),
line AS ({_stat('line0')}), crossing AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY drug_name, reaction_term ORDER BY report_year, report_quarter) AS rn FROM line WHERE case_count >= 3 AND prr > 2 AND ror > 2) w WHERE rn = 1)"""


def _round(c: str, digits: int):
    """Half away from zero in binary arithmetic, as the SQL engine at the other side rounds doubles; infinite values stay.

    ``floor`` gives a long, so it takes only what may have a fraction: from 2^52 on doubles are whole.
    """
    scaled = F.abs(c) * 10.0**digits
    whole = F.when(scaled < 2.0**52, F.floor(scaled) + F.when(scaled - F.floor(scaled) >= 0.5, 1).otherwise(0)).otherwise(scaled)
    return F.signum(c) * F.when(scaled < float("inf"), whole / 10.0**digits).otherwise(F.abs(c))


def _r(*cols: str) -> list:
    return [_round(c, 4).alias(c) for c in cols]


def _rs(*cols: str) -> str:
    return ", ".join(f"round({c}, 4) AS {c}" for c in cols)


def add(name: str, oracle: str | None = None):
    def put(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            while _KEPT:  # each query starts from the tables
                _KEPT.pop().unpersist()
            return f(spark, d)

        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return f

    return put


def _keep(df: DataFrame) -> DataFrame:
    """Let ``df`` be computed once for all parts of a query that read it; the next query lets it go."""
    _KEPT.append(df.persist())
    return df


def _sig(spark, d, role="suspect"):
    return G.signals_of(_keep(G.pair_counts(fact_events(spark, d), role)))


def _quarters(spark, d):
    return _keep(G.quarter_counts(fact_events(spark, d)))


def _over_signals(name: str, f: Callable[[DataFrame], DataFrame], select: str) -> None:
    add(name, f"{SIGNALS} {select}")(lambda spark, d: f(_sig(spark, d)))


def _over_facts(name: str, f: Callable[[DataFrame], DataFrame], select: str, more: str = "") -> None:
    add(name, f"WITH {FACT}{more} {select}")(lambda spark, d: f(fact_events(spark, d)))


P = ("drug_name", "reaction_term")
KEY = "drug_name, reaction_term"

_over_facts("fact_events", lambda f: f, "SELECT * FROM fact")
_over_facts("fact_dedup", lambda f: f.union(f).dropDuplicates(["safetyreportid", *P]), "SELECT * FROM fact")
_over_facts(
    "clean_demographics",
    lambda f: G.clean(f).groupBy("country", S.sex_label().alias("sex"), S.age_band().alias("age_band")).agg(F.count(F.lit(1)).alias("n")),
    "SELECT coalesce(country, 'UNK') AS country, CASE patient_sex_int WHEN 1 THEN 'male' WHEN 2 THEN 'female' ELSE 'unknown' END AS sex, CASE WHEN age_years > 120 OR age_years < 0 OR age_years IS NULL THEN 'unknown' WHEN age_years < 18 THEN '<18' WHEN age_years BETWEEN 18 AND 39 THEN '18-39' WHEN age_years BETWEEN 40 AND 64 THEN '40-64' WHEN age_years BETWEEN 65 AND 84 THEN '65-84' ELSE '85+' END AS age_band, count(*) AS n FROM fact GROUP BY 1, 2, 3",
)


def quarter_folders(spark: SparkSession, d: str) -> str:
    """The facts as Parquet folders by year and quarter, in the shared folder."""
    path = f"{shared_folder(spark)}/facts-{uuid.uuid4().hex}"
    R.write_quarters(fact_events(spark, d), path)
    return path


add("partition_pruned_scan", f"WITH {FACT} SELECT country, count(*) AS n FROM fact WHERE report_year = 1995 AND report_quarter = 2 AND report_date <= DATE '1995-05-31' GROUP BY 1")(
    lambda spark, d: Q.quarter_scan(spark, quarter_folders(spark, d), 1995, 2, "1995-05-31").groupBy("country").agg(F.count(F.lit(1)).alias("n"))
)
_over_facts("pair_counts", G.pair_counts, "SELECT * FROM pairs", f", {A}")
_over_facts("drug_totals", lambda f: G.pair_counts(f).groupBy("drug_name").agg(F.sum("case_count").alias("drug_total")), "SELECT drug_name, CAST(sum(case_count) AS BIGINT) AS drug_total FROM pairs GROUP BY 1", f", {A}")
_over_facts("reaction_totals", lambda f: G.pair_counts(f).groupBy("reaction_term").agg(F.sum("case_count").alias("reaction_total")), "SELECT reaction_term, CAST(sum(case_count) AS BIGINT) AS reaction_total FROM pairs GROUP BY 1", f", {A}")
_over_facts("grand_total", lambda f: G.pair_counts(f).agg(F.sum("case_count").alias("grand_total")), "SELECT CAST(sum(case_count) AS BIGINT) AS grand_total FROM pairs", f", {A}")
_over_facts(
    "contingency_cells",
    lambda f: G.cells(G.with_margins(G.pair_counts(f))).select(*P, "a", "b", "c", "d", "grand_total"),
    f"SELECT {KEY}, case_count AS a, drug_total - case_count AS b, reaction_total - case_count AS c, grand_total - drug_total - reaction_total + case_count AS d, grand_total FROM margins",
    f", {A}",
)
_over_signals("prr_ror", lambda s: s.select(*P, *_r("prr", "ror")), f"SELECT {KEY}, {_rs('prr', 'ror')} FROM sig")
_over_signals("chi_square_yates", lambda s: s.select(*P, *_r("chi2", "chi2_capped")), f"SELECT {KEY}, {_rs('chi2', 'chi2_capped')} FROM sig")
_over_signals("severity_ratios", lambda s: s.select(*P, *_r("serious_ratio", "death_ratio", "hosp_ratio")), f"SELECT {KEY}, {_rs('serious_ratio', 'death_ratio', 'hosp_ratio')} FROM sig")
_PLAIN = ("case_count", "drug_total", "reaction_total", "grand_total", "signal_status", "confidence", "first_date", "last_date", "countries_count", "passes_robust_filter", "artifact_reason")
_FLOAT = ("prr", "ror", "chi2_capped", "serious_ratio", "death_ratio", "robust_signal_score")
_over_signals("drug_signals", lambda s: s.select(*P, *_PLAIN, *_r(*_FLOAT)), f"SELECT {KEY}, {', '.join(_PLAIN)}, {_rs(*_FLOAT)} FROM sig")
_over_signals("top_signals", lambda s: serving.top(s.filter("signal_status != 'NONE'"), 50, "prr", "case_count").select(*P, "case_count", *_r("prr")), f"SELECT {KEY}, case_count, round(prr, 4) AS prr FROM sig WHERE signal_status <> 'NONE' ORDER BY sig.prr DESC NULLS LAST, case_count DESC, {KEY} LIMIT 50")
for _c in ("signal_status", "confidence", "artifact_reason"):
    _over_signals({"artifact_reason": "artifact_reasons"}.get(_c, f"{_c.replace('signal_', 'signal_')}_counts"), lambda s, c=_c: s.groupBy(c).agg(F.count(F.lit(1)).alias("n")), f"SELECT {_c}, count(*) AS n FROM sig GROUP BY 1")
_over_signals("robust_signals", lambda s: s.filter("passes_robust_filter").select(*P, "case_count", *_r("robust_signal_score")), f"SELECT {KEY}, case_count, round(robust_signal_score, 4) AS robust_signal_score FROM sig WHERE passes_robust_filter")
_over_signals("structural_signals", lambda s: s.filter("passes_structural_filter").select(*P), f"SELECT {KEY} FROM sig WHERE passes_structural_filter")
_over_signals(
    "robust_top50",
    lambda s: serving.top(s.filter("passes_robust_filter"), 50, "robust_signal_score", "chi2", "case_count").select(*P, *_r("robust_signal_score", "chi2")),
    f"SELECT {KEY}, {_rs('robust_signal_score', 'chi2')} FROM sig WHERE passes_robust_filter ORDER BY sig.robust_signal_score DESC, sig.chi2 DESC, case_count DESC, {KEY} LIMIT 50",
)
_over_signals(
    "quality_summary",
    G.quality_summary,
    "SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM sig UNION ALL SELECT 'raw_signals', count(*) FROM sig WHERE prr > 2 AND ror > 2 AND case_count >= 3 UNION ALL SELECT 'robust_signals', count(*) FROM sig WHERE passes_robust_filter UNION ALL SELECT 'structural_signals', count(*) FROM sig WHERE passes_structural_filter UNION ALL SELECT 'proxy_only', count(*) FROM sig WHERE is_single_source_proxy"
    " UNION ALL SELECT 'robust_rate', count(*) FILTER (passes_robust_filter) / nullif(count(*) FILTER (prr > 2 AND ror > 2 AND case_count >= 3), 0) FROM sig UNION ALL SELECT concat('reason:', artifact_reason), count(*) FROM sig GROUP BY artifact_reason",
)
add(
    "signal_trends",
    f"WITH {FACT}, {TREND} SELECT {KEY}, report_year, report_quarter, case_count, {_rs('prr', 'ror')} FROM ({_stat('(SELECT q.drug_name, q.reaction_term, q.report_year, q.report_quarter, q.n AS case_count, qd.n AS drug_total, qr.n AS reaction_total, qt.n AS grand_total FROM q JOIN qd USING (drug_name, report_year, report_quarter) JOIN qr USING (reaction_term, report_year, report_quarter) JOIN qt USING (report_year, report_quarter)) j', True)}) v",
)(lambda spark, d: G.trends(None, _quarters(spark, d)).select(*P, *G.QUARTER, "case_count", *_r("prr", "ror")))


def _of_signals(spark, d):
    f = _keep(fact_events(spark, d))
    return f.join(G.signals(f).filter("signal_status != 'NONE'").select(*P), list(P), "left_semi")


_SEMI = "s AS (SELECT fact.* FROM fact SEMI JOIN (SELECT * FROM sig WHERE signal_status <> 'NONE') g USING (drug_name, reaction_term))"
add("signal_geo", f"{SIGNALS}, {_SEMI} SELECT {KEY}, coalesce(country, 'UNK') AS country, count(DISTINCT safetyreportid) AS reports, CAST(sum(death_int) AS BIGINT) AS deaths FROM s GROUP BY 1, 2, 3")(
    lambda spark, d: _of_signals(spark, d).groupBy(*P, F.coalesce("country", F.lit("UNK")).alias("country")).agg(F.count_distinct("safetyreportid").alias("reports"), F.sum("death_int").alias("deaths"))
)
add(
    "signal_demographics",
    f"{SIGNALS}, {_SEMI} SELECT {KEY}, CASE WHEN age_years IS NULL THEN 'unknown' WHEN age_years < 18 THEN '<18' WHEN age_years BETWEEN 18 AND 39 THEN '18-39' WHEN age_years BETWEEN 40 AND 64 THEN '40-64' WHEN age_years BETWEEN 65 AND 84 THEN '65-84' ELSE '85+' END AS age_band, CASE patient_sex_int WHEN 1 THEN 'male' WHEN 2 THEN 'female' ELSE 'unknown' END AS sex, count(DISTINCT safetyreportid) AS reports FROM s GROUP BY 1, 2, 3, 4",
)(lambda spark, d: _of_signals(spark, d).groupBy(*P, S.age_band().alias("age_band"), S.sex_label().alias("sex")).agg(F.count_distinct("safetyreportid").alias("reports")))
add("cumulative_timeline", f"WITH {FACT}, {LINE} SELECT {KEY}, report_year, report_quarter, case_count, drug_total, reaction_total, grand_total, {_rs('prr', 'ror')} FROM line")(lambda spark, d: G.timeline(None, _quarters(spark, d)).select(*P, *G.QUARTER, "case_count", "drug_total", "reaction_total", "grand_total", *_r("prr", "ror")))
_DAY = "last_day(make_date(report_year, 3 * report_quarter, 1))"
_crossed = lambda spark, d, reference=None: G.first_crossing(None, counts=_quarters(spark, d), reference=reference)
add("first_crossing", f"WITH {FACT}, {LINE} SELECT {KEY}, {_DAY} AS signal_first_detected_date, case_count, report_year, report_quarter, {_rs('prr', 'ror')} FROM crossing")(lambda spark, d: _crossed(spark, d).select(*P, "signal_first_detected_date", "case_count", *G.QUARTER, *_r("prr", "ror")))
add("signals_vs_warnings", f"WITH {FACT}, {WARN}, {LINE} SELECT {KEY}, warning_date, date_diff('day', {_DAY}, warning_date) AS days_early FROM crossing JOIN warn USING (drug_name, reaction_term)")(
    lambda spark, d: _crossed(spark, d, warnings_ref(spark, d)).join(warnings_ref(spark, d), list(P)).select(*P, "warning_date", F.datediff("warning_date", "signal_first_detected_date").cast("long").alias("days_early")).orderBy(F.desc("days_early"), *P)
)
add("emerging_unflagged", f"{SIGNALS}, {WARN} SELECT {KEY}, case_count, round(prr, 4) AS prr FROM sig ANTI JOIN warn USING (drug_name, reaction_term) WHERE signal_status = 'STRONG_SIGNAL' ORDER BY sig.prr DESC, {KEY} LIMIT 50")(
    lambda spark, d: serving.top(_sig(spark, d).filter("signal_status = 'STRONG_SIGNAL'").join(warnings_ref(spark, d), list(P), "left_anti"), 50, "prr").select(*P, "case_count", *_r("prr"))
)
_GROW = "g AS (SELECT drug_name, reaction_term, avg((n - prev) * 1.0 / prev) AS qoq_growth FROM (SELECT *, lag(n) OVER (PARTITION BY drug_name, reaction_term ORDER BY report_year, report_quarter) AS prev FROM q) l GROUP BY 1, 2)"
_over_facts("qoq_growth", lambda f: G.growth(f).select(*P, *_r("qoq_growth")), f"SELECT {KEY}, round(qoq_growth, 4) AS qoq_growth FROM g", f", {TREND}, {_GROW}")
add("concurrent_signals", f"WITH {FACT}, {ALL}, {SIG} SELECT drug_name, count(*) AS n_concurrent_signals FROM sig WHERE case_count >= 3 AND prr > 2 GROUP BY 1")(
    lambda spark, d: G.scored(G.pair_counts(fact_events(spark, d), "all")).filter("case_count >= 3 AND prr > 2").groupBy("drug_name").agg(F.count(F.lit(1)).alias("n_concurrent_signals"))
)
_FEAT = f"""WITH {FACT}, {ALL}, {SIG}, {WARN}, {TREND}, {_GROW}, ages AS (SELECT drug_name, reaction_term, avg(age_years) AS mean_age, stddev_samp(age_years) AS std_age, avg(CASE WHEN patient_sex_int = 2 THEN 1.0 ELSE 0.0 END) AS female_ratio FROM fact GROUP BY 1, 2),
conc AS (SELECT drug_name, count(*) AS n FROM sig WHERE case_count >= 3 AND prr > 2 GROUP BY 1), feat AS (SELECT sig.*, mean_age, std_age, female_ratio, coalesce(qoq_growth, 0) AS qoq_growth, coalesce(n, 0) AS n_concurrent_signals, date_diff('day', first_date, DATE '2002-01-01') AS days_since_first_report, warning_date, CASE WHEN warning_date IS NULL THEN 0 ELSE 1 END AS label
 FROM sig JOIN ages USING (drug_name, reaction_term) LEFT JOIN g USING (drug_name, reaction_term) LEFT JOIN conc USING (drug_name) LEFT JOIN warn USING (drug_name, reaction_term))"""
_feat = lambda spark, d: G.features(None, warnings_ref(spark, d), "2002-01-01", quarters=_keep(G.pair_quarters(fact_events(spark, d))))
_FF = ("prr", "ror", "mean_age", "std_age", "female_ratio", "qoq_growth")
add("feature_matrix", f"{_FEAT} SELECT {KEY}, case_count, n_concurrent_signals, days_since_first_report, label, {_rs(*_FF)} FROM feat")(lambda spark, d: _feat(spark, d).select(*P, "case_count", F.col("n_concurrent_signals").cast("long").alias("n_concurrent_signals"), F.col("days_since_first_report").cast("long").alias("days_since_first_report"), "label", *_r(*_FF)))
add("train_set", f"{_FEAT} SELECT {KEY}, label AS raw_label, CASE WHEN warning_date <= DATE '1999-12-31' THEN 1 ELSE 0 END AS label, coalesce(warning_date > DATE '1999-12-31', false) AS evaluated FROM feat")(
    lambda spark, d: _feat(spark, d).select(*P, F.col("label").alias("raw_label"), F.when(F.col("warning_date") <= F.lit("1999-12-31").cast("date"), 1).otherwise(0).alias("label"), F.coalesce(F.col("warning_date") > F.lit("1999-12-31").cast("date"), F.lit(False)).alias("evaluated"))
)
_bayes = lambda spark, d: G.bayes(_sig(spark, d))
BSIG = f"{SIGNALS}, {BAYES}"
add("bcpnn_scores", f"{BSIG} SELECT {KEY}, {_rs('ic', 'ic025')} FROM bayes")(lambda spark, d: _bayes(spark, d).select(*P, *_r("ic", "ic025")))
add("ebgm_scores", f"{BSIG} SELECT {KEY}, {_rs('ebgm')} FROM bayes")(lambda spark, d: _bayes(spark, d).select(*P, *_r("ebgm")))
add("eb05_scores", f"{BSIG} SELECT {KEY}, {_rs('eb05')} FROM bayes")(lambda spark, d: _bayes(spark, d).select(*P, *_r("eb05")))
_long = lambda spark, d: E.ranked(_bayes(spark, d))
BRANK = f"{BSIG}, {RANK}"
_TOP = f"top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, {KEY}) AS rank FROM long) w WHERE rank <= 100)"
add("ranked_top100", f"{BRANK}, {_TOP} SELECT method, {KEY}, round(score, 4) AS score FROM top")(lambda spark, d: E.top_k(_long(spark, d), 100).select("method", *P, *_r("score")))
add("method_score_matrix", f"{BRANK} SELECT {KEY}, " + ", ".join(f"round(coalesce(max(CASE WHEN method = '{m}' THEN score END), 0), 4) AS {m}" for m in E.METHODS) + " FROM long GROUP BY 1, 2")(lambda spark, d: E.score_matrix(_long(spark, d)).select(*P, *_r(*E.METHODS)))
METHODS_SQL = "methods AS (SELECT unnest([" + ", ".join(f"'{m}'" for m in E.METHODS) + "]) AS method)"
LEADS = f"leads AS (SELECT w.*, fd FROM warn w LEFT JOIN (SELECT {KEY}, {_DAY} AS fd FROM crossing) x USING (drug_name, reaction_term))"


def _eval_sql(ranking: str, by: str) -> str:
    """Cells of the full grid of methods and cutoffs; ``ranking`` holds the pairs that count, ``long`` all candidates."""
    return f"""SELECT method, cutoff, coalesce(candidates, 0) AS candidates, future_warnings, coalesce(caught, 0) AS caught, round(coalesce(caught, 0) / nullif(future_warnings, 0), 4) AS recall, round(coalesce(caught, 0) / nullif(CAST({by} AS DOUBLE), 0), 6) AS precision,
 CAST(trunc(lead) AS INT) AS median_lead_days, round(lead / 30, 1) AS median_lead_months, coalesce(lead_basis, 'cutoff') AS lead_basis
 FROM methods CROSS JOIN (SELECT cutoff, count(warning_date) AS future_warnings FROM cutoffs LEFT JOIN warn ON warning_date > CAST(cutoff AS DATE) GROUP BY 1) f LEFT JOIN (SELECT method, count(*) AS candidates FROM long GROUP BY 1) c USING (method)
 LEFT JOIN (SELECT method, cutoff, count(*) AS caught, coalesce(median(date_diff('day', fd, warning_date)), median(date_diff('day', CAST(cutoff AS DATE), warning_date))) AS lead, CASE WHEN count(fd) > 0 THEN 'first_detected' ELSE 'cutoff' END AS lead_basis
 FROM {ranking} JOIN leads USING (drug_name, reaction_term) JOIN cutoffs ON warning_date > CAST(cutoff AS DATE) GROUP BY 1, 2) h USING (method, cutoff)"""


BEVAL = f"{BRANK}, {WARN}, {CUT}, {LINE}, {METHODS_SQL}, {LEADS}"
_evaluated = lambda e: e.select("method", "cutoff", "candidates", "future_warnings", "caught", *_r("recall"), _round("precision", 6).alias("precision"), "median_lead_days", "median_lead_months", "lead_basis")


def _leads(spark, d):
    return _crossed(spark, d, warnings_ref(spark, d))


add("threshold_eval", f"{BEVAL} {_eval_sql('long', 'coalesce(candidates, 0)')}")(lambda spark, d: _evaluated(E.evaluate(_long(spark, d), warnings_ref(spark, d), CUTOFFS, first=_leads(spark, d))))
for _k in (50, 100):
    add("topk_eval" if _k == 100 else f"top{_k}_eval", f"{BEVAL}, {_TOP.replace('100', str(_k))} {_eval_sql('top', str(_k))}")(lambda spark, d, k=_k: _evaluated(E.evaluate(_long(spark, d), warnings_ref(spark, d), CUTOFFS, k, _leads(spark, d))))
_threshold = lambda spark, d: E.evaluate(_long(spark, d), warnings_ref(spark, d), CUTOFFS)
EVAL = f"{BRANK}, {WARN}, {CUT}, {METHODS_SQL}, leads AS (SELECT *, CAST(NULL AS DATE) AS fd FROM warn), ev AS ({_eval_sql('long', 'coalesce(candidates, 0)')})"
_POOLED = "SELECT method, CAST(sum(caught) AS BIGINT) AS caught, CAST(sum(future_warnings) AS BIGINT) AS future, coalesce(sum(caught) / nullif(sum(future_warnings), 0), 0) AS pooled_recall, avg(coalesce(caught / nullif(future_warnings, 0), 0)) AS mean_recall FROM ev GROUP BY 1"
add("method_pooled_recall", f"{EVAL} SELECT method, caught, future, {_rs('pooled_recall', 'mean_recall')} FROM ({_POOLED}) p")(lambda spark, d: E.pooled_recall(_threshold(spark, d)).select("method", "caught", "future", *_r("pooled_recall", "mean_recall")))
add("leaderboard", f"{EVAL} SELECT method, caught, CAST(row_number() OVER (ORDER BY caught DESC, pooled_recall DESC, method) AS INT) AS place FROM ({_POOLED}) p")(lambda spark, d: serving.leaderboard(_threshold(spark, d)).select("method", "caught", "place"))
add("cutoff_method_matrix", f"{EVAL} SELECT cutoff, " + ", ".join(f"CAST(max(CASE WHEN method = '{m}' THEN caught END) AS BIGINT) AS {m}" for m in E.METHODS) + " FROM ev GROUP BY 1")(lambda spark, d: E.cutoff_matrix(_threshold(spark, d)))
_AVGRANK = "SELECT *, rank() OVER (PARTITION BY draw ORDER BY caught DESC) + (count(*) OVER (PARTITION BY draw, caught) - 1) / 2.0 AS avg_rank"
add(
    "ranking_stability",
    f"""{EVAL}, base AS (SELECT method, caught, row_number() OVER (PARTITION BY method ORDER BY cutoff) - 1 AS slot FROM ev), draws AS (SELECT draw, CAST(concat('0x', substring(md5(concat(draw, '|', i, '|42')), 1, 8)) AS BIGINT) % {len(CUTOFFS)} AS slot FROM (SELECT unnest(range(0, 1000)) AS draw) CROSS JOIN (SELECT unnest(range(1, {len(CUTOFFS) + 1})) AS i)),
 totals AS (SELECT draw, method, sum(caught) AS caught FROM draws JOIN base USING (slot) GROUP BY 1, 2), ranks AS ({_AVGRANK} FROM totals) SELECT method, round(avg(avg_rank), 4) AS mean_rank, """
    + ", ".join(f"round(avg(CASE WHEN round_even(avg_rank, 0) = {i} THEN 1.0 ELSE 0.0 END), 4) AS p_rank{i}" for i in range(1, len(E.METHODS) + 1))
    + " FROM ranks GROUP BY 1",
)(lambda spark, d: E.resampled_ranks(_keep(_threshold(spark, d))).select("method", *_r("mean_rank", *[f"p_rank{i}" for i in range(1, len(E.METHODS) + 1)])))
add("sensitivity_grid", f"{BSIG} " + " UNION ALL ".join(f"SELECT '{k}' AS setting, count(*) AS candidates FROM bayes WHERE {c}" for k, c in [*((f"prr>{p},n>={n}", f"prr > {p} AND ror > {p} AND case_count >= {n}") for p in (1.5, 2, 3, 5) for n in (3, 5, 10)), *((f"ic025>{v}", f"ic025 > {v}") for v in (0, 0.5, 1)), *((f"eb05>{v}", f"eb05 > {v}") for v in (1.5, 2, 3))]))(
    lambda spark, d: E.sensitivity(_bayes(spark, d))
)
#: predictions without random draws: a squashed information component stands for the model's probability
_PRED = "pred AS (SELECT drug_name, reaction_term, CASE WHEN warning_date IS NULL THEN 0 ELSE 1 END AS label, warning_date, round_even(1 / (1 + exp(-ic)), 4) AS signal_probability, CASE WHEN 1 / (1 + exp(-ic)) >= 0.5 THEN 1 ELSE 0 END AS predicted, date_diff('day', DATE '1999-06-30', warning_date) AS days_predicted_early FROM bayes LEFT JOIN warn USING (drug_name, reaction_term))"


def _pred(spark, d, bayes=None):
    b = (_bayes(spark, d) if bayes is None else bayes).join(warnings_ref(spark, d), list(P), "left")
    return M.predictions(b.select(*P, F.col("warning_date").isNotNull().cast("int").alias("label"), "warning_date", F.expr("1 / (1 + exp(-ic))").alias("p")), "1999-06-30")


_MLONG = "mlong AS (SELECT method, drug_name, reaction_term, score FROM long UNION ALL SELECT 'model', drug_name, reaction_term, signal_probability FROM pred)"
_CASES = f"""cases AS (SELECT w.drug_name, w.reaction_term, w.warning_date, CASE WHEN r.ok AND m.ok THEN 'both' WHEN r.ok THEN 'rule' WHEN m.ok THEN 'ranking' END AS caught_by, CASE WHEN r.ok IS NULL AND m.ok IS NULL THEN CASE WHEN sig.drug_name IS NULL THEN 'no_exact_match' ELSE 'below_threshold' END END AS reason,
 case_count, prr, ror, CASE WHEN r.ok OR m.ok THEN date_diff('day', coalesce(fd, DATE '1999-12-31'), w.warning_date) END AS days_early, CASE WHEN r.ok OR m.ok THEN CASE WHEN fd IS NULL THEN 'cutoff' ELSE 'first_detected' END END AS lead_basis
 FROM leads w LEFT JOIN sig USING (drug_name, reaction_term) LEFT JOIN (SELECT {KEY}, true AS ok FROM long WHERE method = 'prr_ror') r USING (drug_name, reaction_term)
 LEFT JOIN (SELECT {KEY}, true AS ok FROM mlong WHERE method = 'model' ORDER BY score DESC, {KEY} LIMIT 100) m USING (drug_name, reaction_term) WHERE w.warning_date > DATE '1999-12-31')"""


def _cases(spark, d):
    b = _bayes(spark, d)
    return E.case_tables(E.ranked(b, _pred(spark, d, b)), b, warnings_ref(spark, d), "1999-12-31", first=_leads(spark, d)).withColumn("days_early", F.col("days_early").cast("long"))


BCASES = f"{BEVAL}, {_PRED}, {_MLONG}, {_CASES}"
add("missed_warnings", f"{BCASES} SELECT {KEY}, warning_date, reason FROM cases WHERE caught_by IS NULL")(lambda spark, d: _cases(spark, d).filter("caught_by IS NULL").select(*P, "warning_date", "reason"))
add("case_studies", f"{BCASES} SELECT {KEY}, warning_date, caught_by, case_count, {_rs('prr', 'ror')}, days_early, round(days_early / 30, 1) AS months_early, lead_basis FROM cases WHERE caught_by IS NOT NULL")(
    lambda spark, d: _cases(spark, d).filter("caught_by IS NOT NULL").select(*P, "warning_date", "caught_by", "case_count", *_r("prr", "ror"), "days_early", _round(F.col("days_early") / 30, 1).alias("months_early"), "lead_basis")
)
add("model_ranking_eval", f"{BRANK}, {WARN}, {CUT}, methods AS (SELECT unnest(['eb05', 'model']) AS method), leads AS (SELECT *, CAST(NULL AS DATE) AS fd FROM warn), {_PRED}, {_MLONG}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, {KEY}) AS rank FROM mlong) w WHERE rank <= 100) {_eval_sql('top', '100').replace('FROM long', 'FROM mlong')}")(
    lambda spark, d: _evaluated(E.evaluate(E.ranked(b := _bayes(spark, d), _pred(spark, d, b)), warnings_ref(spark, d), CUTOFFS, 100, methods=["eb05", E.MODEL]))
)
add("predictions_with_signals", f"{BSIG}, {WARN}, {_PRED} SELECT {KEY}, signal_probability, predicted, days_predicted_early, 'boosted-trees-1' AS model_version, signal_status, confidence, round(sig.prr, 4) AS prr FROM pred LEFT JOIN sig USING (drug_name, reaction_term)")(
    lambda spark, d: serving.with_signals(_pred(spark, d, b := _bayes(spark, d)), b).select(*P, "signal_probability", "predicted", F.col("days_predicted_early").cast("long").alias("days_predicted_early"), "model_version", "signal_status", "confidence", *_r("prr"))
)
add("top_predictions", f"{BSIG}, {WARN}, {_PRED} SELECT {KEY}, signal_probability FROM pred WHERE signal_probability >= 0.5 ORDER BY signal_probability DESC, {KEY} LIMIT 100")(lambda spark, d: serving.top_predictions(_pred(spark, d)).select(*P, "signal_probability"))
add("precision_at_100", f"{BSIG}, {WARN}, {_PRED} SELECT 100 AS k, count(*) AS hits, count(*) / 100.0 AS precision FROM (SELECT * FROM pred ORDER BY signal_probability DESC, {KEY} LIMIT 100) t SEMI JOIN warn USING (drug_name, reaction_term)")(
    lambda spark, d: E.precision_at(_pred(spark, d), warnings_ref(spark, d))
)
add(
    "model_metrics",
    f"""{BSIG}, {WARN}, {_PRED}, byp AS (SELECT signal_probability AS s, sum(label) AS p, count(*) AS n FROM pred GROUP BY 1), run AS (SELECT *, sum(p) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS seen, sum(n) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) - n + (n + 1) / 2 AS mid FROM byp),
 vals AS (SELECT 'auc' AS metric, (sum(p * mid) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * (sum(n) - sum(p))) AS value FROM run UNION ALL SELECT 'average_precision', sum(p * tp / seen) / sum(p) FROM run UNION ALL SELECT 'catch_rate', count(*) FILTER (label = 1 AND signal_probability >= 0.5) / count(*) FILTER (label = 1) FROM pred
 UNION ALL SELECT 'median_days_early', median(days_predicted_early) FILTER (label = 1 AND signal_probability >= 0.5) FROM pred UNION ALL SELECT 'precision_at_k', avg(label) FROM (SELECT * FROM pred ORDER BY signal_probability DESC, {KEY} LIMIT 100) t) SELECT metric, round(value, 6) AS value FROM vals""",
)(lambda spark, d: E.model_metrics(_keep(_pred(spark, d))).select("metric", _round("value", 6).alias("value")))
add("false_positives", f"{SIGNALS}, {WARN} SELECT {KEY}, case_count, round(robust_signal_score, 4) AS robust_signal_score FROM sig ANTI JOIN warn USING (drug_name, reaction_term) WHERE passes_robust_filter ORDER BY sig.robust_signal_score DESC, {KEY} LIMIT 100")(
    lambda spark, d: serving.top(_sig(spark, d).filter("passes_robust_filter").join(warnings_ref(spark, d), list(P), "left_anti"), 100, "robust_signal_score").select(*P, "case_count", *_r("robust_signal_score"))
)
_over_signals("signals_search", lambda s: serving.search(s, drug="brand#1", status="STRONG_SIGNAL", limit=20, offset=5).select(*P, *_r("prr")), f"SELECT {KEY}, round(prr, 4) AS prr FROM sig WHERE contains(upper(drug_name), 'BRAND#1') AND signal_status = 'STRONG_SIGNAL' ORDER BY sig.prr DESC NULLS LAST, {KEY} LIMIT 20 OFFSET 5")
_over_signals("alert_high_confidence", lambda s: serving.top(s.filter("signal_status = 'STRONG_SIGNAL' AND confidence = 'HIGH'"), 25, "prr").select(*P, *_r("prr")), f"SELECT {KEY}, round(prr, 4) AS prr FROM sig WHERE signal_status = 'STRONG_SIGNAL' AND confidence = 'HIGH' ORDER BY sig.prr DESC, {KEY} LIMIT 25")
_over_signals("serving_stats", serving.serving_stats, "SELECT count(*) AS total_signals, count(*) FILTER (signal_status = 'STRONG_SIGNAL') AS strong_signals, count(*) FILTER (confidence = 'HIGH') AS high_confidence, max(grand_total) AS grand_total FROM sig")
_over_signals("prr_histogram", lambda s: serving.histogram(s, "prr", 0.0, 40.0, 40), "SELECT CAST(least(floor(prr) + 1, 40) AS BIGINT) AS bin, count(*) AS n FROM sig WHERE prr BETWEEN 0 AND 40 GROUP BY 1")
_SETS = {"caught_union": ("union", "UNION"), "hit_intersection": ("intersect", "INTERSECT"), "miss_difference": ("subtract", "EXCEPT")}
for _n, (_f, _s) in _SETS.items():
    _over_signals(
        _n,
        lambda s, f=_f: getattr(s.filter("prr > 4").select(*P), f)(s.filter("chi2 > 20").select(*P)).distinct(),
        f"SELECT {KEY} FROM sig WHERE prr > 4 {_s} SELECT {KEY} FROM sig WHERE chi2 > 20",
    )
add("auc_by_method", f"{BRANK}, {WARN}, grid AS (SELECT m.method, b.drug_name, b.reaction_term, CASE WHEN w.drug_name IS NULL THEN 0 ELSE 1 END AS y, coalesce(l.score, 0) AS score FROM bayes b CROSS JOIN (SELECT DISTINCT method FROM long) m LEFT JOIN long l USING (method, drug_name, reaction_term) LEFT JOIN warn w USING (drug_name, reaction_term)), rk AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2.0 AS mid FROM grid) SELECT method, round((sum(y * mid) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM rk GROUP BY 1")(
    lambda spark, d: E.midrank_auc(
        _labelled(spark, d).unpivot([*P, "y"], list(E.METHODS), "method", "score"), "y", "score", ["method"]
    ).select("method", _round("auc", 6).alias("auc"))
)


_RAW = ("{n}", " {n} 500 mg tablet", "{n} 5 MG/ML Solution", "{n}-B/x ORAL drops", "Tylenol", "coumadin 2.5mg", "ASA  81 MG", "{n} (R) inject*", "acetylsalicylic acid 10%x", "***", "warfarin\tsodium", "{n} tablets 20 unit dose")


def _raw_name(engine: str) -> str:
    """Part names as they might be written in reports."""
    text = lambda r: " || ".join(f"'{x}'" if k % 2 == 0 else "p_name" for k, x in enumerate(r.split("{n}")[:1] + [y for x in r.split("{n}")[1:] for y in ("", x)]))
    return "CASE p_partkey % 13 " + " ".join(f"WHEN {k} THEN {text(r)}" for k, r in enumerate(_RAW)) + " END"


_CLEAN = "upper(regexp_replace(regexp_replace(raw, '^\\s+', ''), '\\s+$', ''))"
_CLEAN = f"regexp_replace({_CLEAN}, '\\s*\\d+(\\.\\d+)?\\s*(MG|MCG|MG/ML|MG/KG|ML|G|IU|UNIT|%|MG/L)\\b.*$', '', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '\\s+(TABLET|CAPSULE|INJECTION|ORAL|IV|TOPICAL|CREAM|GEL|SYRUP|PATCH|PILL)\\b.*$', '', 'g')"
_CLEAN = f"trim(regexp_replace(regexp_replace({_CLEAN}, '[^A-Z0-9 \\-/]', ' ', 'g'), '\\s+', ' ', 'g'))"
_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in SYNONYMS.items())


@add("normalize_names", f"SELECT id, nullif(coalesce(generic, n), '') AS name FROM (SELECT id, {_CLEAN} AS n FROM (SELECT p_partkey AS id, {_raw_name('sql')} AS raw FROM part) r) c LEFT JOIN (VALUES {_VALUES}) s(brand, generic) ON brand = n")
def _names(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), normalize_name(F.expr(_raw_name("spark"))).alias("name"))


@add("json_props_extract", "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total_k, count(*) AS n FROM events GROUP BY 1")
def _props(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy("event_type").agg(F.sum(F.from_json("props", "k bigint")["k"]).alias("total_k"), F.count(F.lit(1)).alias("n"))


@add("nested_cross_product", "SELECT a.l_orderkey AS report, a.l_partkey AS left_id, b.l_suppkey AS right_id FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b USING (l_orderkey)")
def _nested(spark, d):
    n = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("report")).agg(F.collect_set("l_partkey").alias("x"), F.collect_set("l_suppkey").alias("y"))
    return n.select("report", F.explode("x").alias("left_id"), "y").select("report", "left_id", F.explode("y").alias("right_id"))


_BACK = f"""back AS (SELECT cutoff, count(warning_date) AS future_warnings, count(h) AS caught, coalesce(median(CASE WHEN h = 1 THEN date_diff('day', fd, warning_date) END), median(CASE WHEN h = 1 THEN date_diff('day', CAST(cutoff AS DATE), warning_date) END)) AS lead,
 CASE WHEN count(CASE WHEN h = 1 THEN fd END) > 0 THEN 'first_detected' ELSE 'cutoff' END AS lead_basis FROM cutoffs LEFT JOIN (SELECT leads.*, h FROM leads LEFT JOIN (SELECT {KEY}, 1 AS h FROM sig WHERE prr > 2 AND ror > 2 AND case_count >= 3) s USING (drug_name, reaction_term)) z ON warning_date > CAST(cutoff AS DATE) GROUP BY 1)"""


def _backtest(spark, d):
    hits = _sig(spark, d).filter("prr > 2 AND ror > 2 AND case_count >= 3")
    return E.rule_backtest(hits, _leads(spark, d), warnings_ref(spark, d), CUTOFFS).select("cutoff", "future_warnings", "caught", "median_lead_days", "lead_basis", *_r("recall"), "median_lead_months")


_BACKSEL = "SELECT cutoff, future_warnings, caught, CAST(trunc(lead) AS INT) AS median_lead_days, lead_basis, round(caught / nullif(future_warnings, 0), 4) AS recall, round(lead / 30, 1) AS median_lead_months FROM back"
add("rule_backtest", f"{SIGNALS}, {WARN}, {CUT}, {LINE}, {LEADS}, {_BACK} {_BACKSEL}")(_backtest)
add("latest_backtest", f"{SIGNALS}, {WARN}, {CUT}, {LINE}, {LEADS}, {_BACK} {_BACKSEL} ORDER BY cutoff DESC LIMIT 1")(lambda spark, d: serving.latest_backtest(_backtest(spark, d)))

NEG = """neg AS (SELECT DISTINCT concat(p_brand, '/', CAST(p_size AS STRING)) AS drug_name, concat(p_type, '-MACHINERY') AS reaction_term FROM part WHERE p_partkey % 41 = 5)"""


def _negatives(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").filter("p_partkey % 41 = 5")
    return p.select(F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("drug_name"), F.concat("p_type", F.lit("-MACHINERY")).alias("reaction_term")).distinct()


_CTRL = " UNION ALL ".join(
    f"SELECT '{m}' AS method, (SELECT count(*) FROM neg) AS n_negatives, (SELECT count(*) FROM warn) AS n_positives, (SELECT count(*) FROM neg SEMI JOIN (SELECT * FROM sig WHERE {c}) USING (drug_name, reaction_term)) AS fp, (SELECT count(*) FROM warn SEMI JOIN (SELECT * FROM sig WHERE {c}) USING (drug_name, reaction_term)) AS tp" for m, c in E.CONTROL_RULES.items()
)
add("negative_controls", f"{SIGNALS}, {WARN}, {NEG} SELECT *, round(coalesce(fp / nullif(n_negatives, 0), 0), 4) AS fp_rate, round(coalesce(tp / nullif(n_positives, 0), 0), 4) AS recall, round(1 - coalesce(fp / nullif(n_negatives, 0), 0), 4) AS specificity FROM ({_CTRL}) c")(
    lambda spark, d: E.control_rates(_sig(spark, d), _negatives(spark, d), warnings_ref(spark, d)).select("method", "n_negatives", "n_positives", "fp", "tp", *_r("fp_rate", "recall", "specificity"))
)
_labelled = lambda spark, d: _keep(E.score_matrix(_long(spark, d)).join(warnings_ref(spark, d).select(*P, F.lit(1).alias("y")), list(P), "left").na.fill(0, ["y"]))
_WIDE = f"wide AS (SELECT m.*, CASE WHEN w.warning_date IS NULL THEN 0 ELSE 1 END AS y FROM (SELECT {KEY}, " + ", ".join(f"coalesce(max(CASE WHEN method = '{m}' THEN score END), 0) AS {m}" for m in E.METHODS) + " FROM long GROUP BY 1, 2) m LEFT JOIN warn w USING (drug_name, reaction_term))"
_CELLS = "cells AS (" + " UNION ALL ".join(f"SELECT {KEY}, y, '{m}' AS method, {m} AS score FROM wide" for m in E.METHODS) + ")"
_BYSCORE = "bys AS (SELECT method, score, sum(y) AS p, count(*) AS n, count(*) - sum(y) AS q FROM cells GROUP BY 1, 2)"
add("average_precision", f"{BRANK}, {WARN}, {_WIDE}, {_CELLS}, {_BYSCORE} SELECT method, round(sum(p * tp / seen) / nullif(sum(p), 0), 6) AS average_precision FROM (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM bys WINDOW w AS (PARTITION BY method ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) c GROUP BY 1")(
    lambda spark, d: E.average_precision(_labelled(spark, d).unpivot([*P, "y"], list(E.METHODS), "method", "score"), "y", "score", ["method"]).select("method", _round("average_precision", 6).alias("average_precision"))
)
_PROB = "1 / (1 + exp(-ic))"
add("calibration_bins", f"{BSIG}, {WARN} SELECT CAST(k.bin AS INT) AS bin, round(avg(pr), 4) AS mean_pred, round(avg(y), 4) AS obs_rate, count(pr) AS n FROM (SELECT unnest(range(0, 10)) AS bin) k LEFT JOIN (SELECT {_PROB} AS pr, CASE WHEN warning_date IS NULL THEN 0 ELSE 1 END AS y FROM bayes LEFT JOIN warn USING (drug_name, reaction_term)) s ON k.bin = least(floor(pr * 10), 9) GROUP BY 1")(
    lambda spark, d: E.calibration(_bayes(spark, d).join(warnings_ref(spark, d), list(P), "left").select(F.expr(_PROB).alias("pr"), F.col("warning_date").isNotNull().cast("int").alias("y")), "y", "pr").select("bin", "n", *_r("mean_pred", "obs_rate"))
)
add("mcnemar_matrix", f"{EVAL}, mm AS (SELECT a.method AS method_a, b.method AS method_b, count(*) FILTER (a.caught = 0 AND b.caught > 0) AS b01, count(*) FILTER (a.caught > 0 AND b.caught = 0) AS b10 FROM ev a JOIN ev b USING (cutoff) WHERE a.method < b.method GROUP BY 1, 2) SELECT *, round(least(1, 2 * list_sum(list_transform(range(0, least(b01, b10) + 1), lambda i: exp(lgamma(b01 + b10 + 1) - lgamma(i + 1) - lgamma(b01 + b10 - i + 1)))) / power(2.0, b01 + b10)), 4) AS p FROM mm")(
    lambda spark, d: E.mcnemar_matrix(_threshold(spark, d)).select("method_a", "method_b", "b01", "b10", *_r("p"))
)
_M = list(E.METHODS)
_VS = lambda m: f"max(CASE WHEN method = '{m}' THEN CASE WHEN y = 1 THEN v10 ELSE v01 END END) AS {m}"
_COV = lambda a, b: f"(coalesce(covar_samp({a}, {b}) FILTER (y = 1), 0) / count(*) FILTER (y = 1) + coalesce(covar_samp({a}, {b}) FILTER (y = 0), 0) / count(*) FILTER (y = 0))"
_TESTS = " UNION ALL ".join(f"SELECT '{a}' AS method_a, '{b}' AS method_b, avg({a}) FILTER (y = 1) AS auc_a, avg({b}) FILTER (y = 1) AS auc_b, {_COV(a, a)} + {_COV(b, b)} - 2 * {_COV(a, b)} AS v FROM vs" for i, a in enumerate(_M) for b in _M[i + 1 :])
add(
    "delong_matrix",
    f"""{BRANK}, {WARN}, {_WIDE}, {_CELLS}, {_BYSCORE}, placed AS (SELECT method, score, (coalesce(sum(q) OVER b, 0) + q / 2) / sum(q) OVER w AS v10, (sum(p) OVER w - coalesce(sum(p) OVER b, 0) - p / 2) / sum(p) OVER w AS v01 FROM bys WINDOW w AS (PARTITION BY method), b AS (PARTITION BY method ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 vs AS (SELECT {KEY}, y, {', '.join(map(_VS, _M))} FROM cells JOIN placed USING (method, score) GROUP BY 1, 2, 3), tests AS ({_TESTS}), zs AS (SELECT *, CASE WHEN v <= 1e-14 AND abs(auc_a - auc_b) <= 1e-14 THEN 0.0 WHEN v <= 1e-14 THEN sign(auc_a - auc_b) * CAST('inf' AS DOUBLE) ELSE (auc_a - auc_b) / sqrt(greatest(v, 1e-14)) END AS z FROM tests)
 SELECT method_a, method_b, {_rs('auc_a', 'auc_b')}, round(z, 3) AS z, round(CASE WHEN v <= 1e-14 THEN CASE WHEN z = 0 THEN 1.0 ELSE 0.0 END WHEN abs(z) / sqrt(2) > 6 THEN 0.0 WHEN z = 0 THEN 1.0 ELSE greatest(0, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 251), lambda k: exp((2 * k + 1) * ln(abs(z) / sqrt(2)) - z * z / 2 + 2 * k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2))))) END, 3) AS p FROM zs""",
)(lambda spark, d: E.delong_matrix(_labelled(spark, d), "y", _M).select("method_a", "method_b", *_r("auc_a", "auc_b"), _round("z", 3).alias("z"), _round("p", 3).alias("p")))
_over_signals("signal_lookup", lambda s: serving.lookup(s, "brand#2/11", "economy-building").select(*P, "case_count", "signal_status"), f"SELECT {KEY}, case_count, signal_status FROM sig WHERE upper(drug_name) = 'BRAND#2/11' AND upper(reaction_term) = 'ECONOMY-BUILDING' LIMIT 1")
_over_facts("dataset_table", lambda f: G.pair_counts(f).agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("drug_name").alias("drugs"), F.count_distinct("reaction_term").alias("reactions"), F.sum("case_count").alias("cases")), "SELECT count(*) AS pairs, count(DISTINCT drug_name) AS drugs, count(DISTINCT reaction_term) AS reactions, CAST(sum(case_count) AS BIGINT) AS cases FROM pairs", f", {A}")
_over_signals(
    "snapshot_export",
    lambda s: serving.snapshot(s, 2000).select("id", *P, "passes_structural_filter", *_r("robust_signal_score")),
    f"SELECT CAST(row_number() OVER (ORDER BY passes_structural_filter DESC, robust_signal_score DESC, {KEY}) AS INT) AS id, {KEY}, passes_structural_filter, round(robust_signal_score, 4) AS robust_signal_score FROM sig WHERE passes_robust_filter ORDER BY id LIMIT 2000",
)
_over_facts(
    "pair_features",
    lambda f: f.groupBy(*P).agg(F.count_distinct("safetyreportid").alias("reports"), F.avg("age_years").alias("mean_age"), F.stddev_samp("age_years").alias("std_age"), F.avg((F.col("patient_sex_int") == 2).cast("double")).alias("female_ratio")).select(*P, "reports", *_r("mean_age", "std_age", "female_ratio")),
    f"SELECT {KEY}, count(DISTINCT safetyreportid) AS reports, round(avg(age_years), 4) AS mean_age, round(stddev_samp(age_years), 4) AS std_age, round(avg(CASE WHEN patient_sex_int = 2 THEN 1.0 ELSE 0.0 END), 4) AS female_ratio FROM fact GROUP BY 1, 2",
)
_HASH = "md5(concat(drug_name, '|', reaction_term, '|42'))"
add("undersample", f"{_FEAT} SELECT {KEY}, label FROM feat WHERE label = 1 UNION ALL SELECT {KEY}, label FROM (SELECT *, row_number() OVER (ORDER BY {_HASH}, {KEY}) AS rn FROM feat WHERE label = 0) n WHERE rn <= 5 * (SELECT count(*) FROM feat WHERE label = 1)")(lambda spark, d: M.undersample(_feat(spark, d)).select(*P, "label"))
add("train_test_split", f"{_FEAT} SELECT {KEY}, label, CASE WHEN CAST(concat('0x', substring({_HASH}, 1, 8)) AS BIGINT) % 100 < 80 THEN 'train' ELSE 'test' END AS fold FROM feat")(lambda spark, d: M.split(_feat(spark, d)).select(*P, "label", "fold"))


def _scores(spark, d):
    feats = _feat(spark, d)
    return M.score(M.fit(M.undersample(M.split(feats).filter("fold = 'train'"))), feats)


add("model_scores")(_scores)
add("predictions_top")(lambda spark, d: _scores(spark, d).filter("signal_probability >= 0.5").orderBy(F.desc("signal_probability"), *P).limit(100))
add("bootstrap_ci")(lambda spark, d: E.summary_intervals(_threshold(spark, d)))


_over_facts("facts_until_cutoff", lambda f: G.pair_counts(f, cutoff="1996-12-31").select(*P, "case_count", "last_date"), f"SELECT {KEY}, count(DISTINCT safetyreportid) AS case_count, max(report_date) AS last_date FROM fact WHERE ({_SUSPECT}) AND report_date <= DATE '1996-12-31' GROUP BY 1, 2")
_over_signals(
    "capped_flags",
    lambda s: s.select(*P, S.capped("chi2", 50.0).alias("capped"), S.capped("chi2", 20.0).alias("sentinel"), *_r("chi2_capped")),
    f"SELECT {KEY}, coalesce(chi2 >= 50, false) AS capped, coalesce(chi2 >= 20, false) AS sentinel, round(chi2_capped, 4) AS chi2_capped FROM sig",
)
_over_signals(
    "serving_confidence",
    lambda s: s.select(*P, S.confidence(variant="serving").alias("confidence")),
    f"SELECT {KEY}, CASE WHEN case_count >= 10 AND prr >= 4 AND ror >= 4 THEN 'HIGH' WHEN case_count >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM sig",
)
add(
    "quality_sql_variant",
    f"""{SIGNALS} SELECT {KEY}, CASE WHEN NOT coalesce(prr > 2 AND ror > 2 AND chi2 >= 4, true) THEN 'not_prr_ror_signal' WHEN case_count < 5 THEN 'too_few_cases' WHEN countries_count < 3 THEN 'low_source_diversity_proxy' WHEN serious_ratio < 0.01 THEN 'low_seriousness_ratio' WHEN prr > 1e5 OR ror > 1e5 THEN 'extreme_ratio_artifact' WHEN chi2 < 0 THEN 'invalid_negative_chi_square' ELSE 'passes_robust_filter' END AS artifact_reason,
 coalesce(case_count >= 5 AND countries_count >= 3 AND serious_ratio >= 0.01 AND prr BETWEEN 2 AND 1e5 AND ror BETWEEN 2 AND 1e5 AND chi2 >= 4, false) AS passes_robust_filter FROM sig""",
)(lambda spark, d: G.signals_of(_keep(G.pair_counts(fact_events(spark, d))), q=QualityRules(variant="sql")).select(*P, "artifact_reason", "passes_robust_filter"))
add("sql_named_arguments", f"{SIGNALS} SELECT {KEY}, case_count FROM sig WHERE contains(drug_name, 'Brand#2') AND case_count >= 2 ORDER BY sig.prr DESC NULLS LAST, {KEY} LIMIT 30")(
    lambda spark, d: Q.run_sql(spark, f"SELECT {KEY}, case_count FROM {{signals}} WHERE contains(drug_name, :drug) AND case_count >= :least ORDER BY prr DESC NULLS LAST, {KEY} LIMIT 30", {"signals": _sig(spark, d)}, drug="Brand#2", least=2)
)
_over_signals("report_table", lambda s: serving.formatted(s.groupBy("signal_status").agg(F.count(F.lit(1)).alias("pairs"), F.sum("case_count").alias("cases"))), "SELECT signal_status, format('{:,}', count(*)) AS pairs, format('{:,}', CAST(sum(case_count) AS BIGINT)) AS cases FROM sig GROUP BY 1")
_over_facts("quarter_labels", lambda f: f.groupBy(Q.quarter_label().alias("quarter")).agg(F.count(F.lit(1)).alias("n")), "SELECT concat(report_year, '-', lpad(CAST(report_quarter * 3 AS VARCHAR), 2, '0')) AS quarter, count(*) AS n FROM fact GROUP BY 1")
add("average_ranks", f"{BRANK} SELECT method, {KEY}, rank() OVER (PARTITION BY method ORDER BY score DESC) + (count(*) OVER (PARTITION BY method, score) - 1) / 2.0 AS avg_rank FROM long WHERE method IN ('case_count', 'prr')")(
    lambda spark, d: E.average_rank(_long(spark, d).filter("method IN ('case_count', 'prr')"), "score", ["method"]).select("method", *P, "avg_rank")
)
