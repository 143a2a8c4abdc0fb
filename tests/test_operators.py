import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigengine.functions import stats as S
from sigengine.operators import evaluation as E
from sigengine.operators import signals as G
from sigengine.sources import reports as R
from sigengine.streaming.incremental import stream_quarters


def test_edge_cells(spark):
    rows = [("zero c", 5, 10, 5, 100), ("zero b", 5, 5, 20, 100), ("single", 5, 10, 5, 10), ("large", 3_000_000_000, 4_000_000_000, 5_000_000_000, 12_000_000_000)]
    d = G.cells(spark.createDataFrame(rows, "k string, case_count long, drug_total long, reaction_total long, grand_total long"))
    got = {r["k"]: r for r in d.select("k", S.prr().alias("p"), S.prr(null_rule="trend").alias("t"), S.ror().alias("r"), S.yates_chi2().alias("x")).collect()}
    assert got["zero c"]["p"] is None and got["zero c"]["r"] is None and got["zero c"]["x"] is not None
    assert got["zero b"]["r"] is None and got["zero b"]["p"] is not None and got["zero b"]["t"] is None
    assert got["single"]["p"] is None and got["single"]["x"] is None
    assert math.isfinite(got["large"]["x"])


def _gamma_cdf(s, x):
    """The regularised lower incomplete gamma function, term by term."""
    term = total = 1.0
    k = 0
    while term > 1e-17 * total:
        k += 1
        term *= x / (s + k)
        total += term
    return math.exp(s * math.log(x) - x - math.lgamma(s + 1)) * total


def test_eb05(spark):
    counts = [1, 3, 10, 400, 999, 1000, 1300, 1500, 10**4, 10**5, 10**6, 10**7]
    d = spark.createDataFrame([(3, 9e-6), (400, 180.0), *[(n, 0.5) for n in counts]], "n long, e double")
    got = [r[0] for r in d.select(S.eb05(cases="n", exp=F.col("e"))).collect()]
    assert got[:2] == pytest.approx([2.1673, 2.0397], abs=1e-4)
    for n, q in zip(counts, got[2:]):
        # a relative error of 1e-6 of the quantile moves the probability by its density there
        s = n + 0.5
        slope = math.exp(s * math.log(q) - q - math.lgamma(s))
        assert abs(_gamma_cdf(s, q) - 0.05) < max(1e-6 * slope, 3e-9 * n**0.5), n
        assert q < s


def test_tests_on_pairs():
    assert [E.mcnemar_p(*x) for x in ((0, 0), (0, 5), (3, 7))] == [1.0, 0.0625, 0.34375]
    assert E.binomial_ci(2, 7) == pytest.approx((0, 0.7143), abs=1e-4)
    assert math.isnan(E.binomial_ci(0, 0)[0])
    y = [0, 0, 0, 1, 1, 1]
    assert E.delong(y, [1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6])[2:] == (0.0, 1.0)
    with pytest.raises(ValueError):
        E.delong([1, 1], [1, 2], [1, 2])
    s = E.ranking_stability({"ic025": [3, 3, 2, 0], "a": [2, 2, 1, 0], "b": [2, 2, 1, 0], "c": [2, 2, 1, 0], "d": [2, 2, 1, 0]})
    assert s["ic025"]["mean_rank"] == pytest.approx(1.008, abs=1e-3) and s["a"]["mean_rank"] == pytest.approx(3.498, abs=1e-3)


def test_reports(spark, tmp_path):
    drug = lambda n: None if n is None else {"medicinalproduct": n, "drugcharacterization": "1"}
    doc = {
        "results": [
            {"safetyreportid": "1", "serious": "1", "receivedate": "20200315", "occurcountry": None, "primarysourcecountry": "US", "patient": {"patientsex": "2", "patientonsetage": "abc", "drug": [drug(" a "), {"medicinalproduct": None}, drug("b")], "reaction": [{"reactionmeddrapt": "r1"}, {"reactionmeddrapt": None}, {"reactionmeddrapt": "r1"}, {"reactionmeddrapt": "r2"}]}},
            {"safetyreportid": "2", "receivedate": "2020133x", "patient": {"patientsex": "1"}},
        ]
    }
    (tmp_path / "2019q4").mkdir()
    (tmp_path / "2019q4" / "x.json").write_text(json.dumps(doc))
    flat = R.flatten(R.read_reports(spark, str(tmp_path / "2019q4")))
    rows = flat.collect()
    assert len(rows) == 6 and {(r["report_year"], r["report_quarter"]) for r in rows} == {(2019, 4)}
    assert {r["country"] for r in rows} == {"US"} and {r["age_years"] for r in rows} == {None}
    facts = flat.withColumn("drug_name", flat["drug_name"])
    assert facts.dropDuplicates(["safetyreportid", "drug_name", "reaction_term"]).count() == 4
    target = str(tmp_path / "facts")
    R.write_quarters(flat, target)
    R.write_quarters(flat, target)
    assert R.read_quarters(spark, target, 2019, 4).count() == 6


def test_stream_equals_batch(spark, tmp_path):
    from sigengine.sources.star import fact_events

    f = fact_events(spark, "/root/testdata/sf0.001").filter("report_year = 1995").cache()
    f.repartition(1).sortWithinPartitions("report_quarter").write.parquet(str(tmp_path / "in"))
    stream_quarters(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), f.schema)
    back = spark.read.parquet(str(tmp_path / "out")).select(f.columns)
    assert back.exceptAll(f).count() == 0 and f.exceptAll(back).count() == 0


def test_bootstrap_intervals():
    y, score = np.r_[np.zeros(20), np.ones(20)], np.r_[np.arange(20), np.arange(10, 30)]
    auc = lambda a, b: E.delong(a, b, b)[0]
    value, low, high = E.bootstrap_metric(y, score, auc, draws=200)
    assert low < value < high <= 1 and value == pytest.approx(auc(y, score))
    assert all(map(math.isnan, E.bootstrap_metric([], [], auc)))
    assert math.isnan(E.bootstrap_metric([0, 1], [1, 2], lambda a, b: 1.0 if len(set(b)) == 3 else float("nan"))[1])
    low, high = E.median_ci([1, 2, 3, None, float("nan"), 100], draws=200)
    assert 1 <= low <= 2.5 <= high <= 100
    assert all(map(math.isnan, E.median_ci([None])))


def test_bootstrap_auc_interval_holds_the_area(spark):
    r = np.random.default_rng(2)
    y = r.random(400) < 0.3
    d = spark.createDataFrame([("m", f"d{i}", f"r{i}", int(v), float(x)) for i, (v, x) in enumerate(zip(y, r.random(400) + 0.4 * y))], "method string, drug_name string, reaction_term string, y int, s double")
    auc = E.midrank_auc(d, "y", "s", ["method"]).first().auc
    got = E.bootstrap_auc(d, "y", "s", ["method"], draws=60).first()
    assert got.auc_low < auc < got.auc_high and got.auc_high - got.auc_low < 0.25


def test_grid_has_every_method_and_cutoff(spark):
    long = spark.createDataFrame([("prr", "a", "x", 2.0), ("prr", "b", "x", 1.0)], "method string, drug_name string, reaction_term string, score double")
    warn = spark.createDataFrame([("b", "x", "2001-03-01")], "drug_name string, reaction_term string, d string").selectExpr("drug_name", "reaction_term", "CAST(d AS DATE) AS warning_date")
    got = {(r.method, r.cutoff): r for r in E.evaluate(long, warn, ["2000-12-31", "2002-12-31"], methods=["prr", "ror"]).collect()}
    assert len(got) == 4
    a = got["prr", "2000-12-31"]
    assert (a.candidates, a.caught, a.recall, a.precision, a.median_lead_days, a.lead_basis) == (2, 1, 1.0, 0.5, 60, "cutoff")
    assert got["ror", "2000-12-31"].recall == 0 and got["ror", "2000-12-31"].precision is None
    assert got["prr", "2002-12-31"].recall is None and got["prr", "2002-12-31"].median_lead_days is None
    one = E.evaluate(long, warn, ["2000-12-31"], 1, methods=["prr"]).first()
    assert (one.candidates, one.caught, one.precision) == (2, 0, 0.0)


def test_features_of_a_cutoff(spark):
    rows = [("1", "a", "x", "2000-01-05", 30.0), ("2", "a", "x", "2000-05-05", 40.0), ("3", "a", "x", "2001-05-05", 99.0)]
    f = spark.createDataFrame(rows, "safetyreportid string, drug_name string, reaction_term string, d string, age_years double").selectExpr(
        "*", "CAST(d AS DATE) AS report_date", "year(d) AS report_year", "quarter(d) AS report_quarter", "'1' AS drug_role", "0 AS serious_int", "0 AS death_int", "0 AS hosp_int", "2 AS patient_sex_int", "'US' AS country"
    )
    none = spark.createDataFrame([], "drug_name string, reaction_term string, warning_date date")
    got = G.features(f, none, "2002-01-01", cutoff="2000-12-31").first()
    assert (got.case_count, got.mean_age, got.countries_count, got.female_ratio) == (2, 35.0, 1, 1.0)
    assert got.std_age == pytest.approx(math.sqrt(50))
    assert G.features(f, none, "2002-01-01").first().case_count == 3
