import io
import json

import pytest
from pyspark.sql import functions as F

from sigengine.plans.catalogue import quarter_folders
from sigengine.plans.pipeline import Pipeline, quarterly
from sigengine.sources import query as Q
from sigengine.sources import reports as R
from sigengine.sources import sinks as K


def test_overwrite_replaces_everything(spark, tmp_path):
    p = str(tmp_path / "t")
    K.overwrite(spark.range(10).withColumn("k", F.col("id") % 3), p, "k")
    K.overwrite(spark.range(2).withColumn("k", F.lit(7)), p, "k")
    assert sorted(r.k for r in spark.read.parquet(p).collect()) == [7, 7]


def test_tables_and_rows(spark, tmp_path):
    try:
        K.create_table_as(spark.sql("SELECT 1 AS a, 'x' AS b"), "sig_sink")
        K.create_table_as(spark.sql("SELECT 2 AS a, CAST(NULL AS STRING) AS b"), "sig_sink")
        K.append_row(spark, "sig_sink", a=5)
        assert sorted((r.a, r.b) for r in spark.table("sig_sink").collect()) == [(2, None), (5, None)]
        with pytest.raises(ValueError):
            K.append_row(spark, "sig_sink", c=1)
    finally:
        K.drop_tables(spark, "sig_sink", "sig_none")
    assert not spark.catalog.tableExists("sig_sink")


def test_text_artefacts(spark, tmp_path):
    d = spark.sql("SELECT 1 AS id, double('NaN') AS x, double('-Infinity') AS y, 2.5D AS z")
    K.write_csv(d, str(tmp_path / "c"))
    K.write_json(d, str(tmp_path / "j"))
    K.write_report(d, str(tmp_path / "r.json"))
    row = {"id": 1, "x": None, "y": None, "z": 2.5}
    assert json.loads((tmp_path / "r.json").read_text()) == [row]
    assert [json.loads(x) for f in (tmp_path / "j").glob("part*") for x in f.read_text().splitlines()] == [row]
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().asDict() == {"id": "1", "x": None, "y": None, "z": "2.5"}
    with pytest.raises(ValueError):
        K.write_report(spark.range(3), str(tmp_path / "x.json"), most=2)


def test_named_arguments_and_snapshot(spark, tmp_path):
    v = spark.createDataFrame([("a", 1), ("b'; --", 2)], "k string, n int")
    assert Q.run_sql(spark, "SELECT n FROM {t} WHERE k = :k", {"t": v}, k="b'; --").first().n == 2
    K.write_csv(v, str(tmp_path / "snap"))
    missing = lambda: spark.read.parquet(str(tmp_path / "none"))
    assert sorted(r.n for r in Q.or_snapshot(spark, missing, str(tmp_path / "snap"), "k string, n int").collect()) == [1, 2]
    assert Q.or_snapshot(spark, lambda: v, str(tmp_path / "none")).count() == 2


def test_scan_opens_wanted_folders_only(spark):
    d = Q.quarter_scan(spark, quarter_folders(spark, "/root/testdata/sf0.001"), 1995, 2, "1995-05-31")
    plan = d._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(report_year" in plan and "LessThanOrEqual(report_date,1995-05-31)" in plan
    files = d.select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all("report_year=1995/report_quarter=2" in r.f for r in files)


def test_manifest_and_fetch(tmp_path):
    m = {"results": {"drug": {"partitions": [{"display_name": f"{y} Q{q} (part 1 of 1)", "file": f"http://x/{y}q{q}.zip"} for y in (2019, 2020) for q in (1, 2)]}}}
    assert Q.wanted(m, year=2020, quarter=2) == ["http://x/2020q2.zip"] and len(Q.wanted(m, limit=3)) == 3
    tries = []

    def opener(address):
        tries.append(address)
        if len(tries) == 1:
            raise OSError("reset")
        return io.BytesIO(b"data")

    log = tmp_path / "log"
    assert list(Q.fetch(["http://x/a.zip"], str(tmp_path / "f"), wait=0, log=str(log), opener=opener)) == [str(tmp_path / "f" / "a.zip")]
    assert list(Q.fetch(["http://x/a.zip"], str(tmp_path / "f"), opener=opener)) and len(tries) == 2
    assert [json.loads(x)["status"] for x in log.read_text().splitlines()] == ["failed", "fetched"]
    with pytest.raises(OSError):
        list(Q.fetch(["http://x/b.zip"], str(tmp_path / "f"), tries=1, opener=lambda a: (_ for _ in ()).throw(OSError())))


def test_pipeline_retries_and_resumes():
    seen = []

    def fails_once():
        seen.append("b")
        if len(seen) == 2:
            raise RuntimeError("once")

    p = Pipeline([("a", lambda: seen.append("a")), ("b", fails_once)])
    assert [(x["stage"], x["status"]) for x in p.run()] == [("a", "done"), ("b", "failed"), ("b", "done")]
    p.run(since="b")
    assert seen == ["a", "b", "b", "b"]


def test_quarterly_pipeline_equals_one_pass(spark, tmp_path):
    def report(i, day, drugs, terms):
        return {"safetyreportid": str(i), "serious": "1", "receivedate": day, "occurcountry": "US", "patient": {"patientsex": "2", "patientonsetage": "40", "drug": [{"medicinalproduct": d, "drugcharacterization": "1"} for d in drugs], "reaction": [{"reactionmeddrapt": t} for t in terms]}}

    for q, day in (("2019q4", "20191105"), ("2020q1", "20200202")):
        (tmp_path / "docs" / q).mkdir(parents=True)
        (tmp_path / "docs" / q / "x.json").write_text(json.dumps({"results": [report(f"{q}{i}", day, ["Tylenol 5 mg", "bb"], ["rash", "ache"][: 1 + i % 2]) for i in range(6)]}))
    (tmp_path / "w.csv").write_text("drug_name,reaction_term,warning_date\nacetaminophen, rash,2021-01-01\n")
    root = str(tmp_path / "out")
    for q in ("2019q4", "2020q1", "2020q1"):
        log = quarterly(spark, str(tmp_path / "docs" / q), str(tmp_path / "w.csv"), root).run()
    assert [x["status"] for x in log] == ["done"] * 7
    pairs = {(r.drug_name, r.reaction_term): r.case_count for r in spark.read.parquet(root + "/pairs").collect()}
    assert pairs == {("ACETAMINOPHEN", "RASH"): 12, ("BB", "RASH"): 12, ("ACETAMINOPHEN", "ACHE"): 6, ("BB", "ACHE"): 6}
    assert {r.label for r in spark.read.parquet(root + "/features").filter("drug_name = 'ACETAMINOPHEN' AND reaction_term = 'RASH'").collect()} == {1}
    assert R.read_quarters(spark, root + "/facts", 2020, 1).count() == 18


def test_csv_pairs_and_quarter_token(spark, tmp_path):
    (tmp_path / "w.csv").write_text("drug_name,reaction_term,warning_date\n a ,x,2020-02-01\nA,X,2019-01-01\nb,y,bad\n")
    got = {(r.drug_name, r.reaction_term): str(r.warning_date) for r in R.read_pairs(spark, str(tmp_path / "w.csv")).collect()}
    assert got == {("A", "X"): "2019-01-01", ("B", "Y"): "None"}


def test_report_stream_equals_rebuild(spark, tmp_path):
    from sigengine.plans.pipeline import clean_facts
    from sigengine.streaming.incremental import stream_reports

    def put(q, day, n):
        (tmp_path / "docs" / q).mkdir(parents=True)
        one = lambda i: {"safetyreportid": f"{q}-{i}", "receivedate": day, "patient": {"drug": [{"medicinalproduct": "Advil 200 mg"}], "reaction": [{"reactionmeddrapt": "rash"}]}}
        (tmp_path / "docs" / q / "x.json").write_text(json.dumps({"results": [one(i) for i in range(n)]}))

    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    run = lambda: stream_reports(spark, docs, out, str(tmp_path / "cp"), clean_facts)
    put("2019q4", "20191105", 3)
    run()
    put("2020q1", "20200202", 2)
    run()
    run()
    got = spark.read.parquet(out)
    want = clean_facts(R.flatten(R.read_reports(spark, docs + "/*")))
    columns = [c for c in want.columns if c in got.columns]
    assert got.count() == 5 and got.select(columns).exceptAll(want.select(columns)).count() == 0
    assert {(r.drug_name, r.report_year) for r in got.collect()} == {("IBUPROFEN", 2019), ("IBUPROFEN", 2020)}


def test_health(spark, tmp_path):
    from sigengine.operators.serving import health

    path = str(tmp_path / "gone")
    spark.range(2).write.parquet(path)
    lost = spark.read.parquet(path)
    import shutil

    shutil.rmtree(path)
    got = {r.table: (r.rows, r.ok) for r in health(good=spark.range(3), empty=spark.range(0), lost=lost).collect()}
    assert got == {"good": (3, True), "empty": (0, False), "lost": (None, False)}
