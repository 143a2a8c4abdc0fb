import json
import zipfile

import pytest

from sigengine.sources import catalog as C


def _zip(path, **members):
    with zipfile.ZipFile(path, "w") as z:
        for name, value in members.items():
            z.writestr(name.replace("_", "."), json.dumps(value))


def test_zipped_json(spark, tmp_path):
    _zip(tmp_path / "a.zip", a_json={"results": [{"id": 1}, {"id": 2}]}, notes_txt="x")
    got = C.read_zipped_json(spark, str(tmp_path), "results array<struct<id: int>>").selectExpr("inline(results)").collect()
    assert sorted(r.id for r in got) == [1, 2]
    _zip(tmp_path / "b.zip", a_json={}, b_json={})
    with pytest.raises(Exception, match="2 JSON members"):
        C.read_zipped_json(spark, str(tmp_path), "results array<struct<id: int>>").collect()


def test_catalogue_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(4).selectExpr("id", "CAST(2000 + id % 2 AS INT) AS y").write.partitionBy("y").parquet(path)
    try:
        C.register(spark, "sig_t", "id BIGINT, y INT", ["y"], path)
        C.add_partition(spark, "sig_t", y=2005)
        C.add_partition(spark, "sig_t", y=2005)
        C.analyze(spark, "sig_t", "id")
        assert spark.table("sig_t").count() == 4
        assert spark.sql("SHOW PARTITIONS sig_t").count() == 3
    finally:
        spark.sql("DROP TABLE IF EXISTS sig_t")
