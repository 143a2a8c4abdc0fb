"""Zipped report members, catalogue tables over partitioned Parquet, and a JDBC sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_zipped_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of ``schema`` from zip archives that hold one .json member each; any other number of them is an error.

    Archives are read by Spark's own reader, so ``path`` may lie in any store; an archive is unpacked in one task, and
    archives are dealt over the tasks.
    """

    def members(frames):
        import io
        import zipfile

        import pandas as pd

        for x in frames:
            out = []
            for path_, content in zip(x["path"], x["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if n.lower().endswith(".json")]
                    if len(names) != 1:
                        raise ValueError(f"{path_}: {len(names)} JSON members, one expected")
                    out.append(z.read(names[0]).decode("utf-8"))
            yield pd.DataFrame({"path": x["path"].to_numpy(), "text": out})

    texts = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "path string, text string")
    return texts.select(F.from_json("text", schema).alias("r")).select("r.*")


def register(spark: SparkSession, table: str, columns: str, partitions: list[str], location: str) -> None:
    """An external Parquet table over ``location``; its partitions are those found there."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet PARTITIONED BY ({', '.join(partitions)}) LOCATION '{location}'")
    spark.sql(f"MSCK REPAIR TABLE {table}")


def add_partition(spark: SparkSession, table: str, **values: int) -> None:
    """Make one partition known; known ones stay."""
    spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION ({', '.join(f'{k} = {v}' for k, v in values.items())})")


def analyze(spark: SparkSession, table: str, *columns: str) -> None:
    """Gather row counts, and statistics of ``columns`` for the cost-based optimizer."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS" + (f" FOR COLUMNS {', '.join(columns)}" if columns else ""))


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 5000, **options: str) -> None:
    """Empty ``table`` and fill it from ``df``; NaN becomes NULL."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(clean).write.format("jdbc").options(url=url, dbtable=table, truncate="true", batchsize=str(batch), **options).mode("overwrite").save()
