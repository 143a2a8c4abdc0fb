"""Writing of tables: whole, as catalogue tables, as text artefacts, or row by row."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def overwrite(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace everything at ``path``; a partition's rows go to few files, since its rows are brought together."""
    df = df.repartition(*partitions) if partitions else df
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partitions).parquet(path)


def create_table_as(df: DataFrame, table: str, *partitions: str) -> None:
    """Drop the table and make it anew from ``df``."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    df.write.format("parquet").partitionBy(*partitions).saveAsTable(table)


def drop_tables(spark: SparkSession, *tables: str) -> None:
    """Drop intermediate tables; missing ones are no error."""
    for t in tables:
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def clean_numbers(df: DataFrame) -> DataFrame:
    """NaN and infinities become null, for formats that have no such numbers."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c)
    return df.select([finite(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    clean_numbers(df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line; null fields are written."""
    clean_numbers(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_report(df: DataFrame, file: str, most: int = 10_000) -> None:
    """A small result as one JSON array in a local file of the driver; more rows than ``most`` are an error."""
    rows = clean_numbers(df).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them as a table")
    Path(file).write_text(json.dumps([r.asDict(recursive=True) for r in rows], indent=2, default=str))


def append_row(spark: SparkSession, table: str, **values) -> None:
    """Add one row, such as a back-test result, to a catalogue table; columns that are not given are null."""
    kinds = spark.table(table).schema
    if unknown := values.keys() - set(kinds.names):
        raise ValueError(f"no such columns in {table}: {sorted(unknown)}")
    row = spark.range(1).select([F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in kinds.fields])
    row.write.mode("append").insertInto(table)
