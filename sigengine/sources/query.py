"""Queries with named arguments over tables, a database or the last snapshot; partition scans; fetching of files."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_sql(spark: SparkSession, text: str, views: dict[str, DataFrame] | None = None, **args) -> DataFrame:
    """A query with arguments ``:name``; ``views`` are known to it under their names ``{name}``. Arguments are never part of the text."""
    return spark.sql(text, args=args, **(views or {}))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 8, **options: str) -> DataFrame:
    """A database table; with a numeric ``column`` it is read by ``parts`` tasks, each with its own range."""
    more = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)} if column else {}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **more, **options).load()


def or_snapshot(spark: SparkSession, live: Callable[[], DataFrame], snapshot: str, schema: str | None = None) -> DataFrame:
    """What ``live`` returns, if its first row can be read; else the CSV snapshot with a header."""
    try:
        df = live()
        df.limit(1).collect()
        return df
    except (PySparkException, Py4JJavaError, OSError):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(snapshot)


def quarter_scan(spark: SparkSession, path: str, year: int | None = None, quarter: int | None = None, until: str | None = None) -> DataFrame:
    """Facts of all quarters or of one, up to a date; folders of other quarters are not opened, nor row groups of later dates."""
    d = spark.read.parquet(path)
    d = d.filter(F.col("report_year") == year) if year is not None else d
    d = d.filter(F.col("report_quarter") == quarter) if quarter is not None else d
    return d.filter(F.col("report_date") <= F.lit(until).cast("date")) if until else d


def quarter_label(year: str = "report_year", quarter: str = "report_quarter"):
    """Such as 2019-04: the last month of the quarter, with two digits."""
    return F.concat_ws("-", F.col(year).cast("string"), F.lpad((F.col(quarter) * 3).cast("string"), 2, "0"))


def wanted(manifest: dict, year: int | None = None, quarter: int | None = None, limit: int | None = None, event: str = "drug") -> list[str]:
    """Addresses of the manifest's report files (results -> event -> partitions) of a year or quarter, at most ``limit``."""
    out = []
    for p in manifest["results"][event]["partitions"]:
        name = p["display_name"].lower()  # such as "2019 q4 (part 1 of 30)"
        if (year is None or str(year) in name) and (quarter is None or f"q{quarter}" in name):
            out.append(p["file"])
    return out[:limit]


def fetch(addresses: list[str], folder: str, tries: int = 3, wait: float = 2.0, log: str | None = None, opener: Callable = urllib.request.urlopen) -> Iterator[str]:
    """Fetch files that are not there yet; a file has its name only once it is whole. Each outcome is a line of the log.

    After the n-th failure of an address the next try waits n times ``wait`` seconds; the last failure is raised.
    """
    into = Path(folder)
    into.mkdir(parents=True, exist_ok=True)

    def note(**what) -> None:
        if log:
            with open(log, "a") as f:
                f.write(json.dumps(what) + "\n")

    for address in addresses:
        target = into / address.rsplit("/", 1)[-1]
        if target.exists():
            note(address=address, status="present")
            yield str(target)
            continue
        for n in range(1, tries + 1):
            try:
                part = target.with_suffix(target.suffix + ".part")
                with opener(address) as source, part.open("wb") as out:
                    while block := source.read(1 << 20):
                        out.write(block)
                part.rename(target)
                note(address=address, status="fetched", bytes=target.stat().st_size)
                yield str(target)
                break
            except OSError as e:
                note(address=address, status="failed", attempt=n, error=str(e))
                if n == tries:
                    raise
                time.sleep(wait * n)
