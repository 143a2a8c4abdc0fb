"""Quarterly increments: file streams whose batches replace their quarters, equal to a full rebuild."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigengine.sources.reports import REPORTS, flatten, write_quarters


def stream_quarters(spark: SparkSession, source: str, target: str, checkpoint: str, schema) -> None:
    """Take all new files of ``source`` (Parquet) once and replace the quarters they hold in ``target``."""

    def put(batch: DataFrame, _: int) -> None:
        write_quarters(batch, target)

    spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_reports(spark: SparkSession, source: str, target: str, checkpoint: str, clean: Callable[[DataFrame], DataFrame]) -> None:
    """Take all new report documents below ``source`` once: parse, clean, and replace the quarters they hold in ``target``.

    Files seen before are not read again; all new ones make one batch, so a quarter's files must arrive together.
    """

    def put(batch: DataFrame, _: int) -> None:
        write_quarters(clean(flatten(batch)), target)

    stream = spark.readStream.schema(REPORTS).option("multiLine", True).option("recursiveFileLookup", True).json(source).withColumn("__file", F.col("_metadata.file_path"))
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
