"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import time
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigengine.sources.shared import remove, shared_folder

#: Word separators of the contracts: space and \x09-\x0D.
SPACES = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, *superseded: DataFrame, wait: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there: lost executors cost no recomputation.

    The folder is ``spark.checkpoint.dir``; only where that is unset on one machine (tests) a temporary one is made.
    The files of ``superseded``, earlier cuts that nothing reads any more, are removed once ``df`` is written. With
    ``wait`` the shuffle files of the step before are gone before ``df`` is computed.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    if wait:
        settle(spark)
    else:
        gc.collect()
        sc._jvm.System.gc()
    out = df.checkpoint(eager=True)
    for old in superseded:
        file = old._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            remove(spark, file.get())
    return out


def settle(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files that nothing refers to any more, which an idle driver would notice late."""
    gc.collect()
    time.sleep(1.2)  # references held for Python are given up within a second
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)


def python_ready(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch of whole texts holds, and send this package to the executors once a context."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    sc = spark.sparkContext
    if getattr(sc, "_sigengine_sent", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="sigengine-"), "sigengine_code.zip")  # served from here while the context lives
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._sigengine_sent = True


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row: a one-element transform keeps it from being inlined."""
    return F.transform(F.array(value), body)[0]


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def lower_ascii(text: str) -> str:
    """Lower-case A-Z only."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}
