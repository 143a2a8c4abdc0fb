"""The quarterly signal pipeline: ordered stages, each written before the next one reads it."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigengine.functions.names import normalize_name
from sigengine.operators import signals as G
from sigengine.sources import reports as R


@dataclass
class Pipeline:
    """Named stages, run in order; a stage that fails is tried again ``retries`` times and then ends the run."""

    stages: list[tuple[str, Callable[[], object]]]
    retries: int = 1
    log: list[dict] = field(default_factory=list)

    def run(self, since: str | None = None) -> list[dict]:
        """Run all stages, or those from ``since`` on after a run that ended early."""
        names = [n for n, _ in self.stages]
        for name, stage in self.stages[names.index(since) if since else 0 :]:
            for attempt in range(1, self.retries + 2):
                began = time.time()
                try:
                    stage()
                    self.log.append({"stage": name, "attempt": attempt, "status": "done", "seconds": round(time.time() - began, 3)})
                    break
                except Exception as e:
                    self.log.append({"stage": name, "attempt": attempt, "status": "failed", "error": str(e)[:500]})
                    if attempt > self.retries:
                        raise
        return self.log

    def report(self) -> str:
        return "\n".join(map(json.dumps, self.log))


def clean_facts(flat: DataFrame) -> DataFrame:
    """Flattened reports with generic drug names, sane ages and one row a report and pair."""
    return G.clean(flat.withColumn("drug_name", normalize_name(F.col("drug_name"))))


def quarterly(spark: SparkSession, documents: str, warnings_csv: str, root: str) -> Pipeline:
    """Parse report documents, clean them into their quarters, then rebuild counts, signals, trends, crossings and features.

    Parsing and cleaning replace the quarters they meet and leave others, so a late or repeated quarter is only run again.
    """
    at = lambda name: f"{root}/{name}"
    read = lambda name: spark.read.parquet(at(name))
    put = lambda df, name: df.write.mode("overwrite").parquet(at(name))
    met: list[tuple[int, int]] = []

    def parse() -> None:
        R.write_quarters(R.flatten(R.read_reports(spark, documents)), at("raw"))

    def clean() -> None:
        met[:] = [tuple(r) for r in R.flatten(R.read_reports(spark, documents)).select(*G.QUARTER).distinct().collect()]  # quarters, not reports
        some = spark.createDataFrame(met, "report_year int, report_quarter int")
        R.write_quarters(clean_facts(read("raw").join(F.broadcast(some), G.QUARTER, "left_semi")), at("facts"))

    return Pipeline(
        [
            ("parse", parse),
            ("clean", clean),
            ("pairs", lambda: put(G.pair_counts(read("facts")), "pairs")),
            ("signals", lambda: put(G.bayes(G.signals_of(read("pairs"))), "signals")),
            ("trends", lambda: put(G.trends(read("facts")), "trends")),
            ("crossings", lambda: put(G.first_crossing(read("facts")), "crossings")),
            ("features", lambda: put(G.features(read("facts"), R.read_pairs(spark, warnings_csv), "2002-01-01"), "features")),
        ]
    )
