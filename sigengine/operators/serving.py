"""Look-ups over the signal table: each returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigengine.operators.signals import PAIR


def search(sig: DataFrame, drug: str | None = None, reaction: str | None = None, status: str | None = None, confidence: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    for c, v in (("drug_name", drug), ("reaction_term", reaction)):
        sig = sig.filter(F.contains(F.upper(c), F.upper(F.lit(v)))) if v else sig
    for c, v in (("signal_status", status), ("confidence", confidence)):
        sig = sig.filter(F.col(c) == v) if v else sig
    return sig.orderBy(F.desc_nulls_last("prr"), *PAIR).offset(offset).limit(limit)


def lookup(sig: DataFrame, drug: str, reaction: str) -> DataFrame:
    """The first pair, by name, that equals the two names but for case."""
    return sig.filter((F.upper("drug_name") == drug.upper()) & (F.upper("reaction_term") == reaction.upper())).orderBy(*PAIR).limit(1)


def top(sig: DataFrame, n: int, *by: str) -> DataFrame:
    return sig.orderBy(*[F.desc_nulls_last(c) for c in by], *PAIR).limit(n)


def serving_stats(sig: DataFrame) -> DataFrame:
    return sig.agg(F.count(F.lit(1)).alias("total_signals"), F.count_if(F.expr("signal_status = 'STRONG_SIGNAL'")).alias("strong_signals"), F.count_if(F.expr("confidence = 'HIGH'")).alias("high_confidence"), F.max("grand_total").alias("grand_total"))


def histogram(sig: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    return sig.filter(F.col(column).between(low, high)).groupBy(F.least(F.width_bucket(column, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def snapshot(sig: DataFrame, n: int) -> DataFrame:
    """The first ``n`` robust signals, structural ones first, numbered from 1; only those are gathered to be numbered."""
    order = [F.desc("passes_structural_filter"), F.desc("robust_signal_score"), *PAIR]
    return sig.filter("passes_robust_filter").orderBy(*order).limit(n).withColumn("id", F.row_number().over(Window.orderBy(*order)))


def with_signals(predictions: DataFrame, sig: DataFrame) -> DataFrame:
    """Predictions beside what the signal table says of their pairs; pairs without a signal row stay, with nulls."""
    return predictions.join(sig.select(*PAIR, "case_count", "prr", "ror", "signal_status", "confidence"), PAIR, "left")


def top_predictions(predictions: DataFrame, least: float = 0.5, n: int = 100) -> DataFrame:
    return predictions.filter(F.col("signal_probability") >= least).orderBy(F.desc("signal_probability"), *PAIR).limit(n)


def latest_backtest(results: DataFrame, by: str = "cutoff") -> DataFrame:
    return results.orderBy(F.desc(by)).limit(1)


def leaderboard(evaluated: DataFrame) -> DataFrame:
    """Methods by warnings caught over all cutoffs, then by pooled recall, numbered from 1."""
    from sigengine.operators.evaluation import pooled_recall

    w = Window.orderBy(F.desc("caught"), F.desc("pooled_recall"), "method")  # a row a method
    return pooled_recall(evaluated).withColumn("place", F.row_number().over(w))


def health(**tables: DataFrame) -> DataFrame:
    """(table, rows, ok): whether each table can be read and has rows; unreadable ones are no error here."""
    from functools import reduce

    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    spark, out = None, []
    for name, t in tables.items():
        spark = spark or t.sparkSession
        try:
            n = t.count()
        except (PySparkException, Py4JJavaError):
            n = None
        out.append(spark.createDataFrame([(name, n, bool(n))], "table string, rows long, ok boolean"))
    return reduce(DataFrame.unionByName, out)


def formatted(df: DataFrame, digits: int = 4) -> DataFrame:
    """The cells of a report table as text: doubles with fixed digits, whole numbers with separators, nulls as a dash."""
    kinds = dict(df.dtypes)
    text = lambda c: F.format_number(c, digits) if kinds[c] in ("double", "float") else F.format_number(c, 0) if kinds[c] in ("bigint", "int") else F.col(c).cast("string")
    return df.select([F.coalesce(text(c), F.lit("-")).alias(c) for c in df.columns])
