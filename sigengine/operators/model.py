"""Training sets and the supervised ranking: dated labels, undersampling, split, boosted trees, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigengine.operators.signals import PAIR

FEATURES = ["case_count", "prr", "ror", "chi2", "serious_ratio", "death_ratio", "hosp_ratio", "countries_count", "mean_age", "std_age", "female_ratio", "qoq_growth", "n_concurrent_signals", "days_since_first_report"]


def pair_hash(seed: int) -> Column:
    """A stable pseudo-random hexadecimal string of a pair: the same on every engine and partitioning."""
    return F.md5(F.concat_ws("|", *PAIR, F.lit(str(seed))).cast("binary"))


def undersample(train: DataFrame, label: str = "label", ratio: int = 5, seed: int = 42) -> DataFrame:
    """All positives and ``ratio`` negatives for each, those of the smallest hashes; all rows if there are no positives.

    The hash under which negatives stay is found over hashes and labels only (one count, then one sort of a sample's
    size), so the features are not computed for it more than once more.
    """
    keyed = train.select(F.col(label).alias("y"), pair_hash(seed).alias("h"), *PAIR)
    n = keyed.filter("y = 1").count()
    if not n:
        return train
    last = keyed.filter("y != 1").orderBy("h", *PAIR).limit(ratio * n).agg(F.max("h")).first()[0] or ""
    return train.filter((F.col(label) == 1) | ((F.col(label) != 1) & (pair_hash(seed) <= last)))


def split(train: DataFrame, percent: int = 80, seed: int = 42) -> DataFrame:
    """``fold`` is train or test by the pair's hash, which is independent of the label: each class is split alike."""
    part = F.conv(F.substring(pair_hash(seed), 1, 8), 16, 10).cast("long") % 100
    return train.withColumn("fold", F.when(part < percent, "train").otherwise("test"))


def _vectors(d: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    filled = d.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(f"__{c}") for c in FEATURES])
    return VectorAssembler(inputCols=[f"__{c}" for c in FEATURES], outputCol="__x").transform(filled)


def fit(train: DataFrame, trees: int = 20, depth: int = 4, step: float = 0.1, seed: int = 42):
    """Boosted trees over the features; nulls count as -1."""
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(featuresCol="__x", labelCol="__y", maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=0.9, seed=seed).fit(_vectors(train).withColumn("__y", F.col("label").cast("double")))


VERSION = "boosted-trees-1"


def predictions(probabilities: DataFrame, predicted_on: str, threshold: float = 0.5, version: str = VERSION) -> DataFrame:
    """The prediction table: rows with ``p`` get the rounded probability (half to even), the class, the version and the days
    from the prediction to the pair's warning (negative: the prediction is late; null: no warning)."""
    out = probabilities.withColumns(
        {
            "signal_probability": F.bround("p", 4),
            "predicted": (F.col("p") >= threshold).cast("int"),
            "predicted_on": F.lit(predicted_on).cast("date"),
            "model_version": F.lit(version),
        }
    ).drop("p")
    return out.withColumn("days_predicted_early", F.datediff("warning_date", "predicted_on")) if "warning_date" in out.columns else out


def score(model, feats: DataFrame, threshold: float = 0.5, predicted_on: str = "2002-01-01") -> DataFrame:
    """(pair, label, warning_date, signal_probability, predicted, predicted_on, model_version, days_predicted_early)."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(_vectors(feats)).select(*PAIR, "label", *[c for c in ("warning_date",) if c in feats.columns], vector_to_array("probability")[1].alias("p"))
    return predictions(scored, predicted_on, threshold)
