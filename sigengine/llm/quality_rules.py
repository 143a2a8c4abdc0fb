"""Quality rules with host verdicts, in DataFrame functions only.

Every document gets counts from its whole text; rule failures are aggregated by host, each host's failure rate is
shrunk with a beta prior fitted to all hosts, and hosts whose shrunk rate is over the limit reject their documents.

Defined results: a null or empty text has no words (it fails ``short``); a null host is no host, so that its documents
have only their own verdict; repeated rows and tied ids are rows of their own; an empty table gives an empty result;
columns of the input other than the id, the text and the host are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigengine.llm.common import SPACES, cut, let

SYMBOLS = "#*$%&|<>"
RULES = ("short", "repeated", "symbols", "dup_lines")


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 20
    max_repeat_pct: int = 30
    max_symbol_pct: int = 50  # symbols for each hundred words
    max_dup_line_pct: int = 60
    window: int = 8  # words, at least 1
    host_limit: float = 0.5  # of a host's shrunk failure rate
    least_rho: float = 1e-4  # of the prior's overdispersion
    broadcast_hosts: int = 100_000  # rejected hosts up to which their list is broadcast


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def _repeat_words(words: Column, window: int) -> Column:
    """Words in windows that the text holds twice or more."""

    def covered(hashes: Column) -> Column:
        def from_sorted(pairs: Column) -> Column:
            at = F.array_compact(
                F.transform(
                    pairs,
                    lambda x, k: F.when(
                        F.coalesce(F.get(pairs, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False)),
                        x["i"],
                    ),
                )
            )
            return let(
                F.sort_array(at),
                lambda p: F.aggregate(
                    F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window)))),
                    F.lit(0),
                    lambda acc, x: acc + x,
                ),
            )

        pairs = F.zip_with(hashes, F.sequence(F.lit(0), F.size(hashes) - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(F.array_sort(pairs), from_sorted)).otherwise(F.lit(0))

    def doubled(v: Column, step: int) -> Column:
        """From hashes of ``step`` words to those of twice as many, the last time with as much overlap as the window asks for."""
        if step == window:
            return covered(v)
        by = min(step, window - step)
        nxt = F.zip_with(F.slice(v, F.lit(1), F.size(v) - by), F.slice(v, F.lit(by + 1), F.size(v) - by), lambda a, b: F.xxhash64(a, b))
        return let(nxt, lambda n: doubled(n, step + by))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > window, let(hashed, lambda h: doubled(h, 1))).otherwise(F.lit(0)).cast("long")


def _of_words(text: Column, params: QualityParams) -> Column:
    return let(_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w, params.window).alias("n_repeat_words")))


def _of_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " " + SPACES, "")) > 0)
    return let(lines, lambda v: F.struct(F.size(v).cast("long").alias("n_lines"), (F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("n_dup_lines")))


def _short(n_words: Column, params: QualityParams) -> Column:
    return n_words < params.min_words


def _repeated(n_words: Column, n_repeat_words: Column, params: QualityParams) -> Column:
    return 100 * n_repeat_words > params.max_repeat_pct * n_words


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", params: QualityParams = QualityParams()) -> DataFrame:
    """Counts and rule failures of each document."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    d = d.select(
        "doc_id",
        "host",
        F.length(F.translate("text", " " + SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _of_words(F.col("text"), params).alias("w"),
        _of_lines(F.col("text")).alias("l"),
    ).select("doc_id", "host", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")
    return d.withColumns(
        {
            "short": _short(F.col("n_words"), params),
            "repeated": _repeated(F.col("n_words"), F.col("n_repeat_words"), params),
            "symbols": 100 * F.col("n_symbols") > params.max_symbol_pct * F.col("n_words"),
            "dup_lines": 100 * F.col("n_dup_lines") > params.max_dup_line_pct * F.col("n_lines"),
        }
    )


def host_counts(feats: DataFrame) -> DataFrame:
    return feats.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES])


def beta_priors(hosts: DataFrame, params: QualityParams = QualityParams()) -> dict[str, tuple[float, float]]:
    """(alpha, beta) of each rule by the method of moments for beta-binomial counts; a dozen sums come to the driver."""
    x = hosts.select("n", *RULES).agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum("n").alias("total"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"),
        *[F.sum(r).alias(f"f_{r}") for r in RULES],
        *[F.sum(F.col(r).cast("double") * F.col(r) / F.col("n")).alias(f"s_{r}") for r in RULES],
    ).first()
    out = {}
    for r in RULES:
        n, h = x["total"] or 0, x["hosts"]
        m = (x[f"f_{r}"] or 0) / n if n else 0.0
        var = m * (1 - m)
        spread = (x[f"s_{r}"] or 0.0) - n * m * m  # sum of n (p - m)^2
        room = var * (n - x["n2"] / n - (h - 1)) if n else 0.0
        rho = (spread - var * (h - 1)) / room if room > 0 else params.least_rho
        rho = min(max(rho, params.least_rho), 0.5)
        k = 1 / rho - 1
        m = min(max(m, 1e-6), 1 - 1e-6)
        out[r] = (m * k, (1 - m) * k)
    return out


def host_verdicts(hosts: DataFrame, priors: dict[str, tuple[float, float]], params: QualityParams = QualityParams()) -> DataFrame:
    """Each host's shrunk rates and whether any of them is over the limit."""
    rates = {f"rate_{r}": (F.lit(a) + F.col(r)) / (F.lit(a + b) + F.col("n")) for r, (a, b) in priors.items()}
    return hosts.withColumns(rates).withColumn("host_rejected", F.greatest(*[F.col(c) for c in rates]) > params.host_limit)


def _rejected_hosts(feats: DataFrame, params: QualityParams) -> DataFrame:
    """(host): broadcast if there are few."""
    hosts = cut(host_counts(feats))  # read for the prior and for the verdicts
    bad = cut(host_verdicts(hosts, beta_priors(hosts, params), params).filter("host_rejected").select("host"))
    return F.broadcast(bad) if bad.count() <= params.broadcast_hosts else bad


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", params: QualityParams = QualityParams()) -> DataFrame:
    """One row a document: counts, ``base_failed``, ``host_rejected`` and ``kept``."""
    feats = cut(features(docs, id_col, text_col, host_col, params))
    bad = _rejected_hosts(feats, params).withColumn("host_rejected", F.lit(True))
    return (
        feats.join(bad, "host", "left")
        .withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
        .withColumn("base_failed", F.col("short") | F.col("repeated"))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")
    )


def keep_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source", params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of ``docs`` that are kept. Texts are measured twice, for hosts and for rows, so that none is shuffled."""
    feats = features(docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("host")), "doc_id", "text", "host", params)
    bad = _rejected_hosts(feats, params)
    w = _of_words(F.coalesce(F.col(text_col), F.lit("")), params)
    failed = let(w, lambda x: _short(x["n_words"], params) | _repeated(x["n_words"], x["n_repeat_words"], params))
    return docs.filter(~failed).join(bad, docs[host_col].cast("string") == bad["host"], "left_anti")
