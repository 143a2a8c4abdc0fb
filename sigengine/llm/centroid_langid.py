"""Language identification by nearest centroid.

Characters 1 to 3 long are hashed to a fixed number of dimensions; weights are (1 + ln count) times the inverse document
frequency, which counts every training document. Each language gets several centroids: spherical k-means over a bounded
sample of its distinct training texts (about ``sample_rows``, or all if there are fewer; the only thing fitted on a sample). A text goes to the language of the
centroid of highest cosine; ``rejected`` marks texts whose cosine is under that centroid's distance limit, the lowest
quantile of its own sample.

Defined results: null texts and texts without a letter are ``und`` with score 0 (so is every text if no row is labelled);
ties go to the first language by name; more languages than ``most_languages`` are an error, since each adds its
centroids to what every task holds; repeated rows and tied ids are rows of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigengine.llm.common import python_ready


@dataclass(frozen=True)
class LangParams:
    bits: int = 13  # of hashed dimensions
    clusters: int = 3  # centroids of a language
    sample_rows: int = 400  # training rows of a language that k-means sees, about
    most_languages: int = 2000
    reject_quantile: float = 0.01
    rounds: int = 8
    sharpness: float = 12.0


@dataclass
class LangModel:
    languages: list[str]
    owner: np.ndarray  # language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    limits: np.ndarray  # cosine of each centroid under which a text is rejected


def grams(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, count) of a text's hashed n-grams; letters are lowered, runs of others become one space."""
    u = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(u):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    u = np.where(u < 65, np.uint64(32), u)  # blanks, digits and most signs
    u = u[~((u == 32) & (np.concatenate([[np.uint64(0)], u[:-1]]) == 32))]
    a, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        one = (u + np.uint64(1)) * a
        two = (one[:-1] ^ (u[1:] + np.uint64(77))) * a
        three = (two[:-1] ^ (u[2:] + np.uint64(7777))) * a
    n = np.bincount(np.concatenate([one >> shift, two >> shift, three >> shift]).astype(np.int64), minlength=1 << bits)
    at = np.flatnonzero(n)
    return at, n[at]


def vector(text: str, idf: np.ndarray, bits: int) -> np.ndarray:
    """The normalised TF-IDF vector."""
    at, n = grams(text, bits)
    out = np.zeros(1 << bits, np.float32)
    w = (1 + np.log(n)) * idf[at]
    norm = np.sqrt((w * w).sum())
    out[at] = w / norm if norm else 0
    return out


def _has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def clustered(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; starts from the rows farthest from those chosen before."""
    centers = x[:1]
    while len(centers) < min(k, len(x)):
        far = (x @ centers.T).max(1)
        if far.min() > 1 - 1e-6:
            break
        centers = np.concatenate([centers, x[[far.argmin()]]])
    for _ in range(rounds):
        own = (x @ centers.T).argmax(1)
        means = np.stack([x[own == i].mean(0) if (own == i).any() else centers[i] for i in range(len(centers))])
        centers = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    return centers


def fit(docs: DataFrame, p: LangParams = LangParams(), text_col: str = "text", lang_col: str = "lang") -> LangModel:
    """Learn from all rows of ``docs`` with a text and a language."""
    python_ready(docs.sparkSession)
    d = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    bits = p.bits

    def frequencies(batches):
        import pyarrow as pa

        df, rows = np.zeros((1 << bits) + 1, np.int64), 0
        for b in batches:
            for t in b.column("text").to_pylist():
                at, _ = grams(t, bits)
                df[at] += 1
                rows += 1
        df[-1] = rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["key", "n"])

    got = {r["key"]: r["n"] for r in d.select("text").mapInArrow(frequencies, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()}  # a row a dimension
    rows = got.pop(1 << bits, 0)
    # copies of a text count once here, so that a language of few texts, however often each is repeated, keeps its sample
    distinct = d.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.03).alias("n")).limit(p.most_languages + 1).collect()
    if len(distinct) > p.most_languages:
        raise ValueError(f"more than {p.most_languages} languages")
    langs = {r["lang"]: r["n"] for r in distinct}
    idf = np.zeros(1 << bits)
    if rows:
        idf[:] = np.log(1 + rows)
        for k, n in got.items():
            idf[int(k)] = np.log((1 + rows) / (1 + n)) + 0.05
    if not langs:
        return LangModel([], np.zeros(0, int), np.zeros((0, 1 << bits), np.float32), idf, np.zeros(0))
    share = F.create_map(*[F.lit(v) for k, n in langs.items() for v in (k, 1.0 if n <= 1.1 * p.sample_rows else p.sample_rows / n)])
    chosen = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003.0 <= share[F.col("lang")]

    def vectors(batches):
        import pyarrow as pa

        for b in batches:
            found = [grams(t, bits) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), pa.array([x for x, _ in found], pa.list_(pa.int64())), pa.array([y for _, y in found], pa.list_(pa.int64()))], ["lang", "h", "at", "n"])

    by: dict[str, list] = {}
    # equal texts hash alike, so a large group of copies is taken or left as one; it counts once. Hashes are even, so the
    # rows that come are close to their share: about sample_rows a language
    for r in d.filter(chosen).dropDuplicates(["lang", "text"]).withColumn("h", F.xxhash64("text")).mapInArrow(vectors, "lang string, h long, at array<long>, n array<long>").toLocalIterator():
        at, n = np.array(r["at"], int), np.array(r["n"])
        v = np.zeros(1 << bits, np.float32)
        w = (1 + np.log(n)) * idf[at]
        v[at] = w / max(np.sqrt((w * w).sum()), 1e-12)
        by.setdefault(r["lang"], []).append((r["h"], v))
    languages, owner, centers, limits = sorted(by), [], [], []
    for i, lang in enumerate(languages):
        x = np.stack([v for _, v in sorted(by[lang], key=lambda y: y[0])])  # in the same order on every run
        c = clustered(x, p.clusters, p.rounds)
        best = x @ c.T
        own = best.argmax(1)
        for k in range(len(c)):
            near = best[own == k, k]
            limits.append(float(np.quantile(near, p.reject_quantile)) * 0.8 if len(near) else 0.0)
        owner += [i] * len(c)
        centers.append(c)
    return LangModel(languages, np.array(owner), np.concatenate(centers).astype(np.float32), idf, np.array(limits))


def predict(docs: DataFrame, model: LangModel, p: LangParams = LangParams(), id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row a document: id, the columns of ``keep``, lang_pred, score, rejected."""
    python_ready(docs.sparkSession)
    keep = keep or {}
    d = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in keep.items()], F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.owner, model.centroids, model.idf, model.limits))

    def run(batches):
        import pyarrow as pa

        languages, owner, centroids, idf, limits = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            out = [("und", 0.0, True)] * len(texts)
            some = [i for i, t in enumerate(texts) if languages and _has_letter(t)]
            for part in (some[k : k + 128] for k in range(0, len(some), 128)):
                cos = np.stack([vector(texts[i], idf, p.bits) for i in part]) @ centroids.T
                for i, c in zip(part, cos, strict=True):
                    best = np.array([c[owner == k].max() for k in range(len(languages))])
                    e = np.exp(p.sharpness * (best - best.max()))
                    at = int(c.argmax())
                    out[i] = (languages[int(best.argmax())], float(e.max() / e.sum()), bool(c[at] < limits[at]))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())],
                [*b.schema.names[:-1], "lang_pred", "score", "rejected"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    return d.mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")
