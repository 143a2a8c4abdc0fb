"""Quality classification by a byte-level convolutional network in numpy.

Learned filters run over a text's bytes, at every offset; a chunk's values are the filters' maxima over its positions,
chunks overlap and cover the whole text, and the means, maxima and minima of the chunks' values are combined into one
probability. Nothing but learned filters sees the bytes: text that repeats itself shows in filters that plain text
always excites and that stay low in some chunk. Since a filter over bytes is a sum of one table row for each byte, a
filter bank is ``width`` table look-ups, or half as many in tables of byte pairs, which scoring uses.

The network is fitted on at most about ``sample_rows`` labelled rows of at most ``sample_chars`` characters, chosen by a
hash of the text; scores read whole texts.

Defined results: null texts count as empty (one chunk of padding); without labelled rows every score is the prior 0.5;
repeated rows and tied ids are rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigengine.llm.common import python_ready


@dataclass(frozen=True)
class ConvParams:
    filters: int = 16
    width: int = 6
    chunk: int = 512  # bytes
    step: int = 384  # from chunk to chunk: they overlap by a quarter
    sample_rows: int = 2500
    sample_chars: int = 20_000
    steps: int = 700  # of 32 texts each
    rate: float = 0.03
    seed: int = 7
    threshold: float = 0.3


def chunks(text: str | None, p: ConvParams) -> np.ndarray:
    """(chunks, chunk bytes): overlapping chunks over the whole text, the last one padded with zeros."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-max(len(b) - (p.chunk - p.step), 1) // p.step))
    padded = np.zeros((n - 1) * p.step + p.chunk, np.uint8)
    padded[: len(b)] = b
    return np.lib.stride_tricks.sliding_window_view(padded, p.chunk)[:: p.step]


def start(p: ConvParams) -> dict[str, np.ndarray]:
    r = np.random.default_rng(p.seed)
    return {
        "table": (r.standard_normal((p.width, 256, p.filters)) * 0.3).astype(np.float32),
        "bias": np.zeros(p.filters, np.float32),
        "out": (r.standard_normal(3 * p.filters) * 0.1).astype(np.float32),
        "last": np.zeros(1, np.float32),
    }


def paired(m: dict) -> list[np.ndarray]:
    """The filter bank as tables of byte pairs; the last one stands for a single byte if the width is odd."""
    t = m["table"]
    return [(t[k][:, None] + t[k + 1][None]).reshape(65536, -1) if k + 1 < len(t) else t[k] for k in range(0, len(t), 2)]


def convolved(c: np.ndarray, m: dict, p: ConvParams, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """(chunks, filters) maxima over the positions of each chunk and, if asked for, where they are."""
    n = c.shape[1] - p.width + 1
    tables = m["pairs"] if "pairs" in m else None
    top, at = [], []
    for part in (c[i : i + 64] for i in range(0, len(c), 64)):
        if tables:
            two = (part[:, :-1].astype(np.int32) << 8) | part[:, 1:]
            a = tables[0][two[:, :n]]
            for k in range(2, p.width, 2):
                a += tables[k // 2][two[:, k : k + n] if k + 1 < p.width else part[:, k : k + n]]
        else:
            a = m["table"][0][part[:, :n]]
            for k in range(1, p.width):
                a += m["table"][k][part[:, k : k + n]]
        if where:
            best = a.argmax(1)
            at.append(best)
            top.append(np.take_along_axis(a, best[:, None], 1)[:, 0])
        else:
            top.append(a.max(1))
    return np.maximum(np.concatenate(top) + m["bias"], 0), np.concatenate(at) if where else None


def pooled(maxima: np.ndarray) -> np.ndarray:
    """Means, maxima and minima over a text's chunks."""
    v = np.log1p(maxima)
    return np.concatenate([v.mean(0), v.max(0), v.min(0)])


def probability(text: str | None, m: dict, p: ConvParams) -> float:
    z = float(pooled(convolved(chunks(text, p), m, p)[0]) @ m["out"] + m["last"][0])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[str], labels: list[int], p: ConvParams) -> dict | None:
    """Fit by Adam, one text at a time in batches; None without both labels."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    m, r = start(p), np.random.default_rng(p.seed + 1)
    # the rarer label weighs up to three times as much
    weight = np.where(y == 0, min(3.0, max(1.0, (y == 1).sum() / max((y == 0).sum(), 1))), 1.0).astype(np.float32)
    cut = [chunks(t, p) for t in texts]
    first, second, t = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    f, every = p.filters, np.arange(p.filters)
    while t < p.steps:
        order = r.permutation(len(y))
        for batch in (order[i : i + 32] for i in range(0, len(y), 32)):
            g = {k: np.zeros_like(v) for k, v in m.items()}
            allc = np.concatenate([cut[i] for i in batch])
            top_all, at_all = convolved(allc, m, p, where=True)
            dt_all = np.zeros_like(top_all)
            pos = 0
            for i in batch:
                n = len(cut[i])
                top = top_all[pos : pos + n]
                v = np.log1p(top)
                x = np.concatenate([v.mean(0), v.max(0), v.min(0)])
                z = float(x @ m["out"] + m["last"][0])
                d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) * weight[i] / len(batch)
                g["out"] += d * x
                g["last"] += d
                dv = np.repeat((d * m["out"][:f] / n)[None], n, 0)
                dv[v.argmax(0), every] += d * m["out"][f : 2 * f]
                dv[v.argmin(0), every] += d * m["out"][2 * f :]
                dt_all[pos : pos + n] = dv / (1 + top) * (top > 0)
                pos += n
            g["bias"] += dt_all.sum(0)
            rows, fs = np.nonzero(dt_all)
            for k in range(p.width):
                at = allc[rows, at_all[rows, fs] + k].astype(np.int64) * f + fs
                g["table"][k] = np.bincount(at, dt_all[rows, fs], 256 * f).reshape(256, f)
            t += 1
            rate = p.rate * max(0.02, 1 - t / p.steps)
            for k in m:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
                m[k] = (m[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return m


def fit(docs: DataFrame, labels: DataFrame, p: ConvParams = ConvParams(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict | None:
    """Learn from the rows of ``labels`` (id, label 0 or 1); a bounded sample of texts comes to the driver."""
    l = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).filter("y = y2").drop("y2")
    n = l.count()
    if not n:
        return None
    share = min(1.0, p.sample_rows / n)
    l = l.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0 <= share)
    l = F.broadcast(l) if n * share <= 10 * p.sample_rows else l
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") <= p.sample_chars).join(l, "id")
    rows = d.orderBy(F.xxhash64("id"), "id", "text").limit(2 * p.sample_rows).collect()
    return train([r["text"] for r in rows], [r["y"] for r in rows], p)


def score(docs: DataFrame, model: dict | None, p: ConvParams = ConvParams(), id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row a document: id, the columns of ``keep``, score, predicted."""
    python_ready(docs.sparkSession)
    keep = keep or {}
    d = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in keep.items()], F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shared.value and shared.value | {"pairs": paired(shared.value)}
        for b in batches:
            s = [0.5 if m is None else probability(t, m, p) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64()), pa.array([int(x >= p.threshold) for x in s], pa.int32())], [*b.schema.names[:-1], "score", "predicted"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    return d.mapInArrow(run, f"{kinds}, score double, predicted int")


def keep_documents(docs: DataFrame, model: dict | None, p: ConvParams = ConvParams(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold."""
    python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        m = shared.value and shared.value | {"pairs": paired(shared.value)}
        for b in batches:
            yield b.filter(pa.array([m is None or probability(t, m, p) >= p.threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
