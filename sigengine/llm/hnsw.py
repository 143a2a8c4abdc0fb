"""Near-duplicate vectors by hierarchical navigable small-world graphs, one for each shard.

Vectors with the same label and length are comparable. Equal vectors become one class first; classes are dealt to shards
of bounded size by a hash, each shard gets a graph, and every class looks into every shard of its label. Beams are widened
until an audit of brute-forced queries passes; a beam that is full of links is replaced by an exact scan of the shard, so
dense groups lose no link. Found pairs are verified by cosine in double precision. A task sends back each class's number
of links and its smallest representative within the task, so links are never listed one by one.

Defined results: null labels and vectors that are null, empty, zero or hold null or non-finite components link with
nothing; a null id links with nothing, has a null component and is kept; rows that repeat an id are one vector (of the
smallest label and components); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigengine.llm.common import cut, python_ready
from sigengine.llm.components import components


@dataclass(frozen=True)
class HnswParams:
    cosine: float = 0.98
    links: int = 12  # of a node above the ground layer; twice that many there
    build_beam: int = 48
    beam: int = 48
    shard_rows: int = 16_384
    batch: int = 256
    audit: int = 64  # queries of an audit, at least
    audit_links: int = 500  # that an audit must find, or else all queries are scanned
    recall: float = 0.98
    seed: int = 5
    margin: float = 1e-4  # of single precision


class Graph:
    """A graph over the rows of ``x`` (normalised, single precision)."""

    def __init__(self, x: np.ndarray, p: HnswParams):
        self.x, self.p = x, p
        r = np.random.default_rng(p.seed)
        n = len(x)
        self.level = np.minimum((-np.log(1 - r.random(n)) / np.log(p.links)).astype(int), 6)
        if n:
            self.level[0] = max(1, self.level.max())
        self.layers = [np.full((n, 2 * p.links if k == 0 else p.links), -1, np.int32) for k in range(int(self.level.max(initial=0)) + 1)]
        done = 0
        while done < n:
            size = min(p.batch, max(16, done))
            self._insert(np.arange(done, min(n, done + size)))
            done += size

    def _beam(self, q: np.ndarray, entry: np.ndarray, layer: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the best ``ef`` nodes found for each query, best first; -1 where there are fewer."""
        near, b = self.layers[layer], len(q)
        rows = np.arange(b)
        ids = np.full((b, ef), -1, np.int32)
        sim = np.full((b, ef), -2.0, np.float32)
        fresh = np.zeros((b, ef), bool)
        seen = np.zeros((b, len(self.x)), bool)
        k = min(entry.shape[1], ef)
        ids[:, :k] = entry[:, :k]
        sim[:, :k] = np.where(entry[:, :k] >= 0, np.einsum("bd,bkd->bk", q, self.x[entry[:, :k]]), -2.0)
        fresh[:, :k] = entry[:, :k] >= 0
        at = np.nonzero(entry[:, :k] >= 0)
        seen[at[0], entry[:, :k][at]] = True
        live = rows
        while len(live):
            score = np.where(fresh[live], sim[live], -3.0)
            at = score.argmax(1)
            live, at = (v[score[np.arange(len(live)), at] > -3.0] for v in (live, at))
            if not len(live):
                break
            fresh[live, at] = False
            c = near[ids[live, at]]
            new = (c >= 0) & ~seen[live[:, None], np.maximum(c, 0)]
            at = np.nonzero(c >= 0)
            seen[live[at[0]], c[at]] = True
            s = np.where(new, np.einsum("bd,bmd->bm", q[live], self.x[c]), -2.0)
            some = (s > sim[live, -1][:, None]).any(1)
            at = live[some]
            if len(at):
                all_s = np.concatenate([sim[at], s[some]], 1)
                order = np.argsort(-all_s, 1, kind="stable")[:, :ef]
                sim[at] = np.take_along_axis(all_s, order, 1)
                ids[at] = np.take_along_axis(np.concatenate([ids[at], c[some]], 1), order, 1)
                fresh[at] = np.take_along_axis(np.concatenate([fresh[at], new[some]], 1), order, 1) & (sim[at] > -2.0)
        return np.where(sim > -2.0, ids, -1), sim

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros((len(q), 1), np.int32)
        for layer in range(len(self.layers) - 1, 0, -1):
            entry = self._beam(q, entry, layer, 4)[0]
        return self._beam(q, entry, 0, ef)

    def _chosen(self, q: np.ndarray, ids: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` neighbours to keep of candidates, best first: those nearer to the query than to any kept one, then the rest."""
        v = self.x[ids]
        between = np.einsum("bid,bjd->bij", v, v)
        b, c = ids.shape
        kept = np.zeros((b, c), bool)
        for j in range(c):
            closest = np.where(kept[:, :j], between[:, j, :j], -2.0).max(1, initial=-2.0) if j else np.full(b, -2.0)
            kept[:, j] = (sim[:, j] > closest) & (ids[:, j] >= 0) & (kept.sum(1) < most)
        order = np.argsort(np.where(ids < 0, 2, np.where(kept, 0, 1)), 1, kind="stable")[:, :most]
        out = np.take_along_axis(ids, order, 1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _insert(self, new: np.ndarray) -> None:
        q = self.x[new]
        entry = np.zeros((len(new), 1), np.int32)
        old = int(new[0])
        for layer in range(len(self.layers) - 1, -1, -1):
            near = self.layers[layer]
            if old:
                entry, sim = self._beam(q, entry, layer, self.p.build_beam if layer == 0 else 16)
            else:
                entry, sim = np.full((len(new), 1), -1, np.int32), np.full((len(new), 1), -2.0, np.float32)
            mine = np.flatnonzero(self.level[new] >= layer)
            if len(mine):
                # rows of the same batch see each other
                among = q[mine] @ q[mine].T
                np.fill_diagonal(among, -2.0)
                k = min(near.shape[1], len(mine))
                top = np.argsort(-among, 1, kind="stable")[:, :k]
                ids = np.concatenate([entry[mine], new[mine][top].astype(np.int32)], 1)
                s = np.concatenate([sim[mine], np.take_along_axis(among, top, 1)], 1)
                ids = np.where(s > -2.0, ids, -1)
                order = np.argsort(-s, 1, kind="stable")
                chosen = self._chosen(q[mine], np.take_along_axis(ids, order, 1), np.take_along_axis(s, order, 1), near.shape[1])
                near[new[mine]] = chosen
                self._back(near, new[mine], chosen)
            entry = np.where(entry >= 0, entry, 0) if old else np.zeros((len(new), 1), np.int32)

    def _back(self, near: np.ndarray, nodes: np.ndarray, chosen: np.ndarray) -> None:
        """Links back from the chosen neighbours; full lists are chosen anew."""
        to, frm = chosen.ravel(), np.repeat(nodes, chosen.shape[1])
        to, frm = to[chosen.ravel() >= 0], frm[chosen.ravel() >= 0]
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        targets, first, count = np.unique(to, return_index=True, return_counts=True)
        have = (near[targets] >= 0).sum(1)
        width = near.shape[1] + int(count.max(initial=0))
        for part in (slice(i, i + 512) for i in range(0, len(targets), 512)):
            t = targets[part]
            ids = np.full((len(t), width), -1, np.int32)
            ids[:, : near.shape[1]] = near[t]
            at = np.concatenate([np.arange(h, h + c) for h, c in zip(have[part], count[part], strict=True)])
            who = np.repeat(np.arange(len(t)), count[part])
            lo = first[part][0]
            ids[who, at] = frm[lo : lo + len(at)]
            ids = np.where(_repeated(ids), -1, ids)
            sim = np.where(ids >= 0, np.einsum("bd,bmd->bm", self.x[t], self.x[ids]), -2.0)
            order = np.argsort(-sim, 1, kind="stable")[:, : 3 * near.shape[1]]
            near[t] = self._chosen(self.x[t], np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1), near.shape[1])


def _repeated(ids: np.ndarray) -> np.ndarray:
    """Marks of values that stand earlier in their row."""
    order = np.argsort(ids, 1, kind="stable")
    s = np.take_along_axis(ids, order, 1)
    out = np.zeros(ids.shape, bool)
    np.put_along_axis(out, order, np.concatenate([np.zeros((len(ids), 1), bool), s[:, 1:] == s[:, :-1]], 1), 1)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of double precision, scaled to length one without overflow."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def links(queries: np.ndarray, graph: Graph, exact: np.ndarray, p: HnswParams, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(query row, graph row) of all pairs found of cosine at least ``p.cosine``; both inputs hold unit rows, ``exact`` the graph's.

    With ``same`` the queries are the graph's rows, and a row is no link of itself. The beam is widened until it finds the
    share ``p.recall`` of the links of an audit; where links are too few to judge by, the audit becomes a scan of all queries.
    """
    low, n = np.float32(p.cosine - p.margin), len(exact)
    q32 = queries.astype(np.float32)

    def scan(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for part in (rows[i : i + 256] for i in range(0, len(rows), 256)):
            a, b = np.nonzero(q32[part] @ graph.x.T >= low)
            out.append((part[a], b))
        return out

    def beam(rows: np.ndarray, ef: int) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for part in (rows[i : i + p.batch] for i in range(0, len(rows), p.batch)):
            ids, sim = graph.search(q32[part], ef)
            full = (sim[:, -1] >= low) & (ids[:, -1] >= 0)
            a, b = np.nonzero((sim >= low) & (ids >= 0) & ~full[:, None])
            out += [(part[a], ids[a, b]), *scan(part[full])]
        return out

    def joined(found: list) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate([f[k] for f in found]).astype(np.int64) for k in (0, 1)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def keys(found: list) -> np.ndarray:
        a, b = joined(found)
        return (a * n + b)[a != b] if same else a * n + b

    every, ef = np.arange(len(queries)), min(p.beam, n)
    order = np.random.default_rng(p.seed + 1).permutation(len(queries))
    want, read = [], 0
    while read < len(order) and (read < p.audit or len(keys(want)) < p.audit_links):
        size = max(p.audit, read)
        want += scan(order[read : read + size])
        read += size
    if read >= len(order):
        a, b = joined(want)
    else:
        audit, wanted = order[:read], keys(want)
        while ef < n and np.isin(wanted, keys(beam(audit, ef))).sum() < p.recall * len(wanted):
            ef = min(2 * ef, n)
        a, b = joined(beam(every, ef) if ef < n else scan(every))
    a, b = (a[a != b], b[a != b]) if same else (a, b)
    a, b = np.unique(np.stack([a, b], 1), axis=0).T if len(a) else (a, b)
    ok = np.zeros(len(a), bool)
    for i in range(0, len(a), 100_000):
        s = slice(i, i + 100_000)
        ok[s] = np.einsum("nd,nd->n", queries[a[s]], exact[b[s]]) >= p.cosine
    return a[ok], b[ok]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches by the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low), np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low), np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_vectors(vectors: DataFrame, p: HnswParams = HnswParams(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept."""
    python_ready(vectors.sparkSession)
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"), F.col(label_col).alias("label"))
    named = v.filter("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct("label", "e")).alias("x")).select("vec_id", "x.e", "x.label")
    fine = (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    named = named.withColumn("fine", F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    named = named.withColumns({"h1": F.when(F.col("fine"), F.xxhash64("e")), "h2": F.when(F.col("fine"), F.xxhash64(F.lit(1), "e"))})
    named = cut(named)
    classes = named.filter("fine").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.min(F.struct("vec_id", "e")).alias("x")).select("label", "h1", "h2", "rep", "m", F.col("x.e").alias("e"), F.size("x.e").alias("dim"))
    classes = cut(classes)
    sizes = cut(classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / p.shard_rows).cast("int").alias("shards")))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    label, id_kind = (dealt.schema[c].dataType.simpleString() for c in ("label", "rep"))

    def build(pdf):
        x = unit(np.stack(pdf["e"].to_numpy()))
        order = np.argsort(pdf["rep"].to_numpy(), kind="stable")
        x, ids, m = x[order], pdf["rep"].to_numpy()[order], pdf["m"].to_numpy()[order]
        out = pdf[["label", "dim", "shard", "shards"]].iloc[:1].copy()
        out["blob"] = [pickle.dumps((ids, m, x, Graph(x.astype(np.float32), p)), protocol=5)]
        return out

    graphs = dealt.select("label", "dim", "shard", "shards", "rep", "m", "e").groupBy("label", "dim", "shard").applyInPandas(build, f"label {label}, dim int, shard int, shards int, blob binary")
    graphs = cut(graphs)
    pairs = graphs.select("label", "dim", F.col("shard").alias("s"), F.explode(F.sequence("shard", F.col("shards") - 1)).alias("t"))
    side = lambda x: graphs.select("label", "dim", F.col("shard").alias(x), F.col("blob").alias(f"blob_{x}"))
    pairs = pairs.join(side("s"), ["label", "dim", "s"]).join(side("t"), ["label", "dim", "t"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column("s")[k].as_py() == batch.column("t")[k].as_py()
                ids, m, x, g = pickle.loads(batch.column("blob_s")[k].as_py())
                if same:
                    a, b = links(x, g, x, p, same=True)
                    a, b = np.minimum(a, b), np.maximum(a, b)
                    a, b = np.unique(np.stack([a, b], 1), axis=0).T if len(a) else (a, b)  # found from either side
                    all_ids, all_m = ids, m
                else:
                    ids2, m2, x2, g2 = pickle.loads(batch.column("blob_t")[k].as_py())
                    a, b = links(x, g2, x2, p)
                    b = b + len(ids)
                    all_ids, all_m = np.concatenate([ids, ids2]), np.concatenate([m, m2])
                n = np.bincount(a, all_m[b], len(all_ids)) + np.bincount(b, all_m[a], len(all_ids))
                # the smallest id of a component need not be the first row of two shards
                order = np.argsort(all_ids, kind="stable")
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                root = all_ids[order[_roots(len(all_ids), place[a], place[b])[place]]]
                some = np.flatnonzero(n > 0)
                yield pa.RecordBatch.from_arrays([pa.array(all_ids[some]), pa.array(n[some].astype(np.int64)), pa.array(root[some])], ["rep", "n", "root"])

    found = cut(pairs.select("s", "t", "blob_s", F.when(F.col("s") != F.col("t"), F.col("blob_t")).alias("blob_t")).mapInArrow(run, f"rep {id_kind}, n long, root {id_kind}"))
    comp = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("rep"), "component")
    of_class = classes.select("label", "h1", "h2", "rep", "m").join(found.groupBy("rep").agg(F.sum("n").alias("n")), "rep", "left").join(comp, "rep", "left")
    of_class = of_class.select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = named.filter("fine").select("vec_id", "label", "h1", "h2").join(of_class, ["label", "h1", "h2"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = named.filter("NOT fine").select("vec_id").unionByName(v.filter("vec_id IS NULL").select("vec_id"))
    out = out.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
