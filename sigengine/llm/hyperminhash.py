"""Near-duplicates by HyperMinHash: compressed registers, banding, corrected estimates, then full sets.

A document's set is its distinct word shingles. Hashes of the shingles fall into buckets; a bucket's register keeps the
leading-zero count and mantissa bits of its smallest hash. Buckets that a small set leaves empty are filled by further
rounds, each with its own seed: a shingle's place in a bucket is (round, hash), a bucket keeps the smallest, and two sets
agree in a bucket with the probability of their Jaccard similarity, whatever their sizes.

Equal sets become one class first. Bands of registers bucket the classes; each bucket's members are compared with a few
leaders (not with each other), by register estimates corrected for chance collisions and then on full sets. Components of
these links are found; buckets that still hold several components compare all members across components, by sketches of
a few bits of each register within the join, so that only likely pairs leave it. So every pair that shares a band is
either tested or already joined, and no pairs within a joined group are emitted.

Two sets of similarity 0.75 share none of 40 bands of 4 registers with probability 3e-7.

Defined results: null and empty texts have an empty set and link with nothing; a null id links with nothing, has a null
component and is kept; repeated rows are rows of their own with the same component; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigengine.llm.common import cut, python_ready
from sigengine.llm.components import components

_SPLIT = bytes(c + 32 if 65 <= c <= 90 else 32 if c in b"\x20\x09\x0a\x0b\x0c\x0d" else c for c in range(256))
_U = np.uint64


@dataclass(frozen=True)
class MinHashParams:
    shingle: int = 5
    percent: int = 75  # least similarity, of a hundred
    bands: int = 40
    rows: int = 4  # registers in a band
    mantissa: int = 10
    slack: float = 0.17  # an estimate may be that far under the limit: five standard deviations
    sketch_bits: int = 3  # of each register, for a first comparison of members across components
    parity_bits: int = 2048
    least_match: float = 0.77  # of the sketch's bits: five standard deviations under what similarity 0.75 gives
    seed: int = 20_240_607

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:  # some 30 MB
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_WORDS = _Words()


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = (text or "").encode().translate(_SPLIT).split(b" ")
    words = [w for w in words if w]
    if not words:
        return np.zeros(0, _U)
    h = np.array([_WORDS[w] for w in words], _U)
    with np.errstate(over="ignore"):
        if len(h) < size:
            out = np.array([len(h)], _U)
            for x in h:
                out = mix(out * _U(0x9E3779B97F4A7C15) + x)
            return out
        n = len(h) - size + 1
        out = h[:n].copy()
        for k in range(1, size):
            out = mix(out * _U(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two independent sums over a set, as signed longs."""
    with np.errstate(over="ignore"):
        a, b = mix(s + _U(11)).sum(dtype=_U), mix(s ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def registers(s: np.ndarray, p: MinHashParams) -> np.ndarray:
    """The compressed registers of a set."""
    m, n, t = p.registers, len(s), 0
    best = np.full(m, np.iinfo(np.int64).max, np.int64)
    while t < 1024:
        rounds = 1 if n >= 256 else min(1024 - t, max(1, 2 * m // n) * (1 if t == 0 else 2))
        seeds = mix(np.arange(t, t + rounds, dtype=_U) + _U(p.seed))
        h = mix(s[None, :] ^ seeds[:, None])
        bucket = (((h >> _U(32)) * _U(m)) >> _U(32)).astype(np.int64)
        value = (h & _U(0xFFFFFFFF)).astype(np.int64) | (np.arange(t, t + rounds, dtype=np.int64)[:, None] << 32)
        both = np.sort(((bucket << 42) | value).ravel())
        b = both >> 42
        first = np.flatnonzero(np.diff(b, prepend=-1))
        np.minimum.at(best, b[first], both[first] & ((1 << 42) - 1))
        t += rounds
        if (best < np.iinfo(np.int64).max).all():
            break
    low = (best & 0xFFFFFFFF).astype(np.float64)
    zeros = np.where(low > 0, 31 - np.floor(np.log2(np.maximum(low, 1))), 32).astype(np.int64)
    mantissa = np.where(zeros <= 31, ((best & 0xFFFFFFFF) << np.minimum(zeros + 1, 40) & 0xFFFFFFFF) >> (32 - p.mantissa), 0)
    return (((zeros << p.mantissa) | mantissa) ^ ((best >> 32) * 0x9E37)).astype(np.uint16)


def sketch(regs: np.ndarray, p: MinHashParams) -> np.ndarray:
    """A few hashed bits of each register, in longs: equal registers agree in all of them, others in half."""
    h = mix(regs.astype(_U) + (np.arange(len(regs), dtype=_U) << _U(20)) + _U(1))
    bits = (h[:, None] >> np.arange(p.sketch_bits, dtype=_U)[None]) & _U(1)
    return np.packbits(np.pad(bits.astype(np.uint8).ravel(), (0, -bits.size % 64))).view(np.int64)


def parity(s: np.ndarray, p: MinHashParams) -> np.ndarray:
    """An odd sketch, in longs: a bit says whether an odd number of the set's members fall on it.

    Two sketches differ where members of the symmetric difference fall, so it is precise for sets that are much alike.
    """
    at = (mix(s ^ _U(0xC3C3C3C3C3C3C3C3)) % _U(p.parity_bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=p.parity_bits) & 1).astype(np.uint8)).view(np.int64)


def _differ(a: str, b: str, longs: int) -> Column:
    """Bits in which two arrays of longs differ."""
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(1, longs)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def _alike(p: MinHashParams) -> Column:
    """Whether sketches (sa, sb), odd sketches (oa, ob) and sizes (na, nb) leave the least similarity possible, but for odds of five standard deviations."""
    sizes = 100 * F.least("na", "nb") >= p.percent * F.greatest("na", "nb")
    registers_ = _differ("sa", "sb", -(-p.registers * p.sketch_bits // 64)) <= int((1 - p.least_match) * p.registers * p.sketch_bits)
    # of na + nb members, that many at most are in one set only
    apart = (F.col("na") + F.col("nb")) * ((100 - p.percent) / (100 + p.percent))
    e = F.exp(apart * (-2 / p.parity_bits))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.lit(p.parity_bits / 4) * (1 - e * e) - apart * e * e))
    # a loop, not a term for each long: the join's code stays small enough to be compiled
    odd = F.aggregate(F.zip_with("oa", "ob", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return sizes & registers_ & (odd <= F.lit(p.parity_bits / 2) * (1 - e) + 5.5 * spread + 2)


def chance(na: np.ndarray, nb: np.ndarray, p: MinHashParams) -> np.ndarray:
    """Probability that registers of unrelated sets of these sizes agree by chance."""
    la, lb = (np.maximum(np.asarray(x, float) / p.registers, 0.5) for x in (na, nb))
    out = np.zeros_like(la)
    for z in range(33):
        lo, hi = (0.0, 2.0**-32) if z == 32 else (2.0 ** -(z + 1), 2.0**-z)
        out += (hi - lo) * 2.0**-p.mantissa * la * lb / (la + lb) * (np.exp(-(la + lb) * lo) - np.exp(-(la + lb) * hi))
    return np.minimum(out, 0.5)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, p: MinHashParams) -> np.ndarray:
    """Similarity of rows of registers, corrected for chance agreement."""
    same, e = (a == b).mean(1), chance(na, nb, p)
    return np.maximum(0, (same - e) / (1 - e))


def signatures(docs: DataFrame, p: MinHashParams = MinHashParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, f1, f2, bands): bands are null for empty sets."""
    python_ready(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, f1, f2, bands, sketches, odd, seen = [], [], [], [], [], [], {}
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, p.shingle)
                a, b = fingerprint(s)
                if len(s) and (a, b) not in seen:
                    r = registers(s, p)
                    seen[a, b] = r.view(np.int64), sketch(r, p), parity(s, p)
                x, y, z = seen[a, b] if len(s) else (None, None, None)
                n.append(len(s)), f1.append(a), f2.append(b), bands.append(x), sketches.append(y), odd.append(z)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "f1", "f2", "bands", "sketch", "odd"],
            )
        _WORDS.clear()  # workers live on for other tasks

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_shingles long, f1 long, f2 long, bands array<long>, sketch array<long>, odd array<long>")


def _beside(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """The pairs (lead, member) with ``columns`` of both from ``rows`` (node): those of the lead with an l, those of the member with an m.

    A lead may have very many members. Its pairs are dealt over as many parts as there are thousands of pairs, by a hash
    of the member, and the lead's row is sent once to each part that has some, not with each pair.
    """
    parts = max(16, pairs.count() // 1000)
    part = F.pmod(F.xxhash64("member"), F.lit(parts)).cast("int")
    member = rows.select(F.col("node").alias("member"), *[F.col(c).alias(f"m_{c}") for c in columns])
    lead = rows.select(F.col("node").alias("lead"), *[F.col(c).alias(f"l_{c}") for c in columns])
    sent = pairs.select("lead", part.alias("part")).distinct().join(lead, "lead")
    return pairs.join(member, "member").withColumn("part", part).join(sent, ["lead", "part"])


def _likely(pairs: DataFrame, classes: DataFrame, p: MinHashParams) -> DataFrame:
    """The pairs (lead, member) whose corrected estimate is not far under the limit."""
    limit = p.percent / 100
    both = _beside(pairs, classes.select(F.col("rep").alias("node"), F.col("n_shingles").alias("n"), "bands"), "n", "bands")
    sized = both.filter(100 * F.least("l_n", "m_n") >= p.percent * F.greatest("l_n", "m_n"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                regs = [b.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(b.num_rows, -1) for c in ("l_bands", "m_bands")]
                nl, nm = (b.column(c).to_numpy(zero_copy_only=False) for c in ("l_n", "m_n"))
                b = b.filter(pa.array(estimate(*regs, nl, nm, p) >= limit - p.slack))
            yield b.select(["lead", "member"])

    kind = pairs.schema["lead"].dataType.simpleString()
    return sized.mapInArrow(run, f"lead {kind}, member {kind}")


def _sets(docs: DataFrame, wanted: DataFrame, p: MinHashParams, id_col: str, text_col: str) -> DataFrame:
    """(node, s): the full sets of the wanted classes."""
    python_ready(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text")).join(wanted, "node")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            sets = [shingle_set(t, p.shingle) for t in b.column("text").to_pylist()]
            keep = [fingerprint(s)[0] == f for s, f in zip(sets, b.column("f1").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("node").filter(pa.array(keep, pa.bool_())), pa.array([s.view(np.int64) for s, k in zip(sets, keep, strict=True) if k], pa.list_(pa.int64()))], ["node", "s"]
            )
        _WORDS.clear()

    return d.mapInArrow(run, f"node {d.schema['node'].dataType.simpleString()}, s array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, p: MinHashParams) -> DataFrame:
    """(u, v): the pairs whose full sets are similar enough."""
    both = F.size(F.array_intersect("l_s", "m_s"))
    found = _beside(pairs, sets, "s").filter(100 * both >= p.percent * (F.size("l_s") + F.size("m_s") - both))
    return found.select(F.greatest("lead", "member").alias("u"), F.least("lead", "member").alias("v")).distinct()


def _once(pairs: DataFrame) -> DataFrame:
    """Each pair (lead, member) once, whichever way round it stands; a map-side aggregation."""
    return pairs.groupBy(F.greatest("lead", "member").alias("u"), F.least("lead", "member").alias("v")).agg(F.min("lead").alias("lead")).select("lead", F.when(F.col("lead") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("member"))


def near_duplicates(docs: DataFrame, p: MinHashParams = MinHashParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    sig = cut(signatures(docs, p, id_col, text_col))
    classes = cut(
        sig.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sketch", "odd")).alias("x")).select("f1", "f2", F.col("x.doc_id").alias("rep"), "x.n_shingles", "x.bands", "x.sketch", "x.odd")
    )
    # a set of one or two shingles is similar enough to itself only
    slots = classes.filter("n_shingles > 2").select("rep", F.posexplode("bands").alias("band", "key"))
    shared = slots.groupBy("band", "key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    members = cut(slots.join(shared, ["band", "key"]))
    # a text that others were made from shares more bands with them than they do with each other: such a one leads
    popular = members.groupBy("rep").agg(F.sum("c").alias("popular"))
    leaders = members.join(popular, "rep").groupBy("band", "key").agg(F.min("rep").alias("l0"), F.max_by("rep", F.struct("popular", F.xxhash64("rep"))).alias("l1"))
    starred = members.join(leaders, ["band", "key"]).select("rep", F.explode(F.array("l0", "l1")).alias("lead")).filter("rep != lead").select("lead", F.col("rep").alias("member"))
    likely = cut(_likely(cut(_once(starred)), classes, p))

    def sets_of(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("lead").alias("node")).union(pairs.select("member")).distinct()
        return cut(_sets(docs, ids.join(classes.select(F.col("rep").alias("node"), "f1"), "node"), p, id_col, text_col).dropDuplicates(["node"]))

    links = cut(_confirmed(likely, sets_of(likely), p)) if not likely.isEmpty() else likely.select(F.col("lead").alias("u"), F.col("member").alias("v"))
    comp = cut(components(links))

    # buckets with several components: all members across components
    held = members.select("band", "key", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    parts = held.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max_by("component", "n").alias("big")).filter("lo != hi").select("band", "key", "big")
    held = cut(held.join(mixed, ["band", "key"]).join(classes.select("rep", "n_shingles", "sketch", "odd", "bands"), "rep"))
    if not held.isEmpty():
        side = lambda x: [F.col("rep").alias(x), F.col("component").alias(f"c{x}"), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"), F.col("odd").alias(f"o{x}"), F.col("bands").alias(f"b{x}")]
        left = held.filter("component != big").select("band", "key", "big", *side("a"))
        right = held.select("band", "key", *side("b"))
        # a pair leaves the first of the bands that it shares only; all of them are mixed buckets
        once = F.array_position(F.zip_with("ba", "bb", lambda x, y: x == y), True) == F.col("band") + 1
        across = left.join(right, ["band", "key"]).filter(F.expr("ca != cb AND (cb = big OR a < b)") & _alike(p) & once).select(F.col("b").alias("lead"), F.col("a").alias("member"))
        tried = likely.select(F.greatest("lead", "member").alias("u"), F.least("lead", "member").alias("v"))
        across = _once(across).select("*", F.greatest("lead", "member").alias("u"), F.least("lead", "member").alias("v")).join(tried, ["u", "v"], "left_anti").select("lead", "member")
        more = cut(_likely(cut(across), classes, p))
        if not more.isEmpty():
            found = cut(_confirmed(more, sets_of(more), p))
            if not found.isEmpty():
                comp = cut(components(links.union(found)))
    of_class = classes.select("f1", "f2", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("root"))
    return (
        sig.select("doc_id", "n_shingles", "f1", "f2")
        .join(of_class, ["f1", "f2"], "left")
        .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id")))
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def keep_documents(docs: DataFrame, p: MinHashParams = MinHashParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each component, that of the smallest id.

    Rows without words or without an id are no one's duplicates and stay. Where ids are repeated, rows are told apart by
    id and a digest of the text, so that rows that share an id but not a text are judged each by itself; of rows that
    repeat both one stays, and the smallest is that of the smallest id and digest as text.
    """
    repeated = docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1")
    if repeated.isEmpty():
        gone = cut(near_duplicates(docs, p, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias(id_col)))
        return docs.join(gone, id_col, "left_anti").select(docs.columns)
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.withColumn("__row", F.when(F.col(id_col).isNotNull(), F.concat_ws(":", F.col(id_col).cast("string"), F.md5(text.cast("binary")))))
    gone = cut(near_duplicates(named, p, "__row", text_col).filter("NOT kept").select(F.col("doc_id").alias("__row")).distinct())
    stay = named.join(gone, "__row", "left_anti")
    single = F.col("__row").isNull() | (F.length(F.translate(text, " \t\n\x0b\x0c\r", "")) == 0)
    return stay.filter(single).select(docs.columns).unionByName(stay.filter(~single).dropDuplicates(["__row"]).select(docs.columns))
