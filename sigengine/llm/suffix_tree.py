"""Language-model scores by a probabilistic suffix tree over words.

The symbols are the training words seen at least ``least_count`` times, the end of a text, and one class for all rarer
words, within which the smoothed word frequencies hold. A context of one to ``depth`` symbols is kept if it occurs
``least_count`` times and the distribution of the symbols after it diverges from that of the longest kept suffix by more
than a BIC penalty. Distributions are smoothed towards that suffix's, and the longest kept suffix of what was read scores
the next symbol. The threshold is the same for every size of input, so the tree grows in proportion to the corpus.

Texts are cut into chunks, each encoded once with a vocabulary of its own. For each depth a chunk asks for the distinct
transitions that it holds: it sends them, with its own training counts, as sorted and compressed blocks to partitions by
the hash of their context. A partition adds the counts up, tests the contexts, numbers the transitions that may be
contexts of the next depth, and answers each block in its order, without keys. A context of very many occurrences is split
over partitions by its next symbols; the sums of its parts are bounded by ``most_split`` and shared with all tasks.
Neither the vocabulary nor the tree is ever in one place.

In the divergence test the suffix's probabilities are rounded to a quarter of a bit. Words are counted by 64-bit hashes.

Defined results: null texts count as empty (the end token alone); a null id counts as the empty text in the split;
repeated rows and tied ids are rows of their own; an empty table gives an empty result; without training rows every word
has the uniform smoothing probability; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigengine.llm.common import cut, python_ready, settle
from sigengine.llm.hyperminhash import _SPLIT, mix

END = b"\n"  # no word holds it


@dataclass(frozen=True)
class TreeParams:
    depth: int = 3
    least_count: int = 2
    smoothing: float = 20.0  # weight of the suffix's distribution, in occurrences
    penalty: float = 1.0  # times ln(occurrences) for each symbol seen, against twice the log likelihood ratio
    chunk_tokens: int = 2_250_000
    part_tokens: int = 2_000_000  # tokens of the input for each partition that counts
    split_tokens: int = 1_000_000  # occurrences of a context beyond which it is split, at least
    most_split: int = 50_000  # contexts that may be split
    lump: float = 0.5  # added to each word's count, and to that of unknown words


def _pack(a: np.ndarray, rising: bool = False) -> tuple:
    """An array as compressed planes of bytes; of a rising one the differences."""
    import pyarrow as pa

    raw = np.ascontiguousarray(np.diff(a, prepend=a.dtype.type(0)) if rising else a)
    most = int(raw.view(f"u{raw.itemsize}").max()) if len(raw) else 0
    planes = np.empty((-(-most.bit_length() // 8), len(raw)), np.uint8)  # none for high bytes that are zero throughout
    for k, plane in enumerate(planes):
        plane[:] = raw.view(np.uint8)[k :: raw.itemsize]
    return raw.dtype.str, len(raw), rising, len(planes), pa.compress(planes.tobytes(), "zstd", asbytes=True) if planes.size else b""


def _unpack(packed: tuple) -> np.ndarray:
    import pyarrow as pa

    kind, n, rising, high, data = packed
    size = np.dtype(kind).itemsize
    out = np.zeros(n * size, np.uint8)
    if data:
        for k, plane in enumerate(np.frombuffer(pa.decompress(data, n * high, "zstd", asbytes=True), np.uint8).reshape(high, n)):
            out[k::size] = plane
    a = out.view(kind)
    return np.cumsum(a, dtype=a.dtype) if rising else a


def _ordered(pid: np.ndarray, rank: np.ndarray, ranks: int, pids: int) -> np.ndarray:
    """The stable order by (pid, rank): a sort of whole keys that hold the place, which is several times as fast as one of places."""
    places = max(1, len(pid)).bit_length()
    ranked = max(1, ranks).bit_length()
    if pids.bit_length() + ranked + places > 62:
        return np.lexsort((rank, pid))
    key = (pid.astype(np.int64) << (ranked + places)) | (rank.astype(np.int64) << places) | np.arange(len(pid))
    key.sort()
    return key & ((1 << places) - 1)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def chunks(docs: DataFrame, p: TreeParams, id_col: str, text_col: str, held: Column) -> DataFrame:
    """(chunk, kind, pid, blob, tokens, train): of each chunk a row of kind 0, its documents and their words as numbers of its
    own vocabulary with the order of that by hash, and a row of kind -1, these hashes, which are asked for once."""
    python_ready(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches) -> Iterator:
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId() << 24, 0

        def row(ids, held, parts, vocabulary):
            n = np.array([len(x) for x in parts], np.int64)
            flat = np.concatenate(parts)
            counts = np.bincount(flat, minlength=len(vocabulary))
            order = np.argsort(-counts, kind="stable")  # frequent words get small numbers
            number = np.empty(len(order), np.int32)
            number[order] = np.arange(len(order))
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in vocabulary], np.uint64)[order]
            by_hash = np.argsort(hashes).astype(np.int32)
            blob = pickle.dumps((ids, np.array(held, bool), n, _pack(number[flat]), _pack(by_hash)))
            train = int(n[~np.array(held, bool)].sum())
            both = [{"kind": 0, "blob": blob, "tokens": len(flat), "train": train}, {"kind": -1, "blob": pickle.dumps(_pack(hashes[by_hash], rising=True)), "tokens": 0, "train": 0}]
            return pa.RecordBatch.from_pylist([{"chunk": part + made, "pid": 0, **x} for x in both], schema)

        schema = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("pid", pa.int64()), ("blob", pa.binary()), ("tokens", pa.int64()), ("train", pa.int64())])
        ids, held_, parts, size, vocabulary = [], [], [], 0, _Vocabulary()
        number = vocabulary.__getitem__
        for b in batches:
            for i, h, t in zip(b.column("doc_id").to_pylist(), b.column("held").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = t.encode("utf-8", "surrogatepass").translate(_SPLIT).split()
                words.append(END)
                tokens = np.fromiter(map(number, words), np.int32, len(words))
                ids.append(i), held_.append(h), parts.append(tokens)
                size += len(tokens)
                if size >= p.chunk_tokens:
                    yield row(ids, held_, parts, vocabulary)
                    made += 1
                    ids, held_, parts, size, vocabulary = [], [], [], 0, _Vocabulary()
                    number = vocabulary.__getitem__
        if parts:
            yield row(ids, held_, parts, vocabulary)

    return d.mapInArrow(run, "chunk long, kind int, pid long, blob binary, tokens long, train long")


@dataclass(frozen=True)
class _Root:
    """What all tasks know: sizes, and of each depth read the split contexts that are kept."""

    tokens: int  # for training
    parts: int  # partitions that count
    split: int  # occurrences of a context beyond which it is split
    known: int = 0
    rare: float = 1.0  # probability of the class of rarer words
    lump: float = 0.5
    kept: tuple = ()

    def p(self, c: np.ndarray) -> np.ndarray:
        return (c + self.lump) / (self.tokens + self.lump * (self.known + 1))


class _Chunk:
    """A chunk's tokens and what the answers of the depths before say of them."""

    def __init__(self, state: bytes, answers: list[dict[int, bytes]], root: _Root, p: TreeParams, hashes: bytes | None = None):
        self.root, self.params = root, p
        self.doc_ids, self.held, self.n, ids, order = pickle.loads(state)
        self.ids, self.order = _unpack(ids), _unpack(order)
        self.place = np.arange(len(self.ids), dtype=np.int32) - np.repeat((np.cumsum(self.n) - self.n).astype(np.int32), self.n)
        self.train = np.repeat(~self.held, self.n)
        self.depth = 0
        if hashes:
            # a partition counts the words of a range of hashes
            self.hashes = _unpack(pickle.loads(hashes))
            pid = ((self.hashes >> np.uint64(32)) * np.uint64(root.parts)) >> np.uint64(32)
            self.bounds = np.searchsorted(pid, np.arange(root.parts + 1, dtype=np.uint64))
        if answers:
            self._words(answers[0])
        for a in answers[1:]:
            self._transitions()
            self._answered(a)

    def word_questions(self) -> Iterator[tuple[int, bytes]]:
        n = np.bincount(self.ids[self.train], minlength=len(self.order))
        for pid, at in self._blocks():
            yield pid, pickle.dumps((_pack(self.hashes[self.bounds[pid] : self.bounds[pid + 1]], rising=True), _pack(n[at])))

    def _blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        for pid in range(self.root.parts):
            lo, hi = self.bounds[pid], self.bounds[pid + 1]
            if hi > lo:
                yield pid, self.order[lo:hi]

    def _words(self, answer: dict[int, bytes]) -> None:
        v = len(self.order)
        self.counts, number, lo = np.zeros(v, np.int64), np.zeros(v, np.int64), 0
        for pid in sorted(answer):
            c, t = (_unpack(x) for x in pickle.loads(answer[pid]))
            at = self.order[lo : lo + len(c)]
            self.counts[at], number[at] = c, t
            lo += len(c)
        tracked = number > 0
        self.p0 = self.root.p(self.counts)
        self.within = np.where(tracked, 1.0, self.p0 / self.root.rare)
        self.now = np.where(tracked, self.p0, self.root.rare)[self.ids]  # probability of each symbol by the longest kept suffix so far
        # local numbers of the symbols; all rarer words are the last
        self.symbol = np.where(tracked, np.arange(v), v).astype(np.int32)[self.ids]
        self.symbol_number = np.append(number, 0)
        self.symbol_rank = np.zeros(v + 1, np.int64)
        self.symbol_rank[_ordered(self.symbol_number, np.zeros(v + 1, np.int64), 0, int(number.max(initial=0)))] = np.arange(v + 1)
        # of the contexts that end at each token: their local numbers, and by these the numbers all chunks share and the occurrences
        self.context = np.where(tracked, np.arange(v), -1).astype(np.int32)[self.ids]
        self.context_number, self.context_count = number, self.counts

    def _transitions(self) -> None:
        """The distinct transitions of the next depth, in the order in which they are asked for."""
        import pandas as pd

        self.depth += 1
        before = np.append(np.int32(-1), self.context[:-1]) if len(self.context) else self.context
        self.at = np.flatnonzero((before >= 0) & (self.place >= self.depth))
        bits = len(self.counts).bit_length()
        self.inverse, keys = pd.factorize((before[self.at].astype(np.int64) << bits) | self.symbol[self.at])
        self.from_, symbol = keys >> bits, keys & ((1 << bits) - 1)
        self.ctx, self.sym = self.context_number[self.from_], self.symbol_number[symbol]
        parts = np.uint64(self.root.parts)
        # a context's transitions go to one partition, those of a split one to several: groups are contexts and parts of contexts
        group, numbers = self.from_, self.context_number
        asked = np.flatnonzero(numbers)
        pids = np.zeros(len(numbers), np.int64)
        pids[asked] = (mix(numbers[asked].astype(np.uint64)) % parts).astype(np.int64)
        splits = np.where(numbers > 0, 1 + self.context_count // self.root.split, 1)
        self.large = (splits > 1)[self.from_]
        some = np.flatnonzero(self.large)
        if len(some):
            part = mix(self.sym[some].astype(np.uint64) + np.uint64(1)) % splits[self.from_[some]].astype(np.uint64)
            pid = ((mix(self.ctx[some].astype(np.uint64)) + part) % parts).astype(np.int64)
            pairs, own = np.unique(self.from_[some] * self.root.parts + pid, return_inverse=True)
            group = self.from_.copy()
            group[some] = len(numbers) + own
            numbers, pids = np.append(numbers, numbers[pairs // self.root.parts]), np.append(pids, pairs % self.root.parts)
        # the groups by partition and by the contexts' shared numbers, then their transitions by the symbols' shared numbers
        asked = np.flatnonzero(numbers)
        asked = asked[_ordered(numbers[asked], np.zeros(len(asked), np.int64), 0, int(numbers.max(initial=0)))]
        asked = asked[_ordered(pids[asked], np.zeros(len(asked), np.int64), 0, self.root.parts)]
        rank = np.zeros(len(numbers), np.int64)
        rank[asked] = np.arange(len(asked))
        self.order = _ordered(rank[group], self.symbol_rank[symbol], len(self.symbol_rank), len(asked))  # all keys differ: the same wherever it is made again
        self.bounds = np.append(0, np.cumsum(np.bincount(pids[group], minlength=self.root.parts)))

    def transition_questions(self) -> Iterator[tuple[int, bytes]]:
        self._transitions()
        n = np.bincount(self.inverse[self.train[self.at]], minlength=len(self.ctx))
        q = np.empty(len(self.ctx))
        q[self.inverse] = self.now[self.at]
        q = np.minimum(np.rint(-4 * np.log2(q)), 255).astype(np.uint8)
        ctx, sym, n, q, large = (x[self.order] for x in (self.ctx, self.sym, n, q, self.large))
        for pid, (lo, hi) in enumerate(zip(self.bounds, self.bounds[1:], strict=False)):
            if hi > lo:
                yield pid, pickle.dumps((_pack(ctx[lo:hi], rising=True), _pack(sym[lo:hi]), _pack(n[lo:hi]), _pack(q[lo:hi]), np.unique(ctx[lo:hi][large[lo:hi]])))

    def _answered(self, answer: dict[int, bytes]) -> None:
        count, number, kept = np.zeros(len(self.ctx), np.int64), np.zeros(len(self.ctx), np.int64), np.zeros(len(self.ctx), bool)
        if answer:
            c, t, k = (np.concatenate(x) for x in zip(*([_unpack(x) for x in pickle.loads(answer[pid])] for pid in sorted(answer)), strict=True))
            count[self.order] = c
            if self.depth < self.params.depth:  # numbers come in the order of context and symbol
                number[self.order[(c >= self.params.least_count) & (self.sym[self.order] > 0)]] = t
            ctx = self.ctx[self.order]
            new = np.append(True, ctx[1:] != ctx[:-1])
            new[self.bounds[:-1][np.diff(self.bounds) > 0]] = True
            kept[self.order] = (k > 0)[np.cumsum(new) - 1]
        if self.large.any():
            kept[self.large] = np.isin(self.ctx[self.large], self.root.kept[self.depth - 1])
        m = self.params.smoothing
        # factor and addend of each distinct transition, then of each token
        total = self.context_count[self.from_] + m
        factor, plus = np.where(kept, m / total, 1.0), np.where(kept, count / total, 0.0)
        self.now[self.at] = self.now[self.at] * factor[self.inverse] + plus[self.inverse]
        local = np.where(number > 0, np.arange(len(number)), -1).astype(np.int32)
        self.context = np.full(len(self.ids), -1, np.int32)
        self.context[self.at] = local[self.inverse]
        self.context_number, self.context_count = number, count


def _merged_words(blobs: list[bytes], pid: int, root: _Root, p: TreeParams) -> tuple[list[bytes], bytes]:
    """Answers to the chunks' blocks, and (known words, symbols, occurrences of rarer words)."""
    asked = [pickle.loads(b) for b in blobs]
    hashes, n = [_unpack(x[0]) for x in asked], np.concatenate([_unpack(x[1]) for x in asked])
    unique, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    c = np.bincount(inverse, n, len(unique)).astype(np.int64)
    order = np.argsort(-c, kind="stable")
    rank = np.empty(len(c), np.int64)
    rank[order] = np.arange(len(c))
    number = np.where(c >= p.least_count, 1 + pid + root.parts * rank, 0)
    at = np.cumsum([0, *map(len, hashes)])
    out = [pickle.dumps((_pack(c[i]), _pack(number[i]))) for i in (inverse[a:b] for a, b in zip(at, at[1:], strict=False))]
    return out, pickle.dumps((int((c > 0).sum()), int((c >= p.least_count).sum()), int(c[c < p.least_count].sum())))


def _merged_transitions(blobs: list[bytes], pid: int, root: _Root, p: TreeParams, last: bool) -> tuple[list[bytes], bytes]:
    """Answers to the chunks' blocks, and rows (number, occurrences, sum of c ln(c/q), symbols seen) of the contexts that are split."""
    asked = [pickle.loads(b) for b in blobs]
    own = [_unpack(x[0]) for x in asked]
    ctx, sym, n, q = np.concatenate(own), *(np.concatenate([_unpack(x[k]) for x in asked]) for k in (1, 2, 3))
    large = np.unique(np.concatenate([x[4] for x in asked]))
    span = int(sym.max(initial=0)) + 1
    if int(ctx.max(initial=0)) < 2**62 // span:
        order = np.argsort(ctx * span + sym, kind="stable")  # merges the blocks, which are in order each
    else:
        order = np.lexsort((sym, ctx))
    ctx_s = ctx[order]
    first = _starts(ctx_s, sym[order])
    c = np.add.reduceat(n[order], first) if len(first) else n
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    of, q = ctx_s[first], q[order][first]
    by = _starts(of)
    seen = c > 0
    ratio = np.zeros(len(c))
    ratio[seen] = c[seen] * (np.log(c[seen]) + q[seen] * (np.log(2) / 4))
    total, ratio, seen = (np.add.reduceat(x, by) if len(by) else x for x in (c, ratio, seen.astype(np.int64)))
    kept = (total >= p.least_count) & (2 * (ratio - total * np.log(np.maximum(total, 1))) > p.penalty * seen * np.log(np.maximum(total, 1)))
    number = np.zeros(0, np.int64)
    if not last:
        may = (c >= p.least_count) & (sym[order][first] > 0)
        number = np.where(may, 1 + pid + root.parts * (np.cumsum(may) - 1), 0)
    contexts = of[by]
    kept_of = np.repeat(kept, np.diff(np.append(by, len(of))))
    out, lo = [], 0
    for x in own:
        at = inverse[lo : lo + len(x)]
        lo += len(x)
        own_numbers = number[at] if not last else number
        out.append(pickle.dumps((_pack(c[at]), _pack(own_numbers[own_numbers > 0], rising=True), _pack(kept_of[at[_starts(x)]].astype(np.uint8)))))
    some = np.isin(contexts, large)
    return out, pickle.dumps((contexts[some], total[some], ratio[some], seen[some]))


def _split_kept(side: list[bytes], p: TreeParams) -> np.ndarray:
    """Numbers of the split contexts that are kept, by the sums over their parts."""
    parts = [pickle.loads(x) for x in side]
    ctx, total, ratio, seen = (np.concatenate([x[k] for x in parts]) if parts else np.zeros(0) for k in range(4))
    unique, inverse = np.unique(ctx, return_inverse=True)
    total, ratio, seen = (np.bincount(inverse, x, len(unique)) for x in (total, ratio, seen))
    return unique[2 * (ratio - total * np.log(np.maximum(total, 1))) > p.penalty * seen * np.log(np.maximum(total, 1))]


def score_texts(docs: DataFrame, held: Column, p: TreeParams = TreeParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document; learns from the rows where ``held`` is false."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    state = cut(chunks(docs, p, id_col, text_col, held))
    every, tokens = (x or 0 for x in state.agg(F.sum("tokens"), F.sum("train")).first())
    root = _Root(tokens, max(1, -(-every // p.part_tokens)), max(p.split_tokens, tokens // p.most_split), lump=p.lump)
    state = state.select("chunk", "kind", "pid", "blob")
    parts = [state]

    def of_chunk(table, shared) -> _Chunk:
        """From a chunk's rows: kind 0 is its state, -1 the hashes of its words, k + 1 the answers to question k."""
        rows = table.select(["kind", "pid", "blob"]).to_pylist()
        answers: list[dict] = [{} for _ in range(max(r["kind"] for r in rows))]
        for r in rows:
            if r["kind"] > 0:
                answers[r["kind"] - 1][r["pid"]] = r["blob"]
        own = {r["kind"]: r["blob"] for r in rows if r["kind"] <= 0}
        return _Chunk(own[0], answers, shared.value, p, own.get(-1))

    def grouped():
        return reduce(DataFrame.unionByName, parts).groupBy("chunk")

    def asked_by(k: int, shared):
        def ask(key, table):
            import pyarrow as pa

            c = of_chunk(table, shared)
            rows = [{"chunk": key[0].as_py(), "pid": pid, "blob": blob} for pid, blob in (c.transition_questions() if k else c.word_questions())]
            return pa.Table.from_pylist(rows, pa.schema([("chunk", pa.int64()), ("pid", pa.int64()), ("blob", pa.binary())]))

        return grouped().applyInArrow(ask, "chunk long, pid long, blob binary")

    def answered(k: int, shared):
        def merge(key, table):
            import pyarrow as pa

            pid, blobs, ids = key[0].as_py(), table.column("blob").to_pylist(), table.column("chunk").to_pylist()
            out, side = _merged_transitions(blobs, pid, shared.value, p, k == p.depth) if k else _merged_words(blobs, pid, shared.value, p)
            rows = [{"chunk": i, "kind": k + 1, "pid": pid, "blob": b} for i, b in [*zip(ids, out, strict=True), (-1, side)]]
            return pa.Table.from_pylist(rows, pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("pid", pa.int64()), ("blob", pa.binary())]))

        return asked_by(k, shared).groupBy("pid").applyInArrow(merge, "chunk long, kind int, pid long, blob binary")

    for k in range(p.depth + 1):
        shared = spark.sparkContext.broadcast(root)
        got = cut(answered(k, shared), wait=True)
        side = [r[0] for r in got.filter("chunk < 0").select("blob").toLocalIterator()]  # a few numbers a partition, and the split contexts
        parts = [state.filter("kind = 0"), *parts[1:], got.filter("chunk >= 0")]
        if k:
            root = replace(root, kept=(*root.kept, _split_kept(side, p)))
        else:
            known, tracked, rare = (sum(x) for x in zip((0, 0, 0), *map(pickle.loads, side), strict=True))
            # the class of rarer words also holds the unknown words, which count as one
            root = replace(root, known=known, rare=(rare + p.lump * (known - tracked + 1)) / (tokens + p.lump * (known + 1)))
    settle(spark)
    shared = spark.sparkContext.broadcast(root)
    kind = docs.schema[id_col].dataType
    id_type = to_arrow_type(kind)

    def scored(key, table):
        import pyarrow as pa

        c = of_chunk(table, shared)
        at = np.cumsum(c.n) - c.n
        known_ = np.add.reduceat((c.counts > 0)[c.ids], at, dtype=np.int64)
        base = np.add.reduceat(np.log10(c.p0)[c.ids], at)
        model = np.add.reduceat(np.log10(c.now) + np.log10(c.within)[c.ids], at)
        return pa.Table.from_arrays(
            [pa.array(c.doc_ids, id_type), pa.array(c.held), pa.array(c.n), pa.array(known_), pa.array(np.full(len(c.n), tokens, np.int64)), pa.array(base), pa.array(model)],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return grouped().applyInArrow(scored, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
