"""Packing of tokenised documents into sequences of fixed length, by patterns.

Every document's ids (and an end id) are cut into pieces of at most ``size``; the histogram of piece lengths, at most
``size`` numbers, comes to the driver. There patterns of two to four lengths that fill a sequence exactly get repeat counts
by non-negative least squares against the histogram, over a basis of at most as many patterns as there are lengths; counts
are rounded and what is left is fitted again, then packed best-fit. The plan says which ranks of each length go to which sequences; pieces get ranks within their length in salted groups.

Defined results: a null text counts as empty (one piece: the end id); repeated rows are packed as pieces of their own;
ties in length go by id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigengine.llm import bpe
from sigengine.llm.common import cut, python_ready

_ADJACENT = re.compile(r"\s\s")
#: Where no two blanks stand together: a run of Latin letters with the space before it, a line end, or what else stands
#: up to the next space or line end. A match of the pre-splitting pattern ends wherever one of these does.
_UNITS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^\W\d_])|\n| ?[^ \n]+| ")
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: How byte-level pre-splitting of a tokenizers file splits, and characters whose classes all regular expressions agree on.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER = re.compile(r"[^\t\n\r -~¡-¬®-ɏ]")
_ENCODERS: dict = {}


def merge_loop(path: str, tokenizer):
    """A tiktoken encoding with the merges of a tokenizers file, or None where its ids might be other ones.

    tokenizers merges listed pairs in the order of the list, tiktoken any neighbours that make a token in the order of ids.
    Both do the same if ids follow the list and every token, put to the file's own model, comes back as itself: between
    the edges of a token to be, earlier merges then leave the listed pair and no other.
    """
    import tiktoken
    from tokenizers import pre_tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split, vocab = spec["model"], spec["pre_tokenizer"] or {}, spec["model"].get("vocab")
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    whole = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
    if not (plain and whole):
        return None
    letters = sorted(pre_tokenizers.ByteLevel.alphabet(), key=lambda c: (not (33 <= ord(c) <= 126 or 161 <= ord(c) <= 172 or 174 <= ord(c) <= 255), ord(c)))
    direct = [ord(c) for c in letters if ord(c) < 256]  # those bytes stand for themselves, the others follow in order
    byte = dict(zip(letters, direct + [b for b in range(256) if b not in set(direct)], strict=True))
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    merged = set(made)
    if made != sorted(merged) or -1 in merged or byte.keys() - vocab.keys() or any((t in byte) == (i in merged) for t, i in vocab.items()):
        return None
    if any([x.id for x in tokenizer.model.tokenize(t)] != [i] for t, i in vocab.items()):
        return None
    return tiktoken.Encoding("merges", pat_str=_SPLIT, mergeable_ranks={bytes(map(byte.__getitem__, t)): i for t, i in vocab.items()}, special_tokens={})


class UnitEncoder:
    """Ids of whole texts as the tokenizers library gives them by a file.

    Where the file allows it (``merge_loop``), texts of Latin characters go through tiktoken's faster loop with the file's
    merges. The library encodes the others, each distinct unit once while it is remembered: units end only where byte-level
    pre-splitting always ends a match, so the ids of the units, in order, are those of the text.
    """

    def __init__(self, path: str, remembered: int = 150_000, longest: int = 48):
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered, self.longest = Tokenizer.from_file(path), remembered, longest
        self.forget()
        self.special = sorted(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        self.merges = merge_loop(path, self.tokenizer)

    def units(self, text: str) -> list[str]:
        if any(s in text for s in self.special):
            return [text]
        if _ADJACENT.search(text):
            return _CUT.split(text)
        return _UNITS.findall(text)

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}  # little-endian ids
        self.older: dict[str, bytes] = {}  # those remembered before ``known`` was full; units used again move back

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """At most twice ``remembered`` units of ``longest`` characters outlive the call: some 60 MB."""
        out = [self._merged(t) for t in texts]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for k in range(0, len(rest), 64):
            some = rest[k : k + 64]
            for i, ids in zip(some, self._encode([texts[i] for i in some]), strict=True):
                out[i] = ids
        return out

    def _merged(self, text: str, piece_chars: int = 65_536) -> np.ndarray | None:
        if self.merges is None or not text or _OTHER.search(text) or any(s in text for s in self.special):
            return None
        if len(text) <= piece_chars:
            return np.array(self.merges.encode_ordinary(text), "<u4")
        parts = list(bpe.pieces(text, piece_chars))
        if max(map(len, parts)) > 2 * piece_chars:
            return None
        return np.concatenate([np.array(self.merges.encode_ordinary(p), "<u4") for p in parts])

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.units(t) if t else [] for t in texts]
        if len(self.known) > self.remembered:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        missing = set().union(*split) - known.keys()
        again = missing & older.keys()
        known.update((u, older[u]) for u in again)
        new = list(missing - again)
        if new:
            known.update(zip(new, [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)], strict=True))
        out = [np.frombuffer(b"".join(map(known.__getitem__, us)), "<u4") for us in split]
        for u in new:
            if len(u) > self.longest:
                del known[u]
        return out


def encoder(path: str) -> UnitEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer_file: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): pieces of ``size`` ids from a document's end, so the first may be shorter."""
    python_ready(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        import pyarrow as pa

        enc = encoder(tokenizer_file)
        end = np.array([end_id], "<u4")
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(enc.encode(b.column("text").to_pylist())):
                ids = np.concatenate([ids, end])
                first = len(ids) % size or size
                bounds = [0, *range(first, len(ids) + 1, size)]
                for k, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    row.append(i), piece.append(k), start.append(s), length.append(e - s), crc.append(zlib.crc32(ids[s:e].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        enc.forget()  # workers live on for other tasks

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def patterns(lengths: np.ndarray, size: int, most: int = 120_000) -> np.ndarray:
    """Rows of up to four of ``lengths`` (0: none) whose sum is ``size``; of three and four, evenly spread ones up to about ``most``."""
    have = np.zeros(size + 1, bool)
    have[lengths] = True
    lengths = np.sort(lengths[lengths < size])
    found = []
    b = size - lengths
    ok = (b >= lengths) & have[b]
    found.append(np.stack([lengths[ok], b[ok], 0 * b[ok], 0 * b[ok]], 1))
    if len(lengths):
        # a slab for each first length, so that no whole grid is ever held: it would take some 400 MB of the driver
        three, few = [], lengths[:: max(1, len(lengths) // 64)]
        for a in lengths:
            b = lengths[lengths >= a]
            c = size - a - b
            ok = (c >= b) & have[np.clip(c, 0, size)]
            three.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok], 0 * c[ok]], 1).astype(np.int32))
        three = np.concatenate(three)
        found.append(three[:: max(1, len(three) // (most // 2))].astype(lengths.dtype))
        four = []
        for a in few:
            b, c = (x.ravel() for x in np.meshgrid(few[few >= a], lengths, indexing="ij"))
            d = size - a - b - c
            ok = (b <= c) & (d >= c) & have[np.clip(d, 0, size)]
            four.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok], d[ok]], 1).astype(np.int32))
        four = np.concatenate(four)
        found.append(four[:: max(1, len(four) // (most // 2))].astype(lengths.dtype))
    return np.concatenate(found) if found else np.zeros((0, 4), int)


def _rest(rows: np.ndarray, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What repeats ``x`` of the patterns leave of the histogram; place 0 stands for no piece."""
    out = counts - np.bincount(rows.ravel(), np.repeat(x, rows.shape[1]), len(counts))
    out[0] = 0
    return out


def nnls(rows: np.ndarray, counts: np.ndarray, steps: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns with least squares of (lengths used - counts), by accelerated projected gradient.

    A pattern's step is one over the number of pieces that share a length with it, which bounds its row of the normal matrix.
    """
    x = y = np.zeros(len(rows))
    share = np.bincount(rows.ravel(), minlength=len(counts)).astype(float)
    share[0] = 0
    step = 1 / np.maximum(share[rows].sum(1), 1)
    t = 1.0
    for _ in range(steps):
        z = np.maximum(0, y + step * _rest(rows, y, counts)[rows].sum(1))
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = np.maximum(0, z + (t - 1) / u * (z - x)), z, u
    return x


def fitted(rows: np.ndarray, counts: np.ndarray, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """A basis of at most as many patterns as there are lengths, and its repeat counts by non-negative least squares.

    A fit over all patterns spreads each count over very many of them, where rounding loses it. So patterns of little
    weight leave the basis and those that would take most of what is left enter, round by round.
    """
    most = int((counts[1:] > 0).sum())
    basis = np.argsort(-nnls(rows, counts, 150), kind="stable")[:most]
    for _ in range(rounds):
        x = nnls(rows[basis], counts, 200)
        gain = _rest(rows[basis], x, counts)[rows].sum(1)
        gain[basis] = -np.inf
        new = np.argsort(-gain, kind="stable")[: max(1, most // 2)]
        basis = np.concatenate([basis[x > 1e-3], new[gain[new] > 0.5]])
        basis = basis[np.argsort(-nnls(rows[basis], counts, 200), kind="stable")[:most]]
    return rows[basis], nnls(rows[basis], counts, 600)


def best_fit(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (lengths in a sequence, how many such sequences)."""
    rooms: list[int] = []
    open_: dict[int, list] = {}

    def add(room: int, content: tuple, n: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((content, n))

    done = []
    for length in range(len(counts) - 1, 0, -1):
        left = int(counts[length])
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = size // length
                if left >= each:
                    n = left // each
                    fresh, left = ((length,) * each, n), left - n * each
                else:
                    fresh, left = ((length,) * left, 1), 0
                room = size - sum(fresh[0])
                done.append(fresh) if room == 0 else add(room, *fresh)
                continue
            room = rooms[i]
            content, n = open_[room].pop()
            fit = min(room // length, left)  # into one sequence
            take = min(n, left // fit)
            if n > take:
                open_[room].append((content, n - take))
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            left -= take * fit
            fresh, rest = content + (length,) * fit, room - length * fit
            done.append((fresh, take)) if rest == 0 else add(rest, fresh, take)
    return done + [x for room in rooms for x in open_[room]]


def plan(counts: np.ndarray, size: int, most: int = 120_000, worst: float = 0.75, rounds: int = 12) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, repeats) for a histogram of lengths: patterns first, best-fit for what they leave.

    Patterns with the largest pieces are taken first; counts under one half are rounded up to one, since a pattern fills
    its sequence, as far as the histogram has the pieces. The rest is fitted again until a fit misses ``worst`` of it.
    ``most`` bounds the patterns that are enumerated.
    """
    left = counts.astype(np.int64).copy()
    out = [((size,), int(left[size]))] if left[size] else []
    left[size] = 0
    for n_round in range(rounds):
        rows = patterns(np.flatnonzero(left), size, most)
        if not len(rows):
            break
        rows, x = fitted(rows, left.astype(float))
        if n_round and np.abs(_rest(rows, x, left.astype(float))).sum() > worst * left.sum():
            break
        placed = 0
        for i in np.lexsort((-x, -rows.max(1))):
            if x[i] <= 0.05:
                continue
            content = rows[i][rows[i] > 0]
            lengths, each = np.unique(content, return_counts=True)
            n = int(min(max(1, round(x[i])), (left[lengths] // each).min()))
            if n > 0:
                left[lengths] -= n * each
                out.append((tuple(content.tolist()), n))
                placed += n
        if not placed:
            break
    return out + best_fit(left, size)


def slots(planned: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, ranks, first sequence, offset), by length and rank."""
    next_rank: dict[int, int] = {}
    out, sequence = [], 0
    for content, n in planned:
        offset = 0
        for v in content:
            lo = next_rank.get(v, 0)
            out.append((v, lo, n, sequence, offset))
            next_rank[v] = lo + n
            offset += v
        sequence += n
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_file: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", group_rows: int = 256) -> DataFrame:
    """One row a piece, with its sequence and place there."""
    p = cut(token_pieces(docs, tokenizer_file, size, end_id, id_col, text_col))
    counts = np.zeros(size + 1, np.int64)
    for length, n in p.groupBy("length").count().collect():  # at most ``size`` rows
        counts[length] = n
    table = slots(plan(counts, size))
    groups = F.lit([int(c) // group_rows + 1 for c in counts])[F.col("length").cast("int")]
    p = p.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), groups))
    before = p.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = p.withColumn("rn", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before.select("length", "part", "before"), ["length", "part"]).withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("rn") - 1)
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")

    def place(batches):
        import pyarrow as pa

        keys = (table[:, 0] << 48) + table[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1] if len(length) else table[:0]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = ranked.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
