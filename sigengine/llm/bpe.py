"""Byte-level BPE with tiktoken: whole texts to ids and ids back to bytes.

Long texts are cut before a space that stands between two letters: the pre-splitting pattern never joins a letter to a
following space, so the matches, and the ids, are those of the whole text.

Defined results: a null text counts as empty (no ids; the digests are those of the empty string); repeated rows and tied
ids are rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigengine.llm.common import python_ready

_SAFE = regex.compile(r"(?<=\p{L}) (?=\p{L})")
_LOADED: dict = {}


def encoding(rank_file: str, pattern: str):
    """The encoding of a rank file; kept for the life of the process."""
    import tiktoken

    if (rank_file, pattern) not in _LOADED:
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _LOADED[rank_file, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[rank_file, pattern]


def pieces(text: str, piece_chars: int) -> Iterator[str]:
    """The text in pieces of about ``piece_chars``, cut where no match can run across."""
    at = 0
    while len(text) - at > piece_chars:
        m = _SAFE.search(text, at + piece_chars)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(text: str, enc, piece_chars: int = 65_536) -> list[int]:
    if len(text) <= piece_chars:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text, piece_chars) for i in enc.encode_ordinary(p)]


def decode(ids: list[int], enc) -> bytes:
    return enc.decode_bytes(ids)


def encode_column(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", piece_chars: int = 65_536) -> DataFrame:
    """(doc_id, ids): every text's ids."""
    python_ready(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        import pyarrow as pa

        enc = encoding(rank_file, pattern)
        for b in batches:
            ids = [encode(t, enc, piece_chars) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", piece_chars: int = 65_536) -> DataFrame:
    """One row a document: number of ids, digest of the ids, digest of the bytes decoded from them."""
    python_ready(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        import pyarrow as pa

        enc = encoding(rank_file, pattern)
        names = [str(i) for i in range(enc.max_token_value + 1)]
        for b in batches:
            n, of_ids, of_bytes = [], [], []
            for t in b.column("text").to_pylist():
                ids = encode(t, enc, piece_chars)
                n.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(decode(ids, enc)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
