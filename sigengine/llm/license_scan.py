"""License detection by ordered signature rules.

Hundreds of hand-written regular expressions (``license_rules``) run over the words of a text joined by single spaces. A group
of rules runs only on texts that hold one of its keywords. Detections are taken in the order of their rules; one that lies
within an interval already taken is dropped. Both steps take time in proportion to the text and its detections (the latter
times the logarithm of their number).

Defined results: null and empty texts have no words and no labels (score 0); repeated rows and tied ids are rows of their
own; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigengine.llm.common import python_ready
from sigengine.llm.license_rules import SIGNATURES

#: Bytes to words: A-Z lowered, other ASCII but digits and letters to spaces; bytes over 127 belong to words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

#: Fixed phrases of the contract and their labels.
BASE = ((b"under the mit license", "mit"), (b"apache license version 2", "apache-2"), (b"cc by nc", "cc-by-nc"))


def groups(signatures: str = SIGNATURES) -> list[tuple[list[str], list[tuple[str, float, str]]]]:
    """[(keywords, [(label, weight, pattern)])] as they are written."""
    out: list = []
    for line in filter(None, map(str.strip, signatures.splitlines())):
        if line.startswith("@"):
            out.append(([k.strip() for k in line[1:].split("|")], []))
        else:
            label, weight, pattern = line.split(" ", 2)
            out[-1][1].append((label, float(weight), pattern))
    return out


@lru_cache(1)
def rules() -> tuple:
    """(keywords, [(place in the order, weight, label, compiled rule)]); rules start at the space before a word, which texts are scanned for fast."""
    out, place = [], 0
    for keywords, own in groups():
        compiled = []
        for label, weight, pattern in own:
            compiled.append((place, weight, label, re.compile(f" (?:{pattern})(?= )".encode())))
            place += 1
        out.append(([k.encode() for k in keywords], compiled))
    return tuple(out)


def detections(words: bytes) -> list[tuple[int, int, str, float]]:
    """(start, end, label, weight) in ``words``, a text's words joined by single spaces; contained ones suppressed."""
    padded, found = b" " + words + b" ", []
    for keywords, own in rules():
        if any(k in words for k in keywords):
            for place, weight, label, rule in own:
                found += [(place, m.start(), m.end() - 1, label, weight) for m in rule.finditer(padded)]
    kept: list[tuple[int, int, str, float]] = []
    # the intervals taken that lie within no other one: starts and ends both rise
    starts: list[int] = []
    ends: list[int] = []
    for _, s, e, label, weight in sorted(found):
        at = bisect_right(starts, s)
        if at and ends[at - 1] >= e:
            continue
        kept.append((s, e, label, weight))
        first, last = bisect_left(starts, s), bisect_right(ends, e)
        starts[first:last], ends[first:last] = [s], [e]
    return sorted(kept)


def base_places(words: bytes) -> list[tuple[int, str]]:
    """(word index, label) of every place where a base phrase stands."""
    padded, out = b" " + words + b" ", []
    for phrase, label in BASE:
        look = b" " + phrase + b" "
        at, word, read = padded.find(look), 0, 0
        while at >= 0:
            word += padded.count(b" ", read, at)  # spaces before this one: the words before the phrase
            out.append((word, label))
            read, at = at, padded.find(look, at + 1)
    return out


def scan_text(text: str | None) -> tuple:
    words = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split())
    n = words.count(b" ") + 1 if words else 0
    base = base_places(words)
    more = detections(words)
    base_labels = sorted({x for _, x in base})
    labels = sorted({*base_labels, *(x[2] for x in more)})
    score = 1.0 if base else max((x[3] for x in more), default=0.0)
    at = [i for i, _ in base]
    return n, len(base), min(at, default=None), max(at, default=None), ",".join(base_labels), ",".join(labels), score


COLUMNS = ("n_words long", "n_base long", "first_word long", "last_word long", "base_labels string", "labels string", "score double")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: word count, places and labels of base phrases, all labels, score."""
    python_ready(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa

        types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
        for b in batches:
            rows = [scan_text(t) for t in b.column("text").to_pylist()]
            cols = [pa.array([r[i] for r in rows], types[c.split()[1]]) for i, c in enumerate(COLUMNS)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", *(c.split()[0] for c in COLUMNS)])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {', '.join(COLUMNS)}")
