"""Registered queries of the subpackage: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sigengine.llm.common import crc_mod, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigengine.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigengine.llm.suffix_tree import score_texts

    return score_texts(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 1)


def op3_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigengine.llm.hyperminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigengine.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op5_centroid_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigengine.llm.centroid_langid import fit, predict

    docs, held = table(spark, sf_dir, "documents"), crc_mod("doc_id", 4) == 2
    return predict(docs, fit(docs.filter(~held)), keep={"held_out": held})


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigengine.llm.pii import pii_report

    return pii_report(table(spark, sf_dir, "documents"))


def op7_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigengine.llm.convnet import fit, score

    docs, held = table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 0
    return score(docs, fit(docs, table(spark, sf_dir, "labels").filter(~held)), keep={"held_out": held})


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sigengine.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigengine.llm.hnsw import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sigengine.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_suffix_tree, op3_hyperminhash, op4_license_scan, op5_centroid_langid, op6_pii, op7_convnet, op8_byte_bpe, op9_hnsw, op10_pattern_packing)}

#: words of the contracts, and their separators
_WORD, _BLANK = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"


def _quality_sql() -> str:
    """The counts by windows and distinct lines, the beta prior by moments, and the hosts' verdicts."""
    rules = ("short", "repeated", "symbols", "dup_lines")
    moments = ", ".join(f"sum({r}) AS f_{r}, sum(CAST({r} AS DOUBLE) * {r} / n) AS s_{r}" for r in rules)
    rho = lambda r: f"CASE WHEN f_{r} / n_all * (1 - f_{r} / n_all) * (n_all - n2 / n_all - (h - 1)) > 0 THEN (s_{r} - f_{r} * f_{r} / n_all - f_{r} / n_all * (1 - f_{r} / n_all) * (h - 1)) / (f_{r} / n_all * (1 - f_{r} / n_all) * (n_all - n2 / n_all - (h - 1))) ELSE 1e-4 END"
    prior = ", ".join(f"least(greatest(f_{r} / n_all, 1e-6), 1 - 1e-6) AS m_{r}, 1 / least(greatest({rho(r)}, 1e-4), 0.5) - 1 AS k_{r}" for r in rules)
    rates = ", ".join(f"(m_{r} * k_{r} + {r}) / (k_{r} + n)" for r in rules)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS k FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8) x),
cov AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, k) AS c FROM win) y WHERE c > 1) z CROSS JOIN (SELECT unnest(range(0, 8)) AS j) o GROUP BY 1),
f AS (SELECT doc_id, host, len(words) AS n_words, length(regexp_replace(text, '{_BLANK}', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (rid)),
g AS (SELECT *, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repeated, 100 * n_symbols > 50 * n_words AS symbols, 100 * n_dup_lines > 60 * n_lines AS dup_lines FROM f),
hosts AS (SELECT host, count(*) AS n, {', '.join(f'count(*) FILTER ({r}) AS {r}' for r in rules)} FROM g WHERE host IS NOT NULL GROUP BY 1),
sums AS (SELECT count(*) AS h, CAST(sum(n) AS DOUBLE) AS n_all, sum(CAST(n AS DOUBLE) * n) AS n2, {moments} FROM hosts), prior AS (SELECT {prior} FROM sums),
bad AS (SELECT host FROM hosts CROSS JOIN prior WHERE greatest({rates}) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeated AS base_failed, NOT (short OR repeated) AND bad.host IS NULL AS kept, bad.host IS NOT NULL AS host_rejected FROM g LEFT JOIN bad ON g.host = bad.host"""


_NEAR_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, hash(k) AS k FROM (SELECT doc_id, array_to_string(words[i:i + 4], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0) x) y),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 75 * (a.n + b.n - c)),
edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT reach.doc_id, edges.v FROM reach JOIN edges ON reach.c = edges.u)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY 1) r USING (doc_id)"""

#: Equal rows by SQL; the other operators are held against brute force in the tests.
ORACLE: dict[str, str] = {"op1_quality_rules": _quality_sql(), "op3_hyperminhash": _NEAR_SQL}
