"""Corpus preparation: five stages over ``documents``, each written as Parquet and read again by the next.

All stages but the last return the columns of their input, whatever others than id, text and source there are, and whatever
their names. A null text counts as empty. An empty table gives an empty table. Each row is judged by itself (repeated rows
alike), but for near-duplicates; ties and other cases are those of the operators.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigengine.llm import convnet, hyperminhash, packing, pii, quality_rules
from sigengine.llm.common import crc_mod
from sigengine.sources.shared import remove, shared_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the network scores under its threshold; it learns from labels as the op7 query does.

    Whole texts are scored, null and empty ones as one chunk of padding; without labels every document stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_mod("doc_id", 5) != 0)
    return convnet.keep_documents(docs, convnet.fit(docs, labels))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or whose host is rejected.

    Null and empty texts are too short and go; a document without a host is judged by its own text only.
    """
    return quality_rules.keep_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that of the smallest id.

    Documents without words or without an id stay; of rows that repeat id and text one stays, rows that share an id only
    are judged each by its text.
    """
    return hyperminhash.keep_documents(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by marks; ``n_chars``, if there is such a column, follows the new text. Null texts stay null."""
    out = pii.mask_pii(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences; a null or empty text is its end token alone, repeated rows are packed each."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", rules), ("near_dedup", near_dedup), ("pii", mask_personal_data), ("packing", pack)]

#: The network, the tokenizer and the packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each returns goes through the shared folder.

    What a stage read is removed once its own result is written; the last result stays for the caller to read.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
