"""A training-data pipeline of five operators, each stage's table written and read again.

The stages: line-first quality rules; one document of each group of near copies;
secrets redacted; sources mixed to target weights; byte-level BPE.

Null and edge cases: an empty table gives an empty one at each stage; rows of null or empty
text fail the quality rules, stay in the three stages after them, and have no tokens; rows of
null doc_id are judged like others but are no near copy of anything; rows of null source are
a source of their own; repeated rows stay as often as they come until the mix; other columns,
whatever their names, are carried along up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.llm import bpe, jaccard, mixing, quality, secrets
from docloom.llm.store import new_dir, staged

#: Python helpers run inside the stages, so SQL can't express the result.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failing lines."""
    return quality.clean(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of near copies."""
    return jaccard.first_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced by a mark."""
    clean = secrets.redact(docs, secrets.scan(docs, new_dir(spark, "ledger")))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of each row; ids are little-endian unsigned 32-bit."""
    how = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode(docs, *how, keep=("doc_id", "lang", "source")).select(
        "doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids"
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
