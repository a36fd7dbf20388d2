"""The corpus pipeline: language, near copies, secrets, mixture, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import langid, mixing, packing, secret_scan, simhash
from chronolith.llm.common import id_remainder, pick, unused
from chronolith.session import scratch_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too) go, all others stay.

    The cosine decides nothing: on a word or two it is within the vectors' noise (about 0.03), in a learned language too. So texts in
    languages that were not learned stay as well.
    """
    learned = langid.prototypes(pick(docs, "doc_id", "text", "lang").filter(id_remainder(F.col("doc_id"), 4) != 2))
    name = unused(docs, "language")
    told = langid.with_language(docs, learned, out=name)
    return told.filter(F.col(f"{name}.lang_pred") != langid.NO_LANGUAGE).drop(name)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints connect, the one with the smallest id stays."""
    return simhash.first_of_groups(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced by a mark."""
    return secret_scan.redacted(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: a repeated document is repeated rows, one not taken goes."""
    name = unused(docs, "mix")
    times = F.array_repeat(F.lit(1), F.col(f"{name}.copies").cast("int"))
    return mixing.mixed(docs, out=name).withColumn(name, F.explode(times)).drop(name)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most 1024 tokens."""
    return packing.packed(packing.pieces_of(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near_copies", one_of_near_copies),
    ("secrets", without_secrets),
    ("mixture", mixed_sources),
    ("packing", packed_sequences),
]

#: Fingerprints, a trained forest, subset sums and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written below the shared checkpoint folder and read by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
