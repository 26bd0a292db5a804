"""The corpus pipeline: language ID, exact dedup, near-duplicate join, benchmark
decontamination, and mixing to target weights."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import block_naming, decontaminate, jaccard_join, langid, mixing
from tracewright.llm.common import read, shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go; the model learns from the stage's input.

    Null and empty texts and those without a letter are rejected; null and repeated ids
    and repeated rows make no difference."""
    return langid.drop_rejected(docs, langid.fit(docs, max_rows=6000))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays.

    Null ids are smallest, null texts count as empty; of repeated rows one stays."""
    return block_naming.drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8, the one with the smallest id stays.

    Null ids are largest; rows of one id are told apart by their texts, and of repeated
    rows one stays.  Null and empty texts link with nothing and stay."""
    return jaccard_join.drop_near_duplicates(docs, width=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a ten-word benchmark window occurs go; null and empty ones stay."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"), n=10)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: the documents it takes words of, with how many it takes.

    ``size`` is a document's number of words, ``target`` its source's words in the mix,
    ``taken`` the words taken of it, repeats included; columns of these names in ``docs``
    give way.  Repeated rows are taken each by itself."""
    mixed = mixing.mix_sources(docs, whole_rows=True).where("taken > 0")
    own = ("size", "target", "taken")
    return mixed.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in own], *own)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", benchmark_decontamination),
    ("mixing", mixing_to_weights),
]

#: Language ID is a trained model, which SQL can't express; see tests/llm.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
