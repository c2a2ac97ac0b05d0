"""The corpus pipeline: documents through five stages, each written and read again.

All stages but the last return the columns of what they are given, whatever their names. Rows with null ids,
repeated rows and repeated ids are judged each by its own text; nulls in other columns pass; an empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, jaccard, packing, quality
from tidemark.llm.queries import tokenizer_path
from tidemark.sources.tables import passing_tables, remove_tables, stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are scored from statistics of zero."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_classified(docs, quality.learn(docs, labels))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the constrained trees, which learn from the whole of ``documents``.

    Null, empty and short texts fail the base rules.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality.keep_ruled(docs, quality.learn(whole, labels, monotone=quality.constraints()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class of near-duplicates. Rows without an id stay only where no
    row of their class has one, equal rows stay once, and texts without a word all stay."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word passage of a benchmark item. Null and empty texts stay."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents, with their ids, and their places in sequences of 4096.

    A null text is empty: its only id is the last one.
    """
    return packing.pack_texts(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed_sequences),
]

#: The stages score by fitted models and cut by a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each reads what the one before it wrote.

    What a stage stored for itself is removed once its result is written, and that once the next one's is.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read: list[str] = []
    for name, stage in STAGES:
        written: list[str] = []
        with passing_tables(spark):
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", into=written)
        remove_tables(spark, read)
        read = written
    return docs
