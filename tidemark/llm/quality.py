"""Quality classifier and quality rules: boosted trees over statistics of whole texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import fresh
from tidemark.llm.boosting import Forest, fit
from tidemark.llm.docstats import COUNTS, FEATURES, measured

#: At most so many labelled rows are fitted on; those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
#: From this score on, a document is good.
THRESHOLD = 0.3
#: More of these never raises the score of the rules.
FALLING = ["upper", "symbols", "bangs", "bars", "dup_lines", "repeated"]

def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor

def learn(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
    monotone: dict[int, int] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> Forest:
    """Fit on at most ``sample_rows`` rows of ``labels``, never on one whose id has remainder 0 of 5.

    Rows without an id or a label are not learnt from; of ids with many rows or labels at most ``sample_rows``
    rows come to the driver. Without labels, or with labels of one kind
    only, the model is a constant.
    """
    chosen = (
        labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & (id_remainder(F.col("id"), 5) != 0))
        .orderBy(F.xxhash64("id"), "id", "label")
        .limit(sample_rows)
    )
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body"))
    rows = texts.join(F.broadcast(chosen), "id")  # the sample is bounded by sample_rows
    seen = measured(rows, "body", ["id", "label"], lambda _, x: {"x": list(x)}, "x array<double>")
    seen = seen.orderBy(F.xxhash64("id"), "id", "label", "x").limit(sample_rows).toPandas()  # an id may have any number of rows
    seen = seen.sort_values(["id", "label"], kind="stable")
    x = np.array(seen["x"].tolist(), float).reshape(len(seen), len(FEATURES))
    return fit(x, seen["label"].to_numpy(), monotone=monotone)

def classify(
    docs: DataFrame, model: Forest, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted.

    held_out is true where crc32 of the id modulo 5 is 0, and false for a null id. Null and empty texts
    have all statistics zero and are scored from those. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
    scored = measured(rows, "body", ["doc_id"], lambda _, x: {"score": model.score(x)}, "score double")
    return scored.select(
        "doc_id",
        F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )

def constraints() -> dict[int, int]:
    return {FEATURES.index(name): -1 for name in FALLING}

def apply_rules(
    docs: DataFrame, model: Forest, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document row: doc_id, the counts of ``docstats``, base_failed, score, kept.

    A text fails the base rules if it has fewer than 50 words, or if more than half of its words are in
    repeated 3-word windows; null and empty texts fail. What passes them is kept if the constrained
    trees score it at ``threshold`` or more. Other columns are ignored.
    """

    def finish(counts: np.ndarray, x: np.ndarray) -> dict:
        return {name: counts[:, i] for i, name in enumerate(COUNTS)} | {"score": model.score(x)}

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
    schema = ", ".join(f"{name} bigint" for name in COUNTS) + ", score double"
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    return (
        measured(rows, "body", ["doc_id"], finish, schema)
        .withColumn("base_failed", (n < 50) | (100 * repeated > 50 * n))
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    )

__all__ = ["THRESHOLD", "apply_rules", "classify", "constraints", "docstats", "id_remainder", "learn"]


def keep_classified(docs: DataFrame, model: Forest, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows that the classifier scores at ``threshold`` or more, with all their columns, whatever their names."""
    score = fresh(docs.columns, "score")
    scored = measured(docs, text, docs.columns, lambda _, x: {score: model.score(x)}, f"`{score}` double")
    return scored.where(scored[score] >= threshold).drop(score)


def keep_ruled(docs: DataFrame, model: Forest, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows that pass the base rules and the constrained trees, with all their columns, whatever their names."""
    kept = fresh(docs.columns, "kept")

    def finish(counts: np.ndarray, x: np.ndarray) -> dict:
        n, repeated = counts[:, COUNTS.index("n_words")], counts[:, COUNTS.index("n_repeat_words")]
        return {kept: (n >= 50) & (100 * repeated <= 50 * n) & (model.score(x) >= threshold)}

    judged = measured(docs, text, docs.columns, finish, f"`{kept}` boolean")
    return judged.where(judged[kept]).drop(kept)
