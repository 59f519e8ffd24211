"""A bounded, repeatable sample of labelled documents to fit a classifier on, and what its rows stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsieve.llm.common import remainder, text_or_empty
from claimsieve.operators.layout import reliable


def labelled_sample(
    docs: DataFrame, labels: DataFrame, column: str, modulus: int, held_out: int, rows_per_class: int
) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label): up to ``rows_per_class`` rows of each label outside the held-out remainder; and how many
    rows of each label there are, in the sample or not.

    Rows are chosen by a hash of doc_id, so the choice depends on no partitioning. Of repeated labels of a
    document the largest counts; null ids and labels take no part. Only the ids and labels of the sample are
    sent to all tasks (at most 2 * rows_per_class rows). The sample is written once, in the order of doc_id.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
    known = known.filter(remainder(F.col("doc_id"), modulus) != held_out)
    known = known.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    order = F.xxhash64(F.lit("sample"), "doc_id")
    classes = [known.filter(F.col("label") == v).orderBy(order, "doc_id").limit(rows_per_class) for v in (0, 1)]
    chosen = classes[0].unionByName(classes[1]).select(F.col("doc_id").alias("s_id"), "label")
    sample = docs.select("doc_id", text_or_empty(docs).alias("text"))
    sample = sample.join(F.broadcast(chosen), F.col("doc_id") == F.col("s_id")).select("doc_id", "text", "label")
    rows = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(known, "doc_id")
    whole = {r.label: r.n for r in rows.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    return reliable(sample.repartitionByRange(1, "doc_id").sortWithinPartitions("doc_id", "text")), whole


def times(whole: dict[int, int], sampled: dict[int, int]) -> dict[int, float]:
    """How many rows a sampled row of each label stands for; 1.0 where all rows of the label are in the sample."""
    return {v: whole[v] / n for v, n in sampled.items()}


def row_weight(stands_for: dict[int, float]) -> Column:
    """Weight of a row by its label: with it the sample has the shares of all rows."""
    return F.when(F.col("label") == 1, stands_for[1]).otherwise(stands_for[0])
