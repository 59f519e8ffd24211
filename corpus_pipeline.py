"""From raw documents to token ids: quality, exact copies, near copies, mixture, tokens.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``. Each stage's
result is written as Parquet to the shared folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsieve.llm import exact_dedup, mixing, ngram_join, quality, sentence_pieces
from claimsieve.operators.layout import reliable
from claimsieve.session import ship


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted quality is 1."""
    ship(spark)
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, model).filter("predicted = 1").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    ship(spark)
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group linked by shingles."""
    ship(spark)
    return ngram_join.one_per_component(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture."""
    ship(spark)
    return mixing.mixed(docs, mixing.tempered(mixing.source_counts(docs)))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, position, token_ids, n_tokens): every document with its ids and its place in the mixture.

    Files do not keep an order, so the place is a column. It is a function of the rows alone, and the one by which
    the stage before laid them out; rows that repeat in full have a place each.
    """
    ship(spark)
    weights = mixing.tempered(mixing.source_counts(docs))
    placed = reliable(mixing.mix(docs, weights, columns=("text",)).select("position", "doc_id", "text"))
    tokens = sentence_pieces.with_digest(placed.select(F.col("position").alias("doc_id"), "text"))
    tokens = tokens.withColumnRenamed("doc_id", "place")
    joined = tokens.join(placed.select("position", "doc_id"), F.col("place") == F.col("position"))
    return joined.select("doc_id", "position", "token_ids", "n_tokens")


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixture", mix_sources),
    ("tokens", to_tokens),
]

#: Fitted trees, Pfair slots and tokenisation are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = reliable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
