"""One query per operator over the given tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsieve.llm import (
    exact_dedup, license_scan, line_dedup, mixing, ngram_join, pii, quality, sentence_pieces, spelling, token_alignment, token_counts, topk, toxicity,
)
from claimsieve.session import ship

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    def prepared(spark: SparkSession, folder: str) -> DataFrame:
        return function(ship(spark), folder)

    REGISTRY[function.__name__] = prepared
    return function


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


@query
def op1_license_scan(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return license_scan.license_scan(docs).drop("text")


@query
def op2_sentence_pieces(spark, folder):
    return sentence_pieces.digest(read(spark, folder, "documents").select("doc_id", "text"))


@query
def op3_line_dedup(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    out = line_dedup.line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_removed", "removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query
def op4_ngram_join(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return ngram_join.near_copies(docs).drop("s")


@query
def op5_quality(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, read(spark, folder, "labels"))
    return quality.scored(docs, model).drop("text")


@query
def op6_mixing(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, mixing.tempered(mixing.source_counts(docs)))


@query
def op7_toxicity(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, read(spark, folder, "labels"))
    return toxicity.scored(docs, model)


@query
def op8_topk(spark, folder):
    return topk.top_k(read(spark, folder, "embeddings"))


@query
def op9_pii(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return pii.surrogates(docs)


@query
def op10_exact_dedup(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).drop("check")


@query
def op11_token_alignment(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return token_alignment.alignment_digest(docs, token_alignment.load())


@query
def op12_token_counts(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, token_counts.compiled())


@query
def op13_spelling_variants(spark, folder):
    return spelling.spelling_variants(read(spark, folder, "documents").select("doc_id", "text"))
