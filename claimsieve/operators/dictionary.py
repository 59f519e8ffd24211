"""Stemming and lemma lookup of token arrays through dictionary tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsieve.functions.stem import with_stem
from claimsieve.operators.layout import BROADCAST_ROWS, ITEMS, broadcast_if_bounded, reliable, row_parts, unpack


def distinct_tokens(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(token, n): every word and the number of rows that have it."""
    return unpack(df, [], F.array_distinct(tokens), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def stem_dictionary(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(token, n, stem) of every distinct token: each word is stemmed once, not once per occurrence."""
    return with_stem(distinct_tokens(df, tokens), "token", "stem")


def replace_words(
    df: DataFrame, mapping: pa.Table, tokens: str = "tokens", min_length: int = 1
) -> DataFrame:
    """Swap the words of a token array by a bounded ``(word, replacement)`` table, inside each row.

    Words without a replacement stay; results shorter than ``min_length`` are dropped. Each Arrow batch
    is one hash lookup over its flat words, so nothing is exploded or shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(
        (mapping.column(0).combine_chunks(), mapping.column(1).combine_chunks())
    )
    names, items = df.columns, ITEMS

    def swap(batches):
        known, replacement = shared.value
        for batch in (part for whole in batches for part in row_parts(whole, whole.column(tokens), items)):
            lists = batch.column(tokens)
            flat = lists.flatten()
            new = pc.coalesce(replacement.take(pc.index_in(flat, value_set=known)), flat)
            kept = pc.greater_equal(pc.utf8_length(new), min_length)
            before = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
            offsets = lists.offsets.to_numpy()
            at = pa.array(before[offsets - offsets[0]], pa.int32())
            swapped = pa.ListArray.from_arrays(at, new.filter(kept))
            yield pa.RecordBatch.from_arrays(
                [swapped if n == tokens else batch.column(n) for n in names], names=names
            )

    return df.mapInArrow(swap, df.schema)


def _replace(df: DataFrame, dictionary: DataFrame, tokens: str, min_length: int, max_rows: int) -> DataFrame:
    """Swap words by ``dictionary(token, n, new)``; the result is the same for every size of it.

    The ``max_rows`` most frequent words go to every task. Only rarer words leave their row: each once per row
    that has it, with a number of the row, so frequent words never meet in one task and rows stay apart even
    when all their columns are equal.
    """
    written = reliable(dictionary.select("token", "n", "new"))
    if written.count() <= max_rows:
        return replace_words(df, written.select("token", "new").toArrow(), tokens, min_length)
    frequent = reliable(written.orderBy(F.desc("n"), "token").limit(max_rows).select("token", "new"))
    rows = reliable(df.withColumn("_row", F.monotonically_increasing_id()))
    names = broadcast_if_bounded(frequent.select("token"), max_rows)
    rare = written.select("token", "new").join(names, "token", "left_anti")
    left = unpack(rows, ["_row"], F.array_distinct(tokens), "token").join(names, "token", "left_anti")
    found = left.join(rare, "token").groupBy("_row")
    found = found.agg(F.map_from_entries(F.collect_list(F.struct("token", "new"))).alias("_rare"))
    rest = F.transform(tokens, lambda t: F.element_at("_rare", t))
    rows = rows.join(found, "_row", "left").withColumn("_rare", F.coalesce(rest, F.array().cast("array<string>")))
    rows = replace_words(rows, frequent.toArrow(), tokens, 0)
    merged = F.zip_with(tokens, "_rare", lambda word, new: F.coalesce(new, word))
    return rows.withColumn(tokens, F.filter(merged, lambda w: F.length(w) >= min_length)).select(*df.columns)


def stem_tokens(
    df: DataFrame, tokens: str = "tokens", min_length: int = 1, max_dictionary: int = BROADCAST_ROWS
) -> DataFrame:
    """Stem every token and drop stems shorter than ``min_length``.

    The distinct words are stemmed once; the ``max_dictionary`` most frequent ones go to every task.
    """
    dictionary = stem_dictionary(df, tokens).withColumnRenamed("stem", "new")
    return _replace(df, dictionary, tokens, min_length, max_dictionary)


def lemma_lookup(
    df: DataFrame,
    lemmas: DataFrame,
    tokens: str = "tokens",
    min_length: int = 1,
    max_dictionary: int = BROADCAST_ROWS,
) -> DataFrame:
    """Replace tokens by their lemma where ``lemmas(token, lemma)`` has one.

    Only lemmas of words that occur are used: the distinct words meet the lexicon first. The ``max_dictionary``
    most frequent ones go to every task.
    """
    known = lemmas.select("token", F.col("lemma").alias("new")).dropDuplicates(["token"])
    dictionary = known.join(distinct_tokens(df, tokens), "token").filter(F.col("new").isNotNull())
    return _replace(df, dictionary, tokens, min_length, max_dictionary)
