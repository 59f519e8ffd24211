"""N-grams, term statistics and TF-IDF."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, NGram
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimsieve.operators.layout import BROADCAST_ROWS, ITEMS, reliable, row_parts, unpack

PART = 1 << 18  # words of which grams are added up at a time
BITS = 21  # of a word's number in a gram's


def with_ngrams(df: DataFrame, tokens: str = "tokens", out: str = "grams", longest: int = 3) -> DataFrame:
    """Add all 1..longest-grams of a token array, words joined by one space."""
    keep = [c for c in df.columns if c != out]
    parts = [F.col(tokens)]
    for n in range(2, longest + 1):
        df = NGram(n=n, inputCol=tokens, outputCol=f"_g{n}").transform(df)
        parts.append(F.col(f"_g{n}"))
    return df.select(*keep, F.concat(*parts).alias(out))


def ngrams(df: DataFrame, key: str = "doc_id", tokens: str = "tokens", longest: int = 3) -> DataFrame:
    """One row per gram occurrence."""
    grams = with_ngrams(df.select(key, tokens), tokens, "_grams", longest)
    return unpack(grams, [key], "_grams", "term")


def term_counts(df: DataFrame, key: str = "doc_id", tokens: str = "tokens", longest: int = 3) -> DataFrame:
    """(key, term, tf) without any shuffle.

    All grams of a row are already together, so they are sorted inside the row and counted as runs:
    the positions where a new term starts, and the distance to the next start.
    """
    return count_grams(with_ngrams(df.select(key, tokens), tokens, "_grams", longest), key, "_grams")


def count_grams(grams: DataFrame, key: str, column: str) -> DataFrame:
    """(key, term, tf) of the grams that a row holds in an array."""
    ordered = grams.select(key, F.sort_array(column).alias("_s"))
    places = F.when(F.size("_s") > 0, F.sequence(F.lit(0), F.size("_s") - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1)))
    runs = F.transform(
        F.col("_at"),
        lambda at, j: F.struct(
            F.get("_s", at).alias("term"),
            (F.coalesce(F.get("_at", j + 1), F.size("_s")) - at).cast("bigint").alias("tf"),
        ),
    )
    counted = unpack(ordered.select(key, "_s", starts.alias("_at")), [key], runs, "_r")
    return counted.select(key, "_r.term", "_r.tf")


def row_count(df: DataFrame) -> Column:
    """Number of rows as a scalar subquery, for use inside another plan."""
    return df.agg(F.count(F.lit(1))).scalar()


def document_frequency(
    counts: DataFrame, n_docs: Column, min_df: int = 2, max_df: float = 0.95
) -> DataFrame:
    """(term, df, total) of the terms that are neither too rare nor too common."""
    return term_totals(counts).filter((F.col("df") >= min_df) & not_common(n_docs, max_df))


def term_totals(counts: DataFrame) -> DataFrame:
    """(term, df, total) of all terms."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


def not_common(n_docs: Column, max_df: float) -> Column:
    return F.col("df").cast("double") <= F.lit(float(max_df)) * n_docs.cast("double")


def idf(df: Column, n_docs: Column) -> Column:
    """Smoothed inverse document frequency."""
    return F.ln((F.lit(1.0) + n_docs) / (F.lit(1.0) + df)) + F.lit(1.0)


def vocabulary(
    counts: DataFrame,
    n_docs: Column,
    min_df: int = 2,
    max_df: float = 0.95,
    max_features: int = 5000,
) -> DataFrame:
    """(term, pos, df, total, idf) of the most frequent terms; positions follow the term order.

    The top-k runs per partition first. Numbering the terms is a single-task window, over at most
    ``max_features`` rows.
    """
    return number_terms(top_terms(document_frequency(counts, n_docs, min_df, max_df), max_features), n_docs)


def top_terms(stats: DataFrame, count: int) -> DataFrame:
    return stats.orderBy(F.desc("total"), F.asc("term")).limit(count)


def number_terms(top: DataFrame, n_docs: Column) -> DataFrame:
    pos = (F.row_number().over(Window.orderBy("term")) - 1).alias("pos")
    return top.select("term", pos, "df", "total", idf(F.col("df"), n_docs).alias("idf"))


def token_frequency(
    df: DataFrame, n_docs: Column, key: str = "doc_id", tokens: str = "tokens", longest: int = 3, min_df: int = 2, max_df: float = 0.95,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """:func:`document_frequency` of a token table, with a third of the bytes moved.

    A gram of up to three words, all among the ``max_rows`` most frequent ones, leaves its row as one number made of theirs;
    others as text. A gram with a word of fewer than ``min_df`` rows never leaves it. Most longer grams are in one row only,
    so Spark's adding up before the shuffle would hold all and keep little back: they are added up over some rows at a time.
    """
    odd = F.exists(tokens, lambda t: t.isNull() | F.contains(t, F.lit(" ")))  # a word and a gram may then be one term
    if df.agg(F.bool_or(odd)).first()[0]:
        return document_frequency(term_counts(df, key, tokens, longest), n_docs, min_df, max_df)
    words = reliable(term_totals_of_parts(gram_totals(df, 1, tokens), "term").filter(F.col("df") >= min_df))
    max_rows = min(max_rows, 1 << BITS)
    all_known = words.count() <= max_rows
    known = (words if all_known else words.orderBy(F.desc("df"), "term").limit(max_rows)).select("term").toArrow()
    known = df.sparkSession.sparkContext.broadcast(known.column("term").combine_chunks())
    deal = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stats = words
    for n in range(2, longest + 1):
        coded = n * BITS <= 63
        if coded:
            found = term_totals_of_parts(gram_codes(df, n, tokens, known).repartition(deal, "code"), "code")
            stats = stats.unionByName(decoded(found.filter(F.col("df") >= min_df), n, known))
        if not (coded and all_known):
            found = gram_totals(df, n, tokens, known if coded else None).repartition(deal, "term")
            stats = stats.unionByName(term_totals_of_parts(found, "term").filter(F.col("df") >= min_df))
    return stats.filter(not_common(n_docs, max_df))


def term_totals_of_parts(parts: DataFrame, key: str) -> DataFrame:
    return parts.groupBy(key).agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def flat_words(batches, n: int, size_of_part: int):
    """Per some rows (flat words, their rows, number of rows, whether the gram of ``n`` words from a place on ends in its row)."""
    for part in (part for whole in batches for part in row_parts(whole, whole.column(0), size_of_part)):
        sizes = pc.fill_null(pc.list_value_length(part.column(0)), 0).to_numpy(zero_copy_only=False)
        flat = part.column(0).flatten()
        row = np.repeat(np.arange(len(sizes)), sizes)
        size = max(len(flat) - n + 1, 0)
        yield flat, row[:size], len(sizes), row[:size] == row[n - 1 : size + n - 1]


def added_up(at: np.ndarray, row: np.ndarray, n_rows: int, kinds: int) -> list[pa.Array]:
    """In how many rows each kind of gram is, and how often, from the kind and the row of every gram."""
    pairs = np.unique(at * n_rows + row)
    return [pa.array(np.bincount(x, minlength=kinds), pa.int64()) for x in (pairs // n_rows, at)]


def gram_codes(df: DataFrame, n: int, tokens: str, known) -> DataFrame:
    """(code, df, total) of the grams of ``n`` known words, added up over some rows at a time."""

    items = PART

    def totals(batches):
        for flat, row, n_rows, inside in flat_words(batches, n, items):
            place = pc.fill_null(pc.index_in(flat, value_set=known.value), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            words = [place[i : i + len(row)] for i in range(n)]
            code = np.zeros(len(row), dtype=np.int64)
            for word in words:
                inside = inside & (word >= 0)
                code = code << BITS | word
            codes, at = np.unique(code[inside], return_inverse=True)
            arrays = [pa.array(codes), *added_up(at, row[inside], n_rows, len(codes))]
            yield pa.RecordBatch.from_arrays(arrays, names=["code", "df", "total"])

    return df.select(tokens).mapInArrow(totals, "code bigint, df bigint, total bigint")


def decoded(found: DataFrame, n: int, known) -> DataFrame:
    """(term, df, total) of the codes of grams of ``n`` words."""

    def spell(batches):
        for batch in batches:
            code = batch.column(0).to_numpy()
            words = [known.value.take(pa.array(code >> BITS * i & (1 << BITS) - 1)) for i in reversed(range(n))]
            arrays = [pc.binary_join_element_wise(*words, " "), batch.column(1), batch.column(2)]
            yield pa.RecordBatch.from_arrays(arrays, names=["term", "df", "total"])

    return found.mapInArrow(spell, "term string, df bigint, total bigint")


def joined(flat: pa.Array, count: int) -> pa.Array:
    """The words from each place on, joined by one space, whatever row they are in."""
    size = max(len(flat) - count + 1, 0)
    parts = [flat.slice(i, size) for i in range(count)]
    return parts[0] if count == 1 else pc.binary_join_element_wise(*parts, " ")


def gram_totals(df: DataFrame, n: int, tokens: str, known=None) -> DataFrame:
    """(term, df, total) of the grams of ``n`` words, or of those with a word that is not known, added up over some rows at a time."""

    items = PART

    def totals(batches):
        for flat, row, n_rows, inside in flat_words(batches, n, items):
            if known is not None:
                new = pc.is_null(pc.index_in(flat, value_set=known.value)).to_numpy(zero_copy_only=False)
                inside = inside & np.any([new[i : i + len(row)] for i in range(n)], axis=0)
            found = joined(flat, n).filter(pa.array(inside, pa.bool_())).dictionary_encode()
            at = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            arrays = [found.dictionary, *added_up(at, row[inside], n_rows, len(found.dictionary))]
            yield pa.RecordBatch.from_arrays(arrays, names=["term", "df", "total"])

    return df.select(tokens).mapInArrow(totals, "term string, df bigint, total bigint")


def token_vocabulary(
    df: DataFrame,
    n_docs: Column,
    key: str = "doc_id",
    tokens: str = "tokens",
    longest: int = 3,
    min_df: int = 2,
    max_df: float = 0.95,
    max_features: int = 5000,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """:func:`vocabulary` of a token table, length by length, so that few of its grams are moved.

    A gram is in no more rows, and there no more often, than each gram inside it. Once the words are counted, a gram of two
    can only be among the ``max_features`` most frequent terms if both its words have at least the total of the last
    of these so far; and so on. Only such grams leave their row, so the result is the same as from all of them. Where more
    than ``max_rows`` grams of a length come into question, or a token has a space inside, all grams are counted.
    """
    odd = F.exists(tokens, lambda t: t.isNull() | F.contains(t, F.lit(" ")))
    if df.agg(F.bool_or(odd)).first()[0]:
        return vocabulary(term_counts(df, key, tokens, longest), n_docs, min_df, max_df, max_features)
    stats, least = None, min_df
    grams = df.select(key, F.col(tokens).alias("_grams"))
    for n in range(1, longest + 1):
        found = term_totals(count_grams(grams, key, "_grams"))
        found = reliable(found.filter((F.col("df") >= min_df) & (F.col("total") >= least)))
        stats = found if stats is None else stats.unionByName(found)
        if n == longest:
            break
        last = top_terms(stats.filter(not_common(n_docs, max_df)), max_features)
        last = last.agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("total")).first()
        least = last["total"] if last["n"] == max_features else min_df
        frequent = found.filter(F.col("total") >= least).select("term")
        if frequent.count() > max_rows:
            longer = term_totals(count_grams(longer_grams(df, n, longest, key, tokens), key, "_grams"))
            stats = stats.unionByName(longer.filter((F.col("df") >= min_df) & (F.col("total") >= least)))
            break
        grams = grams_of_frequent(df, frequent.toArrow().column("term").combine_chunks(), n + 1, key, tokens)
    return number_terms(top_terms(stats.filter(not_common(n_docs, max_df)), max_features), n_docs)


def longer_grams(df: DataFrame, above: int, longest: int, key: str, tokens: str) -> DataFrame:
    """(key, _grams): all grams of more than ``above`` and at most ``longest`` words."""
    df = df.select(key, tokens)
    names = []
    for n in range(above + 1, longest + 1):
        names.append(f"_g{n}")
        df = NGram(n=n, inputCol=tokens, outputCol=names[-1]).transform(df)
    return df.select(key, F.concat(*names).alias("_grams"))


def grams_of_frequent(df: DataFrame, frequent: pa.Array, n: int, key: str, tokens: str, rows: int = 256) -> DataFrame:
    """(key, _grams): the grams of ``n`` words of which the first and the last ``n - 1`` are among ``frequent``.

    Works on the flat tokens of some rows at a time.
    """
    shared = df.sparkSession.sparkContext.broadcast(frequent)

    def grams(batches):
        known = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                part = batch.slice(low, rows)
                lists = part.column(tokens)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                flat = lists.flatten()
                row = np.repeat(np.arange(len(sizes)), sizes)
                size = max(len(flat) - n + 1, 0)
                hit = pc.is_valid(pc.index_in(joined(flat, n - 1), value_set=known)).to_numpy(zero_copy_only=False)
                whole = hit[:size] & hit[1 : size + 1] & (row[:size] == row[n - 1 : size + n - 1])
                chosen = joined(flat, n).filter(pa.array(whole))
                at = np.concatenate([[0], np.cumsum(np.bincount(row[:size][whole], minlength=len(sizes)))])
                out = pa.ListArray.from_arrays(pa.array(at, pa.int32()), chosen)
                yield pa.RecordBatch.from_arrays([part.column(key), out], names=[key, "_grams"])

    key_type = df.schema[key].dataType.simpleString()
    return df.select(key, tokens).mapInArrow(grams, f"`{key}` {key_type}, _grams array<string>")


def tfidf_join(counts: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, value) for a vocabulary of any size.

    Terms outside the vocabulary are dropped by the join; one shuffle then brings the surviving entries
    of a row together to scale them to length 1.
    """
    weight = (F.lit(1.0) + F.ln("tf")) * F.col("idf")
    weighted = counts.join(vocab.select("term", "idf"), "term").select(key, "term", weight.alias("_w"))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("_w") / length).alias("value"))


def vocabulary_list(vocab: DataFrame) -> tuple[list[str], np.ndarray]:
    """Terms and idf weights in position order, for a vocabulary whose size is bounded."""
    table = vocab.select("pos", "term", "idf").toArrow().sort_by("pos")
    return table.column("term").to_pylist(), table.column("idf").to_numpy()


def tfidf_rows(
    df: DataFrame,
    words: list[str],
    idf_weights: np.ndarray,
    key: str = "doc_id",
    tokens: str = "tokens",
    longest: int = 3,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(key, keep, indices, values): sublinear tf times idf of the known terms, scaled to length 1.

    Works inside each row: the JVM counts the grams that are in the vocabulary, and the weights of a
    batch of rows are then three vector operations. Nothing is shuffled. Rows without a known term get
    empty arrays.
    """
    grams = with_ngrams(df.select(key, *keep, tokens), tokens, "_grams", longest)
    if not words:
        return df.select(key, *keep, F.array().cast("array<int>").alias("indices"), F.array().cast("array<double>").alias("values"))
    counter = CountVectorizerModel.from_vocabulary(words, inputCol="_grams", outputCol="_counts")
    counted = counter.transform(grams).select(key, *keep, "_counts")
    kinds = ", ".join(f"`{c}` {counted.schema[c].dataType.simpleString()}" for c in (key, *keep))

    items = ITEMS

    def weigh(batches):
        for batch in (part for whole in batches for part in row_parts(whole, whole.column("_counts").field("indices"), items)):
            vector = batch.column("_counts")
            lists = vector.field("indices")
            sizes = np.diff(lists.offsets.to_numpy())
            index = lists.flatten().to_numpy()
            weight = (1.0 + np.log(vector.field("values").flatten().to_numpy())) * idf_weights[index]
            row = np.repeat(np.arange(len(sizes)), sizes)
            length = np.sqrt(np.bincount(row, weight * weight, minlength=len(sizes)))
            at = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in (key, *keep)],
                    pa.ListArray.from_arrays(at, pa.array(index, pa.int32())),
                    pa.ListArray.from_arrays(at, pa.array(weight / length[row])),
                ],
                names=[key, *keep, "indices", "values"],
            )

    return counted.mapInArrow(weigh, f"{kinds}, indices array<int>, values array<double>")


def tfidf(
    df: DataFrame,
    vocab: DataFrame,
    key: str = "doc_id",
    tokens: str = "tokens",
    longest: int = 3,
    max_features: int = 5000,
) -> DataFrame:
    """(key, term, value) of the tokens of each row against a fitted vocabulary."""
    if max_features > BROADCAST_ROWS:
        return tfidf_join(term_counts(df, key, tokens, longest), vocab, key)
    words, weights = vocabulary_list(vocab)
    rows = tfidf_rows(df, words, weights, key, tokens, longest)
    cells = rows.select(key, F.explode(F.arrays_zip("indices", "values")).alias("_e"))
    names = F.lit(words) if words else F.array().cast("array<string>")
    return cells.select(key, F.get(names, F.col("_e.indices")).alias("term"), F.col("_e.values").alias("value"))
