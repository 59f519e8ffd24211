"""License notices by diagonal voting.

Every word 2-gram of every text is joined to the 2-grams of the templates. A hit votes for the diagonal
``place in the text - place in the template`` of its template. A diagonal that gets all votes is the template
word by word; votes on neighbouring diagonals are one notice with words put in or left out. Such a band is at
most ``MAX_DRIFT`` diagonals wide, its votes are the different template places it covers, and the span is verified:
the places must stand in the text in the order of the template. The 2-grams are joined by hash and by their words, so
the places of a verified span have the words.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimsieve.llm.common import FACTORS, UPPER, WordHashes, mixed, null_safe, packed, text_or_empty, unpacked

GRAM = 2
ROWS = 200_000  # 2-grams of one Arrow batch, more only for a text that has more
MAX_DRIFT = 8
MIN_COVER = 0.8
#: label, phrase. The base phrases count only word by word.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notices, which may have some words more, less or changed.
NOTICES = {
    "cc-by-sa": "licensed under cc by sa",
    "cc-by-nc": "licensed under cc by nc",
    "cc-by-nd": "licensed under cc by nd",
    "cc0": "to the extent possible under law the author has waived all copyright and related rights",
    "public-domain": "this work is dedicated to the public domain",
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files to deal in the software without restriction"
    ),
    "apache-2.0": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that",
    "mpl": "this source code form is subject to the terms of the mozilla public license",
    "lgpl": "gnu lesser general public license",
    "agpl": "gnu affero general public license",
}
EXACT_BELOW = 6  # a notice with fewer words must be there word by word


def template_grams(spark: SparkSession, base: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """(t_hash, t_w0, t_w1, template, label, is_base, at, n_grams): bounded by the size of the template lists."""
    rows, hashes = [], WordHashes()
    for number, (label, phrase, is_base) in enumerate(
        [(label, phrase, True) for phrase, label in base.items()] + [(k, v, False) for k, v in notices.items()]
    ):
        words = words_of(phrase)
        if len(words) < GRAM:
            raise ValueError(f"a template has at least {GRAM} words: {phrase!r}")
        n_grams = len(words) - GRAM + 1
        for at, value in enumerate(gram_hashes(words, hashes).view(np.int64).tolist()):
            rows.append((value, *map(bytearray, words[at : at + GRAM]), number, label, is_base, at, n_grams))
    own = ", ".join(f"t_w{k} binary" for k in range(GRAM))
    return spark.createDataFrame(rows, f"t_hash bigint, {own}, template int, label string, is_base boolean, at int, n_grams int")


#: A-Z become lower case, all other ASCII signs but letters and digits become a space; other bytes stay.
WORD_BYTES = bytes(
    ord(chr(b).lower()) if chr(b) in UPPER else b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def gram_hashes(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """The hash of each run of ``GRAM`` words: one fewer than words, none for a text with fewer words."""
    count = max(0, len(words) - GRAM + 1)
    n = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    total = np.zeros(count, dtype=np.uint64)
    for k in range(GRAM):
        total += n[k : k + count] * FACTORS[k]
    return mixed(total)


def word_columns(words: list[bytes], count: int) -> list[pa.Array]:
    """The first, second, ... word of each run, as views of one buffer."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.concatenate(([0], np.cumsum(sizes)))
    if ends[-1] >= 1 << 31:  # beyond the offsets of an Arrow column
        raise ValueError("a text holds more than 2 GB of words")
    data = pa.py_buffer(b"".join(words))
    return [
        pa.BinaryArray.from_buffers(pa.binary(), count, [None, pa.py_buffer(ends[k : k + count + 1].astype(np.int32)), data])
        for k in range(GRAM)
    ]


def grams(docs: DataFrame) -> DataFrame:
    """(doc_id, check, i, h, w0, w1): every 2-gram of every text, by its place, hash and words.

    ``check`` is a hash of the text, so that rows with the same doc_id but other texts stay apart.
    """
    own = ", ".join(f"w{k} binary" for k in range(GRAM))
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    text = text_or_empty(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            held, rows = [], 0

            def joined() -> pa.RecordBatch:
                at = pa.array(np.repeat([h[0] for h in held], [len(h[1]) for h in held]))
                place = np.concatenate([np.arange(len(h[1])) for h in held])
                columns = [pa.concat_arrays([h[2][k] for h in held]) for k in range(GRAM)]
                found = pa.array(np.concatenate([h[1] for h in held]).view(np.int64))
                keys = [batch.column(c).take(at) for c in (0, 1)]
                names = ["doc_id", "check", "i", "h", *[f"w{k}" for k in range(GRAM)]]
                return pa.RecordBatch.from_arrays([*keys, pa.array(place, pa.int64()), found, *columns], names=names)

            for number, value in enumerate(batch.column(2)):
                words = words_of(value.as_py())
                if len(words) < GRAM:
                    continue
                found = gram_hashes(words, hashes)
                held.append((number, found, word_columns(words, len(found))))
                rows += len(found)
                if rows >= ROWS:
                    yield joined()
                    held, rows = [], 0
            if held:
                yield joined()

    named = docs.select("doc_id", F.xxhash64(text).alias("check"), text.alias("text"))
    return named.mapInArrow(cut, f"doc_id {doc_id}, check bigint, i bigint, h bigint, {own}")


def rising(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of (template place, text place) that rises in both; of equally long ones one that ends first."""
    last, chain, before = [], [], {}
    for at, i in sorted(hits, key=lambda h: (h[0], -h[1])):
        n = bisect_left(last, i)
        before[at, i] = chain[n - 1] if n else None
        last[n:], chain[n:] = [i, *last[n + 1 :]], [(at, i), *chain[n + 1 :]]
    out, step = [], chain[-1] if chain else None
    while step:
        out.append(step)
        step = before[step]
    return out[::-1]


def verified(hits: pd.Series) -> pd.DataFrame:
    """(votes, start, first, last) of each band: places that rise, where the template starts, first and last word."""
    rows = []
    for band in hits:
        run = rising([(h["at"], h["i"]) for h in band])
        rows.append((len(run), run[0][1] - run[0][0], run[0][1], run[-1][1] + GRAM - 1))
    return pd.DataFrame(rows, columns=["votes", "start", "first", "last"])


def scan(docs: DataFrame, base: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """(s_id, s_check, label, is_base, first, last, places, cover): verified spans per text and template, and the best
    cover of a template: that of its best span, or without one that of its best single diagonal.

    ``first`` and ``last`` are the smallest and largest word at which the template starts. Spans of one template
    that share words are one place.
    """
    spark = docs.sparkSession
    base, notices = BASE if base is None else base, NOTICES if notices is None else notices
    templates = F.broadcast(template_grams(spark, base, notices))
    same = F.col("h") == F.col("t_hash")
    for k in range(GRAM):
        same = same & (F.col(f"w{k}") == F.col(f"t_w{k}"))
    hits = grams(docs).join(templates, same)
    # one row a diagonal: votes are added map-side. Rows that repeat in full vote once for each place.
    key = ["doc_id", "check", "template", "label", "is_base", "n_grams"]
    votes = hits.groupBy(*key, (F.col("i") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"))
    inexact = ~F.col("is_base") & (F.col("n_grams") >= EXACT_BELOW)
    own = F.size("ats") / F.col("n_grams")
    # a band starts at each diagonal of an inexact template and ends MAX_DRIFT diagonals further
    order = Window.partitionBy(*key).orderBy("diagonal").rangeBetween(0, MAX_DRIFT)
    votes = votes.withColumn("whole", F.sum(F.size("ats")).over(order) >= MIN_COVER * F.col("n_grams"))
    places = F.transform("ats", lambda at: F.struct(at.cast("long").alias("at"), (F.col("diagonal") + at).alias("i")))
    bands = votes.withColumn("band", F.when(inexact, F.flatten(F.collect_list(places).over(order))))
    covered = F.size(F.array_distinct(F.col("band.at"))) >= MIN_COVER * F.col("n_grams")
    check = F.pandas_udf(verified, "votes long, start long, first long, last long")
    spans = bands.filter(inexact & F.col("whole") & covered).select(*key, check("band").alias("span")).select(*key, "span.*")
    spans = spans.filter(F.col("votes") >= MIN_COVER * F.col("n_grams"))
    earlier = Window.partitionBy(*key).orderBy("first", "last", "start").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("fresh", F.coalesce(F.col("first") > F.max("last").over(earlier), F.lit(True)))
    spans = spans.select(*key, F.col("start"), (F.col("votes") / F.col("n_grams")).alias("cover"), "fresh")
    exact = votes.select(*key, F.col("diagonal").alias("start"), own.alias("cover"), (~inexact & (own >= 1.0)).alias("fresh"))
    found = F.col("fresh")
    return exact.unionByName(spans).groupBy(
        F.col("doc_id").alias("s_id"), F.col("check").alias("s_check"), "label", "is_base"
    ).agg(
        F.min(F.when(found, F.col("start"))).alias("first"),
        F.max(F.when(found, F.col("start"))).alias("last"),
        F.count(F.when(found, F.lit(1))).alias("places"),
        F.max("cover").alias("cover"),
    )


def license_scan(docs: DataFrame, base: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score.

    n_base counts all places of base phrases, first_word and last_word are their smallest and largest start (null
    without one). The label strings are distinct, sorted and joined by commas, empty without a label. ``score``
    is the largest share of a template's 2-grams in a verified span or on one diagonal, 0 without any hit. Null and empty
    texts have no words. Rows that share doc_id and text share their result. Columns of ``docs`` that carry
    the names of the added columns are replaced, all others stay, whatever their names.
    """
    found = scan(docs, base, notices)
    some = F.col("places") > 0
    per_text = found.groupBy("s_id", "s_check").agg(
        F.sum(F.when(F.col("is_base"), F.col("places"))).alias("b_places"),
        F.min(F.when(F.col("is_base"), F.col("first"))).alias("b_first"),
        F.max(F.when(F.col("is_base"), F.col("last"))).alias("b_last"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_base") & some, F.col("label")))), ",").alias("b_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(some, F.col("label")))), ",").alias("m_labels"),
        F.max("cover").alias("m_cover"),
    )
    text = text_or_empty(docs)
    count = F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    own = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    rest = [c for c in docs.columns if c not in own]
    keys = [docs["doc_id"].alias("own_id"), F.xxhash64(text).alias("own_check")]
    rows = docs.select(packed(docs, rest), count.cast("long").alias("words_of_row"), *keys)
    rows = rows.join(per_text, null_safe(rows, per_text, [("own_id", "s_id"), ("own_check", "s_check")]), "left")
    return rows.select(
        *unpacked(rest),
        F.col("words_of_row").alias("n_words"),
        F.coalesce("b_places", F.lit(0)).cast("long").alias("n_base"),
        F.col("b_first").cast("long").alias("first_word"),
        F.col("b_last").cast("long").alias("last_word"),
        F.coalesce("b_labels", F.lit("")).alias("base_labels"),
        F.coalesce("m_labels", F.lit("")).alias("labels"),
        F.coalesce("m_cover", F.lit(0.0)).alias("score"),
    )
