"""Repeated passages of lines, found by overlapping windows of three consecutive lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsieve.llm.common import null_safe, packed, text_or_empty, unpacked
from claimsieve.operators.layout import unpack

WIDTH = 3


def windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(place, digest): every window of ``width`` consecutive lines that holds more than white space.

    ``place`` orders all windows: documents by doc_id (null last), then by a hash of the text, then the line.
    """
    text = text_or_empty(docs)
    rows = docs.select("doc_id", F.xxhash64(text).alias("check"), F.split(text, "\n").alias("lines"))
    rows = rows.filter(F.size("lines") >= width)
    lines = F.col("lines")
    starts = F.sequence(F.lit(0), F.size(lines) - width)
    items = F.transform(
        starts, lambda i: F.struct(i.alias("line"), F.concat_ws("\n", *[F.get(lines, i + k) for k in range(width)]).alias("body"))
    )
    items = F.filter(items, lambda x: x["body"].rlike(r"[^\x20\x09-\x0D]"))
    rows = unpack(rows, ["doc_id", "check"], items, "window")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "check", F.col("window.line").alias("line"))
    return rows.select(place.alias("place"), F.unhex(F.sha2(F.col("window.body").cast("binary"), 256)).alias("digest"))


def covered_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(c_id, c_check, covered): the lines that later occurrences of a repeated window cover, per text.

    The first place of each digest is a map-side minimum, so a window that a third of all texts share costs
    one row a task; its occurrences meet that one row in a join whose partitions Spark may split.
    """
    every = windows(docs, width)
    first = every.groupBy("digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = first.select(F.col("digest").alias("f_digest"), "first")
    later = every.join(first, every.digest == first.f_digest).filter(F.col("place") != F.col("first"))
    starts = later.groupBy(F.col("place.doc_id").alias("c_id"), F.col("place.check").alias("c_check"))
    starts = starts.agg(F.collect_set("place.line").alias("starts"))
    reach = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + width - 1)))
    return starts.select("c_id", "c_check", F.array_sort(F.array_distinct(reach)).alias("covered"))


def line_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with the covered lines taken out of ``text``, and n_lines, n_removed, removed (text).

    A window is ``width`` consecutive lines (split at line feeds). Of equal windows the first place stays; lines
    under a later one go, where windows overlap they are merged. The first occurrence of any line is never
    removed. A text with fewer lines than a window, an empty or null text (one empty line) stays as it is; a
    null text stays null. Rows that repeat in full share doc_id and text, so neither counts as the later one.
    ``removed`` lists the merged spans, first line to last line from 0, as "2-4,9-12". Columns of ``docs``
    that carry the names of the added columns are replaced, all others stay, whatever their names.
    """
    covered = covered_lines(docs, width)
    rows = docs.select(packed(docs), docs["doc_id"].alias("own_id"), F.xxhash64(text_or_empty(docs)).alias("own_check"))
    match = null_safe(rows, covered, [("own_id", "c_id"), ("own_check", "c_check")])
    rows = rows.join(covered, match, "left")
    gone = F.coalesce(F.col("covered"), F.array().cast("array<int>"))
    lines = F.split(F.coalesce("row.text", F.lit("")), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    heads = F.filter(gone, lambda x, i: (i == 0) | (x != F.get(gone, i - 1) + 1))
    tails = F.filter(gone, lambda x, i: (i == F.size(gone) - 1) | (x != F.get(gone, i + 1) - 1))
    spans = F.array_join(F.zip_with(heads, tails, lambda a, b: F.concat_ws("-", a, b)), ",")
    made = {
        "text": F.when(F.size(gone) == 0, F.col("row.text")).otherwise(text),
        "n_lines": F.size(lines).cast("long"),
        "n_removed": F.size(gone).cast("long"),
        "removed": spans,
    }
    rows = rows.select("row", F.struct(*[v.alias(c) for c, v in made.items()]).alias("made"))
    new = {c: F.col("made").getField(c) for c in made}
    return rows.select(*unpacked(docs.columns, new), *[new[c].alias(c) for c in made if c not in docs.columns])
