"""Exact duplicates by a stateful stream over digests.

Every text is reduced to a small record: SHA-256 of the text without white space, its stable identifier,
its length and a locator of its content. The records flow through a streaming aggregation whose state lives
in RocksDB, is keyed by the digest and never expires, so a later stream over the same checkpoint still finds
the first copy. A hit is only believed after its bytes were compared with those of the text it hit.

Everything is DataFrame code; the executors run no Python.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsieve.llm.common import SPACES, null_safe, packed, text_or_empty, unpacked
from claimsieve.operators.layout import reliable, shared_folder

STATE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # without this each state partition reserves megabytes for files of some kilobytes
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
RECORD = "digest binary, doc_id bigint, n_points bigint, check bigint"


def normalised(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``."""
    return F.translate(text, SPACES, "")


def records(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, n_points, check): what the stream sees of a document. A null text counts as empty.

    ``check`` is a second hash of the original text: with doc_id it locates the content, also where
    several rows carry one doc_id.
    """
    text = text_or_empty(docs)
    return docs.select(
        F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(text).cast("long").alias("n_points"),
        F.xxhash64(text).alias("check"),
    )


def groups_of(stream: DataFrame) -> DataFrame:
    """Keyed state per digest: the row that stays (most code points, then smallest doc_id, null last) and the size.

    Works on a stream (the state is the streaming state) and, with the same result, on a plain table.
    """
    # max_by of a struct: the longest, then the row with an id, then the smallest id; check only breaks full ties
    order = F.struct(
        F.col("n_points"), F.col("doc_id").isNotNull(), -F.coalesce(F.col("doc_id"), F.lit(0)), F.col("check")
    )
    return stream.groupBy("digest").agg(
        F.max_by(F.struct("doc_id", "check"), order).alias("keep"), F.count(F.lit(1)).alias("group_size")
    )


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_groups(spark: SparkSession, landing: str, checkpoint: str, out: str, files_per_batch: int = 100_000):
    """Run all record files that are new in ``landing`` through the stream; the changed groups go to ``out``.

    Each micro-batch writes the groups it changed to a folder of its own, which a retried batch overwrites.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with settings(spark, STATE):
        source = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
        writer = groups_of(source).writeStream.outputMode("update").foreachBatch(write)
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_groups(spark: SparkSession, out: str, schema) -> DataFrame:
    """(digest, keep, group_size): the newest state of every group."""
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(out)
    newest = F.max_by(F.struct("keep", "group_size"), F.col("batch"))
    return rows.groupBy("digest").agg(newest.alias("last")).select("digest", "last.*")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row of ``docs``, plus ``check``.

    Texts are equal when identical after deleting white space; null is empty. The row with the most code
    points stays, then the one with the smallest doc_id (a null doc_id comes last). Rows that repeat in full
    share doc_id and text: each of them is marked kept if the row that stays looks like them. An empty table
    gives an empty table; other columns are not touched.
    """
    spark = docs.sparkSession
    landing = shared_folder(spark, "records")
    records(docs).write.parquet(landing)
    landed = spark.read.schema(RECORD).parquet(landing)
    state, out = shared_folder(spark, "state"), shared_folder(spark, "groups")
    stream_groups(spark, landing, state, out)
    keep = "digest binary, keep struct<doc_id: bigint, check: bigint>, group_size bigint"
    groups = latest_groups(spark, out, keep) if has_rows(landed) else groups_of(landed)
    groups = groups.withColumnRenamed("digest", "g_digest")
    marked = landed.join(groups, landed.digest == groups.g_digest).drop("g_digest")
    marked = compared(docs, marked)
    return marked.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        same_row("doc_id", "check").alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "check",
    )


def has_rows(df: DataFrame) -> bool:
    return bool(df.take(1))


def same_row(doc_id: str, check: str) -> Column:
    return F.col(doc_id).eqNullSafe(F.col("keep.doc_id")) & (F.col(check) == F.col("keep.check"))


def compared(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Compare the bytes of every hit with the bytes of the row it hit; a difference stops the run.

    A hit is a row of a group that is not itself the row that stays. Its text travels once, to the
    text of the row that stays. Equal SHA-256 with different bytes has never been seen, so there is no
    second way to group such rows: the job fails and names them instead of dropping one.
    """
    text = text_or_empty(docs)
    content = docs.select(
        F.col("doc_id").cast("long").alias("c_id"), F.xxhash64(text).alias("c_check"), normalised(text).alias("body")
    )
    several = marked.filter(F.col("group_size") > 1)
    # one line per distinct (doc_id, check), so that repeated rows meet their text once
    lines = several.groupBy("digest", "doc_id", "check").agg(F.first("keep").alias("keep"))
    texts = lines.join(content, null_safe(lines, content, [("doc_id", "c_id"), ("check", "c_check")]))
    texts = texts.select("digest", "doc_id", "body", same_row("doc_id", "check").alias("is_keeper"))
    texts = reliable(texts)
    keepers = texts.filter("is_keeper").select(F.col("digest").alias("k_digest"), F.col("body").alias("k_body"))
    hits = texts.filter(~F.col("is_keeper"))
    wrong = hits.join(keepers, hits.digest == keepers.k_digest, "left")
    wrong = wrong.filter(~F.col("body").eqNullSafe(F.col("k_body")))
    found = wrong.select("doc_id").take(5)
    if found:
        raise ValueError(f"equal digests of different texts: doc_id {[r.doc_id for r in found]}")
    return marked


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns. Of rows that repeat in full one stays."""
    marks = exact_dedup(docs).filter("kept").groupBy("doc_id", "check").agg(F.count(F.lit(1)).alias("m_rows"))
    marks = reliable(marks.select(F.col("doc_id").alias("m_id"), F.col("check").alias("m_check"), "m_rows"))
    rows = docs.select(packed(docs), docs["doc_id"].alias("own_id"), F.xxhash64(text_or_empty(docs)).alias("own_check"))
    kept = rows.join(marks, null_safe(rows, marks, [("own_id", "m_id"), ("own_check", "m_check")]), "left_semi")
    if has_rows(marks.filter("m_rows > 1")):
        kept = kept.dropDuplicates(["own_id", "own_check"])
    return kept.select(*unpacked(docs.columns))
