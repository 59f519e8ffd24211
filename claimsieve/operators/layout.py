"""Decisions about partitions and broadcasts, in one place."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000
ITEMS = 1 << 20  # list items of an Arrow batch that are worked on at a time


def broadcast_if_bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast a table whose row count is bounded by a parameter; leave the choice to AQE otherwise."""
    return F.broadcast(df) if max_rows <= BROADCAST_ROWS else df


def unbounded(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast.

    The optimizer does not know how many rows an explode makes, so it takes a table that was exploded from a small one
    for a small one. Sorted sides have no bound: they go to disk where memory ends.
    """
    return df.hint("merge")


def unpack(df: DataFrame, keys: list[str], items, name: str) -> DataFrame:
    """(keys, name): one row per item of an array column that is costly to compute.

    A plain explode makes the optimizer add a "not empty" filter on the array and push it towards the
    scan, where the array would be computed a second time. An outer explode adds none.
    """
    return df.select(*keys, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores for CPU-heavy row work on a small input that comes in few splits.

    An input smaller than two full splits per core is at most a few hundred MB per core, so moving its rows is
    cheap. A larger one has enough splits and is left where it is. The size is that of the tables below, as the
    optimizer knows it; no job runs to find it.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if input_bytes(df) >= 2 * cores * split_bytes(spark):
        return df
    return df.repartition(cores, *keys)


def row_parts(batch: pa.RecordBatch, lists: pa.Array, items: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``items`` items of its ``lists`` each, one row at least.

    A batch has a fixed number of rows, however long they are; what is made from one slice has a bound.
    """
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < batch.num_rows:
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + items, side="right")))
        yield batch.slice(low, high - low)
        low = high


def input_bytes(df: DataFrame) -> int:
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def split_bytes(spark: SparkSession) -> int:
    size = spark.conf.get("spark.sql.files.maxPartitionBytes").lower().rstrip("b")
    units = {"k": 10, "m": 20, "g": 30}
    return int(size[:-1]) << units[size[-1]] if size[-1] in units else int(size)


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster shares: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if getattr(context, "_claimsieve_root", None) is None:
        context._claimsieve_root = tempfile.mkdtemp(prefix="claimsieve-")
        atexit.register(shutil.rmtree, context._claimsieve_root, ignore_errors=True)
    return context._claimsieve_root


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new, not yet existing folder of this application below the shared one."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def reliable(df: DataFrame) -> DataFrame:
    """Compute a table once, write it to the shared folder and go on from there.

    This cuts the lineage: a lost executor costs a re-read, not a re-run. Unlike a checkpoint it
    computes the table once, keeps it columnar, and tells the optimizer its size.
    """
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reliable_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """:func:`reliable` for independent tables, as concurrent jobs."""
    with ThreadPoolExecutor(max_workers=4) as pool:
        return dict(zip(tables, pool.map(reliable, tables.values()), strict=True))
