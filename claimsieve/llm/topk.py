"""Exact top-k by inner product, block at a time.

Vectors are ordered so that like ones stand together and cut into blocks of one range each. A block knows the
largest and smallest value of each component, and with them the most a query can score in it. A query visits
blocks in falling order of that bound and stops when no bound reaches its k-th score.

Queries go in groups of ``GROUP`` and blocks in runs of ``RUN`` blocks. A first pass scores the most promising
blocks of each query; its k-th score is the threshold from which the second pass starts in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimsieve.operators.layout import reliable

BLOCK = 256
RUN = 16
GROUP = 512
K = 10
SAFE = float(2**53)
LEAST = -(2**63) + 1


def vectors(table: DataFrame, key: str = "vec_id", name: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(1024 * x) of every component, as double.

    A vector that is null or holds a null or non-finite component takes no part, nor does a null key. Of rows
    with one key the greatest vector counts.
    """
    x = F.col(name)
    usable = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.filter(F.col(key).isNotNull() & usable).groupBy(F.col(key).cast("long").alias("vec_id")).agg(F.max(x).alias("x"))
    whole = F.transform("x", lambda c: c.cast("double") * 1024.0)
    # floor() of a double gives a long, which a huge component would overflow
    return rows.select("vec_id", F.transform(whole, floor_double).alias("v"))


def floor_double(c: Column) -> Column:
    return F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c)


def blocks(table: DataFrame) -> DataFrame:
    """(run, block, ids, data, high, low): the forward index. ``data`` is the block's matrix, row by row.

    The range key of a vector is its signs on the leading components and then their size, so that vectors of one
    block point the same way. Ranges are cut by Spark's range partitioner; no task sees more than its ranges.
    """
    signs = [F.when(F.get("v", F.lit(i)) > 0, F.lit(1 << (15 - i))).otherwise(0) for i in range(16)]
    code = signs[0]
    for s in signs[1:]:
        code = code + s
    rows = table.withColumn("code", code)
    n = rows.count()
    parts = max(1, min(2_000, -(-n // (BLOCK * RUN))))
    rows = rows.repartitionByRange(parts, "code", "vec_id").sortWithinPartitions("code", "vec_id")
    kind = "run bigint, block int, ids array<bigint>, data binary, width int, high array<double>, low array<double>"

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, held = TaskContext.get().partitionId(), 0, []

        def packed(rows: pd.DataFrame) -> dict:
            data = matrix(rows.v)
            return {
                "run": part * 1_000_000 + number // RUN, "block": number, "ids": rows.vec_id.to_numpy(), "data": data.tobytes(),
                "width": data.shape[1], "high": data.max(axis=0), "low": data.min(axis=0),
            }

        for frame in frames:
            held.append(frame)
            whole = pd.concat(held, ignore_index=True)
            out = []
            while len(whole) >= BLOCK:
                out.append(packed(whole.iloc[:BLOCK]))
                whole = whole.iloc[BLOCK:]
                number += 1
            held = [whole]
            if out:
                yield pd.DataFrame(out)
        whole = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
        if len(whole):
            yield pd.DataFrame([packed(whole)])

    return rows.select("vec_id", "v").mapInPandas(pack, kind)


def matrix(column: pd.Series) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    width = max((len(x) for x in column), default=0)
    out = np.zeros((len(column), width))
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Integer inner products. Beyond 2^53 they are added as Python integers and cut to the range of a long."""
    queries, data = same_width(queries, data)
    size = np.abs(queries).max(initial=0.0) * np.abs(data).max(initial=0.0) * max(1, data.shape[1])
    if size < SAFE:
        return (queries @ data.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(queries) @ whole(data).T
    return np.vectorize(lambda s: max(min(s, 2**63 - 1), LEAST), otypes=[np.int64])(exact)


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The most each query can score in each block, rounded up."""
    queries, high = same_width(queries, high)
    _, low = same_width(queries, low)
    most = np.maximum(queries, 0.0) @ high.T + np.minimum(queries, 0.0) @ low.T
    return np.nextafter(most + np.abs(most) * 1e-12, np.inf)


def search(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Top k of each query among the blocks in ``rows``, starting at each query's threshold."""
    asked, ids = matrix(queries.v), queries.query_id.to_numpy(dtype=np.int64)
    least = queries.threshold.to_numpy(dtype=np.int64)
    high, low = matrix(rows.high), matrix(rows.low)
    most = bounds(asked, high, low)
    best_score = np.full((len(ids), k), LEAST)
    best_id = np.full((len(ids), k), np.iinfo(np.int64).max)
    filled = np.zeros((len(ids), k), dtype=bool)
    for place in np.argsort(-most.max(axis=0), kind="stable"):
        row = rows.iloc[place]
        kth = np.where(filled[:, -1], np.maximum(best_score[:, -1], least), least)
        need = np.flatnonzero(most[:, place] >= kth)
        if not len(need):
            continue
        names = np.asarray(row.ids, dtype=np.int64)
        data = np.frombuffer(row["data"]).reshape(len(names), row.width)
        got = scores(asked[need], data)
        ok = names[None, :] != ids[need][:, None]
        score = np.concatenate([best_score[need], got], axis=1)
        name = np.concatenate([best_id[need], np.broadcast_to(names, got.shape)], axis=1)
        live = np.concatenate([filled[need], ok], axis=1)
        order = np.lexsort((name, -score, ~live), axis=1)[:, :k]
        best_score[need] = np.take_along_axis(score, order, 1)
        best_id[need] = np.take_along_axis(name, order, 1)
        filled[need] = np.take_along_axis(live, order, 1)
    q, _ = np.nonzero(filled)
    return pd.DataFrame({"query_id": ids[q], "vec_id": best_id[filled], "score": best_score[filled]})


ANSWER = "query_id bigint, vec_id bigint, score bigint"


def best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query, ties to the smaller vec_id.

    Only k rows per query and task reach the shuffle: the filter on the rank is applied before it."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(table: DataFrame, modulus: int = 100, k: int = K, key: str = "vec_id", name: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for every row whose key is divisible by ``modulus``, against all other rows.

    Exact for any data. Vectors of different width are compared as if the shorter ended in zeros. No query or
    no candidate: no row. See :func:`vectors` for what takes part and :func:`scores` for very large values.
    """
    base = reliable(vectors(table, key, name))
    index = reliable(blocks(base))
    asked = base.filter(F.col("vec_id") % modulus == 0)
    groups = max(1, -(-asked.count() // GROUP))
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    asked = reliable(asked.select(F.col("vec_id").alias("query_id"), "v", group.alias("group")))
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))

    # each group of queries meets the bounds of each run of blocks: the stated query set against all rows, in blocks
    ends = index.select("run", "block", "high", "low").withColumn("group", every_group)
    runs = index.select("run").distinct().withColumn("group", every_group)
    meeting = asked.join(runs, "group").groupBy("group", "run").cogroup(renewed(ends).groupBy("group", "run"))
    pairs = reliable(meeting.applyInPandas(promising, "query_id bigint, group int, run bigint, block int, most double"))

    # the most promising block of each query gives its threshold
    opening = pairs.groupBy("query_id").agg(F.max_by(F.struct("group", "run", "block"), F.struct("most", "run", "block")).alias("p"))
    opening = opening.select("query_id", F.col("p.run").alias("run"), F.col("p.block").alias("block"))
    opening = opening.join(asked, "query_id").withColumn("threshold", F.lit(LEAST))
    wanted = opening.select("group", "run", "block").distinct().join(index, ["run", "block"])
    keys = ["group", "run", "block"]

    def search_one(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return search(queries, rows, k)

    first = opening.groupBy(*keys).cogroup(renewed(wanted).groupBy(*keys)).applyInPandas(search_one, ANSWER)
    kth = best(first, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))

    # runs whose best bound stays below the threshold are not read for that query
    pairs = pairs.join(kth, "query_id", "left").withColumn("threshold", F.coalesce("kth", F.lit(LEAST)))
    live = reliable(pairs.filter(F.col("most") >= F.col("threshold")).select("query_id", "run", "threshold"))
    live = live.join(asked, "query_id")
    wanted = live.select("group", "run").distinct().join(index, "run")
    keys = ["group", "run"]
    found = live.groupBy(*keys).cogroup(renewed(wanted).groupBy(*keys)).applyInPandas(search_one, ANSWER)
    return best(found, k)


def renewed(df: DataFrame) -> DataFrame:
    """The same table under new column identities, for grouping it with a relative of itself."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def promising(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """For each query the block of a run with the highest bound."""
    most = bounds(matrix(queries.v), matrix(rows.high), matrix(rows.low))
    place = most.argmax(axis=1)
    return pd.DataFrame(
        {
            "query_id": queries.query_id, "group": queries.group, "run": queries.run,
            "block": rows.block.to_numpy()[place], "most": most.max(axis=1),
        }
    )
