"""Interleave sources at target weights by Pfair scheduling.

The documents of a source are cut into blocks. With weight w, block j of a source (from 1) may start at slot
floor((j - 1) / w) and must start before slot ceil(j / w); the slot goes to the released block with the
earliest deadline. On one processor that meets all deadlines, so after any number of slots of a phase every source
is less than one block away from its share. Windows are taken from the weights themselves, in whole numbers, over
the whole phase; nothing is rounded, so nothing adds up.

When a source is used up, the others go on by their weights (a new phase). Every document gets exactly one place,
every named source has its own weight, however many there are. The driver holds one line per source and goes through the slots, one per ``block_rows`` documents, and passes them on in bounded chunks; all work on
documents is DataFrame code.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimsieve.llm.common import packed, text_or_empty, unpacked
from claimsieve.operators.layout import broadcast_if_bounded, reliable

BLOCK_ROWS = 16
CYCLE = 1_000
BUCKET_ROWS = 10_000
CHUNK_SLOTS = 500_000


def source_counts(docs: DataFrame) -> list[tuple[str, int]]:
    """Every named source and its rows, the largest first: one line per source reaches the driver."""
    counts = docs.filter(F.col("source").isNotNull()).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return sorted(((r.source, r.n) for r in counts.collect()), key=lambda x: (-x[1], x[0]))


def tempered(counts: list[tuple[str, int]], power: float = 0.5) -> dict[str, float]:
    """Target weights in proportion to the size raised to a power below 1: small sources gain."""
    return {name: n**power for name, n in counts}


def phases(weights: list[float], blocks: list[int], cycle: int = CYCLE) -> list[dict]:
    """An outline of the run in cycles of whole blocks; :func:`schedule` goes by the weights themselves.

    Who takes part, with how many blocks a cycle, for how many cycles.

    In each phase the sources with blocks left share a cycle by weight, to the nearest block; the cycle is as long
    as ``cycle`` and the source that runs out first allow. The phase ends when some source has too few blocks for
    one more cycle.
    """
    left, taken, start, out = list(blocks), [0] * len(weights), 0, []
    while any(left):
        total = sum(w for w, n in zip(weights, left, strict=True) if n)
        slots = min(n * total / w for w, n in zip(weights, left, strict=True) if n)
        slots = max(1, min(cycle, int(slots)))
        share = [min(n, max(1, round(slots * w / total))) if n else 0 for w, n in zip(weights, left, strict=True)]
        cycles = min(n // u for u, n in zip(share, left, strict=True) if u)
        length = sum(share)
        out.append({"phase": len(out), "start": start, "length": length, "share": share, "before": list(taken), "cycles": cycles})
        for i, u in enumerate(share):
            left[i] -= u * cycles
            taken[i] += u * cycles
        start += length * cycles
    return out


def whole_units(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of the weights."""
    ratios = [w.as_integer_ratio() for w in weights]
    scale = max(d for _, d in ratios)  # denominators of floats are powers of two
    return [n * (scale // d) for n, d in ratios]


def schedule(weights: list[float], blocks: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(place, block, phase, release, deadline) of each slot, from slot 0; blocks count from 0."""
    units = whole_units(weights)
    taken, start, phase = [0] * len(units), 0, 0
    alive = [i for i, n in enumerate(blocks) if n]
    total = sum(units[i] for i in alive)
    while alive:
        before, slot, used_up = list(taken), 0, False
        waiting, ready = [(0, i) for i in alive], []
        while not used_up:
            while waiting and waiting[0][0] <= slot:
                release, i = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(taken[i] - before[i] + 1) * total // units[i]), i, release))
            deadline, i, release = heapq.heappop(ready)
            yield i, taken[i], phase, start + release, start + deadline
            taken[i] += 1
            slot += 1
            used_up = taken[i] == blocks[i]
            heapq.heappush(waiting, ((taken[i] - before[i]) * total // units[i], i))
        alive.remove(i)
        total -= units[i]
        start += slot
        phase += 1


def plan_table(spark: SparkSession, weights: list[float], blocks: list[int]) -> DataFrame:
    """(p_place, p_block, phase, release, deadline, slot): one row per block."""
    names = ["p_place", "p_block", "phase", "release", "deadline"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    slots, total, out = schedule(weights, blocks), sum(blocks), None
    for first in range(0, max(1, total), CHUNK_SLOTS):
        rows = [next(slots) for _ in range(min(CHUNK_SLOTS, total - first))]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        numbers = pa.array(range(first, first + len(rows)), pa.int64())
        part = spark.createDataFrame(pa.table([*arrays, numbers], names=[*names, "slot"]))
        if total > CHUNK_SLOTS:
            part = reliable(part)
        out = part if out is None else out.unionByName(part)
    return broadcast_if_bounded(out, total)


def mix(
    docs: DataFrame,
    weights: dict[str, float],
    block_rows: int = BLOCK_ROWS,
    cycle: int = CYCLE,
    seed: str = "mix",
    columns: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, source, place, phase, block, release, deadline, slot, position) and ``columns``, per row of ``docs``.

    ``weights`` names any number of sources; rows of sources it does not name, and rows without one, are one more
    source with the mean weight. Documents of a source are shuffled by a keyed hash of doc_id and text;
    rows that repeat in full follow one another. ``position`` orders all rows; slots are numbered from 0.
    Null ids and texts are ordinary values. An empty table gives an empty table. ``cycle`` changes nothing any more.
    """
    spark = docs.sparkSession
    names = sorted(weights)
    wanted = [*[float(weights[n]) for n in names]]
    wanted.append(sum(wanted) / len(wanted) if wanted else 1.0)
    numbers = pa.array(range(len(names)), pa.int32())
    known = spark.createDataFrame(pa.table([pa.array(names, pa.string()), numbers], names=["w_source", "w_place"]))
    known = broadcast_if_bounded(known, len(names))
    place = F.coalesce("w_place", F.lit(len(names)))
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"), text_or_empty(docs) if "text" in docs.columns else F.lit(""))
    keyed = docs.select("doc_id", "source", *columns, draw.alias("draw"))
    keyed = keyed.join(known, F.col("source") == F.col("w_source"), "left").withColumn("place", place).drop("w_source", "w_place")

    counted = {r.place: r.n for r in keyed.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = [counted.get(i, 0) for i in range(len(wanted))]
    plan = plan_table(spark, [max(w, 1e-9) for w in wanted], [-(-n // block_rows) for n in sizes])

    # number the rows of a source without one task seeing them all: uniform ranges of the draw, counted, then offset
    several = [(i, -(-n // BUCKET_ROWS)) for i, n in enumerate(sizes) if n > BUCKET_ROWS]
    arrays = [pa.array([x[k] for x in several], kind) for k, kind in enumerate((pa.int32(), pa.int64()))]
    ranges = broadcast_if_bounded(spark.createDataFrame(pa.table(arrays, names=["r_place", "ranges"])), len(several))
    share = (F.shiftright(F.col("draw"), 1).cast("double") / 2.0**63) + 0.5
    many = F.coalesce("ranges", F.lit(1).cast("long"))
    bucket = F.least(F.floor(share * many), many - 1)
    rows = keyed.join(ranges, F.col("place") == F.col("r_place"), "left").withColumn("bucket", bucket).drop("ranges", "r_place")
    per_bucket = rows.select("place", "bucket")
    per_bucket = per_bucket.groupBy("place", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        F.col("place").alias("o_place"), F.col("bucket").alias("o_bucket"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"),
    )
    inside = Window.partitionBy("place", "bucket").orderBy("draw", "doc_id")
    rows = rows.withColumn("nth", F.row_number().over(inside) - 1)
    rows = rows.join(offsets, (F.col("place") == F.col("o_place")) & (F.col("bucket") == F.col("o_bucket")))
    rows = rows.withColumn("nth", F.col("nth") + F.col("offset"))
    rows = rows.withColumn("block", F.floor(F.col("nth") / block_rows))

    rows = rows.join(plan, (F.col("place") == F.col("p_place")) & (F.col("block") == F.col("p_block")))
    return rows.select(
        "doc_id", "source", "place", "phase", F.col("block").cast("long"), "release", "deadline", "slot",
        (F.col("slot") * block_rows + F.col("nth") % block_rows).cast("long").alias("position"),
        *columns,
    )


def mixed(docs: DataFrame, weights: dict[str, float], partitions: int | None = None) -> DataFrame:
    """The documents in the order of the mixture: ranges of the position, each sorted."""
    text = ["text"] if "text" in docs.columns else []
    placed = mix(docs.select("doc_id", "source", *text, packed(docs)), weights, columns=("row",))
    ordered = placed.repartitionByRange(*([partitions] if partitions else []), "position")
    ordered = ordered.sortWithinPartitions("position")
    return ordered.select(*unpacked(docs.columns))
