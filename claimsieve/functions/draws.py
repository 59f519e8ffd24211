"""Random draws that depend only on a seed, a tag and key columns.

``F.rand(seed)`` depends on how rows are laid out over partitions. A draw keyed by the row's own
identity gives the same table for any partitioning and after any task retry.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42
HEX_DIGITS = 12  # 48 bits: exactly representable in a double


def _key(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("string")


def uniform(tag: str, *keys, seed: int = SEED) -> Column:
    """Uniform draw in [0, 1) for the given tag and keys."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *[_key(k) for k in keys])
    digits = F.substring(F.md5(text), 1, HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / F.lit(float(16**HEX_DIGITS))


def uniform_between(low: float, high: float, tag: str, *keys, seed: int = SEED) -> Column:
    return F.lit(float(low)) + F.lit(float(high - low)) * uniform(tag, *keys, seed=seed)


def normal(tag: str, *keys, seed: int = SEED) -> Column:
    """Standard normal draw (Box-Muller on two uniform draws)."""
    u1 = uniform(tag + "-u1", *keys, seed=seed)
    u2 = uniform(tag + "-u2", *keys, seed=seed)
    return F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def with_distinct_picks(
    df: DataFrame, out: str, count: int, population: str, tag: str, keys: Sequence[str], seed: int = SEED
) -> DataFrame:
    """Add an array of ``count`` different indices in ``[0, population)``, in draw order.

    The j-th draw picks one of the ``population - j`` free places and then steps over the places
    already taken, so no row has to be paired with every member of the population. A population of
    fewer than ``count`` gives all its indices. One projection per draw: each hash is computed once.
    """
    keep = [c for c in df.columns if c != out]
    taken: list[str] = []
    for j in range(count):
        free = F.col(population).cast("bigint") - F.lit(j)
        draw = uniform(tag, *[F.col(k) for k in keys], j, seed=seed)
        df = df.withColumn("_place", F.floor(draw * free).cast("bigint"))
        if taken:
            df = df.withColumn("_taken", F.array_sort(F.array(*taken)))
            for k in range(len(taken)):
                step = F.when(F.col("_place") >= F.get("_taken", F.lit(k)), 1).otherwise(0).cast("bigint")
                df = df.withColumn("_place", F.col("_place") + step)
        taken.append(f"_pick{j}")
        df = df.withColumn(taken[-1], F.col("_place"))
    size = F.least(F.lit(count), F.col(population).cast("int"))
    return df.select(*keep, F.slice(F.array(*taken), 1, size).alias(out))
