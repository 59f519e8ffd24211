"""Feature blocks side by side, their positions, and per-row sparse arrays."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimsieve.operators.layout import broadcast_if_bounded

# The order in which the blocks stand side by side.
BLOCKS = ("tfidf", "embedding", "categorical", "numeric", "readability")


def concat_blocks(blocks: dict[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """(key, block, feature, value) of all blocks; an absent block adds nothing."""
    parts = [
        blocks[name].select(key, F.lit(name).alias("block"), F.col("feature").cast("string"), "value")
        for name in BLOCKS
        if name in blocks
    ]
    return reduce(DataFrame.unionByName, parts)


def number_features(names: DataFrame) -> DataFrame:
    """(position, block, feature) from ``names(block, feature, place)``.

    The window runs in one task over the fitted feature names, whose number is bounded by the vocabulary
    size, the category cap and the vector width.
    """
    rank = F.array_position(F.array(*[F.lit(b) for b in BLOCKS]), F.col("block"))
    order = Window.orderBy(rank, "place", "feature")
    return names.select((F.row_number().over(order) - 1).alias("position"), "block", "feature")


def feature_counts(index: DataFrame) -> DataFrame:
    """(block, n_features) per block and for all blocks together."""
    counted = index.rollup("block").agg(F.countDistinct("block", "feature").alias("n_features"))
    return counted.select(F.coalesce("block", F.lit("total")).alias("block"), "n_features")


def slice_features(features: DataFrame, selected: DataFrame, max_features: int = 10_000) -> DataFrame:
    """Entries of the selected ``(block, feature)`` only."""
    return features.join(
        broadcast_if_bounded(selected.select("block", "feature"), max_features), ["block", "feature"], "left_semi"
    )


def pack_rows(features: DataFrame, index: DataFrame, key: str = "doc_id", max_features: int = 10_000) -> DataFrame:
    """(key, indices, values): the non-zero entries of each row in position order.

    A row has at most as many entries as there are features, so the collected list is bounded.
    """
    named = features.filter(F.col("value") != 0).join(
        broadcast_if_bounded(index, max_features), ["block", "feature"]
    )
    entry = F.struct(F.col("position").cast("int").alias("position"), "value")
    packed = named.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    return packed.select(key, F.col("_e.position").alias("indices"), F.col("_e.value").alias("values"))


def entry(position: Column, value: Column) -> Column:
    """One entry of a sparse row."""
    return F.struct(position.cast("int").alias("position"), value.cast("double").alias("value"))


def no_entries() -> Column:
    return F.array().cast("array<struct<position: int, value: double>>")


def to_vectors(rows: DataFrame, n_features: int, out: str = "features") -> DataFrame:
    """Turn ``indices``/``values`` arrays into a sparse ML vector column, one Arrow batch at a time."""
    keep = [c for c in rows.columns if c not in ("indices", "values")]
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(out, VectorUDT())])

    def convert(batches):
        for batch in batches:
            n = batch.num_rows
            vectors = pa.StructArray.from_arrays(
                [
                    pa.array([0] * n, pa.int8()),
                    pa.array([n_features] * n, pa.int32()),
                    batch.column("indices").cast(pa.list_(pa.int32())),
                    batch.column("values").cast(pa.list_(pa.float64())),
                ],
                names=["type", "size", "indices", "values"],
            )
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [vectors], names=[*keep, out])

    return rows.mapInArrow(convert, schema)
