"""Dense vectors: pooling, scaling and batch inference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def mean_pool(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, pos, value): element-wise mean of all vectors of a group.

    Sums combine inside each task per (group, position), so a group of any size costs one row per
    position and task in the shuffle.
    """
    cells = df.select(group, F.posexplode(vector).alias("pos", "_x"))
    return cells.groupBy(group, "pos").agg(F.avg(F.col("_x").cast("double")).alias("value"))


def vector_stats(df: DataFrame, vector: str) -> DataFrame:
    """(pos, mean, std): per dimension; a constant dimension gets std 1."""
    cells = df.select(F.posexplode(vector).alias("pos", "_x")).withColumn("_x", F.col("_x").cast("double"))
    spread = F.stddev_pop("_x")
    return cells.groupBy("pos").agg(
        F.avg("_x").alias("mean"), F.when(spread > 0, spread).otherwise(1.0).alias("std")
    )


def standardize(df: DataFrame, stats: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, pos, value): each dimension shifted and scaled by its statistics.

    The statistics (one row per dimension) become one array and are applied inside the row.
    """
    ordered = F.array_sort(F.collect_list(F.struct("pos", "mean", "std")))
    fitted = stats.agg(ordered.alias("fitted")).scalar()
    paired = df.select(key, F.col(vector).alias("_v"), fitted.alias("_f"))
    scaled = F.zip_with("_v", "_f", lambda x, s: (x.cast("double") - s["mean"]) / s["std"])
    return paired.select(key, F.posexplode(scaled).alias("pos", "value"))


def embed_batch(
    df: DataFrame, text: str, model: Callable, out: str = "embedding", batch_size: int = 16
) -> DataFrame:
    """Add a vector per text from a caller-supplied model, applied to Arrow batches.

    ``model()`` is called once per worker and returns a function from an array of texts to a 2-D array.
    """
    infer = predict_batch_udf(
        model, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    return df.withColumn(out, infer(F.col(text)))
