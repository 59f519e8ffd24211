"""Capped one-hot categories and z-scored numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimsieve.operators.layout import broadcast_if_bounded

NULL_NAME = "<null>"
RARE_NAME = "<infrequent>"
EPSILON = 1e-8  # fixed value: keeps constant columns finite


def melt(df: DataFrame, key: str, columns: Sequence[str], value: str, cast: str) -> DataFrame:
    """(key, column, value) of some columns, nulls included."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast(cast).alias(value)) for c in columns]
    return df.select(key, F.explode(F.array(*cells)).alias("_c")).select(key, "_c.column", f"_c.{value}")


def category_counts(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    return melt(df, key, columns, "category", "string").groupBy("column", "category").agg(
        F.count(F.lit(1)).alias("n")
    )


def frequent_categories(counts: DataFrame, cap: int = 50) -> DataFrame:
    """(column, category, n, out_name, is_infrequent, pos): at most ``cap`` outputs per column.

    When a column has more categories than the cap, the most frequent ``cap - 1`` keep an output and
    the rest share one. Ties keep the later category, null being the last. ``pos`` numbers the outputs
    of a column: categories ascending, the shared output last; the shared row has a null category.
    The rank filter lets Spark drop rows before the shuffle, so a column with very many categories
    does not go through one sort.
    """
    by_size = Window.partitionBy("column").orderBy(F.desc("n"), F.desc_nulls_first("category"))
    totals = counts.groupBy("column").agg(F.count(F.lit(1)).alias("_k"), F.sum("n").alias("_all"))
    ranked = counts.withColumn("_r", F.row_number().over(by_size)).filter(F.col("_r") <= cap)
    slots = F.when(F.col("_k") > cap, cap - 1).otherwise(cap)
    kept = ranked.join(F.broadcast(totals), "column").filter(F.col("_r") <= slots)
    shared = kept.filter(F.col("_k") > cap).groupBy("column").agg(
        (F.first("_all") - F.sum("n")).alias("n")
    )
    name = F.concat_ws("=", "column", F.coalesce("category", F.lit(NULL_NAME)))
    rows = kept.select("column", "category", "n", name.alias("out_name"), F.lit(False).alias("is_infrequent"))
    if cap > 1:
        rare = shared.select(
            "column",
            F.lit(None).cast("string").alias("category"),
            "n",
            F.concat_ws("=", "column", F.lit(RARE_NAME)).alias("out_name"),
            F.lit(True).alias("is_infrequent"),
        )
        rows = rows.unionByName(rare)
    order = Window.partitionBy("column").orderBy("is_infrequent", F.asc_nulls_last("category"))
    return rows.withColumn("pos", F.row_number().over(order) - 1)


def onehot(
    df: DataFrame,
    dictionary: DataFrame,
    columns: Sequence[str],
    key: str,
    cap: int = 50,
    known: DataFrame | None = None,
) -> DataFrame:
    """(key, column, feature, value): a 1 for the category of each column.

    The dictionary has at most ``cap`` rows per column and is broadcast; frequent (hot) categories are
    all in it, so they never move. ``known`` is the full ``(column, category)`` table of the fitted
    rows: a category outside the dictionary counts as infrequent if it is known and gives no entry if
    it is not. Without it every such category is infrequent, which is right when ``df`` itself was
    fitted.
    """
    bound = cap * len(columns)
    cells = melt(df, key, columns, "category", "string")
    words = dictionary.filter(~F.col("is_infrequent")).select(
        F.col("column").alias("_col"), F.col("category").alias("_cat"), F.col("out_name").alias("_name")
    )
    match = (F.col("column") == F.col("_col")) & F.col("category").eqNullSafe(F.col("_cat"))
    hits = cells.join(broadcast_if_bounded(words, bound), match, "left")
    rare = dictionary.filter("is_infrequent").select("column", F.col("out_name").alias("_rare"))
    frequent = hits.filter(F.col("_name").isNotNull())
    rest = hits.filter(F.col("_name").isNull()).join(F.broadcast(rare), "column")
    if known is None:
        out = hits.join(F.broadcast(rare), "column", "left").withColumn("_name", F.coalesce("_name", "_rare"))
        out = out.filter(F.col("_name").isNotNull())
        return out.select(key, "column", F.col("_name").alias("feature"), F.lit(1.0).alias("value"))
    rare_known = known.join(
        broadcast_if_bounded(words, bound),
        (F.col("column") == F.col("_col")) & F.col("category").eqNullSafe(F.col("_cat")),
        "left_anti",
    ).select(F.col("column").alias("_kc"), F.col("category").alias("_kk"))
    in_known = (F.col("column") == F.col("_kc")) & F.col("category").eqNullSafe(F.col("_kk"))
    seen = rest.join(rare_known, in_known, "left_semi")
    return (
        frequent.select(key, "column", F.col("_name").alias("feature"))
        .unionByName(seen.select(key, "column", F.col("_rare").alias("feature")))
        .withColumn("value", F.lit(1.0))
    )


def numeric_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean, std_pop) in one pass, nulls skipped."""
    moments = [F.avg(F.col(c).cast("double")).alias(f"_m{i}") for i, c in enumerate(columns)]
    spreads = [F.stddev_pop(F.col(c).cast("double")).alias(f"_s{i}") for i, c in enumerate(columns)]
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("mean"), F.col(f"_s{i}").alias("std_pop"))
        for i, c in enumerate(columns)
    ]
    return df.agg(*moments, *spreads).select(F.inline(F.array(*rows)))


def standard_score(value: Column, mean: Column, std: Column) -> Column:
    """Distance from the mean in standard deviations; a missing value counts as average."""
    return F.coalesce((value - mean) / (std + F.lit(EPSILON)), F.lit(0.0))


def zscore(df: DataFrame, stats: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """(key, feature, value); ``stats`` has one row per column."""
    cells = melt(df, key, columns, "_x", "double")
    scored = cells.join(F.broadcast(stats), "column")
    value = standard_score(F.col("_x"), F.col("mean"), F.col("std_pop"))
    return scored.select(key, F.col("column").alias("feature"), value.alias("value"))
