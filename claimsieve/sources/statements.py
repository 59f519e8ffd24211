"""The headerless tab-separated statement file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimsieve.functions.text import binarize_label, normalize_missing

# The 14 columns of the file, in order.
TEXT_COLUMNS = ("id", "label", "statement", "subject", "speaker", "job", "state", "party")
COUNT_COLUMNS = ("barely_true_c", "false_c", "half_true_c", "mostly_true_c", "pants_on_fire_c")
LAST_COLUMN = "venue"
CATEGORICAL = ("subject", "speaker", "job", "state", "party", "venue")

SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in TEXT_COLUMNS]
    + [T.StructField(c, T.DoubleType()) for c in COUNT_COLUMNS]
    + [T.StructField(LAST_COLUMN, T.StringType())]
)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = SCHEMA, multi_line: bool = True) -> DataFrame:
    """Tab-separated rows without a header; a quote inside quotes is doubled.

    Quoted fields may hold line breaks, and then a file cannot be split between tasks. Pass
    ``multi_line=False`` for files without such breaks, so that large files are split.
    """
    return (
        spark.read.schema(schema)
        .option("sep", "\t")
        .option("header", False)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def normalize_columns(df: DataFrame) -> DataFrame:
    """Missing-value tokens of all string columns become null."""
    text = {f.name: normalize_missing(F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.withColumns(text)


def load_statements(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Statements with a 0/1 label; rows without a statement are dropped."""
    text_schema = T.StructType([T.StructField(f.name, T.StringType()) for f in SCHEMA])
    rows = normalize_columns(read_tsv(spark, path, text_schema, multi_line))
    counts = {c: F.col(c).cast("double") for c in COUNT_COLUMNS}
    rows = rows.withColumns(counts).withColumn("label", binarize_label(F.col("label")))
    return rows.filter(F.col("statement").isNotNull())
