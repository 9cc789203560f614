"""Reading parquet tables and feature sources."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindsight.functions.columns import require_columns, time_literal
from hindsight.session import require_utc
from hindsight.spec.model import Source


def scan(spark: SparkSession, paths: str | Sequence[str], path_column: str | None = None) -> DataFrame:
    """Parquet files under one or more glob paths, with the file path as a column if named."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select("*", F.col("_metadata.file_path").alias(path_column)) if path_column else df


def scan_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """The table of a dataset folder, which lies in its `data` subfolder."""
    return scan(spark, f"{folder}/data")


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


Span = tuple[datetime | None, datetime | None]
EVERYTHING: Span = (None, None)


def read_source(
    spark: SparkSession, source: Source, spans: Sequence[Span] = (EVERYTHING,), untimed: bool = False
) -> DataFrame:
    """A feature source with its time as a timestamp, limited to half-open time spans.

    The limits are compared with the stored column in its stored type, so they reach the
    parquet reader.  Rows without a time are read with everything, or if `untimed`.
    """
    require_utc(spark)
    df = scan(spark, source.path)
    column = source.timestamp_column
    if column is not None:
        require_columns(df, [column])
        if EVERYTHING not in spans:
            df = df.where(within(df, column, spans, untimed))
        df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df.withColumnsRenamed(dict(source.rename))


def within(df: DataFrame, column: str, spans: Sequence[Span], untimed: bool = False) -> Column:
    """Whether a time lies in one of the half-open spans; a None bound is open."""
    dtype, c = df.schema[column].dataType, F.col(column)
    condition = c.isNull() if untimed else F.lit(False)
    for start, end in spans:
        inside = c.isNotNull()
        if start is not None:
            inside = inside & (c >= time_literal(start, dtype))
        if end is not None:
            inside = inside & (c < time_literal(end, dtype))
        condition = condition | inside
    return condition
