"""Scalar and row-wise steps."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970, sub-seconds floored."""
    return F.col(ts).cast("timestamp").cast("long") if isinstance(ts, str) else ts.cast("timestamp").cast("long")


def utc_time(value: str | datetime) -> datetime:
    """An ISO text or datetime as a naive UTC datetime (P15); naive input is taken as UTC."""
    moment = datetime.fromisoformat(value) if isinstance(value, str) else value
    return moment.astimezone(timezone.utc).replace(tzinfo=None) if moment.tzinfo else moment


def time_literal(value: str | datetime, dtype: T.DataType = T.TimestampType()) -> Column:
    """A time constant of the given column type, so that the comparison reaches the scan."""
    text = utc_time(value).isoformat(sep=" ")
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(text).cast(dtype)
    return F.lit(text + "+00:00").cast("timestamp")


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"unknown columns {missing}; the table has {df.columns}")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Project to columns in the given order; unknown names raise."""
    require_columns(df, names)
    return df.select(*names)


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns by name; unknown names raise."""
    require_columns(df, names)
    return df.drop(*names)


def filter_rows(df: DataFrame, predicate: str) -> DataFrame:
    """Filter by a predicate text; `col('x')` may stand for the column x."""
    return df.where(re.sub(r"""\bcol\(\s*(['"])([^'"`]+)\1\s*\)""", r"`\2`", predicate))


def sample_rows(df: DataFrame, probability: float, seed: int) -> DataFrame:
    """Bernoulli sample (P5). Repeatable only while the partitioning stays the same."""
    return df.sample(withReplacement=False, fraction=probability, seed=seed)


#: Copies of a row that are counted out at once.
COPIES = 4096


def content_text(df: DataFrame) -> Column:
    """The values of a row as one text, different for different rows."""
    texts = [F.col(c).cast("string") for c in df.columns]
    return F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.length(t).cast("string"), F.lit(":"), t)) for t in texts])


def sample_by_content(df: DataFrame, probability: float, seed: int) -> DataFrame:
    """Bernoulli sample (P5) that depends on the rows alone, not on their order or partitioning.

    Each of n equal rows is numbered from 1 to n, and kept by a hash of its content, its
    number and the seed.  Equal rows are counted on the map side, so they never meet in a task.
    """
    copies = "__copies"
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(copies))
    runs = counted.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({copies} - 1) div {COPIES}"))))
    first = F.col("__run") * COPIES
    numbers = F.sequence(first + 1, F.least(first + COPIES, F.col(copies)))
    text = F.concat(F.lit(f"{seed}#"), content_text(df), F.lit("#"))
    place = lambda n: F.conv(F.substring(F.md5(F.concat(F.col("__text"), n.cast("string"))), 1, 12), 16, 10).cast("long")
    kept = F.explode(F.filter(numbers, lambda n: place(n) < round(probability * 2**48)))
    return runs.withColumn("__text", text).select(*df.columns, kept.alias("__n")).drop("__n")


def key_bucket(key: str, buckets: int = 100) -> Column:
    """A bucket number of a key that no partitioning can change."""
    digits = F.substring(F.md5(F.col(key).cast("string")), 1, 6)
    return F.conv(digits, 16, 10).cast("long") % buckets


def sample_by_key(df: DataFrame, key: str, probability: float) -> DataFrame:
    """Sample whole keys, repeatable under any partitioning (P5).

    Of 2**48 buckets of keys, as many as the probability says are kept.
    """
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 12), 16, 10).cast("long")
    return df.where(bucket < round(probability * 2**48))


def to_bool(
    column: str | Column, true_values: Sequence[str], false_values: Sequence[str], strict: bool = False
) -> Column:
    """Boolean from two value lists (P6). Other values become NULL, or raise if `strict`."""
    c = F.col(column) if isinstance(column, str) else column
    text = c.cast("string")
    other = F.lit(None).cast("boolean")
    if strict:
        message = F.concat(F.lit("value in neither list: "), text)
        other = F.when(text.isNull(), other).otherwise(F.raise_error(message).cast("boolean"))
    return (
        F.when(text.isin(*true_values), F.lit(True))
        .when(text.isin(*false_values), F.lit(False))
        .otherwise(other)
    )


def path_columns(df: DataFrame, pattern: str, path: Column | None = None) -> DataFrame:
    """Columns from a path pattern such as `/year={year}/month={month}`."""
    path = F.col("_metadata.file_path") if path is None else path
    pieces = re.split(r"\{(\w+)\}", pattern)
    regex = "".join("([^/]+)" if i % 2 else re.escape(piece) for i, piece in enumerate(pieces))
    names = pieces[1::2]
    return df.select(
        "*", *[F.nullif(F.regexp_extract(path, regex, i), F.lit("")).alias(n) for i, n in enumerate(names, 1)]
    )


def as_number(df: DataFrame, column: str) -> Column:
    """A numeric or boolean column with missing values as 0 (P11); other types raise."""
    dtype = df.schema[column].dataType
    c = F.col(column)
    if isinstance(dtype, T.BooleanType):
        c = c.cast("int")
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        c = F.nanvl(c, F.lit(0).cast(dtype))
    elif not isinstance(dtype, T.NumericType):
        raise ValueError(f"column {column!r} of type {dtype.simpleString()} is not numeric; drop it first")
    return F.coalesce(c, F.lit(0).cast(dtype if isinstance(dtype, T.NumericType) else "int")).alias(column)


def fill_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values of the given columns as 0, the other columns unchanged."""
    require_columns(df, columns)
    return df.select(*[as_number(df, c) if c in columns else F.col(c) for c in df.columns])


def preview(df: DataFrame, rows: int = 5, order: Sequence[str] = ()) -> DataFrame:
    """First rows (L1); give an order when the choice must be stable."""
    return (df.orderBy(*order) if order else df).limit(rows)
