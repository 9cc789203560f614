"""Finding the few groups of rows that are too large for one task.

Every profile below returns a list with a fixed upper length to the driver; the lists
only choose the physical route of a row, never whether it is kept.  All routes of an
operator give the same result and every row takes exactly one.  A profile counts all rows;
a key beyond its list is found by a join, or its rows are shuffled and Spark splits them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SkewPolicy:
    """Sizes that steer the routing.

    dense_rows: rows of one key within one longest rolling frame before the frame is
        assembled from tiles instead of being re-read for every row.  Both take the
        same time at about 350 rows.
    hot_rows: rows one task should hold; larger seconds of a key are not shuffled, and ranges
        of the as-of join are made smaller than that.
    max_groups: upper length of the lists of crowded keys and seconds.
    broadcast_bytes: size, as distinct keys times the longest key, up to which the keys of
        an observation table are broadcast to read only their feature rows.
    """

    dense_rows: int = 500
    hot_rows: int = 4_000_000
    max_groups: int = 10_000
    broadcast_bytes: int = 64 << 20


def key_hash(keys: Sequence[str]) -> Column:
    """64-bit hash of a key. Colliding keys share a route, which changes no result."""
    return F.xxhash64(*[F.col(k) for k in keys])


def heavy_groups(
    df: DataFrame, by: Sequence[str], min_rows: int, policy: SkewPolicy, extra: Iterable[Column] = ()
) -> list[Row]:
    """The largest groups with more than `min_rows` rows: their columns, `n` and `extra`."""
    return (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n"), *extra)
        .where(F.col("n") > min_rows)
        .orderBy(F.desc("n"), *by)
        .limit(policy.max_groups)
        .collect()
    )


def inline(spark: SparkSession, names: Sequence[str], rows: Iterable[Sequence[int]]) -> DataFrame:
    """A small table of longs held in the plan itself; NULLs allowed."""
    values = ", ".join(
        "(" + ", ".join("CAST(NULL AS BIGINT)" if v is None else f"{v}L" for v in row) + ")"
        for row in rows
    )
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def is_in(column: str, values: Iterable[int]) -> Column:
    """Membership in a bounded list of longs."""
    return F.expr(f"{column} IN ({', '.join(f'{v}L' for v in values)})")
