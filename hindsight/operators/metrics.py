"""Metrics of 0/1 predictions and the time range of a table (A1-A6, ML6)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def time_coverage(df: DataFrame, ts: str) -> DataFrame:
    """One row: first and last time (A1)."""
    return df.agg(F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Row count of every (label, prediction) pair that occurs (A5), without NULLs as in `evaluate`."""
    pairs = df.select(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction"))
    return pairs.dropna().groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def evaluate(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: counts, precision, recall, F1 and accuracy in a single pass.

    Rows with a NULL label or prediction are left out; a zero denominator gives 0.0.
    """
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    counts = df.where(y.isNotNull() & p.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((p == 1) & (y == 1)).alias("tp"),
        F.count_if((p == 1) & (y != 1)).alias("fp"),
        F.count_if((p != 1) & (y == 1)).alias("fn"),
        F.count_if(y == p).alias("right"),
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    tp, fp, fn, n = (F.col(c) for c in ("tp", "fp", "fn", "n"))
    return counts.select(
        "n", "tp", "fp", "fn",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(F.col("right"), n).alias("accuracy"),
    )


def check_quality(metrics: DataFrame, at_least: Mapping[str, float]) -> dict[str, float]:
    """Raise if a metric of the one-row result is below its threshold (ML6)."""
    row = metrics.first().asDict()
    low = {m: row[m] for m, bound in at_least.items() if row[m] < bound}
    if low:
        raise ValueError(f"quality too low: {low}, wanted at least {dict(at_least)}")
    return row
