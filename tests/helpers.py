"""Small tables and plan inspection for the tests."""

import re
from datetime import datetime, timedelta

START = datetime(2024, 1, 10)


def at(**offset) -> datetime:
    return START + timedelta(**offset)


def table(spark, schema: str, rows):
    """A DataFrame of rows whose datetimes are UTC wall-clock times."""
    ntz = spark.createDataFrame(rows, re.sub(r" timestamp\b(?=,|$)", " timestamp_ntz", schema))
    return ntz.selectExpr(*[
        f"CAST(`{f.name}` AS TIMESTAMP) AS `{f.name}`" if f.dataType.typeName() == "timestamp_ntz" else f"`{f.name}`"
        for f in ntz.schema
    ])


def wall_clock(df):
    """Timestamps as TIMESTAMP_NTZ, so that collecting does not use the local zone."""
    return df.selectExpr(*[
        f"CAST(`{f.name}` AS TIMESTAMP_NTZ) AS `{f.name}`" if f.dataType.typeName() == "timestamp" else f"`{f.name}`"
        for f in df.schema
    ])


def rows(df) -> list[tuple]:
    return sorted([tuple(r) for r in wall_clock(df).collect()], key=repr)


def plan(df) -> str:
    """The physical plan as first planned."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return text


def count(df, node: str) -> int:
    return len(re.findall(rf"(?:\+- |:- |\*\(\d+\) |^){node}\b(?! \d)", plan(df), flags=re.M))
