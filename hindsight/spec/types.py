"""Declared column types (M7)."""

from __future__ import annotations

from pyspark.sql import types as T

# The eight declared type names.
COLUMN_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "integer": T.IntegerType(),
    "boolean": T.BooleanType(),
    "datetime": T.TimestampType(),
    "double": T.DoubleType(),
    "float": T.FloatType(),
    "long": T.LongType(),
    "binary": T.BinaryType(),
}


def spark_type(name: str) -> T.DataType:
    """The Spark type of a declared type name, in any letter case; unknown names raise."""
    try:
        return COLUMN_TYPES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown column type {name!r}, expected one of {sorted(COLUMN_TYPES)}") from None


def type_name(dtype: T.DataType) -> str:
    """The declared name of a Spark type; both timestamp types are `datetime`."""
    if isinstance(dtype, T.TimestampNTZType):
        return "datetime"
    for name, known in COLUMN_TYPES.items():
        if known == dtype:
            return name
    raise ValueError(f"type {dtype.simpleString()} cannot be declared as a feature type")
