"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

RUNTIME = {
    # Stored TIMESTAMP_NTZ values become instants by the session zone; pin it.
    "spark.sql.session.timeZone": "UTC",
    # INT96, the default, carries no statistics, so time filters would skip no row group.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the settings that change results or pruning; sizes stay the cluster's."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


UTC = {"utc", "etc/utc", "gmt", "z", "+00:00", "utc+00:00", "gmt+00:00", "etc/gmt", "zulu", "etc/zulu", "uct", "etc/uct"}


def require_utc(spark: SparkSession) -> None:
    """Raise unless the session's zone is UTC, in which stored times, days and windows are read.

    In another zone rows would fall out of their days without an error.
    """
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone.lower() not in UTC:
        raise ValueError(f"the session's zone is {zone!r}; set spark.sql.session.timeZone to UTC (hindsight.session.prepare)")


def shared_folder(spark: SparkSession, base: str | None = None) -> str:
    """A new folder below `base`, or below the one the cluster names in spark.checkpoint.dir.

    Only a session in one process may do without, as in tests: a temporary folder takes its
    place.  On a cluster each executor would write to a folder of its own.
    """
    base = base or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"no shared folder: set spark.checkpoint.dir (the master is {master!r})")
        base = tempfile.mkdtemp(prefix="hindsight-")
    return f"{base.rstrip('/')}/hindsight-{uuid.uuid4().hex}"
