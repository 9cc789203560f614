"""What several operators need of Spark: cut lineages, checked broadcasts, components."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindsight.session import shared_folder

#: The most that is ever sent to all executors at once.
BROADCAST_BYTES = 8 << 20


_SHIPPED: set[str] = set()
#: Rows that a Python worker gets at once, as rows hold texts or packed arrays.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Make a session ready: smaller batches, and this package on the Python workers.

    Ten thousand texts, Spark's batch, are tens of megabytes in each of several buffers.
    """
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(batch)) > BATCH_ROWS:
        spark.conf.set(batch, str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    # executors fetch it from the driver, whenever they start
    archive = Path(tempfile.mkdtemp(), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared folder of spark.checkpoint.dir.

    Spark removes the files when nothing refers to them any more, if the session has
    spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def sent_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """`df`, which must be settled, marked for broadcast if its rows are small in total.

    Beyond that the join shuffles, and Spark splits its hot keys.
    """
    sizes = [F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.lit(16) for f in df.schema]
    total = df.agg(F.sum(sum(sizes, F.lit(16)))).first()[0] or 0
    return F.broadcast(df) if total <= most else df


def order_key(column: str) -> Column:
    """A document number for comparisons: rows without one come last."""
    return F.coalesce(F.col(column).cast("long"), F.lit(2**63 - 1))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of undirected `links` (a, b), two long columns.

    The component is its smallest node.  Alternates the star steps of Kiveris et al.,
    "Connected Components in MapReduce and Beyond": first every node's larger neighbours,
    then its smaller ones, are linked to its smallest neighbour, until nothing changes.
    A node of many links never meets them in one row: only minima are grouped.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = settle(small.where("a > b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
