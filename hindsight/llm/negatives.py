"""Hard negatives by length buckets and coordinate pruning.

For anchors, the rows of highest inner product are found among those of the same label
(positives), and among those of other labels within a share of each positive's score
(negatives).  Both are exact, by the pruning of Teflioudi et al., "LEMP: Fast retrieval of
large entries in a matrix product", 2015:

* Rows lie in buckets by length, and those in blocks of bounded bytes.  A block holds, for
  each coordinate, the list of its rows sorted by that coordinate of their unit vectors.
* Who is to reach a score of t with an anchor a, in a block of longest row l, needs a cosine
  of t / (|a| l).  Above 1 the block is left out, without being read for the anchor.
* A cosine bounds every coordinate of a unit vector.  For the anchor's largest coordinates,
  the focus, the feasible ranges are found in the sorted lists; the rows of the shortest
  range that lie in all others too are the candidates, and only their scores are computed.

Blocks are built once and kept.  Anchors, a small share of the rows, are copied to the blocks
that they cannot leave out; the share of a block that meets in one task has a bound in bytes.
Each anchor first looks through its own block, so that it has a score to reach elsewhere.

Numbers are whole: components are floored multiples, scores are exact.  Scores beyond 64 bits
count as the largest or smallest 64-bit number.

Cases: rows without a number or a label, with a null vector or one that holds a null or a
number that is not finite take no part; vectors meet those of their own dimension only;
repeated rows count once; rows with one number but different contents all take part, but none
as another's positive or negative; zero vectors have the score 0; ties go to the smaller
number; an anchor with too few rows has fewer results; no rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindsight.llm.shared import sent_if_small, settle

LONGS = -(2**63), 2**63 - 1


@dataclass(frozen=True)
class Mining:
    """What is mined, and sizes.

    low, high: a negative's score lies between these percents of the positive's.  scale:
    components are floored after they are multiplied by it.  buckets: buckets of length for
    each doubling.  focus: coordinates of an anchor whose ranges are looked up.
    """

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    scale: int = 256
    buckets: int = 8
    block_rows: int = 8192
    block_bytes: int = 16 << 20
    asked_bytes: int = 32 << 20
    focus: int = 6


def _whole(x: np.ndarray) -> np.ndarray:
    """In as few bytes as hold it."""
    most = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    return x.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


class Block:
    """Rows of one bucket with a sorted list for each coordinate."""

    def __init__(self, vectors: np.ndarray, order: np.ndarray | None = None):
        self.vectors = vectors
        wide = vectors.astype(np.float64)
        length = np.sqrt(np.square(wide).sum(axis=1))
        self.longest = float(length.max(initial=0.0))
        self.unit = np.ascontiguousarray((wide / np.where(length > 0, length, 1)[:, None]).T)
        self.order = np.argsort(self.unit, axis=1, kind="stable") if order is None else order
        self.sorted = np.take_along_axis(self.unit, self.order.astype(np.int64), axis=1)
        self.most = float(np.abs(wide).max(initial=0.0))
        self.wide = wide

    def candidates(self, anchor: np.ndarray, least: float, focus: int) -> np.ndarray:
        """Rows that may reach the score `least` with the anchor."""
        n, norm = len(self.vectors), float(np.sqrt(np.square(anchor.astype(np.float64)).sum()))
        most = norm * self.longest
        if least > most * (1 + 1e-9):
            return np.zeros(0, np.int64)
        if least <= 0 or most == 0:
            return np.arange(n)
        angle = np.arccos(min(1.0, least / most * (1 - 1e-9)))
        unit = anchor / norm
        chosen = np.argsort(-np.abs(unit), kind="stable")[:focus]
        own = np.arccos(np.clip(unit[chosen], -1, 1))
        # rounding must lose no row
        low, high = np.cos(np.minimum(np.pi, own + angle)) - 1e-7, np.cos(np.maximum(0, own - angle)) + 1e-7
        begin = np.array([self.sorted[f].searchsorted(v, "left") for f, v in zip(chosen, low, strict=True)])
        end = np.array([self.sorted[f].searchsorted(v, "right") for f, v in zip(chosen, high, strict=True)])
        least_rows = int(np.argmin(end - begin))
        rows = self.order[chosen[least_rows], begin[least_rows] : end[least_rows]].astype(np.int64)
        for i, f in enumerate(chosen):
            if i != least_rows and end[i] - begin[i] < n:
                rows = rows[(self.unit[f, rows] >= low[i]) & (self.unit[f, rows] <= high[i])]
        return rows

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products as longs."""
        bound = self.most * float(np.abs(anchor.astype(np.float64)).max(initial=0.0)) * max(1, len(anchor))
        if bound < 2**52:
            return (self.wide[rows] @ anchor.astype(np.float64)).astype(np.int64)
        if bound < 2**62:
            return self.vectors[rows].astype(np.int64) @ anchor
        exact = self.vectors[rows].astype(object) @ anchor.astype(object)
        return np.array([min(max(int(x), LONGS[0]), LONGS[1]) for x in exact], np.int64)


def _packed(block_rows: pa.Table) -> pa.Table:
    """One row for the rows of a block."""
    dim = block_rows.column("dim")[0].as_py()
    n = block_rows.num_rows
    vectors = block_rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dim)
    order = Block(vectors).order
    small = _whole(vectors)
    return pa.table({
        **{c: block_rows.column(c).slice(0, 1) for c in ("dim", "bucket", "block")},
        **{c: pa.array([block_rows.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in ("vec_id", "label")},
        "width": pa.array([small.itemsize], pa.int32()),
        "vectors": pa.array([small.tobytes()], pa.binary()),
        "order_": pa.array([order.astype(np.int32).tobytes()], pa.binary()),
    })


INDEX = "dim int, bucket int, block int, vec_id binary, label binary, width int, vectors binary, order_ binary"
FOUND = "anchor long, band int, vec_id long, score long"


def _search(k: int, same: bool, how: Mining):
    """The best k rows of a block for each anchor and band (floor, cap), by falling score."""

    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if index.num_rows and asked.num_rows:
            row = {c: index.column(c)[0].as_py() for c in index.column_names}
            ids, labels = (np.frombuffer(row[c], np.int64) for c in ("vec_id", "label"))
            shape = len(ids), row["dim"]
            vectors = np.frombuffer(row["vectors"], f"i{row['width']}").reshape(shape)
            block = Block(vectors, np.frombuffer(row["order_"], np.int32).reshape(shape[::-1]))
            flat = asked.column("a_v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            for i, anchor in enumerate(flat.reshape(asked.num_rows, row["dim"])):
                key, own, label, floors, caps = (asked.column(c)[i].as_py() for c in ("anchor", "a_id", "a_label", "floors", "caps"))
                rows = block.candidates(anchor, float(min(floors)), how.focus)
                rows = rows[((labels[rows] == label) == same) & (ids[rows] != own)]
                score = block.scores(rows, anchor)
                for band, (low, high) in enumerate(zip(floors, caps, strict=True)):
                    inside = np.flatnonzero((score >= low) & (score <= high))
                    if len(inside) > k:
                        least = np.partition(score[inside], -k)[-k]
                        inside = inside[score[inside] >= least]
                    best = inside[np.lexsort((ids[rows[inside]], ~score[inside]))][:k]
                    if len(best):
                        out.append((np.full(len(best), key), np.full(len(best), band), ids[rows[best]], score[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 4
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c.astype(np.int64)).cast(t) for c, t in zip(columns, types, strict=True)], ["anchor", "band", "vec_id", "score"])

    return run


def _visit(index: DataFrame, asked: DataFrame, parts: DataFrame, k: int, same: bool, how: Mining) -> DataFrame:
    """What anchors find in the blocks that they are to visit (dim, bucket, block), best k of each block."""
    asked = asked.join(parts, "dim").withColumn("part", F.pmod(F.xxhash64("anchor", F.lit(1)), "parts").cast("int"))
    copies = index.join(parts, "dim").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    keys = ["dim", "bucket", "block", "part"]
    asked = asked.select(*keys, "anchor", "a_id", "a_label", "a_v", "floors", "caps")
    return copies.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search(k, same, how), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def finite(vector: str) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, how: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: rows with vec_id, embedding and label; `label`: an expression that stands for it.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    )
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("x"))
    # multiples beyond 64 bits count as the largest or smallest long
    whole = F.transform("x", lambda x: F.when(F.abs(x * how.scale) < 9.2e18, F.floor(x * how.scale)).otherwise(F.when(x > 0, LONGS[1]).otherwise(LONGS[0])).cast("long"))
    rows = rows.select("vec_id", "label", "asks", whole.alias("v")).distinct()
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    bucket = F.when(length > 0, F.floor(F.log2(length) * how.buckets)).otherwise(-1).cast("int")
    rows = settle(rows.select("*", F.size("v").alias("dim"), length.alias("length"), bucket.alias("bucket")))

    bytes_of = 8 * F.greatest(F.col("dim"), F.lit(1))
    room = F.greatest(F.lit(1), F.least(F.lit(how.block_rows), F.floor(how.block_bytes / bytes_of)))
    sizes = rows.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / F.max(room)).cast("int").alias("blocks"))
    sizes = sent_if_small(settle(sizes))
    parts = rows.where("asks").groupBy("dim").agg(F.ceil(F.count("*") * F.max(bytes_of + 256) / how.asked_bytes).cast("int").alias("parts"))
    parts = sent_if_small(settle(parts))
    dealt = rows.join(sizes, ["dim", "bucket"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "v"), "blocks").cast("int"))
    index = settle(dealt.groupBy("dim", "bucket", "block").applyInArrow(_packed, INDEX))
    anchors = settle(dealt.where("asks").select(
        "dim", "bucket", "block", F.xxhash64("vec_id", "label", "v").alias("anchor"),
        F.col("vec_id").alias("a_id"), F.col("label").alias("a_label"), F.col("v").alias("a_v"), F.col("length").alias("a_length"),
    ))

    def everywhere(asked: DataFrame) -> DataFrame:
        """Anchors with `floors`, copied to all blocks whose rows are long enough."""
        longest = F.when(F.col("bucket") < 0, 0.0).otherwise(F.pow(F.lit(2.0), (F.col("bucket") + 1) / how.buckets)) * (1 + 1e-6)
        near = asked.drop("bucket", "block").join(sizes, "dim")
        near = near.where((F.array_min("floors") <= 0) | (F.col("a_length") * longest >= F.array_min("floors")))
        return near.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    no_floor, no_cap = F.array(F.lit(LONGS[0])), F.array(F.lit(LONGS[1]))
    first = _visit(index, anchors.withColumns({"floors": no_floor, "caps": no_cap}), parts, how.positives, True, how)
    reached = first.groupBy("anchor").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= how.positives)
    asked = anchors.join(reached, "anchor", "left").withColumns({"floors": F.array(F.coalesce("least", F.lit(LONGS[0]))), "caps": no_cap})
    found = _visit(index, everywhere(asked), parts, how.positives, True, how)
    positives = settle(_best(found, how.positives).select("anchor", F.col("rank").alias("p"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # positives below zero have no negatives: no number lies between 80 and 100 percent of them
    exact = F.col("positive_score").cast("decimal(38,0)")
    banded = positives.select("anchor", F.struct(
        "p", F.ceil(exact * how.low / 100).cast("long").alias("low"), F.floor(exact * how.high / 100).cast("long").alias("high")
    ).alias("b")).where("b.low <= b.high").groupBy("anchor").agg(F.sort_array(F.collect_list("b")).alias("bands"))
    asked = anchors.join(banded, "anchor").withColumns({"floors": F.col("bands.low"), "caps": F.col("bands.high")})
    found = _best(_visit(index, everywhere(asked.drop("bands")), parts, how.negatives, False, how), how.negatives)
    by_band = banded.select("anchor", F.posexplode("bands").alias("band", "b")).select("anchor", "band", F.col("b.p").alias("p"))
    named = positives.join(by_band, ["anchor", "p"]).join(anchors.select("anchor", "a_id"), "anchor")
    return found.join(named, ["anchor", "band"]).select(
        F.col("a_id").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
