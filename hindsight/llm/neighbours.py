"""Nearest neighbours by collision counting over query-aware hashing.

Vectors are projected on `projections` random lines; for each line a block of vectors has a
sorted array of their places on it.  A query looks at a window around its own place on every
line.  All windows widen together by virtual rehashing, that is, by searching the same arrays
with a larger radius, and only what a window gains is counted.  Vectors that have collided on
`threshold` lines are verified by their distance.  The search of a block ends when as many
neighbours as wanted are verified within the radius, at which nearer ones would have collided
(Huang et al., "Query-aware locality-sensitive hashing", 2015), or when all are verified.

All rows are indexed, in blocks of bounded bytes; queries, in blocks, visit every block of
their dimension, and the best of all blocks are ranked.

Cases: vectors that are null, zero, or hold a null or a number that is not finite take no
part, nor do rows without a number; vectors meet those of their own length only; of rows with
one number the smallest vector counts; ties go to the smaller number; no rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, erf, exp, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindsight.llm.shared import sent_if_small, settle


@dataclass(frozen=True)
class Search:
    """How many neighbours, and the sizes of blocks and windows.

    `width` is a window's width at radius 1, `ratio` by how much radii grow; `miss` bounds
    the chance that a vector within the radius does not collide often enough.
    """

    k: int = 10
    block_rows: int = 16_384
    block_bytes: int = 32 << 20
    query_rows: int = 256
    width: float = 2.72
    far: float = 2.0
    miss: float = exp(-1) / 4
    false_share: float = 0.02
    ratio: float = 1.25
    seed: int = 271828

    def lines(self) -> tuple[int, int]:
        """(projections, threshold) for these chances, by the bounds of the paper."""
        near, far = (erf(self.width / 2 / s / sqrt(2)) for s in (1.0, self.far))
        spread, chance = sqrt(log(2 / self.false_share)), sqrt(log(1 / self.miss))
        lines = ceil((spread + chance) ** 2 / (2 * (near - far) ** 2))
        ratio = spread / chance
        return lines, ceil((ratio * near + far) / (1 + ratio) * lines)


class Block:
    """Sorted arrays of the vectors' places on each line, one after the other."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, how: Search):
        self.vectors, self.ids, self.how = vectors, ids, how
        count, self.threshold = how.lines()
        self.lines = np.random.default_rng(how.seed).standard_normal((vectors.shape[1], count))
        places = (vectors @ self.lines).T
        order = np.argsort(places, axis=1, kind="stable")
        # a line's places are moved by a step that no window reaches across
        self.span = 4 * float(np.abs(places).max()) + 1.0
        self.step = np.arange(count) * (2 * self.span)
        self.first = np.arange(count) * len(ids)
        self.places = (np.take_along_axis(places, order, axis=1) + self.step[:, None]).reshape(-1)
        self.order = order.reshape(-1)

    def _window(self, centre: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """On each line, the first place in the window and the one after its last."""
        half = min(half, self.span)
        left, right = self.places.searchsorted(centre - half, "left"), self.places.searchsorted(centre + half, "right")
        return np.maximum(left, self.first), np.minimum(right, self.first + len(self.ids))

    def _between(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The vectors at these runs of places."""
        size = end - begin
        total = np.cumsum(size)
        return self.order[np.arange(total[-1]) + np.repeat(begin - total + size, size)]

    def search(self, query: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, distance) of the nearest found; the query's own row takes no part."""
        how, n = self.how, len(self.ids)
        place = (query[None, :] @ self.lines)[0]
        # a query far outside the block is as far as any: its windows open on the whole line
        centre = np.clip(place, -self.span / 2, self.span / 2) + self.step
        # equal vectors may be a rounding apart on a line
        slack = 1e-9 * self.span
        left, right = self._window(centre, slack)
        hits = np.bincount(self._between(left, right), minlength=n)
        # the first radius takes in some vectors on a typical line
        reach = 2 * how.k
        high, low = np.minimum(right + reach, self.first + n - 1), np.maximum(left - reach, self.first)
        radius = max(float(np.median(self.places[high] - self.places[low])) / how.width, slack)
        verified = np.zeros(n, bool)
        rows, found = np.zeros(0, np.int64), np.zeros(0)
        while True:
            a, b = self._window(centre, how.width * radius / 2)
            hits += np.bincount(self._between(np.append(a, right), np.append(left, b)), minlength=n)
            left, right = a, b
            new = np.flatnonzero((hits >= self.threshold) & ~verified)
            verified[new] = True
            new = new[self.ids[new] != own]
            distance = np.sqrt(np.square(self.vectors[new] - query).sum(axis=1))
            rows, found = np.append(rows, new), np.append(found, distance)
            if verified.all() or np.count_nonzero(found <= radius) >= how.k:
                best = np.lexsort((self.ids[rows], found))[: how.k]
                return rows[best], found[best]
            radius *= how.ratio


def usable(vector: str) -> Column:
    """Whether a vector can be compared: it has length and direction, and finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, how: Search = Search()) -> DataFrame:
    """query_id, rank, vec_id, score from vectors (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = settle(rows.withColumn("dim", F.size("v")).withColumn("q", F.coalesce(is_query, F.lit(False))))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("q").alias("asked"))
    room = F.greatest(F.lit(1), F.least(F.lit(how.block_rows), F.floor(how.block_bytes / (8 * F.col("dim")))))
    sizes = settle(sizes.select(
        "dim", F.ceil(F.col("n") / room).cast("int").alias("blocks"), F.ceil(F.col("asked") / how.query_rows).cast("int").alias("parts")
    ).where("parts > 0"))
    known = rows.join(sent_if_small(sizes), "dim")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    data = known.select("dim", "vec_id", "v", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), every("parts").alias("part"))
    asked = known.where("q").select(
        F.col("dim").alias("q_dim"), F.col("vec_id").alias("q_id"), F.col("v").alias("q_v"),
        F.pmod(F.xxhash64("vec_id", F.lit(1)), "parts").cast("int").alias("q_part"), every("blocks").alias("q_block"),
    )

    def search(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(data) and len(asked):
            data = data.sort_values("vec_id")
            ids = data["vec_id"].to_numpy()
            block = Block(np.stack(data["v"].to_numpy()), ids, how)
            for own, query in zip(asked["q_id"], asked["q_v"], strict=True):
                found, distance = block.search(np.asarray(query), own)
                out += zip([own] * len(found), ids[found].tolist(), distance.tolist(), strict=True)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    # both sides have keys of the same types, else they would be dealt differently
    pairs = data.groupBy("dim", "block", "part").cogroup(asked.groupBy("q_dim", "q_block", "q_part"))
    found = pairs.applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= how.k).select("query_id", "rank", "vec_id", "score")
