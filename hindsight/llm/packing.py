"""Documents as token sequences of one length: best-fit decreasing, certified and repacked.

Pieces are dealt over partitions of bounded size, and each is packed by best-fit
decreasing.  Dual feasible functions bound from below how many sequences a partition needs;
one that uses no more is done.  The others keep their full sequences, exchange the pieces of
the rest in a new deal, and are packed again, as long as that saves sequences.

Cases: a null or empty text is one piece of the end token alone; every row is a document of
its own, also repeated ones; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindsight.llm.arrays import slices
from hindsight.llm.bpe import encoder
from hindsight.llm.shared import settle


@dataclass(frozen=True)
class Packing:
    """Tokens of a sequence, pieces of a partition, and how many deals there are at most."""

    capacity: int = 2048
    partition_pieces: int = 50_000
    deals: int = 5


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences at its end, the rest first."""
    first = length % capacity or capacity
    if length <= capacity:
        return [(0, length)]
    return [(0, first), *[(at, capacity) for at in range(first, length, capacity)]]


def pieces(docs: DataFrame, path: str, pattern: str | None, capacity: int, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all documents, with the end id after each."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, pattern)
        for batch in batches:
            for part, _, _ in slices(batch):
                ids = code.encode([t or "" for t in part.column("text").to_pylist()])
                rows = []
                for row, x in enumerate(ids):
                    x += end
                    for n, (at, length) in enumerate(cut(len(x) // 4, capacity)):
                        rows.append((row, n, at, length, crc32(x[4 * at : 4 * (at + length)])))
                owner, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(owner)), *[pa.array(c, pa.int64()) for c in rest]],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        code.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, piece long, start long, length long, ids_crc32 long"
    )


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that `counts[length]` pieces need at least.

    The best of two families of dual feasible functions (Fekete and Schepers): one takes
    pieces above `capacity - e` as whole sequences and forgets those below `e`, the other
    rounds shares of a sequence to multiples of 1/k.
    """
    sizes = np.flatnonzero(counts)
    if not len(sizes):
        return 0
    n = counts[sizes].astype(np.int64)
    best = -(-int((sizes * n).sum()) // capacity)
    for e in sizes[sizes <= capacity // 2]:
        value = np.where(sizes > capacity - e, capacity, np.where(sizes < e, 0, sizes))
        best = max(best, -(-int((value * n).sum()) // capacity))
    for k in range(1, 21):
        scaled = sizes * (k + 1)
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)  # times k
        best = max(best, -(-int((value * n).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each size: longest first, each where it leaves least room."""
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0  # bit r of rooms: some sequence has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, at = capacity, used
            used += 1
        sequence[i], offset[i] = at, capacity - room
        open_by_room[room - size].append(at)
        rooms |= 1 << (room - size)
    return sequence, offset


def _deal(items: DataFrame, deal: int, groups: int, capacity: int) -> DataFrame:
    """(row, length, sequence_id, offset, gap, full) of the items after one deal."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row")
        sizes = group["length"].to_numpy()
        sequence, offset = best_fit_decreasing(sizes, capacity)
        filled = np.bincount(sequence, weights=sizes)
        bound = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        number = (deal * 2**24 + int(group["g"].iloc[0])) * 2**31  # other deals have other numbers
        return pd.DataFrame({
            "row": group["row"], "length": sizes, "sequence_id": number + sequence, "offset": offset,
            "gap": len(filled) > bound, "full": filled[sequence] >= capacity,
        })

    dealt = items.select("row", "length", F.pmod(F.xxhash64("row", F.lit(deal)), F.lit(groups)).alias("g"))
    return dealt.groupBy("g").applyInPandas(pack, "row long, length long, sequence_id long, offset long, gap boolean, full boolean")


def _sequences(packed: DataFrame) -> int:
    """How many sequences there are: each has one piece at offset 0."""
    return packed.where("offset = 0").count()


def pack_items(items: DataFrame, how: Packing) -> DataFrame:
    """(row, sequence_id, offset) of settled items (row, length), all shorter than a sequence."""
    done = None
    best, before = None, None
    loose, count = items, items.count()
    for deal in range(how.deals):
        groups = max(1, -(-count // how.partition_pieces))
        packed = settle(_deal(loose, deal, groups, how.capacity))
        used = _sequences(packed)
        if before is not None and used >= before:
            break  # the deal saved nothing: what was before stays
        open_ones = F.col("gap") & ~F.col("full")
        closed = packed.where(~open_ones)
        done = closed if done is None else done.unionByName(closed)
        best = packed.where(open_ones)
        loose, count, before = best.select("row", "length"), best.count(), _sequences(best)
        if count == 0:
            break
    return done.unionByName(best).select("row", "sequence_id", "offset")


def pack(docs: DataFrame, path: str, pattern: str | None = None, how: Packing = Packing()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row for each piece.

    Texts are read once; what is kept and dealt are a few numbers for each piece.
    """
    cut_up = settle(pieces(docs, path, pattern, how.capacity).withColumn("row", F.monotonically_increasing_id()))
    whole = F.col("length") == how.capacity
    placed = pack_items(cut_up.where(~whole).select("row", "length"), how)
    alone = cut_up.where(whole).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return cut_up.join(placed.unionByName(alone), "row").select(
        "doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset"
    )
