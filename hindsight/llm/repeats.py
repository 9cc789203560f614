"""Keys that occur under two or more owners, found over a whole corpus in one shuffle.

Used for word shingles of documents and for the anchors of byte strings.  A task packs the
(key, owner, extra) entries of some text by bucket, the first bits of the key, with
six bytes for the rest of a key; a bucket has a bounded number of entries, as the number of
buckets follows the data and keys are spread evenly over them.  Entries are held until there are
enough for each bucket, so the packed rows are as many as the entries call for, not slices times
buckets.  Each bucket then keeps what occurs under several owners.

A key that the held entries have under many owners is hot.  Its entries go to separate buckets,
one for each time that they are packed, and only a count goes to the key's own bucket; they get their key's count back by
a join, whose hot keys Spark splits.  So no bucket grows with how often one key occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindsight.llm.arrays import slices
from hindsight.llm.shared import sent_if_small, settle

#: Entries of a bucket, on average; a worker holds some copies of a bucket of 32 bytes each.
BUCKET_ENTRIES = 1 << 18
#: Bytes of text that a worker packs at once; it holds some dozen numbers for each.
PACK_BYTES = 1 << 18
#: Entries of a packed row, on average, and the most that a worker holds to get there.
ROW_ENTRIES = 1 << 8
HELD_ENTRIES = 1 << 21
#: Bits of a key besides its bucket's, at most.
KEY_BITS = 48
#: Owners of a key within the held entries from which it is hot.
HOT_OWNERS = 64
HOT_BUCKETS = 1 << 20  # numbers from here on are of hot entries

PACKED = "bucket long, owners binary, counts binary, low binary, high binary, extra binary, weights binary"
FIELDS = ["bucket", "owners", "counts", "low", "high", "extra", "weights"]

#: (key, owner, extra) arrays, sorted by owner.
Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def bucket_bits(entries: int, most: int = BUCKET_ENTRIES) -> int:
    return min(20, max(0, (max(1, entries) - 1) // most).bit_length())


def shorten(keys: np.ndarray, bits: int, key_bits: int = KEY_BITS) -> np.ndarray:
    """Keys as they are told apart: the bucket's bits and the lowest ones."""
    return keys & np.uint64(((1 << bits) - 1) << (64 - bits) | ((1 << key_bits) - 1))


def _changes(values: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


def _planes(values: np.ndarray) -> bytes:
    """First bytes of all values, then second ones, and so on: the last ones, mostly 0, then take no room."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _of_planes(raw: pa.Buffer | bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _row(bucket: int, keys: np.ndarray, owners: np.ndarray, extra: np.ndarray, weights: np.ndarray) -> tuple:
    first = np.flatnonzero(_changes(owners))
    counts = np.diff(np.append(first, len(owners))).astype(np.uint32)
    low, high = keys.astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint16)
    plain = [x.tobytes() for x in (owners[first], low, high, weights.astype(np.uint32))]
    return bucket, plain[0], _planes(counts), plain[1], plain[2], _planes(extra.astype(np.int64)), plain[3]


def _packed(entries: Entries, bits: int, hot_owners: int, key_bits: int = KEY_BITS) -> Iterator[tuple]:
    keys, owners, extra = entries
    keys = shorten(keys, bits, key_bits)
    order = np.argsort(keys, kind="stable")
    ranked, by = keys[order], owners[order]
    new = _changes(ranked)
    # owners are in order within a key, as the entries came by owner
    group = np.cumsum(new) - 1
    held = np.bincount(group, weights=new | _changes(by)).astype(np.int64)
    hot = np.zeros(len(keys), bool)
    hot[order] = held[group] >= hot_owners
    if hot.any():
        # a bucket of these entries alone; in place of weights, the first bits of the keys
        salt = HOT_BUCKETS + (int(owners[0] ^ owners[-1]) & ((1 << 40) - 1))
        yield _row(salt, keys[hot], owners[hot], extra[hot], keys[hot] >> np.uint64(48))
    marks, weights = ranked[new][held >= hot_owners], held[held >= hot_owners]
    cold = ~hot
    keys, owners, extra = keys[cold], owners[cold], extra[cold]
    shift = np.uint64(64 - bits) if bits else None
    buckets = (keys >> shift).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    mark_buckets = (marks >> shift).astype(np.int64) if bits else np.zeros(len(marks), np.int64)
    order = np.argsort(buckets, kind="stable")
    cuts = np.searchsorted(buckets[order], np.arange((1 << bits) + 1))
    for b in np.union1d(buckets, mark_buckets).tolist():
        rows, mine = order[cuts[b] : cuts[b + 1]], mark_buckets == b
        # markers stand first: as many as there are weights
        pad = np.zeros(mine.sum(), np.int64)
        yield _row(b, np.append(marks[mine], keys[rows]), np.append(pad, owners[rows]), np.append(pad, extra[rows]), weights[mine])


def pack_entries(
    docs: DataFrame, entries: Callable[..., Entries], bits: int, hot_owners: int = HOT_OWNERS, key_bits: int = KEY_BITS
) -> DataFrame:
    """Packed rows of all texts; `entries(rows, data, at)` gives a slice's, each (key, owner, extra) once.

    Keys must be spread evenly, as their first bits are their buckets.  Fewer `key_bits` take less
    room, for callers that can do with some keys taken for one another: one of 2**14 at 32.
    """
    most = min(ROW_ENTRIES << bits, HELD_ENTRIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Entries] = []

        def flush() -> pa.RecordBatch:
            found = held.pop() if len(held) == 1 else tuple(np.concatenate(c) for c in zip(*held, strict=True))
            if held:
                held.clear()
                order = np.argsort(found[1], kind="stable")
                found = tuple(c[order] for c in found)
            columns = list(zip(*_packed(found, bits, hot_owners, key_bits), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]], FIELDS)

        for batch in batches:
            for part, data, at in slices(batch, most=PACK_BYTES):
                found = entries(part, data, at)
                if len(found[0]):
                    held.append(found)
                    if sum(len(h[0]) for h in held) >= most:
                        yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(run, PACKED)


def _unpack(row: tuple, bits: int) -> tuple[np.ndarray, ...]:
    """(key, owner, extra, weight) of a packed row; only markers have a weight."""
    bucket, owners, counts, low, high, extra, weights = row
    keys = (np.frombuffer(high, "<u2").astype(np.uint64) << np.uint64(32)) | np.frombuffer(low, "<u4")
    weights = np.frombuffer(weights, "<u4").astype(np.int64)
    if bucket >= HOT_BUCKETS:
        keys |= weights.astype(np.uint64) << np.uint64(48)
        weights = weights[:0]
    elif bits:
        keys |= np.uint64(bucket << (64 - bits))
    weight = np.zeros(len(keys), np.int64)
    weight[: len(weights)] = weights
    return keys, np.repeat(np.frombuffer(owners, "<i8"), _of_planes(counts, "<u4")), _of_planes(extra, "<i8"), weight


def _shared(keys, owners, extra, weight) -> tuple[np.ndarray, ...]:
    """(owner, extra, key, owners) of a bucket: of cold entries, and of hot keys with owners < 0.

    Goes through the keys in order, some at a time, to need little memory.
    """
    order = np.argsort(keys)
    found, first, chunk = [], 0, 1 << 17
    while first < len(order):
        last = min(first + chunk, len(order))
        while last < len(order) and keys[order[last]] == keys[order[last - 1]]:
            last += 1
        rows = order[first:last]
        found.append(_shared_keys(keys[rows], owners[rows], extra[rows], weight[rows]))
        first = last
    owners, *rest = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4
    by = np.argsort(owners, kind="stable")  # so that owners stand together
    return owners[by], *[x[by] for x in rest]


def _shared_keys(keys, owners, extra, weight) -> tuple[np.ndarray, ...]:
    marker = weight > 0
    order = np.lexsort((owners, ~marker, keys))
    keys, owners, extra, weight, marker = keys[order], owners[order], extra[order], weight[order], marker[order]
    new = _changes(keys)
    other = ~marker & (new | _changes(owners) | np.append(False, marker[:-1]))
    group = np.cumsum(new) - 1
    total = (np.bincount(group, weights=other) + np.bincount(group, weights=weight)).astype(np.int64)[group]
    kept = (total >= 2) & (~marker | new)
    return owners[kept], extra[kept], keys[kept].view(np.int64), np.where(marker, -total, total)[kept]


def shared_entries(packed: DataFrame, bits: int) -> DataFrame:
    """(owner, extra, key, owners) of the entries whose key has two or more owners.

    `owners` is how many there are; where a key is hot it may count some of them twice.
    """
    chunk = 1 << 16

    def keep(group: pa.Table) -> pa.Table:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        columns = [group.column("bucket").to_pylist(), *[[x.as_buffer() for x in group.column(c)] for c in FIELDS[1:]]]
        hot = columns[0][0] >= HOT_BUCKETS
        rows = list(zip(*[_unpack(r, bits) for r in zip(*columns, strict=True)], strict=True))
        del columns
        entries = []
        while rows:  # the parts of a column go once they are joined
            entries.append(np.concatenate(rows.pop(0)))
        if hot:
            keys, owners, extra, _ = entries
            found = (owners, extra, keys.view(np.int64), np.zeros(len(keys), np.int64))
        else:
            found = _shared(*entries)
        del entries
        parts = [[squeeze(x[i : i + chunk].tobytes()) for i in range(0, len(x), chunk)] for x in found]
        marks = [bool((found[3][i : i + chunk] < 0).any()) for i in range(0, len(found[3]), chunk)]
        return pa.table(
            [pa.array([int(hot)] * len(marks), pa.int32()), pa.array(marks, pa.bool_()), *[pa.array(x, pa.binary()) for x in parts]],
            ["kind", "marks", *OUT],
        )

    schema = "kind int, marks boolean, " + ", ".join(f"{c} binary" for c in OUT)
    found = settle(packed.groupBy("bucket").applyInArrow(keep, schema))
    cold = _spread(found.where("kind = 0")).where("owners > 0")
    marks = settle(_spread(found.where("marks")).where("owners < 0").select("key", (-F.col("owners")).alias("owners")))
    hot = _spread(found.where("kind = 1")).drop("owners").join(sent_if_small(marks), "key")
    return cold.unionByName(hot.select(*OUT))


OUT = ["owner", "extra", "key", "owners"]


def _spread(found: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in zip(*[batch.column(c) for c in OUT], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(expand(x.as_py()), "<i8")) for x in row], OUT)

    return found.select(*OUT).mapInArrow(run, ", ".join(f"{c} long" for c in OUT))
