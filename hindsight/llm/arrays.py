"""Texts of an Arrow batch as numpy arrays: slices of bounded size, words, hashes.

All functions work on many texts at once: `data` holds their UTF-8 bytes one after the
other, `at` the place where each begins, plus the end (so `len(at)` is one more than the
number of texts).  A hash is 64 bits of a polynomial over random byte values; equal byte
strings have equal hashes, and different ones differ but for a chance of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A slice holds so many bytes of text, or one longer text.  Memory of a task is some
#: dozens of times this, or of its longest text.
SLICE_BYTES = 1 << 19

#: What parts words: space and the five control characters from tab to carriage return.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, data, at) of runs of rows; a null text is an empty one."""
    texts = pc.fill_null(batch.column(column), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        before = ends[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(first, last - first), *bytes_of(texts.slice(first, last - first))
        first = last


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    at = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def per_text(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of a value per byte over each text."""
    return np.diff(np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])[at])


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text number) of the words, which are runs without separators."""
    inner = np.concatenate([~SEPARATORS[data], [False]])
    # a text's first byte begins a word, and the byte after its last one ends it
    begins = inner.copy()
    begins[1:] &= ~inner[:-1]
    edge = at[:-1][np.diff(at) > 0]
    begins[edge] = inner[edge]
    ends = np.zeros(len(inner), bool)
    ends[1:] = inner[:-1] & ~inner[1:]
    edge = edge[edge > 0]
    ends[edge] |= inner[edge - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return begin, end, np.searchsorted(at, begin, "right") - 1


@lru_cache(maxsize=1)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    out = []
    for number in (base, pow(base, -1, 1 << 64)):
        power = np.full(length, number, np.uint64)
        power[0] = 1
        out.append(np.multiply.accumulate(power))
    return out[0], out[1]


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Enough of them; longer texts than a slice get their own."""
    return _powers(max(SLICE_BYTES + 1, length))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64 over all of them (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def running_sums(data: np.ndarray) -> np.ndarray:
    """Sums before each byte, from which `span_hashes` takes the hash of any span."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[begin]) * down[begin])


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` values, in their order."""
    count = max(0, len(values) - size + 1)
    out = np.zeros(count, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + values[i : i + count] + np.uint64(i + 1))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
