"""Minimal perfect hashes of sets of byte strings, in shards, with their keys beside them.

A shard hashes its n keys into 2n bits.  Keys alone in their place set its bit; the others
try again on a level of their own, and so on.  The number of set bits before a key's own is
its slot, so slots run from 0 to n - 1 (Limasset et al., "Fast and scalable minimal perfect
hashing for massive key sets", 2017).  A string that is no key may fall on a set bit too,
which is why the keys are stored by slot and compared.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from hindsight.llm.arrays import mix

#: The seed with which Spark's xxhash64 gives the same numbers.
SEED = 42
#: Keys that are still together after so many levels have one 64-bit hash; they are listed.
LEVELS = 48


def hashes(keys: Sequence[bytes]) -> np.ndarray:
    """As Spark's xxhash64 of strings."""
    return np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in keys), np.uint64, len(keys))


def _places(h: np.ndarray, level: int, sizes) -> np.ndarray:
    return (mix(h + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)) % np.asarray(sizes, np.uint64)).astype(np.int64)


@dataclass(frozen=True)
class Shard:
    """Bits of each level one after the other, and the keys in the order of their slots."""

    levels: list[int]
    bits: np.ndarray
    keys: list[bytes]

    @classmethod
    def of(cls, keys: Sequence[bytes]) -> Shard:
        """The shard of distinct keys."""
        h, left = hashes(keys), np.arange(len(keys))
        levels: list[int] = []
        parts, order = [np.zeros(0, bool)], []
        while len(left) and len(levels) < LEVELS:
            size = 2 * len(left)
            place = _places(h[left], len(levels), size)
            alone = np.bincount(place, minlength=size)[place] == 1
            bits = np.zeros(size, bool)
            bits[place[alone]] = True
            order += left[alone][np.argsort(place[alone])].tolist()
            levels.append(size)
            parts.append(bits)
            left = left[~alone]
        return cls(levels, np.concatenate(parts), [keys[i] for i in [*order, *left]])


class PerfectHash:
    """Slots of the keys of many shards; those of one shard are neighbours.

    `first[i]` is the slot of the first key of shard i, and `first[-1]` the number of keys.
    """

    def __init__(self, shards: Sequence[Shard]):
        depth = max([1, *[len(s.levels) for s in shards]])
        self.sizes = np.zeros((depth, len(shards)), np.int64)
        for i, s in enumerate(shards):
            self.sizes[: len(s.levels), i] = s.levels
        bits = np.concatenate([np.zeros(0, bool), *[s.bits for s in shards]])
        flat = np.concatenate([[0], np.cumsum(self.sizes.T.reshape(-1))[:-1]]) if len(shards) else np.zeros(0, np.int64)
        self.starts = flat.reshape(len(shards), depth).T
        self.first = np.concatenate([[0], np.cumsum([len(s.keys) for s in shards])]).astype(np.int64)
        # keys beyond the levels follow those of the bits, so that ranks need a step for each shard
        placed = np.array([int(s.bits.sum()) for s in shards], np.int64)
        extra = np.concatenate([[0], np.cumsum(np.diff(self.first) - placed)])[:-1]
        self.rank = np.cumsum(bits, dtype=np.int64) - 1 + np.repeat(extra, self.sizes.sum(axis=0))
        self.bits = bits
        self.keys = pa.array([k for s in shards for k in s.keys], pa.binary())
        self.listed = {
            (i, k): int(self.first[i]) + int(placed[i]) + j
            for i, s in enumerate(shards) for j, k in enumerate(s.keys[int(placed[i]) :])
        }

    def slots(self, strings: list[bytes], h: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """The slot of each string in its shard, or -1 if it is none of the keys."""
        out = np.full(len(strings), -1, np.int64)
        left = np.arange(len(strings))
        for level in range(len(self.sizes)):
            left = left[self.sizes[level, shard[left]] > 0]
            if not len(left):
                break
            at = self.starts[level, shard[left]] + _places(h[left], level, self.sizes[level, shard[left]])
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        found = np.flatnonzero(out >= 0)
        same = pc.equal(self.keys.take(pa.array(out[found])), pa.array(strings, pa.binary()).take(pa.array(found)))
        out[found[~same.to_numpy(zero_copy_only=False).astype(bool)]] = -1
        if self.listed:
            for i in np.flatnonzero(out < 0):
                out[i] = self.listed.get((int(shard[i]), strings[i]), -1)
        return out
