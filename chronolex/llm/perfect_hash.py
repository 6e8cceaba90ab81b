"""Minimal perfect hashing of distinct 64-bit keys, built by shards and looked up in bulk.

A level is a bit array; a key that hashes to a bit of its own there is settled, the
others go on to the next level with another seed. A key's number is the rank of its bit in
all shards' levels laid end to end, so numbers fill 0 .. n - 1 without gaps. Keys that were
not hashed get any number or none: lookups are verified against the keys in this order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LOAD = 1.5  # bits of a level for each key that reaches it


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser: multiplications and shifts that spread every bit."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(((seed + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(keys, 1000) % np.uint64(shards)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(words of each level's bits, the distinct keys in order of their numbers)."""
    levels, order, left = [], [], np.unique(keys)
    while len(left):
        words = -(-int(len(left) * LOAD) // 64) + 1
        at = (mixed(left, len(levels)) % np.uint64(words * 64)).astype(np.int64)
        alone = np.bincount(at, minlength=words * 64)[at] == 1
        taken = np.sort(at[alone])
        bits = np.zeros(words, np.uint64)
        np.bitwise_or.at(bits, taken >> 6, np.uint64(1) << (taken & 63).astype(np.uint64))
        levels.append(bits)
        order.append(left[alone][np.argsort(at[alone])])
        left = left[~alone]
    return levels, np.concatenate(order) if order else np.zeros(0, np.int64)


@dataclass
class PerfectHash:
    bits: np.ndarray
    rank: np.ndarray  # bits set before each word
    starts: np.ndarray  # [shard, level]: first word
    words: np.ndarray  # [shard, level]: words; 0 past the last level
    keys: np.ndarray

    @classmethod
    def of(cls, shards: list[tuple[list[np.ndarray], np.ndarray]]) -> PerfectHash:
        depth = max((len(levels) for levels, _ in shards), default=0)
        words = np.array([[len(x) for x in levels] + [0] * (depth - len(levels)) for levels, _ in shards], np.int64).reshape(len(shards), depth)
        starts = (np.cumsum(words.ravel()) - words.ravel()).reshape(words.shape)
        bits = np.concatenate([x for levels, _ in shards for x in levels] or [np.zeros(0, np.uint64)])
        held = np.bitwise_count(bits).astype(np.int64)
        return cls(bits, np.cumsum(held) - held, starts, words, np.concatenate([k for _, k in shards] or [np.zeros(0, np.int64)]))

    def __len__(self) -> int:
        return len(self.keys)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, or -1 if it is none of the hashed keys."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys) or not len(keys):
            return out
        shard, open_ = shard_of(keys, len(self.words)), np.arange(len(keys))
        for level in range(self.words.shape[1]):
            words = self.words[shard[open_], level]
            open_, words = open_[words > 0], words[words > 0]
            at = (mixed(keys[open_], level) % (words * 64).astype(np.uint64)).astype(np.int64)
            word, bit = self.starts[shard[open_], level] + (at >> 6), (at & 63).astype(np.uint64)
            found = (self.bits[word] >> bit & np.uint64(1)).astype(bool)
            below = self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[found]] = (self.rank[word] + np.bitwise_count(below))[found]
            open_ = open_[~found]
        return np.where((out >= 0) & (self.keys[out] == keys), out, -1)
