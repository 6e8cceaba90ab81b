"""Hashed word n-gram features and softmax regression trained by follow-the-regularised-leader.

Features are the distinct hashed unigrams and bigrams of a text's tokens: words, and
runs of punctuation. A word equal to the word before it counts as a repetition mark.
They are computed for a whole Arrow batch at once, from its bytes: token hashes are
differences of prefix sums of a polynomial hash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_by_hash, stored, utf8_buffers

BASE, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
REPEAT = np.uint64(0x5BD1E9955BD1E995)
SAMPLE_AT_MOST = 8000


@cache
def _classes() -> np.ndarray:
    """Byte classes: 0 white space, 1 word (letters, digits, underscore, any non-ASCII), 2 punctuation."""
    kind = np.full(256, 2, np.uint8)
    kind[[9, 10, 11, 12, 13, 32]] = 0
    for a, b in ((48, 58), (65, 91), (97, 123), (95, 96), (128, 256)):
        kind[a:b] = 1
    return kind


@cache
def _fold() -> np.ndarray:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return low


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i below n."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            out = np.ones(max(n, 1 << 16), np.uint64)
            out[1:] = np.uint64(base)
            _powers.append(np.multiply.accumulate(out))
    return _powers[0], _powers[1]


def features(raw: np.ndarray, bounds: np.ndarray, bits: int, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature) of every unigram and bigram of the rows' bytes, and each row's number of white-space words."""
    n = len(bounds) - 1
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    kind = _classes()[raw]
    change = np.empty(len(raw), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    starts_of_rows = bounds[:-1][bounds[:-1] < len(raw)]
    change[starts_of_rows] = True
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(raw))
    token = kind[starts] > 0
    starts, ends = starts[token], ends[token]
    row = np.searchsorted(bounds, starts, side="right") - 1
    # White-space words: a token that does not follow another one at once.
    opens = np.ones(len(starts), bool)
    opens[1:] = (starts[1:] != ends[:-1]) | (row[1:] != row[:-1])
    words = np.bincount(row[opens], minlength=n)
    power, inverse = powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_fold()[raw] if fold else raw).astype(np.uint64) * power[: len(raw)] + power[: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h ^= h >> np.uint64(29)
    h *= MIX
    if len(h):
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1]) & (kind[starts[1:]] == 1)
        h = np.where(again, REPEAT, h)
    same = row[1:] == row[:-1]
    pair = (h[:-1] * np.uint64(3) + (h[1:] ^ np.uint64(0x94D049BB133111EB)))[same] * MIX
    both = np.concatenate([h, pair])
    both ^= both >> np.uint64(32)
    both *= MIX
    return np.concatenate([row, row[1:][same]]), (both >> np.uint64(64 - bits)).astype(np.int64), words


@dataclass
class Model:
    """Softmax over classes; weights[feature, class]; features are binary."""

    classes: list
    weights: np.ndarray
    bias: np.ndarray
    bits: int
    fold: bool

    def posteriors(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x classes, words of each row)."""
        row, feature, words = features(raw, bounds, self.bits, self.fold)
        used = self.used()[feature]
        key = np.unique(row[used] << self.bits | feature[used])
        row, feature = key >> self.bits, key & ((1 << self.bits) - 1)
        n = len(bounds) - 1
        z = np.stack([np.bincount(row, self.weights[feature, c], n) for c in range(len(self.classes))], 1) + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True), words

    def used(self) -> np.ndarray:
        if getattr(self, "_used", None) is None:
            self._used = self.weights.any(1)
        return self._used

    def of_arrow(self, column: pa.Array, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors and word counts of a string column, about `piece` bytes at a time (a longer text stays whole)."""
        raw, bounds = utf8_buffers(column)
        out, words, a = [np.zeros((0, len(self.classes)))], [np.zeros(0, np.int64)], 0
        while a < len(bounds) - 1:
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + piece, side="right")) - 1)
            b = min(b, len(bounds) - 1)
            p, w = self.posteriors(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            out.append(p)
            words.append(w)
            a = b
        return np.concatenate(out), np.concatenate(words)


def train(texts: pa.Array, labels: list, bits: int = 18, fold: bool = True, updates: int = 24_000, alpha: float = 0.3, beta: float = 1.0, l1: float = 2.0, l2: float = 1.0) -> Model:
    """Per-coordinate FTRL-Proximal over the examples in the given order, 3 to 20 times, so often that there are about `updates`."""
    classes = sorted(set(labels))
    k = len(classes)
    raw, bounds = utf8_buffers(texts)
    examples, a = [], 0
    while a < len(labels):
        b = min(len(labels), a + 256)
        row, feature, _ = features(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], bits, fold)
        key = np.unique(row << bits | feature)
        cuts = np.searchsorted(key, np.arange(b - a + 1) << bits)
        examples += [key[s:e] & ((1 << bits) - 1) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        a = b
    z, n = np.zeros(((1 << bits) + 1, k)), np.zeros(((1 << bits) + 1, k))
    truth = np.eye(k)[[classes.index(x) for x in labels]] if k else np.zeros((0, 0))
    lasso = np.full((1 << bits) + 1, l1)
    lasso[-1] = 0  # the bias

    def weights(at: np.ndarray) -> np.ndarray:
        zi, ni, l = z[at], n[at], lasso[at][:, None]
        return np.where(np.abs(zi) <= l, 0.0, (np.sign(zi) * l - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    bias = 1 << bits
    for _ in range(min(20, max(3, -(-updates // max(1, len(examples)))))):
        for i, own in enumerate(examples):
            at = np.append(own, bias)
            w = weights(at)
            score = w.sum(0)
            p = np.exp(score - score.max())
            g = (p / p.sum() - truth[i])[None, :]
            square = n[at] + g * g
            z[at] += g - (np.sqrt(square) - np.sqrt(n[at])) / alpha * w
            n[at] = square
    final = weights(np.arange((1 << bits) + 1))
    return Model(classes, final[:-1].astype(np.float32), final[-1], bits, fold)


def learn(docs: DataFrame, labelled: DataFrame, at_most: int = SAMPLE_AT_MOST, **options) -> Model | None:
    """A model of `labelled` (doc_id, label) from the texts of `docs`, on `at_most` labelled ids at most, chosen by a hash of the id.

    Of an id that several rows share the least text is learned.
    """
    rows = labelled.where("doc_id is not null and label is not null").select("doc_id", "label").distinct()
    chosen = stored(least_by_hash(rows, at_most, 23, "doc_id", "label"), "labelled-sample")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label").toArrow()  # at_most rows
    if not sample.num_rows:
        return None
    sample = sample.sort_by([("label", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
    order = np.random.default_rng(7).permutation(sample.num_rows)
    sample = sample.take(pa.array(order))
    return train(sample.column("text").combine_chunks(), sample.column("label").to_pylist(), **options)
