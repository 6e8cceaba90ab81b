"""Importance resampling of documents towards the n-grams of a target text collection.

Words are joined by single spaces, and that normalised document is scanned once: the
running CRC is kept at every word's end. The checksum of any run of words follows from
two of these prefixes alone: the earlier one, moved over the run's length by the linear map
over GF(2) that appending zero bytes is, cancels out of the later one. So no n-gram is
ever built. A document is a histogram of its n-grams' buckets; the histograms of all
documents and of the target are summed in tasks first, then by bucket, and give each
bucket's gain (at most `buckets` numbers on the driver). A second scan weighs documents.
Gumbel noise from a hash of the id turns the best-scored into a draw without replacement.
Ranks come from an order cut into ranges and a count for each range, so the draw may grow
with the table.

Cases: null text, and text without a word, has no feature and weight 0. A null id has the
hash of the seed alone and comes before other ids of its score. Repeated rows are scored
and drawn one by one, in no set order among themselves. Very long texts are used whole,
`AT_ONCE` bytes at a time. Empty tables, and an empty target, are allowed: without any
feature on one side all gains are what the smoothing alone gives. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored

LONGEST, BUCKETS = 3, 10_000
#: Bytes of one text that are scanned at once, and of all texts of a batch.
AT_ONCE, BATCH_BYTES = 8 << 20, 1 << 20
RANGE_ROWS = 200_000

# Bytes to scan: A-Z lower-cased, all other ASCII characters but letters and digits blank; bytes of other characters stay.
SCANNED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(rb" [^ ]+")


def _byte_table() -> np.ndarray:
    """The register after one zero byte, for each value of its low byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


BYTE = _byte_table()


def _over_zeros(crc: np.ndarray) -> np.ndarray:
    return BYTE[crc & 0xFF] ^ (crc >> 8)


class Shift:
    """Moves checksums over a number of zero bytes: a linear map over GF(2), as four tables of 256 for each power of two.

    Lengths below `near` have tables of their own.
    """

    def __init__(self, near: int = 128) -> None:
        units = np.uint32(1) << np.arange(32, dtype=np.uint32)  # each bit's image is a column of the map
        images = [_over_zeros(units)]
        for _ in range(40):
            images.append(self._apply(images[-1], images[-1]))
        self.powers = [self._tables(image) for image in images]
        each, image = [self._tables(units)], units
        for _ in range(1, near):
            image = _over_zeros(image)
            each.append(self._tables(image))
        self.near, self.each = near, np.stack(each, axis=1).reshape(4, -1)

    @staticmethod
    def _apply(image: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros_like(values)
        for bit in range(32):
            out ^= np.where(values >> np.uint32(bit) & 1, image[bit], np.uint32(0))
        return out

    @classmethod
    def _tables(cls, image: np.ndarray) -> np.ndarray:
        low = np.arange(256, dtype=np.uint32)
        return np.stack([cls._apply(image, low << np.uint32(8 * k)) for k in range(4)])

    def __call__(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        row = np.where(lengths < self.near, lengths, 0) << 8
        parts = [(crc >> np.uint32(8 * k)) & 0xFF for k in range(4)]
        out = self.each[0][row + parts[0]]
        for k in range(1, 4):
            out ^= self.each[k][row + parts[k]]
        far = np.flatnonzero(lengths >= self.near)
        if len(far):
            value, length = crc[far], lengths[far]
            for bit, tables in enumerate(self.powers[: int(length.max()).bit_length()]):
                on = (length >> bit & 1).astype(bool)
                moved = value[on]
                value[on] = tables[0][moved & 0xFF] ^ tables[1][moved >> np.uint32(8) & 0xFF] ^ tables[2][moved >> np.uint32(16) & 0xFF] ^ tables[3][moved >> np.uint32(24)]
            out[far] = value
        return out


_shift: list[Shift] = []


def shift() -> Shift:
    """The tables, made once in each worker."""
    if not _shift:
        _shift.append(Shift())
    return _shift[0]


def _runs(words: list[bytes], owner: np.ndarray, longest: int, known: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, CRC-32) of each run of 1 to `longest` words of one owner that ends after the first `known` words; words with a space before them."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.fromiter(accumulate(words, lambda crc, word: zlib.crc32(word, crc), initial=0), np.uint32, len(words) + 1)
    # The register before a word: after the word before and a space. A checksum is a register's complement.
    register = ~ends[:-1]
    starts, upto = ~(BYTE[(register ^ 0x20) & 0xFF] ^ (register >> 8)), np.cumsum(lengths)
    begin = upto - lengths + 1
    for n in range(1, longest + 1):
        last = np.arange(max(known, n - 1), len(words))
        last = last[owner[last - n + 1] == owner[last]]
        yield owner[last], ends[last + 1] ^ shift()(starts[last - n + 1], upto[last] - begin[last - n + 1])


def features(texts: list[bytes], longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of UTF-8 texts, in parts: how many words each has in the part, and the features' owners (places in `texts`) and CRC-32 (uint32)."""
    short = [text if len(text) <= AT_ONCE else b"" for text in texts]
    found = [WORD.findall(b" " + text.translate(SCANNED)) for text in short]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    owners, crcs = zip(*_runs(list(chain.from_iterable(found)), np.repeat(np.arange(len(texts)), counts), longest), strict=True)
    yield counts, np.concatenate(owners), np.concatenate(crcs)
    for i in (i for i, text in enumerate(texts) if len(text) > AT_ONCE):
        text, words, a = b" " + texts[i].translate(SCANNED), [], 0
        while a < len(text):
            b = text.find(b" ", a + AT_ONCE)
            b = len(text) if b < 0 else b
            before, new = words[max(0, len(words) - longest + 1) :], WORD.findall(text, a, b)
            words, a = before + new, b
            owners, crcs = zip(*_runs(words, np.full(len(words), i), longest, len(before)), strict=True)
            counts = np.zeros(len(texts), np.int64)
            counts[i] = len(new)
            yield counts, np.concatenate(owners), np.concatenate(crcs)


def _utf8(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def histogram(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of a table's texts fall in each bucket; a row for each task and bucket is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for part in slices(batches, "text", BATCH_BYTES):
            for _, _, crcs in features(_utf8(part.column(0)), longest):
                seen += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(seen[some])], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:  # one for each bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier each bucket is in the target, both smoothed by one."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    ratio = lambda s, t: (float(t + 1) * float(s_all + n)) / (float(s + 1) * float(t_all + n))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(h: int) -> int:
    """Thousandths of Gumbel noise, from a 32-bit hash."""
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: str = "42") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    held, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for part in slices(batches, "text", BATCH_BYTES):
            words, n, weight = (np.zeros(part.num_rows, np.int64) for _ in range(3))
            for counts, owners, crcs in features(_utf8(part.column(1)), longest):
                words += counts
                n += np.bincount(owners, minlength=part.num_rows)
                np.add.at(weight, owners, gain[crcs % np.uint32(buckets)])
            score = weight + np.array([noise(h) for h in part.column(2).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (words, n, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"))
    return given.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def drawn(scored: DataFrame, per_cent: int = 5, least_words: int = 20) -> DataFrame:
    """`scored` with `rank` (1, 2, ...) of the highest scores among documents of at least `least_words` words; the others' is null."""
    kept = stored(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("_row")]
    eligible, columns = kept.where(F.col("n_words") >= least_words), scored.columns
    n = eligible.count()
    k = per_cent * n // 100
    ranged = eligible.repartitionByRange(max(1, -(-n // RANGE_ROWS)), *order).select("*", F.spark_partition_id().alias("_part"))
    ranged = stored(ranged, "ranges")
    starts, upto = [], 0
    for r in sorted(ranged.groupBy("_part").count().collect()):  # a row for each range
        starts.append((r["_part"], upto))
        upto += r["count"]
    start = kept.sparkSession.createDataFrame(starts, "_part int, _start long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_start")
    placed = ranged.join(F.broadcast(start), "_part").select(*columns, place.cast("long").alias("rank"))
    placed = placed.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return placed.unionByName(kept.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, per_cent: int = 5, least_words: int = 20, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document (doc_id, text), drawn towards the texts of `target` (text)."""
    gain = gains(histogram(docs, buckets, longest), histogram(target, buckets, longest))
    return drawn(weigh(docs, gain, longest), per_cent, least_words).select("doc_id", "n_features", "weight", "score", "rank")
