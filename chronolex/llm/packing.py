"""Best-two-fit packing of tokenised documents into sequences of fixed capacity.

Greedy fill, then improvement: the bin's smallest document is replaced by two
unpacked documents that fit its expanded gap more tightly. Bins depend on lengths
only, so the packing is computed on the histogram of lengths (at most `capacity`
entries, whatever the number of documents): equal bins are one template with a
multiplicity. Documents of a length are numbered in a distributed way and the
numbers select the template's slots. The result equals packing bin by bin.

Cases: null text is an empty text (one end id). Repeated rows are packed one by one.
A document longer than the capacity is cut so that only its first piece is shorter.
An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored
from .tokens import CACHE_ENTRIES, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_two_fit(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Templates (lengths in a bin, number of such bins) that use every item of the histogram once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} outside 1..{capacity}")
        left[length] = n
    index = np.arange(capacity + 1)
    templates: list[tuple[list[int], int]] = []
    largest = capacity
    while True:
        while largest and not left[largest]:
            largest -= 1
        if not largest:
            return templates
        free = left.copy()  # what is unpacked beside this bin
        free[largest] -= 1
        chosen, gap = [largest], capacity - largest
        while gap:
            fits = np.flatnonzero(free[1 : gap + 1])
            if not len(fits):
                break
            item = int(fits[-1]) + 1
            free[item] -= 1
            chosen.append(item)
            gap -= item
        while gap:
            smallest, room = min(chosen), gap + min(chosen)
            below = np.maximum.accumulate(np.where(free[: room + 1] > 0, index[: room + 1], 0))
            first = np.flatnonzero(free[1:room]) + 1
            if not len(first):
                break
            second = below[room - first]
            same = (second == first) & (free[first] < 2)
            second = np.where(same, below[np.maximum(first - 1, 0)], second)
            total = np.where(second > 0, first + second, 0)
            best = int(np.argmax(total))
            if total[best] <= smallest:
                break
            chosen.remove(smallest)
            free[smallest] += 1
            for item in (int(first[best]), int(second[best])):
                chosen.append(item)
                free[item] -= 1
            gap = room - int(total[best])
        lengths, uses = np.unique(chosen, return_counts=True)
        times = int((left[lengths] // uses).min())
        left[lengths] -= uses * times
        templates.append((sorted(chosen, reverse=True), times))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, slice_bytes: int = 1 << 20, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path, cache_entries), np.array([end_id], "<u4").tobytes()
        for part in slices(batches, "text", slice_bytes):
            rows = []
            for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                a, piece = 0, 0
                while a < n:
                    b = a + (n % capacity or capacity) if piece == 0 else a + capacity
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                    a, piece = b, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def place(items: DataFrame, capacity: int, rows_per_part: int = 4_000) -> DataFrame:
    """Give every row of `items` (with an integer column `length` up to the capacity) sequence_id and offset.

    `items` is read several times: pass a stored table. Its other columns order equal lengths.
    """
    spark = items.sparkSession
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not histogram:
        return items.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    templates = best_two_fit(histogram, capacity)

    # For each length: up to which number of its documents a template serves, and where their slots are.
    taken: dict[int, int] = {}
    sequence = 0
    ends, ids, firsts, uses, offsets = [], [], [], [], []
    for lengths, times in templates:
        at = 0
        by: dict[int, list[int]] = {}
        for length in lengths:
            by.setdefault(length, []).append(at)
            at += length
        for length, where in by.items():
            taken[length] = taken.get(length, 0) + times * len(where)
            ends.append((length, taken[length]))
            ids.append(sequence)
            firsts.append(taken[length] - times * len(where))
            uses.append(len(where))
            offsets.append(where[0])
        sequence += times
    base = np.zeros(capacity + 2, np.int64)  # documents of shorter lengths
    for length, n in histogram.items():
        base[length + 1] = n
    base = np.cumsum(base)
    key = np.array([base[length] + end for length, end in ends], np.int64)
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast((base, key[order], *(np.array(x, np.int64)[order] for x in (ids, firsts, uses, offsets))))

    parts = max(1, min(1 << 16, sum(histogram.values()) // rows_per_part))
    keyed = items.withColumn("_part", F.pmod(F.xxhash64(*items.columns), F.lit(parts)).cast("int"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("length", "_part").agg(F.count("*").alias("_n")).select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_part").orderBy(*items.columns)
    numbered = keyed.withColumn("_rank", F.row_number().over(within) - 1).join(counts, ["length", "_part"])
    numbered = numbered.select(*items.columns, (F.col("_rank") + F.col("_before")).alias("_number"))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, key, ids, firsts, uses, offsets = shared.value
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            number = batch.column(batch.schema.get_field_index("_number")).to_numpy()
            run = np.searchsorted(key, base[length] + number, side="right")
            inside = number - firsts[run]
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "_number"}
            columns["sequence_id"] = pa.array(ids[run] + inside // uses[run], pa.int64())
            columns["offset"] = pa.array(offsets[run] + inside % uses[run] * length, pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    schema = ", ".join(f"`{n}` {t}" for n, t in items.dtypes) + ", sequence_id long, offset long"
    return numbered.mapInArrow(slots, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Tokenise, cut and pack documents; a row for each piece. `cache_entries` words are kept in each of a worker's two caches."""
    return place(stored(pieces(docs, tokenizer_path, capacity, end_id, cache_entries=cache_entries), "pieces"), capacity)
