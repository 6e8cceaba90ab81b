"""Approximate nearest neighbours with an inverted multi-index.

Each half of a vector is quantised by a codebook of its own, so K + K centroids give K * K
cells. A query meets cells in order of the summed distances of their two centroids, taken
from a heap of centroid pairs, until they hold `budget` vectors; the vectors of these cells
are ranked by their exact distances. The budget is not guessed: for a bounded sample of
queries the true neighbours are found by scoring all vectors, and the budget is what
reaches the wanted share of them. On data without near neighbours worth the name it
thus grows towards the whole table rather than lose neighbours.

Codebooks are fitted on at most `SAMPLE` vectors; all vectors are indexed. Equal vectors
are one entry, with as many of the smallest ids as a result can need, so copies cost
nothing. Entries are stored in shards of about `SHARD` of neighbouring cells; a larger cell
fills several. A query goes once to each shard that holds any of its cells, the queries
of a shard in blocks, so no task holds more than a shard and a block. The driver holds the
codebooks and the number of vectors in each cell: at most 1024 * 1024 numbers.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no
part, neither do rows without id. A vector is compared with those of its length only. Rows
equal in id and vector are one; different vectors of one id are a query each, under one
query_id, and no candidates for each other. Ties go to the smaller vec_id. Fewer
candidates than k: all of them that are met. An empty table gives no rows. Further columns
are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import least_by_hash, stored

#: Vectors that the codebooks are fitted on, centroids of a half, queries that set the budget: at most.
SAMPLE, CENTROIDS, TRIALS = 32_768, 1024, 200
#: Entries of a shard, queries that meet a shard in one row, shards up to which their loads are broadcast.
SHARD, QUERIES_AT_ONCE, BROADCAST_SHARDS = 512, 256, 500_000


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id long, v array<double>) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)


def entries(vectors: DataFrame, ids: int) -> DataFrame:
    """(v, h, ids): each distinct vector with its `ids` smallest ids; copies are cut down before they are shuffled."""
    distinct = vectors.withColumn("h", F.xxhash64("v")).select("h", "v", "vec_id").distinct()
    place = F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))
    few = distinct.withColumn("place", place).where(F.col("place") <= ids)
    return few.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), width)


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * (x @ centres.T), 0)


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([squared_distances(x[a : a + 4096], centres).argmin(1) for a in range(0, len(x), 4096)])
        sizes = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


@dataclass
class Codebooks:
    """Centroids of the first and of the second half."""

    first: np.ndarray
    second: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, k: int) -> Codebooks:
        half = x.shape[1] // 2
        return cls(k_means(x[:, :half], k), k_means(x[:, half:], k))

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return squared_distances(x[:, :half], self.first), squared_distances(x[:, half:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)


def traverse(a: np.ndarray, b: np.ndarray, counts: np.ndarray, budget: int) -> list[int]:
    """Cells of two halves' centroids in order of summed distance, until they hold `budget` entries; cells without entries are passed over."""
    by_a, by_b = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    da, db, k = a[by_a].tolist(), b[by_b].tolist(), len(b)
    heap, out, met = [(da[0] + db[0], 0, 0)], [], 0
    while heap and met < budget:
        _, i, j = heapq.heappop(heap)
        cell = by_a[i] * k + by_b[j]
        if counts[cell]:
            met += int(counts[cell])
            out.append(cell)
        # Each pair has one predecessor: (i, j - 1), or (i - 1, 0) in the first column.
        if j + 1 < k:
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(da):
            heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
    return out


def nearest(q: np.ndarray, own: int, v: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[float, int, int]]:
    """(distance, id, row) of the k nearest ids but the query's own, ties to the smaller id."""
    d = np.sqrt(((v - q) ** 2).sum(1))
    rows = np.flatnonzero(d <= np.partition(d, k)[k]) if len(d) > k + 1 else np.arange(len(d))
    return sorted((float(d[r]), i, int(r)) for r in rows for i in ids[r] if i != own)[:k]


def budget_for(index: DataFrame, queries: DataFrame, books: Codebooks, counts: np.ndarray, width: int, k: int, recall: float, trials: int = TRIALS) -> int:
    """Vectors that a query must meet so that `recall` of the true neighbours are among them, from a sample of queries scored against all vectors."""
    some = least_by_hash(queries.select("vec_id", "v"), trials, 5, "vec_id", "v").toArrow()
    if not some.num_rows:
        return 0
    own, q = some.column("vec_id").to_pylist(), matrix(some.column("v"), width)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[tuple[float, int, int]]] = [[] for _ in own]
        for batch in batches:
            v, ids, cells = matrix(batch.column(0), width), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for n, i in enumerate(own):
                found[n] = sorted([*found[n], *((d, x, cells[r]) for d, x, r in nearest(q[n], i, v, ids, k))])[:k]
        rows = [(n, *f) for n, each in enumerate(found) for f in each]
        columns = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.int64(), pa.int32()), strict=True)], ["n", "d", "vec_id", "cell"])

    place = F.row_number().over(Window.partitionBy("n").orderBy("d", "vec_id"))
    truth = index.select("v", "ids", "cell").mapInArrow(best, "n int, d double, vec_id long, cell int").withColumn("place", place).where(F.col("place") <= k).collect()  # k rows a trial
    a, b = books.distances(q)
    cells: list[set[int]] = [set() for _ in own]
    for r in truth:
        cells[r["n"]].add(r["cell"])
    depth = {}
    for n, mine in enumerate(cells):
        sums = (a[n][:, None] + b[n][None]).ravel()
        for cell in mine:
            depth[n, cell] = int(counts[sums <= sums[cell]].sum())
    depths = [depth[r["n"], r["cell"]] for r in truth]
    return int(np.quantile(depths, recall, method="higher")) if depths else 0


def shards(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first shard and number of shards of each cell, number of all): neighbouring cells share one up to `size` entries, a larger cell has its own."""
    first, many, shard, room = np.zeros(len(counts), np.int32), np.ones(len(counts), np.int32), -1, 0
    for cell in np.flatnonzero(counts).tolist():
        n = int(counts[cell])
        if n > size:
            first[cell], many[cell] = shard + 1, -(-n // size)
            shard, room = shard + int(many[cell]), 0
        else:
            if n > room:
                shard, room = shard + 1, size
            first[cell] = shard
            room -= n
    return first, many, shard + 1


def _search(vectors: DataFrame, queries: DataFrame, width: int, k: int, recall: float, budget: int | None, shard_rows: int, queries_at_once: int) -> DataFrame:
    spark = vectors.sparkSession
    distinct = stored(entries(vectors, k + 1), "vectors")
    total = distinct.count()
    centroids = max(1, min(CENTROIDS, math.isqrt(total) // 2))
    sample = least_by_hash(distinct.select("v", "h"), SAMPLE, 3, "h", "v").select("v").toArrow()
    books = Codebooks.fit(matrix(sample.column("v"), width), min(centroids, sample.num_rows))
    held = spark.sparkContext.broadcast(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held.value.cells(matrix(part.column(0), width)), pa.int32())], ["v", "h", "ids", "cell"])

    index = stored(distinct.select("v", "h", "ids").mapInArrow(coded, "v array<double>, h long, ids array<long>, cell int"), "coded")
    sizes = index.groupBy("cell").count().toArrow()  # a row for each cell
    counts = np.zeros(len(books.first) * len(books.second), np.int64)
    counts[sizes.column("cell").to_numpy()] = sizes.column("count").to_numpy()
    if budget is None:
        budget = budget_for(index, queries, books, counts, width, k, recall)
    first, many, n_shards = shards(counts, shard_rows)
    places = spark.sparkContext.broadcast((counts, first, many))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, first, many = places.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                a, b = held.value.distances(matrix(part.column(2), width))
                rows = []
                for r in range(part.num_rows):
                    to: dict[int, list[int]] = {}
                    for cell in traverse(a[r], b[r], counts, budget):
                        for block in range(many[cell]):
                            to.setdefault(int(first[cell]) + block, []).append(cell)
                    rows += [(r, shard, sorted(cells)) for shard, cells in to.items()]
                which = pa.array([r for r, *_ in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(which) for c in part.columns), pa.array([s for _, s, _ in rows], pa.int32()), pa.array([c for *_, c in rows], pa.list_(pa.int32()))], ["q", "query_id", "v", "shard", "cells"])

    def shelved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, many = places.value
        for batch in batches:
            cell = batch.column(2).to_numpy()
            block = batch.column(3).to_numpy().astype(np.uint64) % many[cell].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(first[cell] + block.astype(np.int32), pa.int32())], ["v", "ids", "cell", "shard"])

    shelf = index.select("v", "ids", "cell", "h").mapInArrow(shelved, "v array<double>, ids array<long>, cell int, shard int").groupBy("shard").agg(F.collect_list(F.struct("v", "ids", "cell")).alias("rows"))
    asked = stored(queries.select("q", "vec_id", "v").mapInArrow(dealt, "q long, query_id long, v array<double>, shard int, cells array<int>"), "asked")
    loads = asked.groupBy("shard").agg(F.ceil(F.count("*") / queries_at_once).alias("blocks"))
    loads = F.broadcast(loads) if n_shards <= BROADCAST_SHARDS else loads
    blocks = asked.join(loads, "shard").withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks"))).groupBy("shard", "block").agg(F.collect_list(F.struct("q", "query_id", "v", "cells")).alias("asked"))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows, asked in zip(batch.column(0), batch.column(1), strict=True):
                v, ids, cell = matrix(rows.values.field("v"), width), rows.values.field("ids").to_pylist(), rows.values.field("cell").to_numpy()
                fields = (asked.values.field(n) for n in ("q", "query_id", "cells"))
                for n, (q, own, cells) in enumerate(zip(*(f.to_pylist() for f in fields), strict=True)):
                    if not n:
                        asking = matrix(asked.values.field("v"), width)
                    met = np.flatnonzero(np.isin(cell, cells))
                    out += [(q, own, i, d) for d, i, _ in nearest(asking[n], own, v[met], [ids[m] for m in met], k)]
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["q", "query_id", "vec_id", "score"])

    found = shelf.join(blocks, "shard").select("rows", "asked").mapInArrow(ranked, "q long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(rows: DataFrame, k: int = 10, every: int = 100, recall: float = 0.95, budget: int | None = None, shard_rows: int = SHARD, queries_at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the k nearest found of every row whose vec_id is divisible by `every`.

    `recall` is the share of true neighbours that the budget is set for; `budget`, if given, is used as it is.
    """
    vectors = usable(rows)
    asking = vectors.where(F.col("vec_id") % every == 0).distinct().select(F.monotonically_increasing_id().alias("q"), "vec_id", "v")
    asking = stored(asking, "queries")
    parts = []
    for (width,) in sorted(asking.select(F.size("v")).distinct().collect()):  # one, unless vectors differ in length
        alike = F.size("v") == width
        parts.append(_search(vectors.where(alike), asking.where(alike), width, k, recall, budget, shard_rows, queries_at_once))
    out = parts[0] if parts else rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for p in parts[1:]:
        out = out.union(p)
    return out
