"""Exact top-k inner-product search by distributed histogram selection.

Every query is scored against every vector. Each round counts, for each query, the
scores in equal bins of the range that still may hold its k-th value; the bin of the
k-th value is the next round's range, until a bin is one integer. A last pass keeps
what lies above the k-th value and, of the rows equal to it, the smallest ids. A task
only reports the bins that hold its own k largest scores: the k-th value of all is no
smaller than that of any part, so lower bins cannot hold it. What is reported thus
depends on k, the queries and the number of tasks, not on the number of vectors.

Queries are taken in blocks of bounded size, each broadcast to a full parallel pass;
neither scores nor vectors are shuffled. A block's rows are stored before the next one
begins, so the result is one table however many blocks there are.

Cases: vectors that are null or hold null or non-finite components take no part, neither
do rows without id. A vector is compared with those of its own length only. Fewer
candidates than k: all of them. Ties go to the smaller vec_id; a repeated id is a
candidate for each row, and rows of the query's own id are no candidates. Rows of one id
and vector are one query; different vectors of one id are a query each, under the same
query_id. Where an inner product could leave 64 bits (by the vectors' norms), an error is
raised. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

FOUND = "query_id long, rank int, vec_id long, score long"
BINS, QUERY_BLOCK, CELLS = 4096, 2048, 1 << 22


def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and the vector as floor(scale * x) long, without the rows that take no part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    floats = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", v.alias("v")).where(usable)
    return floats.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), width)


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in floating point only where every partial sum is exact."""
    if len(vectors) and queries.shape[1] * float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) < 2**53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


def top_k(rows: DataFrame, k: int = 5, every: int = 50, scale: int = 256, bins: int = BINS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query (rows whose vec_id is divisible by `every`)."""
    spark = rows.sparkSession
    vectors = integer_vectors(rows, scale).where(F.size("v") > 0)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    is_query = F.col("vec_id") % every == 0
    lengths = vectors.groupBy(F.size("v").alias("width")).agg(F.max(norm).alias("reach"), F.count_if(is_query).alias("queries")).where("queries > 0").orderBy("width").collect()
    folder, found = scratch(spark, "top-k"), False
    for width, reach, edges in lengths:  # one, unless vectors differ in length
        alike = vectors.where(F.size("v") == width)
        blocks = max(1, -(-edges // query_block))
        block_of = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
        for b in range(blocks):
            block = alike.where(is_query & (block_of == b)).distinct().orderBy("vec_id", "v").collect()  # about query_block rows
            if block:
                ids = np.array([r["vec_id"] for r in block], np.int64)
                _block(alike, ids, np.array([r["v"] for r in block], np.int64), width, float(np.sqrt(reach)), k, bins).write.mode("append").parquet(folder)
                found = True
    return spark.read.schema(FOUND).parquet(folder) if found else spark.createDataFrame([], FOUND)


def _block(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, width: int, longest: float, k: int, bins: int) -> DataFrame:
    spark = vectors.sparkSession
    n = len(ids)
    norms = np.sqrt((queries.astype(np.float64) ** 2).sum(1)) * longest
    if norms.max() >= 2**63 * (1 - 1e-9):
        raise ValueError(f"inner products may reach {norms.max():.3g}, beyond 64 bits; use a smaller scale")
    reach = [min(int(x * (1 + 1e-12)) + 1, 2**63 - 2) for x in norms]
    # Values from low to low + span - 1; differences of 64-bit integers are taken without sign.
    low, span = np.array([-x for x in reach], np.int64), np.array([2 * x + 1 for x in reach], np.uint64)
    step, want = np.array([(2 * x + 1) // bins + 1 for x in reach], np.uint64), np.full(n, k, np.int64)
    floor = np.full(n, np.iinfo(np.int64).min)
    held = spark.sparkContext.broadcast((ids, queries))

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(vec ids, scores [query, row]) with the query's own rows at the least value."""
        own, q = held.value
        for batch in batches:
            for a in range(0, batch.num_rows, max(1, CELLS // n)):
                part = batch.slice(a, max(1, CELLS // n))
                vec = part.column(0).to_numpy()
                s = _scores(q, _matrix(part.column(1), width))
                s[own[:, None] == vec[None, :]] = np.iinfo(np.int64).min
                yield vec, s

    open_ = np.ones(n, bool)
    while open_.any():
        state = spark.sparkContext.broadcast((low, span, step, want))

        def count(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            low, span, step, want = state.value
            seen = np.zeros((n, bins), np.int64)
            for _, s in passes(batches):
                above_low = s.view(np.uint64) - low.view(np.uint64)[:, None]
                inside = (s >= low[:, None]) & (above_low < span[:, None])
                query, _ = np.nonzero(inside)
                bin_ = (above_low // step[:, None])[inside].astype(np.int64)
                seen += np.bincount(query * bins + bin_, minlength=n * bins).reshape(n, bins)
            above = np.cumsum(seen[:, ::-1], 1)[:, ::-1] - seen  # in higher bins of this part
            query, bin_ = np.nonzero((seen > 0) & (above < want[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(bin_, pa.int32()), pa.array(seen[query, bin_])], ["query", "bin", "n"])

        histogram = vectors.mapInArrow(count, "query int, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
        over = Window.partitionBy("query").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        wanted = spark.createDataFrame([(i, int(w)) for i, w in enumerate(want)], "query int, want long")
        reached = histogram.withColumn("upto", F.sum("n").over(over)).join(F.broadcast(wanted), "query").where("upto >= want and upto - n < want")
        found = {r["query"]: r for r in reached.collect()}  # a row for each query of the block
        low, span, step, want = low.copy(), span.copy(), step.copy(), want.copy()
        for i in range(n):
            if not open_[i]:
                continue
            if i not in found:  # fewer than k candidates: all of them
                open_[i], floor[i] = False, np.iinfo(np.int64).min + 1
                step[i], want[i] = 1, 0
                continue
            r = found[i]
            want[i] -= r["upto"] - r["n"]
            low[i] = int(low[i]) + r["bin"] * int(step[i])
            span[i] = step[i]
            if step[i] == 1:
                open_[i], floor[i] = False, low[i]
                want[i] = 0
            else:
                step[i] = -(-int(step[i]) // bins)

    final = spark.sparkContext.broadcast(floor)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = final.value
        best: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for vec, s in passes(batches):
            query, row = np.nonzero(s >= floor[:, None])
            order = np.lexsort((vec[row], -s[query, row], query))
            query, row = query[order], row[order]
            first = np.searchsorted(query, np.arange(n))
            place = np.arange(len(query)) - first[query]
            for q, r in zip(query[place < k].tolist(), row[place < k].tolist(), strict=True):
                best[q].append((-int(s[q, r]), int(vec[r])))
            for q in set(query[place < k].tolist()):
                best[q] = sorted(best[q])[:k]
        rows = [(q, v, -s) for q, found in enumerate(best) for s, v in sorted(found)[:k]]
        own = held.value[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array([q for q, *_ in rows], pa.int32()), pa.array([int(own[q]) for q, *_ in rows], pa.int64()), pa.array([v for _, v, _ in rows], pa.int64()), pa.array([s for *_, s in rows], pa.int64())],
            ["query", "query_id", "vec_id", "score"],
        )

    kept = vectors.mapInArrow(keep, "query int, query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
