"""Kernels on curves: dense arrays as column expressions, dynamic programmes as NumPy batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """Null if either curve is zero everywhere."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def squared(a: Column, b: Column) -> Column:
    """-ln of the squared distance; infinite for equal curves."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(d == 0, F.lit(float("inf"))).otherwise(0.0 - F.ln(d))


def jensen_shannon(a: Column, b: Column, variant: str = "reference") -> Column:
    """Divergence of two curves; 'reference' takes p + q/2 as the middle, 'standard' (p + q)/2. Null for a zero curve."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)

    def middle(p: Column, q: Column) -> Column:
        return p + q / 2 if variant == "reference" else (p + q) / 2

    return 0.5 * F.aggregate(F.zip_with(_shares(a), _shares(b), lambda x, y: part(x, middle(x, y)) + part(y, middle(x, y))), F.lit(0.0), lambda s, x: s + x)


def _shares(v: Column) -> Column:
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), total(v)))


def earth_mover(a: Column, b: Column) -> Column:
    """Minus the summed differences of the running totals, not normalised."""
    state = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(s: Column, d: Column) -> Column:
        return F.struct((s["run"] + d).alias("run"), (s["sum"] + F.abs(s["run"] + d)).alias("sum"))

    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double")), state, step, lambda s: 0.0 - s["sum"])


def moving_average(a: Column, width: int = 5) -> Column:
    """Truncated means of every full window."""
    at = F.sequence(F.lit(0), F.size(a) - width, F.lit(1))
    mean = F.transform(at, lambda i: F.floor(F.aggregate(F.slice(a, i + 1, width), F.lit(0).cast("long"), lambda s, x: s + x) / width).cast("long"))
    return F.when(F.size(a) >= width, mean).otherwise(F.array().cast("array<bigint>"))


def median(a: Column, variant: str = "reference") -> Column:
    """'reference': the mean of the two middle values is truncated."""
    s, n = F.array_sort(a), F.size(a)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.floor((low + high) / 2).cast("long") if variant == "reference" else (low + high) / 2


def max_index(a: Column) -> Column:
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def min_index(a: Column) -> Column:
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def dtw(query: np.ndarray, curves: np.ndarray, band: int = 10) -> np.ndarray:
    """Dynamic time warping distance of every row of `curves` to `query`, cells within the band only."""
    n, m = curves.shape[1], len(query)
    band = max(band, abs(n - m))
    before = np.full((len(curves), m + 2), np.inf)
    before[:, 0] = 0
    for i in range(1, n + 1):
        row = np.full((len(curves), m + 2), np.inf)
        for j in range(max(1, i - band), min(m, i + band) + 1):
            cost = np.abs(curves[:, i - 1] - query[j - 1])
            row[:, j] = cost + np.minimum(np.minimum(before[:, j], row[:, j - 1]), before[:, j - 1])
        before = row
    return before[:, m]


def carry_warp(state: np.ndarray, rows: np.ndarray, window: np.ndarray, start: int, band: int = 10) -> np.ndarray:
    """Banded warping costs after row `start`, carried over further rows of two curves of one length.

    Place k of a state is column i + k - band in row i. `rows` are the row curves' values
    from place `start` on; `window` the column curve's from start - band on, and to band
    places beyond the last row, zero outside the axis.
    """
    width = 2 * band + 1
    for r in range(rows.shape[1]):
        above = state.copy()
        np.minimum(state[:, :-1], state[:, 1:], out=above[:, :-1])
        cost = np.abs(rows[:, r : r + 1] - window[r : r + width])
        outside = band - start - r
        if outside > 0:
            above[:, :outside] = np.inf
        upto = np.cumsum(cost, axis=1)
        state = upto + np.minimum.accumulate(above - (upto - cost), axis=1)
    return state


def first_warp(curves: int, band: int = 10) -> np.ndarray:
    """The states before the first row."""
    state = np.full((curves, 2 * band + 1), np.inf)
    state[:, band] = 0
    return state


def with_dtw(frame: DataFrame, query: list[int], column: str = "curve", band: int = 10, name: str = "score") -> DataFrame:
    """`frame` with minus the warping distance of its dense curves to the query's."""
    reference = np.array(query, np.float64)
    names = frame.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                curves = part.column(names.index(column))
                matrix = np.asarray(curves.flatten(), np.float64).reshape(len(curves), -1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(0.0 - dtw(reference, matrix, band))], [*names, name])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in frame.dtypes), f"{name} double"])
    return frame.mapInArrow(scored, schema)


def lcs(a: list, b: list, limit: int | None = 2000) -> int:
    """Length of the longest common subsequence of the first `limit` items (None: of all), by bit-parallel dynamic programming."""
    a, b = a[:limit], b[:limit]
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _lcs_shares(limit: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 1024):
                sides = [c.slice(at, 1024) for c in batch.columns[-2:]]
                many = len(sides[0])
                # Words become numbers for many pairs at once, which costs a fraction of a Python string for each.
                words = pa.concat_arrays([s.flatten() for s in sides]).dictionary_encode().indices.to_numpy()
                upto = np.cumsum(np.concatenate([[0], *(s.value_lengths().to_numpy() for s in sides)])).tolist()
                for i in range(many):
                    a, b = (words[upto[k] : upto[k + 1]].tolist() for k in (i, many + i))
                    common = set(a) & set(b)
                    x, y = [w for w in a if w in common][:limit], [w for w in b if w in common][:limit]
                    least = min(len(x), len(y))
                    out.append(lcs(x, y, None) / least if least else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.float64())], [*batch.schema.names[:-2], "share"])

    return run


def with_lcs(pairs: DataFrame, limit: int | None = 2000) -> DataFrame:
    """`pairs`, whose last two columns are word arrays, with these replaced by `share`: common subsequence over the shorter, both reduced to common words, of which the first `limit` count (None: all)."""
    keep = pairs.dtypes[:-2]
    return pairs.mapInArrow(_lcs_shares(limit), ", ".join([*(f"`{n}` {t}" for n, t in keep), "share double"]))
