"""Two-pass k-means on curves with evenly spaced seeds.

The first pass of the reference semantics goes row by row: a row joins the nearest seed
among clusters of more than n/k rows if there are any, else among all. So rows are free
until some cluster first exceeds n/k, and from then on all rows join that one cluster:
the first pass is a free assignment and one order statistic, both distributed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import dot
from ..plans.storage import stored
from .index import ranked


def distance(a: Column, b: Column) -> Column:
    """1 - cosine; 0 if either is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(1.0 - F.try_divide(dot(a, b), norm))


def nearest(vec: Column, centres: list[list[float]], among: list[int] | None = None) -> Column:
    """Index of the nearest centre, the lower one if tied, of all or of some."""
    chosen = range(len(centres)) if among is None else among
    table = F.from_json(F.lit(json.dumps([{"i": i, "c": centres[i]} for i in chosen])), "array<struct<i:int,c:array<double>>>")
    return F.array_min(F.transform(table, lambda x: F.struct(distance(vec, x["c"]).alias("d"), x["i"].alias("cluster"))))["cluster"]


def centroids(assigned: DataFrame, k: int) -> list[list[float]]:
    """Componentwise sums; an empty cluster is zero. Bounded by k and the dimension."""
    sums = assigned.select("cluster", F.posexplode("vec").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("x").alias("x")).collect()
    width = max(r["pos"] for r in sums) + 1
    out = [[0.0] * width for _ in range(k)]
    for r in sums:
        out[r["cluster"]][r["pos"]] = float(r["x"])
    return out


def seeds(rows: DataFrame, n: int, k: int, block: int = 1) -> list[list[float]]:
    """Row i*(n//k), or the sum of a block of rows from there."""
    step = n // k
    wanted = rows.where(F.exists(F.array(*(F.lit(i * step) for i in range(k))), lambda s: F.col("row_idx").between(s, s + block - 1)))
    found = {r["row_idx"]: r["vec"] for r in wanted.select("row_idx", "vec").collect()}
    return [[float(sum(x)) for x in zip(*(found[i * step + j] for j in range(block) if i * step + j in found), strict=True)] for i in range(k)]


def k_means(rows: DataFrame, k: int, balanced: bool = False, block: int = 1, chunk: int = 1 << 16) -> DataFrame:
    """(row_idx, cluster) for (row_idx, vec), the rows taken in the order of row_idx. balanced=True: only clusters below n/k may grow in the first pass.

    A row_idx that is null or repeated, a vector that is null, holds nulls or differs in
    length, and k of n or more raise an error. An empty table gives no rows.
    """
    plain = rows.select(F.col("row_idx").cast("long").alias("row_idx"), F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    plain = stored(plain, "vectors")
    bad = F.col("row_idx").isNull() | F.col("vec").isNull() | F.exists("vec", lambda x: x.isNull())
    seen = plain.agg(F.count("*").alias("n"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"), F.count_distinct("row_idx").alias("ids"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most")).first()
    n = seen["n"]
    if not n:
        return plain.select("row_idx", F.lit(0).alias("cluster"))
    if seen["bad"] or seen["ids"] < n or seen["least"] != seen["most"]:
        raise ValueError("rows need distinct row_idx and vectors of one length without nulls")
    if not k < n:
        raise ValueError("k must be below the number of rows")
    places, _ = ranked(plain, "row_idx")
    numbered = stored(plain.withColumnRenamed("row_idx", "id").join(places.withColumnRenamed("row_idx", "id"), "id").select("id", F.col("at").alias("row_idx"), "vec"), "numbered")
    start = seeds(numbered, n, k, block)
    first = _first_pass(numbered, start, n // k, balanced, chunk)
    return numbered.select(F.col("id").alias("row_idx"), nearest(F.col("vec"), centroids(first, k)).alias("cluster"))


def _first_pass(rows: DataFrame, start: list[list[float]], size: int, balanced: bool, chunk: int) -> DataFrame:
    """Rows with the cluster they join, one after the other: as a free choice up to the row with which a cluster's size
    closes others (or itself, if balanced), and so on from there; each round is distributed."""
    open_ = list(range(len(start)))
    assigned = stored(rows.select("row_idx", "vec", nearest(F.col("vec"), start).alias("cluster")), "free")
    if not balanced:
        over = _first_over(assigned, size, chunk)
        return assigned if over is None else assigned.withColumn("cluster", F.when(F.col("row_idx") > over[0], over[1]).otherwise(F.col("cluster")))
    while open_ and (full := _first_over(assigned.where(F.col("cluster").isin(open_)), size - 1, chunk)):
        open_.remove(full[1])
        again = nearest(F.col("vec"), start, open_ or None)
        assigned = stored(assigned.withColumn("cluster", F.when(F.col("row_idx") > full[0], again).otherwise(F.col("cluster"))), "free")
    return assigned


def _first_over(free: DataFrame, size: int, chunk: int) -> tuple[int, int] | None:
    """(row, cluster) with which a cluster first holds more than `size` rows."""
    part = F.floor(F.col("row_idx") / chunk).cast("long")
    counts = free.groupBy("cluster", part.alias("part")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("cluster").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.withColumn("upto", F.sum("n").over(upto)).where((F.col("upto") > size) & (F.col("upto") - F.col("n") <= size))
    inside = free.withColumn("part", part).join(F.broadcast(reached), ["cluster", "part"])
    number = F.row_number().over(Window.partitionBy("cluster").orderBy("row_idx")) + F.col("upto") - F.col("n")
    hit = inside.withColumn("number", number).where(F.col("number") == size + 1).orderBy("row_idx").select("row_idx", "cluster").first()
    return (hit["row_idx"], hit["cluster"]) if hit else None
