"""Shared plumbing of the training-data operators: tables, shared scratch, Arrow text buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column name as an expression reads it."""
    return "`" + name.replace("`", "``") + "`"


def columns_of(df: DataFrame) -> list[str]:
    """All columns of a frame, quoted for select."""
    return [quoted(c) for c in df.columns]


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores behind it as make it new among `taken` (whatever the case of letters)."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the data directory (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the cluster's shared checkpoint folder.

    The folder comes from spark.checkpoint.dir. Only where that is unset and the master is
    local (tests on one machine) is a temporary folder made and recorded in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="chronolex-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage, computes once."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_remainder(column: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus` (null ids count as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit(""))) % modulus


def sample_fraction(total: int, bound: int) -> float:
    """Share of rows to keep so that about `bound` of `total` remain."""
    return 1.0 if total <= bound else bound / total


def hash_share(seed: int, *columns: str | Column) -> Column:
    """A repeatable number in [0, 1) from columns' values."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def least_by_hash(rows: DataFrame, bound: int, seed: int, *columns: str) -> DataFrame:
    """`bound` rows at most, those of the least hash of `columns`, in that order: a repeatable sample
    that no frequent value of one column can enlarge."""
    share = min(1.0, 2 * sample_fraction(rows.count(), bound) + 1e-6)
    some = rows.where(hash_share(seed, *columns) < share) if share < 1 else rows
    return some.orderBy(F.xxhash64(*columns, F.lit(seed)), *columns).limit(bound)


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column, nulls as empty; offsets has one entry more than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    bounds = np.frombuffer(offsets, np.int64, count=n + 1, offset=column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each part holds about `limit` bytes of text (a single longer row stays whole)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, bounds = utf8_buffers(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < n:
            end = int(np.searchsorted(bounds, bounds[start] + limit, side="right")) - 1
            end = min(n, max(end, start + 1))
            yield batch.slice(start, end - start)
            start = end
