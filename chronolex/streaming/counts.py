"""Incremental upkeep of count tables from a stream of documents.

The reference has no streams; this only keeps its batch tables current: each micro-batch
appends its postings, and readers sum them, so a restarted query repeats no batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.index import counts


def keep_counts(stream: DataFrame, out: str, checkpoint: str):
    """Start a query that writes each micro-batch's (term, doc_id, tf) to a folder of its own below `out`."""

    def write(batch: DataFrame, number: int) -> None:
        counts(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("term").agg(F.sum("tf").alias("tf"))
