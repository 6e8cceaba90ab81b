"""Corpus lists: census counters, samples, per-year lists, descriptive statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.text import book_path, census_year


def census(books: DataFrame) -> DataFrame:
    """One row of counters over (id, identifier, language, year, date, exists): books are those whose metadata and book exist,
    the others count as nonexistent alone."""
    there = F.coalesce("exists", F.lit(False))
    language = F.lower(F.trim("language"))
    blank = language.isNull() | (language == "")
    c = lambda x, n: F.count_if(x).alias(n)
    return books.agg(
        c(there, "books"),
        c(~there, "nonexistent"),
        c(there & ~F.col("identifier").eqNullSafe(F.col("id")), "bad_metadata"),
        c(there & blank, "no_language"),
        c(there & ~blank & ~language.startswith("eng"), "non_english"),
        c(there & census_year(F.col("year"), F.col("date")).isNull(), "no_date"),
    )


def dated_books(books: DataFrame) -> DataFrame:
    """(id, path, year): the census's lines, of books that exist and have a year; from (id, path, year, date, exists), `path` being that of the metadata."""
    found = books.where(F.coalesce("exists", F.lit(False))).select("id", book_path(F.col("path")).alias("path"), census_year(F.col("year"), F.col("date")).alias("year"))
    return found.where(F.col("path").isNotNull() & F.col("year").isNotNull())


def date_lists(lists: DataFrame, out: str, first: int = 1820, last: int = 1920) -> None:
    """Write a list of paths for each year of (path, year), both ends included. A large year's list is several files of one folder, in order of the paths."""
    dated = lists.where(F.col("year").between(first, last)).select(F.col("path").alias("value"), "year")
    dated.repartitionByRange("year", "value").sortWithinPartitions("year", "value").write.mode("overwrite").partitionBy("year").text(out)


def sample_list(lines: DataFrame, n: int, seed: int = 13, column: str = "path") -> DataFrame:
    """n lines in a seeded hash order."""
    return lines.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(column))), column).limit(n)


def shard(lines: DataFrame, node: int, nodes: int) -> DataFrame:
    """Lines (ord) of one of `nodes` workers, in turn."""
    if not 0 <= node < nodes:
        raise ValueError("node outside 0..nodes-1")
    return lines.where(F.col("ord") % nodes == node)


def statistics(curves: DataFrame, base: int = 0) -> DataFrame:
    """For each (term, curve): sum, mean, population variance, truncated median, positions of the extremes from `base`."""
    c = F.col("curve")
    n, s = F.size(c), kernels.total(c)
    mean = s / n
    variance = F.aggregate(c, F.lit(0.0), lambda t, x: t + (x - mean) * (x - mean)) / n
    return curves.select(
        "term", s.cast("long").alias("total"), F.round(mean, 6).alias("mean"), F.round(variance, 6).alias("variance"), kernels.median(c).alias("median"),
        F.array_max(c).alias("most"), F.array_min(c).alias("least"), (kernels.max_index(c) + base).alias("most_at"), (kernels.min_index(c) + base).alias("least_at"),
    )
