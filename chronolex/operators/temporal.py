"""Dated search and term-by-year curves."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import FIRST_YEAR, YEARS


def date_counts(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, year, tf): counts of documents of valid year summed; sparse."""
    years = docs.where("year is not null").select("doc_id", "year")
    return counts.join(years, "doc_id").groupBy("term", "year").agg(F.sum("tf").alias("tf")).where("tf > 0")


def search(counts: DataFrame, term: str) -> DataFrame:
    """(doc_id, tf) of one term. More than one word has no defined meaning and raises."""
    if len(term.split()) != 1:
        raise ValueError("a count query is one word")
    return counts.where(F.col("term") == term.lower()).select("doc_id", "tf")


def date_search(counts: DataFrame, docs: DataFrame, term: str) -> DataFrame:
    """(doc_id, year, tf) of hits with a valid year."""
    return search(counts, term).join(docs.where("year is not null").select("doc_id", "year"), "doc_id").select("doc_id", "year", "tf")


def by_year(hits: DataFrame) -> DataFrame:
    return hits.groupBy("year").agg(F.count("*").alias("documents"), F.sum("tf").alias("tf"))


def docs_of_year(docs: DataFrame, year: int) -> DataFrame:
    return docs.where(F.col("year") == year).select("doc_id", "year")


def dense(curves: DataFrame, first: int = FIRST_YEAR, years: int = YEARS) -> DataFrame:
    """(term, curve): zero-filled array of the year domain."""
    maps = curves.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("year", F.col("tf").cast("long")))).alias("m"))
    spine = F.sequence(F.lit(first), F.lit(first + years - 1))
    return maps.select("term", F.transform(spine, lambda y: F.coalesce(F.try_element_at("m", y), F.lit(0).cast("long"))).alias("curve"))


def curve_of(curves: DataFrame, term: str, first: int = FIRST_YEAR, years: int = YEARS) -> list[int]:
    """One term's dense curve on the driver: as many numbers as there are years."""
    found = {r["year"]: int(r["tf"]) for r in curves.where(F.col("term") == term).groupBy("year").agg(F.sum("tf").alias("tf")).collect()}
    return [found.get(first + i, 0) for i in range(years)]


def probabilities(curves: DataFrame) -> DataFrame:
    """(term, year, p): share of the year's words; years without words give no rows."""
    totals = curves.groupBy("year").agg(F.sum("tf").alias("total")).where("total > 0")
    return curves.join(F.broadcast(totals), "year").select("term", "year", (F.col("tf") / F.col("total")).alias("p"))


def scatter(spark: SparkSession, weights: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, year, tf): each year's weight spread over its documents, truncated, zeros left out. weights: (year, weight)."""
    dated = docs.where("year is not null").select("doc_id", "year")
    sizes = dated.groupBy("year").agg(F.count("*").alias("n"))
    shares = weights.join(sizes, "year").select("year", F.floor(F.col("weight") / F.col("n")).cast("long").alias("tf")).where("tf > 0")
    return dated.join(F.broadcast(shares), "year").select("doc_id", "year", "tf")


def step_function(spark: SparkSession, start: int, weight: int = 150, first: int = FIRST_YEAR, years: int = YEARS) -> DataFrame:
    """(year, weight): weight from the start year on, else 0."""
    year = F.col("id").cast("int")
    return spark.range(first, first + years).select(year.alias("year"), F.when(year >= start, weight).otherwise(0).cast("long").alias("weight"))


def parse_query(query: str, first: int = FIRST_YEAR, years: int = YEARS) -> tuple[str, int | str]:
    """('step', year) for $YYYY within the domain, else ('term', text)."""
    m = re.fullmatch(r"\$(\d{4})", query.strip())
    if m and first <= int(m[1]) < first + years:
        return "step", int(m[1])
    return "term", query.strip().lower()


def curves_csv(curves: DataFrame, terms: list[str]) -> DataFrame:
    """One row for each queried term: the term and a column for each year."""
    return in_columns(curves.where(F.col("term").isin(terms)), "Document")


def in_columns(curves: DataFrame, first: str, value: str = "tf", kind: str = "long", *keys: str) -> DataFrame:
    """One row for each term (and further keys): the term under the name `first`, and a column of values for each year, 0 where there is none."""
    rows = curves.groupBy("term", *keys).agg(F.map_from_entries(F.collect_list(F.struct("year", F.col(value).cast(kind)))).alias("m"))
    years = (F.coalesce(F.try_element_at("m", F.lit(y)), F.lit(0).cast(kind)).alias(str(y)) for y in range(FIRST_YEAR, FIRST_YEAR + YEARS))
    return rows.select(F.col("term").alias(first), *keys, *years)
