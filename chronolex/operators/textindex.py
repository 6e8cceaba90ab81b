"""Word counts by slot (year), thresholds, and lookups on the resulting table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .similarity import best
from .temporal import probabilities


def create(counts: DataFrame, threshold: int = 600) -> DataFrame:
    """(term, year, tf) of the words whose largest count in any slot is above the threshold. One aggregation replaces sorting and merging of slots."""
    summed = counts.groupBy("term", "year").agg(F.sum("tf").alias("tf"))
    keep = summed.groupBy("term").agg(F.max("tf").alias("most")).where(F.col("most") > threshold)
    return summed.join(keep.select("term"), "term")


def exact(curves: DataFrame, queries: list[str]) -> tuple[DataFrame, DataFrame]:
    """((term, year, p, ord) of the queried terms, as they are written; queries without a row). p is a word's share of all words of the index in that year."""
    asked = curves.sparkSession.createDataFrame(list(enumerate(queries)), "ord int, term string")
    found = probabilities(curves).join(F.broadcast(asked), "term")  # one row a query
    return found, asked.join(curves.select("term").join(F.broadcast(asked.select("term")), "term", "left_semi").distinct(), "term", "left_anti")


#: Characters of a run; queries shorter than that which are broadcast (there are few such strings).
GRAM, SHORT = 3, 100_000


def grams(text: Column) -> Column:
    """The distinct runs of `GRAM` characters of a text; all of a shorter text."""
    n = F.length(text)
    runs = F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda i: F.substring(text, i, F.lit(GRAM)))
    return F.array_distinct(F.when(n < GRAM, F.array(text)).otherwise(runs))


def containing(terms: DataFrame, queries: DataFrame) -> DataFrame:
    """(term, ord): the terms (term) that contain a query's (ord, q) lower-case form, once for each query they contain.

    Terms and queries meet by runs of three characters: a query by the one that fewest terms have, so most that meet do contain it, and
    each is verified. A query of one or two characters meets the terms by the runs that contain it. Any number of queries is one plan.
    An empty query is in every term.
    """
    asked = queries.select("ord", F.lower("q").alias("q")).where("q is not null")
    listed = terms.select("term", F.explode(grams(F.col("term"))).alias("gram"))
    frequency = listed.groupBy("gram").agg(F.count("*").alias("n"))
    wanted = asked.where(F.length("q") >= GRAM).select("ord", "q", F.explode(grams(F.col("q"))).alias("gram"))
    # A run that no term has rules its query out: counted as none, it is the rarest.
    rare = wanted.join(frequency, "gram", "left").groupBy("ord", "q").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram").alias("g"))).alias("gram"))
    long = listed.join(rare, "gram").where(F.contains("term", F.col("q"))).select("term", "ord")
    short = asked.where(F.length("q") < GRAM)
    runs = frequency.join(F.broadcast(short.limit(SHORT)) if short.count() <= SHORT else short, F.contains("gram", F.col("q"))).select("gram", "ord")  # runs, not terms, against short queries
    return long.unionByName(listed.join(runs, "gram").select("term", "ord").distinct())


def matching(curves: DataFrame, queries: list[str] | DataFrame) -> DataFrame:
    """(term, year, p, ord) of the terms that contain a query's lower-case form, once for each query they contain; queries are a list or a table (ord, q)."""
    spark = curves.sparkSession
    asked = queries if isinstance(queries, DataFrame) else spark.createDataFrame(list(enumerate(queries)), "ord int, q string")
    return probabilities(curves).join(containing(curves.select("term").distinct(), asked), "term").select("term", "year", "p", "ord")


def find_similar(curves: DataFrame, term: str, method: str = "cos", k: int = 10) -> DataFrame:
    """(rank, term, score): all terms ranked by the cosine of their yearly shares with the query's ('cos'), or by 1 - cosine
    ('cos-diff', the least alike first). The query is taken as written; an unknown one gives no rows."""
    if method not in ("cos", "cos-diff"):
        raise ValueError(f"unknown method {method}")
    shares = probabilities(curves)
    mine = {r["year"]: r["p"] for r in shares.where(F.col("term") == term).collect()}  # a row a year
    q = F.broadcast(curves.sparkSession.createDataFrame(list(mine.items()), "year int, q double"))
    sums = shares.join(q, "year", "left").groupBy("term").agg(F.sum(F.col("p") * F.col("p")).alias("n"), F.sum(F.col("p") * F.coalesce("q", F.lit(0.0))).alias("dot"))
    cosine = F.col("dot") / (F.sqrt(F.lit(sum(x * x for x in mine.values()))) * F.sqrt("n"))
    scored = sums.where("n > 0").select("term", (cosine if method == "cos" else 1 - cosine).alias("score"))
    return best(scored if mine else scored.limit(0), k)
