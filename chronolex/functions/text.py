"""Column functions on words, queries and metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST_YEAR, YEARS = 1820, 100

# The short English stop list that Apache Lucene publishes.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these",
    "they", "this", "to", "was", "will", "with",
)


def tokens(text: Column) -> Column:
    """ASCII words of a text, lower-case, in order: array<string>."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def normalised(word: Column) -> Column:
    """Index form of a word: lower-case letters and digits only; null if nothing is left."""
    kept = F.regexp_replace(F.lower(word), r"[^\p{L}\p{Nd}]", "")
    return F.when(kept != "", kept)


def filtered(word: Column) -> Column:
    """Text-pipeline form of a word, or null: ASCII letters only (two or more), or two or four digits. Tested before lower-casing."""
    return F.when(word.rlike("^([A-Za-z]{2,}|[0-9]{2}|[0-9]{4})$"), F.lower(word))


def filter_words(words: DataFrame, column: str, stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(term) of every word that passes `filtered` and is no stop word."""
    listed = words.sparkSession.createDataFrame([(w.lower(),) for w in stop], "term string")
    return words.select(filtered(F.col(column)).alias("term")).where("term is not null").join(F.broadcast(listed), "term", "left_anti")


def clean_query(query: Column) -> Column:
    """Without characters that are neither letters, digits nor white space; case stays."""
    return F.regexp_replace(query, r"[^\p{L}\p{Nd}\s]", "")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def retrieval_year(year: Column, date: Column, first: int = FIRST_YEAR, years: int = YEARS) -> Column:
    """Digits of year (of date only where year is null) as a year of the domain, else null."""
    number = _digits(F.coalesce(year, date)).try_cast("int")
    return F.when(number.between(first, first + years - 1), number)


def census_year(year: Column, date: Column) -> Column:
    """The first of year and date that has exactly four digits."""

    def four(v: Column) -> Column:
        return F.when(F.length(_digits(v)) == 4, _digits(v).cast("int"))

    return F.coalesce(four(year), four(date))


def book_path(meta_path: Column) -> Column:
    """Path of the book that belongs to a metadata file; null for other paths."""
    return F.when(meta_path.endswith("_meta.xml.bz2"), F.regexp_replace(meta_path, r"_meta\.xml\.bz2$", "_mbtei.xml.gz"))


def fraction(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def harmonic_mean(a: Column, b: Column) -> Column:
    return F.when(a + b == 0, 0.0).otherwise(F.try_divide(2.0 * a * b, a + b))


def hex_id(n: Column, width: int = 8) -> Column:
    return F.lower(F.lpad(F.hex(n), width, "0"))


def mebibytes(n: Column) -> Column:
    return F.shiftrightunsigned(n.cast("long"), 20)


def kibibytes(n: Column) -> Column:
    return F.shiftrightunsigned(n.cast("long"), 10)


def gibibytes(n: Column) -> Column:
    return F.shiftrightunsigned(n.cast("long"), 30)


def string_hash(word: Column) -> Column:
    """The 31-polynomial 32-bit hash of a word's UTF-16 units, as the JVM has it."""
    add = lambda h, unit: (h * 31 + unit).bitwiseAND(F.lit(0xFFFFFFFF))
    zero = F.lit(0).cast("long")
    plain = F.aggregate(F.filter(F.split(word, ""), lambda c: c != ""), zero, lambda h, c: add(h, F.ascii(c)))
    units = F.hex(F.encode(word, "UTF-16BE"))
    at = F.filter(F.sequence(F.lit(0), F.length(units) - 1, F.lit(4)), lambda i: i < F.length(units))
    wide = F.aggregate(at, zero, lambda h, i: add(h, F.conv(F.substring(units, i + 1, F.lit(4)), 16, 10).cast("long")))
    total = F.when(word.rlike(r"^[\x00-\x7F]+$"), plain).when(word == "", zero).otherwise(wide)
    return F.when(total >= 1 << 31, total - (1 << 32)).otherwise(total).cast("int")
