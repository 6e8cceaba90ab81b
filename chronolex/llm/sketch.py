"""Document fingerprints as threshold-scaled sketches, in DataFrame expressions only.

A sketch keeps every hash of a text's five-word shingles that lies below one fixed
fraction of the hash space, whatever the text's length, and no other. So its size follows the document's,
the sketch of two documents' shingles together is the union of their sketches, and
containment is estimated by the share of a sketch that another one holds, however unequal
the documents are. The estimate of a text of n shingles has a standard error of about
sqrt(c (1 - c) / (n * fraction)).

Cases: null text is an empty text; its sketch is empty. A text of fewer than five
words is one shingle. A very short text may keep no hash. Two empty sketches are alike
(1.0), an empty and another one not (0.0). Equal texts have equal sketches. Repeated rows each take their place in the
order of (doc_id, hash of the text, text); null ids come first. An empty table gives no
rows. Further columns are ignored. Very long texts are treated whole, in time linear in
the length.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS, FRACTION = 5, 1 / 2
LOWEST = -(1 << 63)
BUCKET_BYTES, BUCKETS_A_TASK, BUCKETS_AT_MOST = 2 << 20, 4, 1 << 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kept(hashes: Column, fraction: float = FRACTION) -> Column:
    """Sorted distinct hashes below the fraction."""
    return F.sort_array(F.array_distinct(F.filter(hashes, lambda x: x < F.lit(LOWEST + int(fraction * (1 << 64))))))


def sketch(text: Column, words: int = WORDS, fraction: float = FRACTION) -> Column:
    """Sorted distinct hashes (array<bigint>) of a text's shingles that lie below the fraction."""
    none = F.array().cast("array<bigint>")
    hashed = F.transform(F.filter(F.split(F.lower(text), "[ \\t\\n\\x0b\\f\\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - words)
        return F.when(F.size(h) < words, F.array(F.xxhash64(h))).otherwise(F.transform(at, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(words)))))

    return let(hashed, lambda h: F.when(F.size(h) == 0, none).otherwise(kept(shingles(h), fraction)))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two documents' shingles together."""
    return F.sort_array(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def written(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), ",")


def with_next(docs: DataFrame, columns: list[str], bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """`docs` (doc_id long, text, ...) with `next_<column>` of the next row in order of (doc_id, hash of the text, text); the first follows the last.

    The order is cut into ranges of about equal numbers of rows, by id and, within an id (or
    null) that fills several ranges, by the hash; each range is one window partition, which
    also gets the first row of the next range. So the texts are shuffled once, some ranges to
    each task, and no task holds the whole order. Only rows equal in id and
    text cannot be parted.
    """
    spark = docs.sparkSession
    total = docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    n = max(1, min(BUCKETS_AT_MOST, total["rows"], total["bytes"] // bucket_bytes))
    # Null ids are all alike: their ranges are cut by the hash alone.
    nameless = round(n * total["nulls"] / max(1, total["rows"]))
    points: list[tuple[bool, int]] = [(False, 0)] * nameless
    if n - nameless > 1:
        found = docs.select(F.percentile_approx("doc_id", [k / (n - nameless) for k in range(1, n - nameless)], max(10_000, 4 * n))).first()[0] or []
        points += [(True, i) for i in found]
    splits: list[tuple[bool, int, int]] = []
    for point, run in groupby(points):  # equal points: one id that fills several ranges
        same = sum(1 for _ in run)
        splits += [(*point, LOWEST + j * ((1 << 64) // same)) for j in range(same)]
    steps = [1 << k for k in range(len(splits).bit_length() - 1, -1, -1)]
    array = F.from_json(F.lit(json.dumps([{"k": k, "i": i, "h": h} for k, i, h in splits])), "array<struct<k:boolean,i:bigint,h:bigint>>")
    h, to, copy = "_hash", "_to", "_copy"
    own = F.struct(F.col("doc_id").isNotNull().alias("k"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("i"), F.col(h).alias("h"))
    place = F.lit(0)
    if splits:  # binary search: how many splits are not above the row
        place = F.aggregate(
            F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when((at + step <= len(splits)) & (F.get(array, at + step - 1) <= own), at + step).otherwise(at)
        )
    keyed = docs.withColumn(h, F.xxhash64("text")).withColumn("_bucket", place)
    firsts = sorted((r["_bucket"], r["least"]) for r in keyed.groupBy("_bucket").agg(F.min(own).alias("least")).collect())
    before = [(b, *least, firsts[i - 1][0]) for i, (b, least) in enumerate(firsts)]
    edge = spark.createDataFrame(before, "_bucket int, _k boolean, _i long, _h long, _before int")  # a row for each range
    stays = F.struct(F.col("_bucket").alias(to), F.lit(False).alias(copy))
    copied = F.struct(F.col("_before").alias(to), F.lit(True).alias(copy))
    is_first = own == F.struct(F.col("_k").alias("k"), F.col("_i").alias("i"), F.col("_h").alias("h"))
    dealt = keyed.join(F.broadcast(edge), "_bucket").select(*docs.columns, h, F.inline(F.when(is_first, F.array(stays, copied)).otherwise(F.array(stays))))
    w = Window.partitionBy(to).orderBy(copy, F.asc_nulls_first("doc_id"), h, "text")
    nexts = [F.lead(c).over(w).alias(f"next_{c}") for c in columns]
    return dealt.repartition(max(1, -(-len(firsts) // BUCKETS_A_TASK)), to).select(*docs.columns, copy, *nexts).where(~F.col(copy)).drop(copy)


def fingerprints(docs: DataFrame, words: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """Each document's fingerprint, and that of the document with its second half replaced by the start of the next one."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pairs = with_next(own, ["text"])  # sketches are cheaper to compute again than to shuffle
    pairs = pairs.withColumns({"sketch": sketch(F.col("text"), words, fraction), "next_sketch": sketch(F.col("next_text"), words, fraction)})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half))
    e = pairs.withColumn("n_chars", F.length("text").cast("long")).select("doc_id", "n_chars", "sketch", "next_sketch", edited.alias("edited"))
    e = e.withColumns({"edited_sha256": F.sha2("edited", 256), "edited_sketch": sketch(F.col("edited"), words, fraction)})
    return e.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
