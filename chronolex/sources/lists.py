"""Line-based inputs and outputs: lists, word counts, count tables, word pairs, barrels, CSV."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import stored
from . import barrels

#: Scanned parts of files up to which a row for each is broadcast.
BROADCAST_PARTS = 500_000


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value): text lines (gz and bz2 by suffix) with their order within the files by name.

    The files are scanned once. Each scanned part is known by its first byte, and a line by its place in the part; both are stored
    with the line, so numbers do not depend on how the files were cut, nor on a later scan being cut alike.
    """
    place = F.monotonically_increasing_id()  # rises within a task, which reads its parts one after the other
    scanned = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), place.alias("id"))
    raw = stored(scanned, "scanned-lines")
    parts = raw.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each part
    side = before.select("file", "start", "first", "before")
    keyed = raw.join(F.broadcast(side) if parts.count() <= BROADCAST_PARTS else side, ["file", "start"])
    return keyed.select((F.col("before") + F.col("id") - F.col("first")).alias("ord"), "value")


def line_range(numbered: DataFrame, start: int, count: int) -> DataFrame:
    return numbered.where(F.col("ord").between(start, start + count - 1))


def id_paths(values: DataFrame) -> DataFrame:
    """(id, path) of lines of two fields; others are left out."""
    f = values.select(F.split("value", r"\s").alias("f")).where(F.size("f") == 2)
    return f.select(F.col("f")[0].alias("id"), F.col("f")[1].alias("path"))


def id_path_years(values: DataFrame) -> DataFrame:
    """(id, path, year) of lines of three fields; any other line raises."""
    f = values.select("value", F.split("value", r"\s").alias("f"))
    checked = F.when(F.size("f") == 3, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("not three fields: "), F.col("value"))))
    g = f.select(checked.alias("f"))
    return g.select(F.col("f")[0].alias("id"), F.col("f")[1].alias("path"), F.col("f")[2].cast("int").alias("year"))


def word_pairs(values: DataFrame) -> DataFrame:
    """(w1, w2, human)."""
    f = values.select(F.split(F.trim("value"), r"\s+").alias("f"))
    return f.select(F.col("f")[0].alias("w1"), F.col("f")[1].alias("w2"), F.col("f")[2].cast("double").alias("human"))


def word_counts(values: DataFrame) -> DataFrame:
    """(word, cnt) of lines `count word`, leading blanks allowed; any other line raises."""
    ok = F.col("value").rlike(r"^\s*[0-9]+ \S+$")
    v = values.select(F.when(ok, F.ltrim("value")).otherwise(F.raise_error(F.concat(F.lit("not a count and a word: "), F.col("value")))).alias("v"))
    return v.select(F.split_part("v", F.lit(" "), F.lit(2)).alias("word"), F.split_part("v", F.lit(" "), F.lit(1)).cast("long").alias("cnt"))


def count_table(numbered: DataFrame) -> DataFrame:
    """(term, counts) of lines `word c0 c1 ...`; of a repeated word the last line holds."""
    f = numbered.select("ord", F.split("value", " ").alias("f"))
    rows = f.select("ord", F.col("f")[0].alias("term"), F.transform(F.slice("f", F.lit(2), F.size("f")), lambda x: x.cast("double")).alias("counts"))
    return rows.groupBy("term").agg(F.max_by("counts", "ord").alias("counts"))


def write_count_table(table: DataFrame, path: str, compression: str = "none") -> None:
    """(term, counts array) as lines, clustered by term."""
    line = F.concat_ws(" ", "term", F.array_join(F.transform("counts", lambda x: x.cast("long").cast("string")), " "))
    table.repartitionByRange("term").sortWithinPartitions("term").select(line.alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def write_csv(table: DataFrame, path: str, compression: str = "none") -> None:
    table.write.mode("overwrite").option("header", True).option("compression", compression).csv(path)


def score_lines(scores: DataFrame) -> DataFrame:
    """`term score` lines of a ranked result."""
    return scores.orderBy("rank").select(F.format_string("%s %s", F.col("term"), F.col("score").cast("string")).alias("value"))


# The printed forms of hits and of blocks.
HIT, BLOCK, MEMBER = "%-60s %4d %10d", "%d-%d - w=%d:", "  %s %.3f %d"


def hit_lines(hits: DataFrame) -> DataFrame:
    """Name, year and count in fixed columns."""
    return hits.select(F.format_string(HIT, F.col("doc_id").cast("string"), F.col("year"), F.col("tf")).alias("value"))


def block_lines(ranked: DataFrame) -> DataFrame:
    """Of each block of `similarity.quantized` a line for the query, then one for each of its terms."""
    head = ranked.where("rank = 1").select("start", F.lit(0).alias("rank"), F.format_string(BLOCK, "start", "end", "query_weight").alias("value"))
    rest = ranked.select("start", "rank", F.format_string(MEMBER, "term", "score", "candidate_total").alias("value"))
    return head.unionByName(rest).orderBy("start", "rank").select("value")


def barrel_bytes(docs: list[tuple[int, list[int]]]) -> bytes:
    """Legacy barrel: big-endian 32-bit number of documents, then index, length and word hashes of each."""
    return struct.pack(">i", len(docs)) + b"".join(struct.pack(f">ii{len(h)}i", i, len(h), *h) for i, h in docs)


def parse_barrel(raw: bytes) -> list[tuple[int, list[int]]]:
    (n,), at, out = struct.unpack_from(">i", raw), 4, []
    for _ in range(n):
        idx, length = struct.unpack_from(">ii", raw, at)
        out.append((idx, list(struct.unpack_from(f">{length}i", raw, at + 8))))
        at += 8 + 4 * length
    return out


#: Documents whose words are hashed at once.
HASHED = 256


def word_hashes(words):
    """`string_hash` of an Arrow array of strings, as numpy 32-bit integers; of nulls 0."""
    import numpy as np

    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    if (raw < 128).all():
        units, length = raw, np.diff(ends)
    else:
        wide = [(w or "").encode("utf-16-be") for w in words.to_pylist()]
        units, length = np.frombuffer(b"".join(wide), ">u2"), np.array([len(w) // 2 for w in wide])
    until = np.cumsum(length)
    powers = np.full(int(length.max(initial=0)) + 1, 31, np.uint32)
    powers[0] = 1
    powers = np.multiply.accumulate(powers, dtype=np.uint32)  # wraps, as the hash does
    out, some = np.zeros(len(words), np.uint32), length > 0
    if some.any():
        out[some] = np.add.reduceat(units.astype(np.uint32) * powers[np.repeat(until, length) - 1 - np.arange(len(units))], (until - length)[some], dtype=np.uint32)
    return out.view(np.int32)


def _hashed(batches):
    import pyarrow as pa

    for whole in batches:
        for at in range(0, whole.num_rows, HASHED):
            batch = whole.slice(at, HASHED)
            words = batch.column(1)
            flat = words.flatten().cast(pa.string())
            hashes = pa.array(word_hashes(flat), pa.int32(), mask=flat.is_null().to_numpy(zero_copy_only=False))
            counts = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offsets = pa.array([0, *counts.cumsum().tolist()], pa.int32(), mask=[*words.is_null().to_pylist(), False] if words.null_count else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, hashes)], ["idx", "hashes"])


def write_barrel(docs: DataFrame, path: str, binary: bool = False) -> None:
    """(idx, words) as a barrel of the words' hashes: a Parquet one, where they are text as `read_barrels` gives them, or gzipped binary files in the folder `path`."""
    hashes = docs.select("idx", "words").mapInArrow(_hashed, f"idx {dict(docs.dtypes)['idx']}, hashes array<int>")
    if binary:
        barrels.write(hashes, path)
    else:
        hashes.select("idx", F.transform("hashes", lambda h: h.cast("string")).alias("words")).write.mode("overwrite").parquet(path)


def read_barrels(spark: SparkSession, path: str, binary: bool | None = None) -> DataFrame:
    """(idx, words) of binary barrel files (a file, or a folder of them; names with .barrel) or of a Parquet barrel; words are their hashes as text."""
    if binary if binary is not None else ".barrel" in path.rstrip("/").rsplit("/", 1)[-1]:
        return barrels.read(spark, path).select(F.col("idx").cast("long").alias("idx"), F.transform("hashes", lambda h: h.cast("string")).alias("words"))
    return spark.read.parquet(path).select("idx", "words")
