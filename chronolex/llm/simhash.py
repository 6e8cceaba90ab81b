"""SimHash near-duplicates by anchor-point covering.

Fingerprints within `distance` bits are linked exactly, without comparing all pairs.
The 64 bits are cut into three blocks, of 23, 23 and 18 bits. Each block has a linear
covering code: the perfect binary Golay code (radius 3) on 23 bits, the Hamming code
of 15 bits (radius 1) beside three-fold repetition (radius 1) on 18 bits. The code
words are the anchors. Two fingerprints that differ in at most four bits differ in at
most one bit of some block (pigeonhole), or in at most two bits of some pair of
blocks. A fingerprint goes to every anchor within the covering radius plus that
allowance (counted part by part), so two near fingerprints meet at the anchor that
covers either of them. Up to some millions of distinct fingerprints single blocks are
used (about 19 anchors for each); beyond that pairs of blocks, with more and far
smaller groups (about 200 anchors). Both are exact; only the work differs.

Equal fingerprints are merged first, and only a spanning forest of a group's links is
emitted. A group above `block_rows` is split into blocks that are compared pair by
pair, so a task holds two blocks at most. Components come from alternating large-star
and small-star steps, whose results are written to the shared folder.

Cases: null and empty texts have no words and the fingerprint zero, which is linked
like any other. A text of fewer words than a shingle is one shingle. Repeated rows get
equal results; ties need no rule. An empty table gives no rows. Rows with a null doc_id
are linked by their fingerprints like any other; a component's id is null only if all
its members lack an id. Further columns are ignored, and kept by `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, quoted, slices, stored

WORDS, SEED, BITS = 4, 42, 64
GOLAY_POLYNOMIAL = 0b101011100011  # generator of the binary Golay code of length 23
PAIRS_ABOVE = 2_000_000


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of one text."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined, lengths = b" ".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    last = ends[words - 1 :] if len(parts) > words else ends[-1:]
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, BITS)
        ones += bits.sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and the fingerprint as a signed 64-bit integer, for every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 8 << 20):
            found = np.fromiter((fingerprint(t.as_py(), words) for t in part.column(1)), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(hashed, "doc_id long, fp long")


def _golay_syndromes() -> np.ndarray:
    """For each of 23 bits, the remainder of x^bit by the generator polynomial."""
    out, value = [], 1
    for _ in range(23):
        out.append(value)
        value <<= 1
        if value >> 11 & 1:
            value ^= GOLAY_POLYNOMIAL
    return np.array(out, np.uint32)


#: name: (syndrome of each bit, covering radius)
CODES = {
    "golay23": (_golay_syndromes(), 3),
    "hamming15": (np.arange(1, 16, dtype=np.uint32), 1),
    "repetition3": (np.array([1, 2, 3], np.uint32), 1),
}
#: blocks: (code, first bit) of each part
BLOCKS = ((("golay23", 0),), (("golay23", 23),), (("hamming15", 46), ("repetition3", 61)))


@cache
def _coset(code: str, allowance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors up to radius + allowance sorted by syndrome: (vectors, their excess over the radius, first of each syndrome)."""
    columns, radius = CODES[code]
    n = len(columns)
    vectors, excess, syndromes = [], [], []
    for weight in range(min(n, radius + allowance) + 1):
        for bits in combinations(range(n), weight):
            vectors.append(sum(1 << b for b in bits))
            excess.append(max(0, weight - radius))
            syndromes.append(int(np.bitwise_xor.reduce(columns[list(bits)])) if bits else 0)
    order = np.argsort(np.array(syndromes), kind="stable")
    first = np.searchsorted(np.array(syndromes)[order], np.arange((1 << int(columns.max()).bit_length()) + 1))
    return np.array(vectors, np.uint64)[order], np.array(excess, np.int8)[order], first


def _nearby(values: np.ndarray, code: str, allowance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of one code near each value: (row, anchor, excess)."""
    columns, _ = CODES[code]
    syndrome = np.zeros(len(values), np.uint32)
    for b, column in enumerate(columns):
        syndrome ^= np.where(values >> np.uint64(b) & np.uint64(1), column, np.uint32(0)).astype(np.uint32)
    vectors, excess, first = _coset(code, allowance)
    counts = first[syndrome + 1] - first[syndrome]
    rows = np.repeat(np.arange(len(values)), counts)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[syndrome], counts)
    return rows, values[rows] ^ vectors[at], excess[at]


def schemes(pairs: bool) -> list[tuple[tuple[tuple[str, int], ...], int]]:
    """(parts, allowance) of each covering; for four differing bits in all."""
    if pairs:
        return [(BLOCKS[a] + BLOCKS[b], 2) for a, b in combinations(range(3), 2)]
    return [(block, 1) for block in BLOCKS]


def anchors(fps: np.ndarray, pairs: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, group key) of every anchor that each fingerprint is sent to."""
    all_rows, all_keys = [], []
    for number, (parts, allowance) in enumerate(schemes(pairs)):
        rows, keys, spent, width = np.arange(len(fps)), np.zeros(len(fps), np.uint64), np.zeros(len(fps), np.int8), 0
        for code, shift in parts:
            n = len(CODES[code][0])
            near, anchor, excess = _nearby(fps >> np.uint64(shift) & np.uint64((1 << n) - 1), code, allowance)
            counts = np.bincount(near, minlength=len(fps))
            begin = np.cumsum(counts) - counts
            times = counts[rows]
            at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin[rows], times)
            rows, keys, spent = np.repeat(rows, times), np.repeat(keys, times) | anchor[at] << np.uint64(width), np.repeat(spent, times) + excess[at]
            keep = spent <= allowance
            rows, keys, spent = rows[keep], keys[keep], spent[keep]
            width += n
        all_rows.append(rows)
        all_keys.append(keys | np.uint64(number) << np.uint64(60))
    return np.concatenate(all_rows), np.concatenate(all_keys)


def forest(fps: np.ndarray, distance: int, halves: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints (row, row). With `halves`, links within a half are left to others."""
    n = len(fps)
    linked = np.zeros(n, bool)
    step = max(1, (1 << 21) // max(1, n))
    for a in range(0, n, step):
        near = np.bitwise_count(fps[a : a + step, None] ^ fps[None, :]) <= distance
        linked[a : a + step] = near.sum(1) > 1
    left, edges = np.flatnonzero(linked), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = np.full(len(left), -1)
            for a in range(0, len(front), step):
                near = np.bitwise_count(fps[front[a : a + step], None] ^ fps[None, left]) <= distance
                hit = near.any(0) & (reached < 0)
                reached[hit] = front[a + near.argmax(0)[hit]]
            found = reached >= 0
            edges += zip(reached[found].tolist(), left[found].tolist(), strict=True)
            front, left = left[found], left[~found]
    return edges


def links(distinct: DataFrame, distance: int = 4, block_rows: int = 4096, pairs: bool | None = None) -> DataFrame:
    """Spanning links (a, b) between nodes whose fingerprints differ in at most `distance` (0 to 4) bits.

    `distinct` has a row for each fingerprint: node long, fp long; it is read twice.
    """
    if not 0 <= distance <= 4:
        raise ValueError("the covering is made for up to four bits")
    if pairs is None:
        pairs = distinct.count() > PAIRS_ABOVE

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                node, fp = (part.column(i).to_numpy() for i in (0, 1))
                rows, keys = anchors(fp.view(np.uint64), pairs)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(node[rows]), pa.array(fp[rows])], ["anchor", "node", "fp"])

    sent = distinct.select("node", "fp").mapInArrow(spread, "anchor long, node long, fp long")
    sizes = sent.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
    large = stored(sizes.select("anchor", F.ceil(F.col("n") / (block_rows / 2)).cast("int").alias("blocks")), "large-anchors")
    if large.isEmpty():
        dealt = sent.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:
        # A row of block b meets the rows of every block, itself included: keys (min, max).
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
        dealt = sent.join(large, "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
        dealt = dealt.select("anchor", "node", "fp", F.inline(cells))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come sorted by group; a group may go on in the next batch."""
        rest: list[np.ndarray] = []

        def groups(columns: list[np.ndarray], last: bool) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
            key = columns[:3]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in key], axis=0)) + 1
            cuts = [0, *change.tolist(), len(key[0])]
            whole = cuts if last else cuts[:-1]
            out = []
            for a, b in zip(whole[:-1], whole[1:], strict=True):
                if b - a > 1:
                    out += [(int(columns[3][a + x]), int(columns[3][a + y])) for x, y in forest(columns[4][a:b].view(np.uint64), distance)]
            return out, [c[whole[-1] :] for c in columns]

        def batch_of(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(edges, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both.min(1)), pa.array(both.max(1))], ["a", "b"])

        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)] if rest else columns
            if len(columns[0]):
                edges, rest = groups(columns, False)
                if edges:
                    yield batch_of(edges)
        if rest and len(rest[0]):
            edges, _ = groups(rest, True)
            if edges:
                yield batch_of(edges)

    grouped = dealt.select("anchor", "i", "j", "node", "fp").repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    return grouped.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the component's smallest node. Edges: a < b, long."""
    stars, seen = stored(edges, "links"), None
    for _ in range(rounds):
        both = stars.union(stars.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        stars = stored(small, "stars")
        now = tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    members = stars.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return members.union(stars.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _roots(prints: DataFrame, distance: int, block_rows: int, pairs: bool | None) -> DataFrame:
    """(fp, root, component_id): a component's nodes are its fingerprints; its root is the least of them."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select(F.col("fp").alias("node"), "fp"), distance, block_rows, pairs)).withColumnRenamed("node", "fp")
    labelled = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return labelled.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = 4, block_rows: int = 4096, pairs: bool | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id linked directly or not) for every row."""
    prints = stored(fingerprints(docs, words), "fingerprints")
    labelled = _roots(prints, distance, block_rows, pairs).select("fp", "component_id")
    return prints.join(labelled, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _least_rows(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Of the rows of each key the least, by text (null first), then the other columns."""
    ordered = sorted((c for c, t in rows.select(*map(quoted, columns)).dtypes if "map<" not in t and "variant" not in t), key=lambda c: c != "text")
    order = F.struct(*(quoted(c) for c in ordered))
    if len(ordered) == len(columns):
        least = F.min(order)
    else:
        least = F.min_by(F.struct(*map(quoted, columns)), order)
    (name,) = free_names(rows.columns, "_row")
    kept = rows.groupBy(key).agg(least.alias(name)).select(F.col(f"{name}.*"))
    return kept.select(*map(quoted, columns))


def one_of_each(docs: DataFrame, words: int = WORDS, distance: int = 4, block_rows: int = 4096) -> DataFrame:
    """One row of `docs` for each component: that of its smallest doc_id. Rows of one id are one document: the
    least of them stays, by text (null first), then the other columns. So does the least row of a component without ids."""
    prints = stored(fingerprints(docs, words), "fingerprints")
    labelled = stored(_roots(prints, distance, block_rows, None), "components")
    found = prints.where("doc_id is not null").join(labelled, "fp").where("doc_id = component_id")
    keep = found.select("doc_id").distinct()
    kept = _least_rows(docs.where("doc_id is not null").join(keep, "doc_id", "left_semi"), "doc_id", docs.columns)
    nameless = labelled.where("component_id is null")
    if nameless.isEmpty():
        return kept
    rows = docs.where("doc_id is null")
    fp, root = free_names(docs.columns, "_fp", "_root")
    schema = T.StructType([*rows.schema.fields, T.StructField(fp, T.LongType())])
    at = docs.columns.index("text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 8 << 20):
            found = np.fromiter((fingerprint(t.as_py(), words) for t in part.column(at)), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found.view(np.int64))], schema.names)

    named = rows.mapInArrow(hashed, schema).join(nameless.select(F.col("fp").alias(fp), F.col("root").alias(root)), fp)
    return kept.unionByName(_least_rows(named, root, docs.columns))
