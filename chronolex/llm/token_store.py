"""Token-ID output in directly addressable codes.

An id is split into chunks of eight bits, least significant first. Level 0 holds the
first chunk of every id, level k the (k+1)-th chunk of the ids that have one. Each
level keeps a bitmap that says which of its entries go on in the next level, and a
rank directory (set bits before every 512th bit), so `get(i)` follows one entry from
level to level without decoding any other.

File: segments of about a MB of text each, then arrays of fixed width: the segments' byte
and token positions, the tokens before each document, the documents' ids and which of them
are null; then where these begin and how many there are. So a token or a document is found
by reading a few entries. A file holds one range of document ids, of about `FILE_BYTES` of
text; its documents are in ascending order of id, nulls first.

Cases: null text is an empty text and still gets its end id. A repeated doc_id gives
a document of its own for each row, ordered by a hash of the text, then the text; the
ranges are cut by id and that hash, so an id (or null) of very many rows is spread over
files unless the rows' texts are equal too. An empty table gives no file and no row.
Further columns are ignored. A text longer than a segment is a segment.
"""

from __future__ import annotations

import io
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, slices, stored
from .tokens import encoder

CHUNK_BITS, RANK_STEP, MAGIC = 8, 512, b"CLXDAC01"
#: Text bytes and documents of a file, at most about; text bytes from which a table has as many files as the cluster has cores.
FILE_BYTES, FILE_ROWS, LEAST_BYTES = 64 << 20, 2_000_000, 4 << 20


class Codes:
    """Directly addressable codes of one sequence of unsigned 32-bit integers."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.levels = levels

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        levels, rest = [], np.ascontiguousarray(ids, np.uint32)
        while True:
            more = rest >> CHUNK_BITS
            goes_on = more != 0
            bitmap = np.packbits(goes_on, bitorder="little")
            bitmap = np.pad(bitmap, (0, -len(bitmap) % (RANK_STEP // 8)))
            counts = np.bitwise_count(bitmap).reshape(-1, RANK_STEP // 8).sum(1, dtype=np.uint64)
            levels.append((rest.astype(np.uint8), bitmap, np.concatenate([[0], np.cumsum(counts)]).astype(np.uint64)))
            rest = more[goes_on]
            if not len(rest):
                return cls(levels)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def rank(self, level: int, i: int) -> int:
        """Set bits of a level's bitmap before position i."""
        _, bitmap, ranks = self.levels[level]
        block = i // RANK_STEP
        start = block * (RANK_STEP // 8)
        whole = i // 8
        count = int(ranks[block]) + int(np.bitwise_count(bitmap[start:whole]).sum(dtype=np.int64))
        return count + ((int(bitmap[whole]) & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else 0)

    def get(self, i: int) -> int:
        """The i-th integer, read through one entry of each level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * level)
            if not bitmap[i // 8] >> (i % 8) & 1:
                break
            i = self.rank(level, i)
        return value

    def range(self, start: int, end: int) -> np.ndarray:
        """The integers from start to end, reading only their own entries."""
        out = np.zeros(end - start, np.uint32)
        at = np.arange(end - start)
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if start >= end:
                break
            out[at] |= chunks[start:end].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            bits = np.unpackbits(bitmap[start // 8 : (end + 7) // 8], bitorder="little")[start % 8 :][: end - start]
            at = at[bits.view(bool)]
            start = self.rank(level, start) if len(at) else 0
            end = start + len(at)
        return out

    def dump(self) -> bytes:
        parts = [np.array([len(self.levels)], "<u8").tobytes()]
        for chunks, bitmap, ranks in self.levels:
            parts += [np.array([len(chunks), len(bitmap), len(ranks)], "<u8").tobytes(), chunks.tobytes(), bitmap.tobytes(), ranks.astype("<u8").tobytes()]
        return b"".join(parts)

    @classmethod
    def load(cls, raw: bytes) -> Codes:
        (n,), at, levels = np.frombuffer(raw, "<u8", 1), 8, []
        for _ in range(int(n)):
            a, b, c = (int(x) for x in np.frombuffer(raw, "<u8", 3, at))
            at += 24
            levels.append((np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a), np.frombuffer(raw, "<u8", c, at + a + b)))
            at += a + b + 8 * c
        return cls(levels)


class Writer:
    """Appends segments of packed documents to a binary sink, then the footer."""

    def __init__(self, sink) -> None:
        self.sink, self.at = sink, len(MAGIC)
        sink.write(MAGIC)
        self.segments: list[tuple[int, int, int]] = []
        self.tokens = 0
        self.ids, self.nulls, self.starts = array("q"), array("b"), array("q", [0])

    def add(self, ids: list[int | None], packed: list[bytes]) -> None:
        raw = Codes.of(np.frombuffer(b"".join(packed), "<u4")).dump()
        self.segments.append((self.at, len(raw), self.tokens))
        self.sink.write(raw)
        self.at += len(raw)
        self.ids.extend(i or 0 for i in ids)
        self.nulls.extend(i is None for i in ids)
        self.starts.extend((self.tokens + np.cumsum([len(p) // 4 for p in packed])).tolist())
        self.tokens = self.starts[-1]

    def close(self) -> None:
        """Arrays of fixed width, then where they begin and how many there are: any entry is found by its place."""
        for part in (np.array(self.segments, "<u8"), np.array(self.starts, "<u8"), np.array(self.ids, "<i8"), np.array(self.nulls, np.uint8)):
            self.sink.write(part.tobytes())
        self.sink.write(np.array([self.at, len(self.segments), len(self.ids)], "<u8").tobytes())


class Reader:
    """Random access to the tokens and documents of one file; a single token or document reads only the bytes it touches, besides a row for each segment."""

    def __init__(self, source) -> None:
        self.source = source
        source.seek(0, io.SEEK_END)
        self.footer, segments, self.n_documents = (int(x) for x in np.frombuffer(self._read(source.tell() - 24, 24), "<u8"))
        self.segments = np.frombuffer(self._read(self.footer, 24 * segments), "<u8").astype(np.int64).reshape(-1, 3)  # place, bytes, tokens before
        self.after = self.footer + 24 * segments
        self.first = self.segments[:, 2]
        self.held: tuple[int, Codes | None] = (-1, None)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def starts(self, a: int, b: int) -> np.ndarray:
        """Tokens before the documents a to b - 1 (before the end for the number of documents)."""
        return np.frombuffer(self._read(self.after + 8 * a, 8 * (b - a)), "<u8").astype(np.int64)

    def ids(self, a: int, b: int) -> list[int | None]:
        at = self.after + 8 * (self.n_documents + 1)
        ids = np.frombuffer(self._read(at + 8 * a, 8 * (b - a)), "<i8").tolist()
        nulls = self._read(at + 8 * self.n_documents + a, b - a)
        return [None if null else i for i, null in zip(ids, nulls, strict=True)]

    def _codes(self, segment: int) -> Codes:
        if self.held[0] != segment:
            at, n, _ = self.segments[segment].tolist()
            self.held = segment, Codes.load(self._read(at, n))
        return self.held[1]

    def token(self, i: int) -> int:
        """One token: of each level a chunk, a bit, and the rank of the bit from the directory and one block of bits."""
        k = int(np.searchsorted(self.first, i, side="right")) - 1
        at, value, i = int(self.segments[k, 0]), 0, i - int(self.first[k])
        (levels,) = np.frombuffer(self._read(at, 8), "<u8")
        at += 8
        for level in range(int(levels)):
            chunks, bitmap, ranks = (int(x) for x in np.frombuffer(self._read(at, 24), "<u8"))
            if i >= chunks:
                raise IndexError(i)
            value |= self._read(at + 24 + i, 1)[0] << (CHUNK_BITS * level)
            bits, block = at + 24 + chunks, i // RANK_STEP
            inside = self._read(bits + block * (RANK_STEP // 8), i // 8 - block * (RANK_STEP // 8) + 1)
            if not inside[-1] >> (i % 8) & 1:
                break
            (before,) = np.frombuffer(self._read(bits + bitmap + 8 * block, 8), "<u8")
            i = int(before) + sum(x.bit_count() for x in inside[:-1]) + (inside[-1] & ((1 << (i % 8)) - 1)).bit_count()
            at = bits + bitmap + 8 * ranks
        return value

    def document(self, d: int) -> np.ndarray:
        """Ids of the d-th document of the file; a document never spans segments."""
        a, b = self.starts(d, d + 2).tolist()
        k = int(np.searchsorted(self.first, a, side="right")) - 1
        return self._codes(k).range(a - int(self.first[k]), b - int(self.first[k]))

    def documents(self) -> Iterator[tuple[np.ndarray, list[int | None], list[np.ndarray]]]:
        """All documents in order, a segment at a time: (tokens before each and before the end, document ids, token ids)."""
        starts = self.starts(0, self.n_documents + 1)
        cuts = [*np.searchsorted(starts[:-1], self.first).tolist(), self.n_documents]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            codes, bounds = self._codes(k), (starts[a : b + 1] - self.first[k]).tolist()
            ids = codes.range(0, len(codes)).astype("<u4", copy=False)
            yield starts[a : b + 1], self.ids(a, b), [ids[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]


def qualified(spark: SparkSession, folder: str) -> str:
    """`folder` with the scheme that Spark reads it by, so that tasks write where the session's file system is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, segment_bytes: int = 1 << 20) -> DataFrame:
    """Write the documents' ids below `folder` (shared by all executors); returns the stored manifest (shard, file, tokens, documents).

    Each task writes one file under a name of its own attempt; only files named in the
    committed manifest count, so lost executors and repeated tasks leave no wrong data.
    """

    folder = qualified(docs.sparkSession, folder)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, out, sink = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes(), None, None
        number = TaskContext.get().partitionId()
        for part in slices(batches, "text", segment_bytes):
            if out is None:
                system, base = _filesystem(folder)
                system.create_dir(base, recursive=True)
                name = f"ids-{number:06d}-{uuid.uuid4().hex}.dac"
                sink = system.open_output_stream(f"{base}/{name}")
                out = Writer(sink)
            out.add(part.column(0).to_pylist(), [p + end for p in enc.encode(part.column(1).to_pylist())])
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int32()), "file": [f"{folder}/{name}"], "tokens": pa.array([out.tokens], pa.int64()), "documents": pa.array([len(out.ids)], pa.int64())})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    tasks = min(docs.sparkSession.sparkContext.defaultParallelism, -(-size["bytes"] // LEAST_BYTES))  # for small tables
    files = max(1, tasks, -(-size["bytes"] // FILE_BYTES), -(-size["rows"] // FILE_ROWS))
    ordered = ordered.repartitionByRange(files, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return stored(ordered.mapInArrow(shard, "shard int, file string, tokens long, documents long"), "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Each document as the files hold it: doc_id, start, n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    files = manifest.orderBy("shard").collect()  # a row for each file, not for each document
    rows, start = [], 0
    for f in files:
        rows.append((f.file, start))
        start += f.tokens
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = _filesystem(file)
                with system.open_input_file(path) as source:
                    for starts, ids, found in Reader(source).documents():
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(ids, pa.int64()),
                                pa.array(starts[:-1] + base, pa.int64()),
                                pa.array(np.diff(starts), pa.int64()),
                                pa.array([zlib.crc32(x) for x in found], pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    listed = spark.createDataFrame(rows, "file string, base long").repartition(len(rows), "file")
    return listed.mapInArrow(documents, schema)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write all documents, read every one back from the files."""
    return read(write(docs, scratch(docs.sparkSession, "token-ids"), tokenizer_path, end_id))
