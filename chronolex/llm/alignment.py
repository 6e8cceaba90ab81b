"""Alignment of two tokenizers over a corpus, and how common each pair of linked tokens is.

Both tokenizers cut a text by its bytes. Places where tokens of both end part it into
groups; tokens whose bytes overlap are linked. The count of an id pair is the number of
documents in which it is linked.

Each text is encoded once, and its ids are stored. First pass over them: the distinct pairs
of the corpus. They get a minimal perfect hash, built by shards in tasks. Every task then
counts documents in one dense vector, indexed by the hash; the vectors are cut into slices
and summed in a tree. Second pass: documents are aligned again and their links' counts
looked up; a key that is not its number's key is an error. A task holds a hash and vector
of at most `PAIRS_AT_ONCE` pairs; if the corpus has more, pairs are dealt by their first id
into rounds of that size, whose sums add up, so the result is the same.

The second tokenizer's texts are cut at single spaces behind a character that is no white
space: none of its pieces spans such a place (checked when the file is read), so the parts
are encoded alone, each distinct one once as long as a worker remembers it.

Cases: texts that are null or empty, or that either tokenizer does not give back byte for
byte, have no tokens: zeros and an empty digest. They count no pairs. Repeated rows are
counted row by row. Strings of special tokens are ordinary text. Very long texts are used
whole, in memory linear in their tokens. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, slices, stored
from .perfect_hash import PerfectHash, build, mixed, shard_of
from .tokens import Encoder

#: Pairs that one hash holds, keys of a shard, counts of a slice, tasks' vectors that are summed in as many groups first.
PAIRS_AT_ONCE, SHARD_KEYS, SLICE, BRANCHES = 4_000_000, 1 << 16, 1 << 16, 16
#: Characters of a part that is remembered, remembered parts and words of each generation, bytes of texts and of ids at once.
LONG, CACHE_ENTRIES, TEXT_BYTES, ID_BYTES = 64, 100_000, 1 << 20, 1 << 19
PLACE = re.compile(r"(?<=\S) ")
ODD = re.compile(r"\s\s|[^\S ]")
#: A pair as one number: first id * this + second id.
SECOND = 1 << 32


def byte_level(token: str) -> bytes:
    """Bytes of a byte-level token: printable characters stand for themselves, the other bytes for U+0100 onwards, in order."""
    return bytes(BYTES[c] for c in token)


def _byte_of() -> dict[str, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


BYTES = _byte_of()


class Vocabularies:
    """Bytes, and their number, of each token of a byte-level vocabulary file and of a model of pieces with byte fallback."""

    def __init__(self, first: str, second: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        a, b = Tokenizer.from_file(first), SentencePieceProcessor(model_file=second)
        special = {t.content for t in a.get_added_tokens_decoder().values()}
        self.a_bytes = [b""] * a.get_vocab_size()
        for token, i in a.get_vocab().items():
            self.a_bytes[i] = token.encode() if token in special else byte_level(token)
        self.pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else b"" if b.is_control(i) or b.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.pieces)]
        self.kind = np.dtype("<u2" if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else "<u4")
        self.a_length, self.b_length = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))


class Encoders:
    """Both tokenizers, and the words and parts they were last used on. Ids are 16 bits wide, or 32 for larger vocabularies."""

    def __init__(self, first: str, second: str, cache_entries: int = CACHE_ENTRIES) -> None:
        from sentencepiece import SentencePieceProcessor

        self.tokens = Vocabularies(first, second)
        self.a, self.b = Encoder(first, cache_entries), SentencePieceProcessor(model_file=second)
        self.a.tokenizer.encode_special_tokens, self.a.added = True, None
        self.kind = self.tokens.kind
        #: Whether texts may be cut for the second: no piece goes on behind a single space.
        self.cuts = not any(re.search("[^▁]▁", p) for p in self.tokens.pieces)
        self.space = self.b.piece_to_id("▁")
        self.cache: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}
        self.cache_entries = cache_entries

    def _second(self, parts: list[str]) -> list[bytes | None]:
        """Ids of parts (each behind a space); None where they are not the part's bytes."""
        ids = [i or [self.space] for i in self.b.encode(parts, num_threads=1)]
        known = self.tokens.b_bytes
        return [np.array(i, self.kind).tobytes() if b"".join([known[x] for x in i]) == b" " + p.encode() else None for p, i in zip(parts, ids, strict=True)]

    def parts(self, text: str) -> list[str]:
        """A text's parts, each without the space before it."""
        if not self.cuts:
            return [text]
        return PLACE.split(text) if text[0] == " " or ODD.search(text) else text.split(" ")

    def encode(self, texts: Sequence[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of each text by both; none if it has no tokens."""
        if len(self.cache) > self.cache_entries:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        cut = [self.parts(t) if t else [] for t in texts]
        new, some = [], {}
        for p in {p for parts in cut for p in parts if p not in cache}:
            if p in older:
                cache[p] = older[p]
            else:
                new.append(p)
        for at in range(0, len(new), 4096):
            for p, ids in zip(new[at : at + 4096], self._second(new[at : at + 4096]), strict=True):
                (cache if len(p) <= LONG else some)[p] = ids
        first = self.a.encode([" " + t if t else None for t in texts])
        for text, parts, a in zip(texts, cut, first, strict=True):
            if not text:
                yield b"", b""
                continue
            ids = np.frombuffer(a, "<u4")
            found = [cache[p] if p in cache else some[p] for p in parts]
            b = None if None in found else b"".join(found)
            if b is None and len(parts) > 1:  # tried uncut before it is given up
                (b,) = self._second([text])
            same = b is not None and int(self.tokens.a_length[ids].sum()) == len(text.encode()) + 1
            yield (ids.astype(self.kind).tobytes(), b) if same else (b"", b"")


_made: dict[tuple, object] = {}


def made(kind: type, first: str, second: str) -> object:
    """One of its kind for each worker process and pair of files."""
    if (kind, first, second) not in _made:
        _made[kind, first, second] = kind(first, second)
    return _made[kind, first, second]


def encoded(docs: DataFrame, first: str, second: str) -> DataFrame:
    """(row, doc_id, a, b): the ids of each document's text, packed; written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = made(Encoders, first, second)
        for part in slices(batches, "text", TEXT_BYTES):
            found = list(enc.encode(part.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([f[k] for f in found], pa.binary()) for k in (0, 1))], ["row", "doc_id", "a", "b"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "row long, doc_id long, a binary, b binary"
    path = scratch(docs.sparkSession, "token-ids")
    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ID_BYTES of ids (a single longer row stays whole)."""
    for batch in batches:
        upto, start = np.cumsum(pc.binary_length(batch.column(batch.schema.get_field_index("a"))).to_numpy(zero_copy_only=False)), 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + ID_BYTES, side="right")))
            yield batch.slice(start, end - start)
            start = end


class Links:
    """The alignment of a batch's documents, end to end."""

    def __init__(self, part: pa.RecordBatch, tokens: Vocabularies) -> None:
        kind, self.tokens = tokens.kind, tokens
        packed = [part.column(part.schema.get_field_index(n)).to_pylist() for n in "ab"]
        self.n = [np.fromiter((len(x) // kind.itemsize for x in p), np.int64, len(p)) for p in packed]
        self.a, self.b = (np.frombuffer(b"".join(p), kind).astype(np.int64) for p in packed)
        ends_a, ends_b = np.cumsum(tokens.a_length[self.a]), np.cumsum(tokens.b_length[self.b])
        #: Of each first token: the second token in which it ends, and whether both end there.
        upto = np.searchsorted(ends_b, ends_a)
        self.closes = ends_b[upto] == ends_a if len(ends_a) else np.zeros(0, bool)
        since = np.concatenate([np.zeros(1, np.int64), upto + self.closes])[:-1]
        self.each = upto - since + 1
        total = int(self.each.sum())
        before = np.cumsum(self.each) - self.each
        self.of_second = np.arange(total) - np.repeat(before - since, self.each)
        self.pairs = np.repeat(self.a, self.each) * SECOND + self.b[self.of_second]
        self.document = np.repeat(np.repeat(np.arange(len(self.n[0])), self.n[0]), self.each)
        self.closed_b = upto[self.closes]

    def per_document(self, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sums of values that lie document by document."""
        sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]

    def columns(self) -> list[np.ndarray]:
        """Tokens of both, groups and links of each document."""
        return [*self.n, self.per_document(self.closes, self.n[0]), self.per_document(self.each, self.n[0])]

    def written(self) -> Iterator[str]:
        """The groups of each document: `a1,a2|b1;a3|b2,b3`."""
        last = np.zeros(len(self.b), bool)
        last[self.closed_b] = True
        group_a = np.cumsum(self.closes) - self.closes
        group_b = np.cumsum(last) - last
        # A first token stands behind the second tokens of earlier groups, a second one behind the first tokens up to its own group.
        seconds = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(last) + 1])
        firsts = np.flatnonzero(self.closes) + 1
        out = np.empty(len(self.a) + len(self.b), object)
        out[np.arange(len(self.a)) + seconds[group_a]] = _strings(len(self.tokens.a_bytes), ",|")[self.a * 2 + self.closes]
        out[np.arange(len(self.b)) + firsts[group_b]] = _strings(len(self.tokens.b_bytes), ",;")[self.b * 2 + last]
        at = 0
        for n in (self.n[0] + self.n[1]).tolist():
            yield "".join(out[at : at + n].tolist())[:-1]
            at += n


def _strings(ids: int, ends: str) -> np.ndarray:
    """Each id followed by the first or by the second of two signs."""
    if (ids, ends) not in _made:
        _made[ids, ends] = np.array([f"{i}{e}" for i in range(ids) for e in ends], object)
    return _made[ids, ends]


def pairs_of(ids: DataFrame, first: str, second: str) -> DataFrame:
    """(pair): the distinct linked pairs of all documents, distinct in each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = made(Vocabularies, first, second)
        seen = np.zeros(0, np.int64)
        for part in bounded(batches):
            pairs = np.unique(Links(part, tokens).pairs)
            pairs = np.setdiff1d(pairs, seen, assume_unique=True)
            seen = np.union1d(seen, pairs) if len(seen) < 1 << 20 else pairs
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64())], ["pair"])

    return ids.select("a", "b").mapInArrow(run, "pair long").distinct()


def _round_of(pairs: np.ndarray, rounds: int) -> np.ndarray:
    return (mixed(pairs // SECOND, 2000) % np.uint64(rounds)).astype(np.int64)


def hashed(pairs: DataFrame, number: int, rounds: int, shards: int) -> PerfectHash:
    """The perfect hash of one round's pairs; a shard is built in a task."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            keys = keys[_round_of(keys, rounds) == number]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(shard_of(keys, shards))], ["pair", "shard"])

    def make(table: pa.Table) -> pa.Table:
        levels, keys = build(table.column("pair").to_numpy())
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "levels": pa.array([[x.tobytes() for x in levels]], pa.list_(pa.binary())), "keys": pa.array([keys.tobytes()], pa.binary())})

    rows = pairs.mapInArrow(deal, "pair long, shard long").groupBy("shard").applyInArrow(make, "shard long, levels array<binary>, keys binary").collect()  # bounded by PAIRS_AT_ONCE
    made = {r["shard"]: ([np.frombuffer(x, np.uint64) for x in r["levels"]], np.frombuffer(r["keys"], np.int64)) for r in rows}
    return PerfectHash.of([made.get(s, ([], np.zeros(0, np.int64))) for s in range(shards)])


def _numbers(table: PerfectHash, pairs: np.ndarray) -> np.ndarray:
    """Numbers of pairs; a pair without one is an error."""
    out = table.numbers(pairs)
    if len(out) and out.min() < 0:
        raise ValueError("a pair of the second pass was not met in the first")
    return out


def counted(ids: DataFrame, first: str, second: str, table: PerfectHash, number: int, rounds: int) -> np.ndarray:
    """In how many documents each pair is linked, by its number: dense vectors of all tasks, summed in a tree."""
    held = ids.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, table = made(Vocabularies, first, second), held.value
        seen = np.zeros(len(table), np.int64)
        for part in bounded(batches):
            links = Links(part, tokens)
            mine = _round_of(links.pairs, rounds) == number if rounds > 1 else slice(None)
            once = np.unique(links.document[mine] * max(1, len(table)) + _numbers(table, links.pairs[mine]))  # once a document
            seen += np.bincount(once % max(1, len(table)), minlength=len(table))[: len(table)]
        cut = [(k, seen[k * SLICE : (k + 1) * SLICE]) for k in range(-(-len(seen) // SLICE))]
        cut = [(k, x.tobytes()) for k, x in cut if x.any()]
        branch = TaskContext.get().partitionId() % BRANCHES
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in cut], pa.int32()), pa.array([branch] * len(cut), pa.int32()), pa.array([x for _, x in cut], pa.binary())], ["slice", "branch", "counts"])

    def added(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in rows.column("counts"))
        return rows.slice(0, 1).set_column(2, "counts", pa.array([total.tobytes()], pa.binary()))

    schema = "slice int, branch int, counts binary"
    vectors = ids.select("a", "b").mapInArrow(run, schema).groupBy("slice", "branch").applyInArrow(added, schema)
    whole = np.zeros(len(table), np.int64)
    for r in vectors.groupBy("slice").applyInArrow(added, schema).collect():  # bounded by PAIRS_AT_ONCE
        whole[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.int64)
    return whole


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def looked_up(ids: DataFrame, first: str, second: str, table: PerfectHash, counts: np.ndarray, number: int, rounds: int) -> DataFrame:
    """row, doc_id, COLUMNS and groups_sha256; n_best and count_sum over the links of the round."""
    firsts = table.keys // SECOND
    most = np.zeros(int(firsts.max(initial=0)) + 1, np.int64)
    np.maximum.at(most, firsts, counts)
    held = ids.sparkSession.sparkContext.broadcast((table, counts, counts == most[firsts]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, (table, counts, best) = made(Vocabularies, first, second), held.value
        for part in bounded(batches):
            links = Links(part, tokens)
            mine = _round_of(links.pairs, rounds) == number if rounds > 1 else slice(None)
            n = _numbers(table, links.pairs[mine])
            columns = links.columns()
            for looked in (best[n], counts[n]):
                each = np.zeros(len(links.pairs), np.int64)
                each[mine] = looked
                columns.append(links.per_document(each, columns[3]))
            digests = [hashlib.sha256(text.encode()).hexdigest() if text else "" for text in links.written()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, columns), pa.array(digests, pa.string())], ["row", "doc_id", *COLUMNS, "groups_sha256"])

    return ids.mapInArrow(run, ", ".join(["row long", "doc_id long", *(f"{c} long" for c in COLUMNS), "groups_sha256 string"]))


def align(docs: DataFrame, first: str, second: str, at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """doc_id, COLUMNS, groups_sha256 of every document (doc_id, text). `first` is a byte-level vocabulary file, `second` a model of pieces with byte fallback."""
    ids = encoded(docs, first, second)
    pairs = stored(pairs_of(ids, first, second), "token-pairs")
    n = pairs.count()
    rounds = max(1, -(-n // at_once))
    parts = []
    for number in range(rounds):
        table = hashed(pairs, number, rounds, max(1, n // rounds // SHARD_KEYS))
        parts.append(looked_up(ids, first, second, table, counted(ids, first, second, table, number, rounds), number, rounds))
    if rounds == 1:
        return parts[0].drop("row")
    whole = stored(parts[0], "round")
    for p in parts[1:]:
        whole = whole.unionByName(stored(p, "round"))
    same = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return whole.groupBy(*same).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).select("doc_id", *COLUMNS, "groups_sha256")
