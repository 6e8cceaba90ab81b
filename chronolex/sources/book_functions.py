"""Book XML as table functions: words, metadata and text of a file's bytes, scanned as they are unpacked.

A file is unpacked in pieces and scanned with a buffer that holds no more than one element; words leave one by one.
A file that is cut short or broken has no words: it is unpacked once before for that, in pieces too.
"""

from __future__ import annotations

import bz2
import codecs
import itertools
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .books import TAG, decoded

PIECE, LONGEST_TAG = 1 << 16, 1 << 16
#: A tag with the text behind it, and a run of these without a stray `<`.
ELEMENT = re.compile(TAG.pattern + "([^<]*+)")
RUN = re.compile(f"(?:{TAG.pattern}[^<]*+)*+")
#: In a run, other elements being passed over: the next <w>'s text; the same trimmed, or `<` for the next <pb> or <lb>. Empty at the run's end.
INSIDE = r"""[^<>"]*+(?:"[^"]*+"[^<>"]*+)*+"""
OTHERS = r"(?:<(?!\s*+(?:%s)[\s>])" + INSIDE + r">[^<]*+)*+"
W, BREAK, CLOSED = rf"w(?:\s{INSIDE})?+>", rf"\s*+[pl]b(?:\s{INSIDE})?+>", r"(?:</w>[^<]*+)?+"
RUN_WORDS = re.compile(rf"(?:<{W}|{OTHERS % 'w'}(?:<\s*+{W}|\Z))([^<]*+){CLOSED}")
RUN_LINES = re.compile(rf"(?:<{W}|{OTHERS % 'w|[pl]b'}(?:<\s*+{W})?+)\s*+([^<\s]++(?:\s++[^<\s]++)*+|(?:<(?={BREAK}))?+)(?:(?<=<){BREAK})?+[^<]*+{CLOSED}")


def unpacked(raw: bytes) -> Iterator[bytes]:
    """A plain, gz or bz2 file's bytes in pieces; a packed one that ends early raises."""
    kind = "gz" if raw[:2] == b"\x1f\x8b" else "bz2" if raw[:3] == b"BZh" else None
    at = 0
    if kind is None:
        while at < len(raw):
            yield raw[at : at + PIECE]
            at += PIECE
        return
    unpack = None
    while at < len(raw):
        if unpack is None:
            unpack = zlib.decompressobj(31) if kind == "gz" else bz2.BZ2Decompressor()
        piece = raw[at : at + PIECE]
        at += PIECE
        while piece:
            yield unpack.decompress(piece)
            if not unpack.eof:
                break
            piece = unpack.unused_data  # another packed part follows
            if piece:
                unpack = zlib.decompressobj(31) if kind == "gz" else bz2.BZ2Decompressor()
    if unpack is None or not unpack.eof:
        raise EOFError("the file ends early")


def whole(raw: bytes) -> bool:
    if raw[:2] != b"\x1f\x8b" and raw[:3] != b"BZh":
        return True  # a plain file is as long as it is
    try:
        for _ in unpacked(raw):
            pass
    except (OSError, EOFError, ValueError, zlib.error):
        return False
    return True


def bare(tag: str) -> str:
    return words[0] if (words := tag.split(None, 1)) else ""


def runs(raw: bytes) -> Iterator[tuple[str | None, str, int, int]]:
    """In order: (bare tag name, text, begin, end) of an element's text up to the next tag, or (None, text, begin, end) of a run of whole elements."""
    text_of, buffer, name, at, ended = codecs.getincrementaldecoder("utf-8")("replace"), "", None, 0, False
    pieces = unpacked(raw)
    while not ended:
        piece = next(pieces, None)
        ended = piece is None
        buffer, at = buffer[at:] + text_of.decode(piece or b"", final=ended), 0
        if (start := buffer.find("<")) >= 0:
            run = RUN.match(buffer, start)
            if (last := run.start(1) - 1) > start:  # all but the last are complete, whatever follows
                if name is not None:
                    yield name, buffer, 0, start
                yield None, buffer, start, last
                name, at = bare(run[1]), run.end(1) + 1
        for m in TAG.finditer(buffer, at):
            early = buffer.find("<", at, m.start())
            if early >= 0 and not ended and len(buffer) - early < LONGEST_TAG:
                break  # may yet turn out to be a tag around this one
            if name is not None:
                yield name, buffer, at, m.start()
            name, at = bare(m[1]), m.end()
    if name is not None:
        yield name, buffer, at, len(buffer)


def elements(raw: bytes) -> Iterator[tuple[str, str]]:
    """(bare tag name, text up to the next tag), in order."""
    for name, text, begin, end in runs(raw):
        if name is None:
            for tag, after in ELEMENT.findall(text, begin, end):
                yield bare(tag), after
        else:
            yield name, text[begin:end]


class BookWords:
    """(position, word): contents of every <w>, untrimmed, without empty ones."""

    def columns(self, content: bytes):
        n = 0
        if content is not None and whole(content):
            for name, text, begin, end in runs(content):
                if name is None or name == "w":
                    found = RUN_WORDS.findall(text, begin, end) if name is None else [text[begin:end]]
                    words = [word for raw in found if (word := decoded(raw) if "&" in raw else raw)]
                    yield range(n, n + len(words)), words
                    n += len(words)

    def eval(self, content: bytes):
        for positions, words in self.columns(content):
            yield from zip(positions, words, strict=True)


class BookMetadata:
    """(position, tag, value): the tags before the text, as they stand but for decoded entities."""

    def eval(self, content: bytes):
        n = 0
        if content is not None and whole(content):
            for name, raw in elements(content):
                if name in ("/metadata", "text"):
                    return
                if name and name[0] not in "/?!" and name not in ("metadata", "w"):
                    yield n, name, decoded(raw)
                    n += 1


class BookLines:
    """(line, text): trimmed words joined by spaces, a line up to each <pb> or <lb>."""

    def eval(self, content: bytes):
        line, parts = 0, []
        if content is not None and whole(content):
            for name, text, begin, end in runs(content):
                if name is None:
                    found = [part for part in RUN_LINES.findall(text, begin, end) if part]
                    first, *others = self.between(found) if "&" in (joined := " ".join(found)) else map(str.strip, joined.split("<"))
                elif name in ("w", "pb", "lb"):
                    first, *others = [decoded(text[begin:end]).strip()] if name == "w" else ["", ""]
                else:
                    continue
                parts.append(first)
                for other in others:
                    yield line, " ".join(filter(None, parts))
                    line, parts = line + 1, [other]
            yield line, " ".join(filter(None, parts))

    def between(self, found: list[str]) -> Iterator[str]:
        """Words with entities, joined between breaks."""
        words = []
        for part in found:
            if part == "<":
                yield " ".join(words)
                words = []
            elif word := decoded(part).strip():
                words.append(word)
        yield " ".join(words)


class BookExtents:
    """(tag, begin, end): each element's interval of word places, its end excluded; one that is not closed reaches to the last word."""

    def eval(self, content: bytes):
        n, opened = 0, {}
        if content is not None and whole(content):
            for name, raw in elements(content):
                if name == "w":
                    n += bool(decoded(raw))
                elif name[:1] == "/" and opened.get(name[1:]):
                    yield name[1:], opened[name[1:]].pop(), n
                elif name and name[0] not in "/?!" and name[-1] != "/" and name not in ("pb", "lb"):
                    opened.setdefault(name, []).append(n)
            for name, begins in opened.items():
                for begin in begins:
                    yield name, begin, n


book_extents = F.udtf(BookExtents, returnType="tag string, begin int, end int")
book_words = F.udtf(BookWords, returnType="position int, word string")
book_metadata = F.udtf(BookMetadata, returnType="position int, tag string, value string")
book_lines = F.udtf(BookLines, returnType="line int, text string")


#: Rows of a table function that leave together.
ROWS = 1 << 16


def with_rows(files: DataFrame, function, content: str = "content") -> DataFrame:
    """Each row of `files` without its content, beside each row that a table function makes of it, in Arrow batches of `ROWS`. A function that has
    `columns` gives many rows at once."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kept, made, rows_of = files.drop(content), function.returnType, function.func
    made = made if isinstance(made, StructType) else StructType.fromDDL(made)
    arrow = to_arrow_schema(made)

    def columns_of(raw):
        if hasattr(rows_of, "columns"):
            yield from rows_of().columns(raw)
            return
        rows = rows_of().eval(raw)
        while some := list(itertools.islice(rows, ROWS)):
            yield zip(*some, strict=True)

    def column(values, kind):
        return pa.array(np.arange(values.start, values.stop) if isinstance(values, range) else values, kind)

    def run(batches):
        for batch in batches:
            raw, beside = batch.column(batch.num_columns - 1), pa.Table.from_arrays(batch.columns[:-1], batch.schema.names[:-1])
            of, parts, n = [], [], 0

            def done():
                rows = pa.Table.from_batches(parts).combine_chunks()
                table = beside.take(pa.array(np.repeat(of, [p.num_rows for p in parts]), pa.int64()))
                for name, values in zip(arrow.names, rows.columns, strict=True):
                    table = table.append_column(name, values)
                return table.combine_chunks().to_batches(max_chunksize=ROWS)

            for i in range(batch.num_rows):
                for columns in columns_of(raw[i].as_py()):
                    parts.append(pa.RecordBatch.from_arrays([column(c, f.type) for c, f in zip(columns, arrow, strict=True)], arrow.names))
                    of.append(i)
                    n += parts[-1].num_rows
                    if n >= ROWS:
                        yield from done()
                        of, parts, n = [], [], 0
            if n:
                yield from done()

    return files.select(*kept.columns, content).mapInArrow(run, StructType([*kept.schema.fields, *made.fields]))


def as_map(metadata: DataFrame, key: str) -> DataFrame:
    """(key, metadata): repeated tags joined by line feeds."""
    joined = metadata.groupBy(key, "tag").agg(F.array_sort(F.collect_list(F.struct("position", "value"))).alias("v"))
    values: Column = F.array_join(F.transform("v", lambda x: x["value"]), "\n")
    return joined.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("tag", values))).alias("metadata"))
