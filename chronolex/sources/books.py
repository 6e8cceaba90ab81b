"""Scanned-book XML: metadata, words and texts, from plain, gz or bz2 files."""

from __future__ import annotations

import bz2
import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TAG = re.compile(r"""<([^<>"]*+(?:"[^"]*+"[^<>"]*+)*+)>""")
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"'}


def content(raw: bytes) -> str | None:
    """Text of a file, decompressed by its first bytes; None if it is cut short or broken."""
    try:
        if raw[:2] == b"\x1f\x8b":
            raw = gzip.decompress(raw)
        elif raw[:3] == b"BZh":
            raw = bz2.decompress(raw)
        return raw.decode("utf-8", "replace")
    except (OSError, EOFError, ValueError):
        return None


def decoded(text: str) -> str:
    """Four entities are decoded, every other one is dropped."""
    return re.sub(r"&([^;<&\s]*);", lambda m: ENTITIES.get(m[1], ""), text) if "&" in text else text


def elements(xml: str) -> Iterator[tuple[str, str]]:
    """(bare tag name, text up to the next tag), in order."""
    tags = list(TAG.finditer(xml))
    for i, m in enumerate(tags):
        end = tags[i + 1].start() if i + 1 < len(tags) else len(xml)
        name = m[1].split(None, 1)[0] if m[1].split() else ""
        yield name, xml[m.end() : end]


def words(xml: str) -> list[str]:
    """Contents of every <w>, untrimmed, without empty ones."""
    return [t for name, raw in elements(xml) if name == "w" and (t := decoded(raw))]


def metadata(xml: str, keys: list[str] | None = None) -> dict[str, str]:
    """Contents by bare tag name. With keys: the first of each that is not empty, entities left as they are. Else all before the text, as they
    stand but for decoded entities, repeated ones joined by line feeds."""
    out: dict[str, str] = {}
    for name, raw in elements(xml):
        if keys is None and name in ("/metadata", "text"):
            break
        if not name or name[0] in "/?!" or name in ("metadata", "w"):
            continue
        if keys is not None:
            if raw.strip() and name in keys and name not in out:
                out[name] = raw
                if len(out) == len(keys):
                    break
        else:
            out[name] = f"{out[name]}\n{decoded(raw)}" if name in out else decoded(raw)
    return out


def text(xml: str) -> str:
    """Trimmed words joined by spaces; <pb> and <lb> turn the space before them into a line feed."""
    out = ""
    for name, raw in elements(xml):
        if name in ("pb", "lb"):
            out = out[:-1] + "\n" if out.endswith(" ") else out + "\n"
        elif name == "w" and (w := decoded(raw).strip()):
            out += w + " "
    return out.rstrip(" ")


BOOK = "path string, metadata map<string,string>, words array<string>, text string"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            xml = content(raw or b"")
            rows.append((path, [], [], "") if xml is None else (path, list(metadata(xml).items()), words(xml), text(xml)))
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["path", "metadata", "words", "text"])


def parse(files: DataFrame) -> DataFrame:
    """(path, metadata, words, text) from (path, content); broken files have no words."""
    return files.select("path", "content").mapInArrow(_parse, BOOK)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.format("binaryFile").load(path))
