"""Whole-text token ids with the `tokenizers` library, at the cost of distinct words.

A byte-level BPE works on each pre-token alone, so a text's ids are the joined ids
of its pre-tokens. Words repeat, so each worker encodes a distinct pre-token once
(through the library) and joins packed ids. The split is done here only for texts
of plain Latin characters, whose classes are listed below in full; any other text
goes to the library whole, so no Unicode table of another engine is trusted. So does
a text that holds a string of the file's added tokens (such as <|endoftext|>), which
the library reads as that token. The ids are those the library gives for the whole text
with add_special_tokens=False.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from itertools import chain, compress
from operator import not_

import numpy as np

# The classes, within U+0000..U+024F, that byte-level pre-tokenisation tells apart.
LETTER = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
NUMBER = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\u00a0"
PLAIN = re.compile(f"[\\t\\n\\r -~\u00a1-\u024f]*")
SPLIT = re.compile(  # words first: no other branch begins as they do
    f" ?[{LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[^{SPACE}{LETTER}{NUMBER}]+| ?[{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)

LINES = 20  # words read from one text; short texts are the library's fastest


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    The word cache has two generations of about `cache_entries` each: a full one becomes the
    older, words met again move to the new one, and the rest go with the next change.
    """

    def __init__(self, path: str, cache_entries: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        (self.line_feed,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache_entries = cache_entries

    def _library(self, texts: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Encode unseen pre-tokens. Those without white space but for a leading space are read from
        short texts, a line each: a line feed around them leaves them a pre-token of their own."""
        lines = [w for w in new if not w.isspace()]
        if lines:
            texts = ["\n".join(lines[k : k + LINES]) + "\n" for k in range(0, len(lines), LINES)]
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(e.ids for e in found), "<u4")
            feeds = np.flatnonzero(ids == self.line_feed)  # no piece has a line feed of its own
            if len(feeds) != len(lines):
                raise ValueError("pre-tokens were not kept apart")
            packed, ends = ids.tobytes(), (feeds * 4).tolist()
            starts = [0, *(feeds * 4 + 4).tolist()]
            self.cache.update(zip(lines, (packed[a:b] for a, b in zip(starts, ends, strict=False)), strict=True))
        spaces = [w for w in new if w.isspace()]
        if spaces:
            self.cache.update(zip(spaces, self._library(spaces), strict=True))

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Packed ids of each text; null is empty."""
        out: list[bytes] = [b""] * len(texts)
        if len(self.cache) > self.cache_entries:
            self.older, self.cache = self.cache, {}
        get = self.cache.get
        open_: list[tuple[int, list[bytes | None], list[int], list[str]]] = []
        whole: list[int] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if not PLAIN.fullmatch(text) or (self.added and self.added.search(text)):
                whole.append(i)
                continue
            pieces = SPLIT.findall(text)
            ids = list(map(get, pieces))
            if None in ids:
                places = list(compress(range(len(ids)), map(not_, ids)))
                open_.append((i, ids, places, [pieces[k] for k in places]))
            else:
                out[i] = b"".join(ids)
        missed = set().union(*(words for *_, words in open_))
        again = {w: known for w in missed if (known := self.older.get(w))}
        self.cache.update(again)
        new = [w for w in missed if w not in again]
        if new:
            self._learn(new)
        for i, ids, places, words in open_:
            for k, w in zip(places, words, strict=True):
                ids[k] = self.cache[w]
            out[i] = b"".join(ids)
        for i, ids in zip(whole, self._library([texts[i] for i in whole]) if whole else [], strict=True):
            out[i] = ids
        return out


CACHE_ENTRIES = 400_000
_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache_entries: int = CACHE_ENTRIES) -> Encoder:
    """One encoder for each worker process, vocabulary file and cache size."""
    if (path, cache_entries) not in _encoders:
        _encoders[path, cache_entries] = Encoder(path, cache_entries)
    return _encoders[path, cache_entries]
