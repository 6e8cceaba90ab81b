"""Alignment of two tokenizers against whole texts encoded by the libraries, and the perfect hash."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pytest

from chronolex.llm import alignment, perfect_hash
from chronolex.llm.queries import tokenizer_path

from .corpus import awkward, empty

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@cache
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    names = {i: t for t, i in a.get_vocab().items()}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    b = SentencePieceProcessor(model_file=B)

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    return a, b, lambda i: bytes(table[c] for c in names[i]), piece


def plain_groups(text):
    """(ids of A, ids of B, groups, links) by sets of byte places; None without tokens."""
    if not text:
        return None
    a, b, bytes_a, bytes_b = libraries()
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw = (" " + text).encode()
    cut = []
    for side, of in zip(ids, (bytes_a, bytes_b), strict=True):
        if b"".join(map(of, side)) != raw:
            return None
        ends = np.cumsum([len(of(i)) for i in side]).tolist()
        cut.append(list(zip([0, *ends[:-1]], ends, side, strict=True)))
    both = sorted({e for _, e, _ in cut[0]} & {e for _, e, _ in cut[1]})
    inside = [[[] for _ in both] for _ in cut]
    for side, out in zip(cut, inside, strict=True):
        for _, e, i in side:
            out[bisect_left(both, e)].append(str(i))
    groups = ";".join(",".join(x) + "|" + ",".join(y) for x, y in zip(*inside, strict=True))
    links, k = [], 0
    for s, e, i in cut[0]:
        while cut[1][k][1] <= s:
            k += 1
        m = k
        while m < len(cut[1]) and cut[1][m][0] < e:
            links.append((i, cut[1][m][2]))
            m += 1
    return *ids, groups, links


def plain_rows(rows):
    found = [(i, plain_groups(t)) for i, t in rows]
    count = Counter(p for _, g in found if g for p in set(g[3]))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    for i, g in found:
        if g is None:
            yield i, 0, 0, 0, 0, 0, 0, ""
        else:
            a, b, groups, links = g
            yield i, len(a), len(b), groups.count(";") + 1, len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(groups.encode()).hexdigest()


@pytest.mark.parametrize("which, at_once", [("table", 4_000_000), ("awkward", 4_000_000), ("awkward", 60)])
def test_alignment(spark, sf, which, at_once):
    docs = spark.read.parquet(f"{sf}/documents.parquet") if which == "table" else awkward(spark)
    want = sorted(plain_rows([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]), key=str)
    got = alignment.align(docs, A, B, at_once)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sum(r[4] for r in want) > 1000


def test_alignment_of_empty_tables_and_texts(spark):
    docs = awkward(spark)
    assert alignment.align(empty(docs), A, B).count() == 0
    none = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string")
    assert {tuple(r)[1:] for r in alignment.align(none, A, B).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_parts_give_what_whole_texts_give():
    rng = random.Random(7)
    parts = [" ", "  ", "\n", "\t", "\r", "\x1c", "\u00a0", "\u3000", "a", "word", "Wort", "it's", "'ll", "12", "\u00e9", "e\u0301", "日本", "😀", "▁", "<s>", "<|endoftext|>", "<0x0A>", ";\r", "—", "!!", "ﬁ", "\u00ad", "\x00"]
    texts = [None, "", " ", "  ", "foo ", " foo", "foo  bar\n x", "a▁b c", "▁", "x" * 300 + " y", *("".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(3000))]
    enc = alignment.Encoders(A, B, cache_entries=500)
    assert enc.cuts
    for at in range(0, len(texts), 50):
        some = texts[at : at + 50]
        ids = list(enc.encode(some))
        links = alignment.Links(pa.RecordBatch.from_pydict({"a": pa.array([i[0] for i in ids], pa.binary()), "b": pa.array([i[1] for i in ids], pa.binary())}), enc.tokens)
        per = np.split(links.pairs, np.cumsum(links.columns()[3])[:-1])
        for text, written, pairs, n in zip(some, links.written(), per, zip(*links.columns(), strict=True), strict=True):
            want = plain_groups(text)
            assert written == (want[2] if want else ""), text
            assert sorted(pairs.tolist()) == sorted(a * alignment.SECOND + b for a, b in (want[3] if want else []))
            assert n == ((len(want[0]), len(want[1]), want[2].count(";") + 1, len(want[3])) if want else (0, 0, 0, 0))


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(0)
    for n, shards in ((0, 1), (1, 3), (1000, 1), (50_000, 4)):
        keys = np.unique(rng.integers(0, 1 << 48, n))
        dealt = perfect_hash.shard_of(keys, shards)
        table = perfect_hash.PerfectHash.of([perfect_hash.build(keys[dealt == s]) for s in range(shards)])
        assert sorted(table.numbers(keys).tolist()) == list(range(len(keys))) and len(table) == len(keys)
        other = np.setdiff1d(rng.integers(0, 1 << 48, 500), keys)
        assert (table.numbers(other) == -1).all()
        assert table.bits.nbytes * 8 < 5 * len(keys) + 5000
