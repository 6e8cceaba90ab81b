"""Each operator against a plain restatement over the same rows."""

import hashlib
import random
import re
import zlib
from functools import cache

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chronolex.llm import packing, queries, secrets, simhash, sketch, token_store, topk
from chronolex.llm.common import scratch, stored

from .corpus import awkward, empty, rows_of


def base_spans(text):
    """The base kinds as the contract states them, with Python's regex engine."""
    out = []
    kinds = [
        ("assign", r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.I | re.A),
        ("access", r"AKIA[A-Z0-9]+", 0, 20, 0),
        ("hex", r"[0-9a-f]+", 0, 24, 0),
    ]
    for rank, (kind, pattern, group, least, flags) in enumerate(kinds):
        for m in re.finditer(pattern, text or "", flags):
            if len(m[group]) >= least:
                out.append((m.start(), rank, m.end(), kind))
    return [(kind, a, b) for a, rank, b, kind in sorted(out)]


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_secrets(spark, sf, which):
    docs = spark.read.parquet(f"{sf}/documents.parquet") if which == "table" else awkward(spark)
    found = secrets.scan(docs).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        s = base_spans(r.text)
        n = [sum(k == kind for k, *_ in s) for kind in ("assign", "access", "hex")]
        want.append((r.doc_id, *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()))
    key = lambda x: tuple(str(v) for v in x)
    assert sorted([tuple(r)[:5] for r in found], key=key) == sorted(want, key=key)
    assert sum(w[1] for w in want) > 0
    assert secrets.scan(empty(docs)).count() == 0


def test_secrets_of_rows_that_share_a_key(spark):
    """A repeated row and rows without id hold the same trigrams under one key."""
    key, github = "AKIA" + "Q" * 16, "ghp_" + "x" * 36
    rows = [(1, f"a {key} b"), (1, f"a {key} b"), (None, f"{key} password=hunter22"), (None, f"c {key} {github}"), (None, "none"), (2, key)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r)[:4] for r in secrets.scan(docs).collect()]
    assert sorted(found, key=str) == sorted([(1, 0, 1, 0), (1, 0, 1, 0), (None, 1, 1, 0), (None, 0, 1, 0), (None, 0, 0, 0), (2, 0, 1, 0)], key=str)
    left = [r.text for r in secrets.redact(docs).collect()]
    assert sorted(left) == sorted(["a [secret] b"] * 2 + ["[secret] [secret]", "c [secret] [secret]", "none", "[secret]"])


def test_trigram_queries_miss_nothing():
    held = lambda text, q: any(all(g in text.lower() for g in clause) for clause in q)
    cases = {"assign": ["API_KEY=abcdef", "apikey: q", "Passwd='x"], "access": ["AKIAQQQQ"], "hex": ["00ff"], "github": ["ghp_" + "a" * 36], "private_key": ["-----BEGIN RSA PRIVATE KEY-----"], "jwt": ["eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + "." + "c" * 10]}
    for rule in secrets.RULES:
        q = secrets.trigram_query(rule.pattern)
        for text in cases.get(rule.kind, []):
            assert re.search(rule.pattern, text) and held(text, q)
    assert secrets.trigram_query("[0-9a-f]+") == {frozenset()}
    assert secrets.trigram_query("abcd(ef|gh)?x") >= {frozenset({"abc", "bcd", "cdx"})}


def test_redaction(spark):
    docs = awkward(spark)
    out = {r.doc_id: r.text for r in secrets.redact(docs).where("doc_id in (-3, 7)").collect()}
    assert out[-3] == '[secret]" token: abc [secret] [secret] é😀 [secret]' and out[7] == "one"
    assert secrets.redact(docs).columns == docs.columns and secrets.redact(docs).count() == docs.count()
    assert secrets.spans(docs).columns == [*docs.columns, "_spans_"]
    again = secrets.spans(secrets.redact(docs)).select(F.sum(F.size("_spans_"))).first()[0]
    assert again == 0
    odd = docs.selectExpr("*", "7 as _rules", "8 as _key")
    rest = [c for c in odd.columns if c != "text"]
    assert sorted(map(str, secrets.redact(odd).select(rest).collect())) == sorted(map(str, odd.select(rest).collect()))


def test_written_index_serves_other_rules(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id < 120")
    secrets.write_index(docs, str(tmp_path / "grams"))
    rules = (*secrets.BASE, secrets.Rule("word", "[Tt]hank(ed|s)|merci"))
    key = lambda r: str(r)
    want = sorted(secrets.spans(docs, rules).drop("text").collect(), key=key)
    assert sorted(secrets.spans(docs, rules, index_path=str(tmp_path / "grams")).drop("text").collect(), key=key) == want


@cache
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids_of(text, path):
    return library(path).encode(text or "", add_special_tokens=False).ids


def test_small_word_caches_change_nothing(sf):
    from chronolex.llm.tokens import Encoder

    path = queries.tokenizer_path()
    texts = [r[0] for r in duckdb.connect().execute(f"SELECT text FROM '{sf}/documents.parquet'").fetchall()]
    small = Encoder(path, cache_entries=50)
    got = [ids for k in range(0, len(texts), 7) for ids in small.encode(texts[k : k + 7])]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [ids_of(t, path) for t in texts]
    odd = ["it's 'strange' he'll 'llama ''s a 's", "a  b\t\n c \u00a0 d", " \n", "x\u00b2y\u00bd 12\u00b9", "we'RE 've'd!!'s"]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in small.encode(odd)] == [ids_of(t, path) for t in odd]


def test_ids_are_those_of_the_unchanged_library():
    """Random strings with added tokens, quotes, spaces and other scripts; null, empty and long texts."""
    from chronolex.llm.tokens import Encoder

    path, rng = queries.tokenizer_path(), random.Random(11)
    parts = ["<|endoftext|>", "<|endof", "text|>", "<|", "|>", " ", "  ", "\n", "\t", "'s", "it's", "'ll", "Wort", " word", "12", "²", "é", "日本", "😀", "—", "a", "\u00a0", "\x00", "!!"]
    texts = [None, "", "a <|endoftext|> b", "<|endoftext|>", " <|endoftext|>" * 3, "word <|endoftext|> " * 5000]
    texts += ["".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(4000)]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in Encoder(path, cache_entries=300).encode(texts)]
    assert got == [ids_of(t, path) for t in texts] and 50256 in got[2]


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_token_store(spark, sf, which):
    docs = spark.read.parquet(f"{sf}/documents.parquet") if which == "table" else awkward(spark)
    path = queries.tokenizer_path()
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want, start = [], 0
    for r in rows:
        ids = np.array([*ids_of(r.text, path), 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in token_store.round_trip(docs, path).collect()), key=lambda r: r[1]) == want
    assert token_store.round_trip(empty(docs), path).count() == 0


def test_codes_give_any_token():
    rng = np.random.default_rng(2)
    for top in (1, 200, 60_000, 1 << 31):
        ids = rng.integers(0, top, 5000).astype(np.uint32)
        codes = token_store.Codes.load(token_store.Codes.of(ids).dump())
        assert [codes.get(i) for i in range(0, 5000, 7)] == ids[::7].tolist()
        for a, b in ((0, 5000), (13, 14), (511, 1025), (4999, 5000), (77, 77)):
            assert (codes.range(a, b) == ids[a:b]).all()
    assert len(token_store.Codes.of(np.zeros(0, np.uint32))) == 0


class Counting:
    """A source that counts what is read from it."""

    def __init__(self, source):
        self.source, self.bytes, self.seek, self.tell = source, 0, source.seek, source.tell

    def read(self, n):
        raw = self.source.read(n)
        self.bytes += len(raw)
        return raw


def test_reader_random_access(spark, sf, monkeypatch):
    monkeypatch.setattr(token_store, "FILE_ROWS", 15)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    manifest = token_store.write(docs, scratch(spark, "ids"), queries.tokenizer_path(), 2, segment_bytes=50_000)
    assert manifest.count() >= 3
    for f in manifest.collect():
        system, path = token_store._filesystem(f.file)
        with system.open_input_file(path) as source:
            r = token_store.Reader(source)
            whole = np.concatenate([r.document(d) for d in range(f.documents)])
            assert len(whole) == f.tokens and [r.token(i) for i in range(0, f.tokens, 101)] == whole[::101].tolist()
            assert r.ids(0, f.documents) == sorted(r.ids(0, f.documents))
            few = token_store.Reader(Counting(source))
            few.token(f.tokens - 1)
            assert few.source.bytes < 600 < f.tokens
            with pytest.raises(IndexError):
                r.token(f.tokens)


def check_packing(rows, capacity):
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(fill)


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_packing(spark, sf, which):
    docs = spark.read.parquet(f"{sf}/documents.parquet") if which == "table" else awkward(spark)
    path = queries.tokenizer_path()
    rows = packing.pack(docs, path).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*ids_of(r.text, path), 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    bins = check_packing(rows, 2048)
    least = -(-sum(w[3] for w in want) // 2048)
    assert bins <= least * 1.02 + 1
    assert packing.pack(empty(docs), path).count() == 0


def test_best_two_fit_equals_bin_by_bin():
    """Templates with multiplicities equal the method applied to one bin after the other."""

    def single(items, capacity):
        left = sorted(items, reverse=True)
        bins = []
        while left:
            chosen = [left.pop(0)]
            gap = capacity - chosen[0]
            for x in sorted(left, reverse=True):
                if x <= gap:
                    left.remove(x)
                    chosen.append(x)
                    gap -= x
            while gap:
                small = min(chosen)
                room = gap + small
                best = None
                for a in sorted(set(left)):
                    rest = list(left)
                    rest.remove(a)
                    fits = [b for b in rest if a + b <= room and b <= a or (a + b <= room and b > a)]
                    if fits and (best is None or a + max(fits) > best[0]):
                        best = (a + max(fits), a, max(fits))
                if best is None or best[0] <= small:
                    break
                chosen.remove(small)
                left.append(small)
                for x in best[1:]:
                    left.remove(x)
                    chosen.append(x)
                gap = room - best[0]
            bins.append(tuple(sorted(chosen, reverse=True)))
        return sorted(bins)

    rng = np.random.default_rng(5)
    for _ in range(40):
        capacity = int(rng.integers(5, 60))
        items = rng.integers(1, capacity + 1, int(rng.integers(1, 60))).tolist()
        histogram = {x: items.count(x) for x in items}
        mine = packing.best_two_fit(histogram, capacity)
        assert sorted(x for lengths, n in mine for _ in range(n) for x in lengths) == sorted(items)
        assert len(single(items, capacity)) == sum(n for _, n in mine)


def test_numbering_over_several_parts(spark):
    items = stored(spark.range(3000).selectExpr("id as doc_id", "0 as piece", "cast(id % 7 * 100 + 50 as long) as length"), "items")
    rows = packing.place(items, 2048, rows_per_part=100).collect()
    assert len(rows) == 3000
    check_packing(rows, 2048)


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def plain_components(items):
    """{id: smallest id reachable} from [(id, fingerprint)]."""
    root = {i: i for i, _ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(items):
        for b, y in items[:k]:
            if (x ^ y).bit_count() <= 4:
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {i: find(i) for i, _ in items}


@pytest.mark.parametrize("pairs", [False, True])
def test_simhash(spark, sf, pairs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = [(r.doc_id, plain_simhash(r.text)) for r in rows]
    want = plain_components(prints)
    got = simhash.near_duplicates(docs, pairs=pairs).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{p:016x}", want[i]) for i, p in prints)
    assert any(want[i] != i for i in want)


def test_simhash_of_awkward_rows(spark):
    docs = awkward(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[0].fingerprint == by[1].fingerprint == by[6].fingerprint == "0" * 16 and by[6].component_id == 0
    assert by[5].component_id == 4 and by[7].fingerprint == f"{plain_simhash('one'):016x}"
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
    assert {str(r) for r in docs.collect()} >= {str(r) for r in kept.collect()}
    assert kept.where("doc_id in (0, 1, 4, 5, 6)").count() == 2
    assert simhash.near_duplicates(empty(docs)).count() == 0 and simhash.one_of_each(empty(docs)).count() == 0


def test_least_row_of_a_repeated_id_stays(spark):
    rows = [(1, "b text of its own", "y"), (1, "a text of another kind", "z"), (1, "a text of another kind", "x"), (2, None, "n"), (2, "words", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(5)
    assert sorted(map(tuple, simhash.one_of_each(docs).collect())) == [(1, "a text of another kind", "x"), (2, None, "n")]
    mapped = docs.selectExpr("*", "map('k', _row) as m")
    assert sorted((r.doc_id, r.m["k"]) for r in simhash.one_of_each(mapped).collect()) == [(1, "x"), (2, "n")]


def test_rows_without_id_are_linked(spark):
    """A row without id joins two documents; copies without any id leave one row."""
    near = [0b0, 0b1111, 0b11111111]
    prints = stored(spark.createDataFrame([(1, near[0]), (None, near[1]), (2, near[2]), (None, 1 << 40 | 1 << 50 | 1 << 60 | 31 << 20)], "doc_id long, fp long"), "prints")
    roots = {r.fp: r.component_id for r in simhash._roots(prints, 4, 4096, None).collect()}
    assert [roots[f] for f in near] == [1, 1, 1] and list(roots.values()).count(None) == 1
    rows = [(None, "copy of one text here", 1), (None, "copy of one text here", 0), (5, "another text altogether is here", 2), (None, "another text altogether is here", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _fp long")
    assert sorted(map(str, simhash.one_of_each(docs).collect())) == sorted(map(str, docs.where("_fp in (0, 2)").collect()))


@pytest.mark.parametrize("pairs", [False, True])
def test_links_cover_all_near_pairs(spark, pairs):
    """Chains and clusters of fingerprints, groups above the block size, both coverings."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    near = [int(b) for b in base]
    for b in base[:60]:
        x = int(b)
        for _ in range(6):
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(bit)
            near.append(x)
    near += [int(base[100]) ^ (1 << a) ^ (1 << b) for a in range(16) for b in range(a)]
    items = list(enumerate(dict.fromkeys(near)))
    frame = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in items], "node long, fp long")
    edges = stored(simhash.links(frame, block_rows=32, pairs=pairs), "edges")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert {i: roots.get(i, i) for i, _ in items} == plain_components(items)
    assert edges.count() < len(items) * 20


def test_components_of_a_long_chain(spark):
    edges = spark.range(500).selectExpr("id as a", "id + 1 as b")
    rows = simhash.components(edges).collect()
    assert {(r.node, r.root) for r in rows} == {(i, 0) for i in range(501)}


def test_topk(spark, sf):
    rows = rows_of(sf, "embeddings")
    v = {r[0]: np.floor(256 * np.array(r[1], np.float64)).astype(np.int64) for r in rows}
    want = []
    for q in (x for x in v if x % 50 == 0):
        best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:5]
        want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(best)]
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert sorted(tuple(r) for r in topk.top_k(table).collect()) == sorted(want)
    assert sorted(tuple(r) for r in topk.top_k(table, bins=64, query_block=6).collect()) == sorted(want)


def test_topk_of_awkward_vectors(spark):
    rows = [(0, [1.0, 0.5]), (50, [0.25, 1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 0.0]), (4, [float("inf"), 0.0]), (5, [1.0]), (None, [1.0, 1.0])]
    rows += [(i, [1.0, 1.0]) for i in range(10, 40)] + [(100, [1.0, 1.0]), (41, [1.0, 1.0]), (41, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).withColumn("score", F.lit(1))
    got = sorted(tuple(r) for r in topk.top_k(frame).collect())
    assert [r[2] for r in got if r[0] == 0] == [10, 11, 12, 13, 14] and [r[2] for r in got if r[0] == 100] == [10, 11, 12, 13, 14]
    few = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.25, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few).collect()] == [(0, 1, 1, 256 * 64 + 128 * 256)]
    assert topk.top_k(frame.limit(0)).count() == 0


def test_topk_of_large_repeated_and_unequal_vectors(spark):
    rng = np.random.default_rng(6)
    big = rng.integers(-3_000_000, 3_000_000, (200, 16)).astype(np.float64)
    rows = [(i, v.tolist()) for i, v in enumerate(big)] + [(50, big[50].tolist()), (50, big[51].tolist()), (3, big[3].tolist())]
    rows += [(1000 + i, [float(i)]) for i in range(8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = [(i, [int(np.floor(256 * x)) for x in e]) for i, e in rows]
    want = []
    for q, e in {(i, tuple(e)) for i, e in v if i % 50 == 0}:
        best = sorted((-sum(a * b for a, b in zip(e, c, strict=True)), i) for i, c in v if i != q and len(c) == len(e))[:5]
        want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    assert max(abs(w[3]) for w in want) > 2**60
    assert sorted(tuple(r) for r in topk.top_k(frame).collect()) == sorted(want)
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e9]), (1, [1e9])], "vec_id long, embedding array<double>"), scale=1 << 20)


def signed_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (h >> 63 << 64)


def plain_fingerprints(rows):
    rows = sorted(((r.doc_id, r.text or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed_hash(r[1]), r[1]))
    for (i, text), (_, other) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        yield i, len(text), hashlib.sha256((text[: len(text) - half] + other[:half]).encode()).hexdigest()


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_fingerprints(spark, sf, which):
    docs = spark.read.parquet(f"{sf}/documents.parquet") if which == "table" else awkward(spark)
    key = lambda x: (x[0] is not None, x[0] or 0, x[2])
    got = sketch.fingerprints(docs).collect()
    assert sorted((tuple(r)[:3] for r in got), key=key) == sorted(plain_fingerprints(docs.select("doc_id", "text").collect()), key=key)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    prints = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id in text:
            prints.setdefault(text[r.doc_id], set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert sketch.fingerprints(empty(docs)).count() == 0


@pytest.mark.parametrize("which", ["table", "awkward", "hot"])
def test_next_over_many_ranges(spark, sf, which, monkeypatch):
    monkeypatch.setattr(sketch, "BUCKETS_A_TASK", 1)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text") if which == "table" else awkward(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if which == "hot":  # a third of the rows share one id, a third have none
        ids = F.when(F.col("n") % 3 == 0, F.lit(7)).when(F.col("n") % 3 == 1, F.col("n"))
        docs = spark.range(900).select(F.col("id").alias("n")).select(ids.cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("n").cast("string")).alias("text"))
    got = sketch.with_next(docs, ["text"], bucket_bytes=500)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, signed_hash(r[1]), r[1]))
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.text, r.next_text) for r in got.collect()), key=key) == sorted(((*a, b[1]) for a, b in zip(rows, rows[1:] + rows[:1], strict=True)), key=key)
    if which == "hot":
        sizes = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert max(sizes) < 250


def shingles_of(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_sketch(text):
    """Every shingle hash below half of the hash space: of the words' hashes, chained from the seed as Spark hashes several values."""
    words = [signed_hash(w) for w in (text or "").lower().split()]

    def chained(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), seed)
        return seed - (seed >> 63 << 64)

    shingles = [words[i : i + 5] for i in range(len(words) - 4)] or ([words] if words else [])
    return sorted(h for h in {chained(s) for s in shingles} if h < 0)


def test_sketches_hold_every_hash_below_the_fraction_and_no_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    want = {}
    for (i, text), (_, other) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        a, e, n = map(plain_sketch, (text, text[: len(text) - half] + other[:half], other))
        near = lambda x, y: float(x == y) if not x or not y else len(set(x) & set(y)) / len(x)
        want[i] = (",".join(f"{h % (1 << 64):016x}" for h in a), ",".join(f"{h % (1 << 64):016x}" for h in e), near(a, e), near(a, n))
    got = {r.doc_id: (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in sketch.fingerprints(docs).collect()}
    assert got == want and sketch.FRACTION == 0.5


def test_sketches_against_exact_containment(spark, sf):
    """Likeness to the edited text and to the next document, of every document, against sets of shingles, by length."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    off = {}
    exact = {}
    for (i, text), (_, other) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        own, edited, following = (shingles_of(t) for t in (text, text[: len(text) - half] + other[:half], other))
        exact[i] = (len(own & edited) / len(own), len(own & following) / len(own), len(own)) if own else (float(not edited), float(not following), 0)
    for r in sketch.fingerprints(docs).collect():
        edited, following, n = exact[r.doc_id]
        off.setdefault(min(3, len(str(n // 10 * 10)) if n >= 10 else 1), []).append((abs(r.near_edited - edited), abs(r.near_next - following)))
    for digits, most in ((2, 0.11), (3, 0.045)):  # 10 to 99 shingles, 100 and more
        assert np.mean([e for e, _ in off[digits]]) < most and np.mean([n for _, n in off[digits]]) < 0.01


def test_sketches_estimate_containment_and_merge(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 20_000)]
    rows = [(" ".join(words), " ".join(words[5000:7000])), ("a b c", "a b c"), ("", ""), ("", "x y z w v u t s r q p"), (" ".join(words[:50]), " ".join(words[30:90])), (" ".join(words[:300]), " ".join(words[200:280]))]

    def hashes(name):
        words = F.split(name, " ")
        return F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*(F.xxhash64(F.get(words, i + k)) for k in range(5))))

    whole = F.array_union(hashes("big"), hashes("small"))
    frame = spark.createDataFrame(rows, "big string, small string")
    two = frame.select(sketch.sketch(F.col("big")).alias("b"), sketch.sketch(F.col("small")).alias("s"), F.when(F.size(F.split("big", " ")) > 4, sketch.kept(whole)).alias("both"))
    r = two.select(sketch.containment(F.col("s"), F.col("b")).alias("in"), sketch.containment(F.col("b"), F.col("s")).alias("out"), (sketch.merged(F.col("b"), F.col("s")) == F.col("b")).alias("m"), (sketch.merged(F.col("b"), F.col("s")) == F.col("both")).alias("same")).collect()
    assert r[0]["in"] == 1.0 and abs(r[0]["out"] - 0.1) < 0.03 and r[0]["m"]
    assert r[1]["in"] == 1.0 and r[2]["in"] == 1.0 and r[3]["out"] == 0.0
    assert [x["m"] for x in r[:3]] == [True, True, True] and all(r[i]["same"] for i in (0, 4, 5))
