"""Nearest neighbours and importance resampling against plain restatements."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolex.llm import neighbours, resample

from .corpus import awkward, empty


def plain_nearest(rows, k, every):
    """{(query id, vector): [(distance, id)]} over rows (id, vector)."""
    rows = {(i, tuple(v)) for i, v in rows}
    out = {}
    for q, u in rows:
        if q % every == 0:
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(u, v, strict=True))), i) for i, v in rows if i != q and len(v) == len(u))
            out[q, u] = near[:k]
    return out


def test_neighbours_of_the_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = plain_nearest([(r.vec_id, r.embedding) for r in table.collect()], 10, 100)
    got = {}
    for r in neighbours.search(table).collect():
        got.setdefault(r.query_id, []).append(r)
    assert {q for q, _ in want} == set(got)
    hits, distances = 0, {(r.vec_id, tuple(r.embedding)): r for r in table.collect()}
    vectors = {i: np.array(v) for i, v in distances}
    for (q, _), near in want.items():
        mine = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and len({r.vec_id for r in mine}) == 10
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        assert all(r.score == pytest.approx(float(np.linalg.norm(vectors[q] - vectors[r.vec_id])), abs=1e-12) for r in mine)
        hits += len({r.vec_id for r in mine} & {i for _, i in near})
    assert hits / (10 * len(want)) >= 0.9


@pytest.mark.parametrize("shard, block", [(512, 256), (7, 3)])
def test_a_budget_of_all_is_exact(spark, shard, block):
    """Clusters, one vector that a third of the rows share, ties, copies of queries, several blocks and shards."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(0, 4, 5) + 0.5).tolist()) for i in range(120)] + [(200 + i, [9.0, 9.0, 9.0, 9.0, 9.0]) for i in range(90)]
    rows += [(300, [9.0, 9.0, 9.0, 9.0, 8.0]), (300, [9.0, 9.0, 9.0, 9.0, 8.0]), (300, [1.0, 0.0, 0.0, 0.0, 0.0]), (301, [0.0, 0.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    want = {(q, rank + 1, i, round(d, 9)) for (q, _), near in plain_nearest([r for r in rows if any(r[1])], 10, 10).items() for rank, (d, i) in enumerate(near)}
    got = neighbours.search(frame, every=10, budget=10**9, shard_rows=shard, queries_at_once=block).collect()
    assert {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got} == want


def test_neighbours_of_awkward_vectors(spark):
    rows = [(0, [1.0, 0.5]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 0.0]), (4, [float("inf"), 0.0]), (5, [0.0, 0.0]), (6, []), (None, [1.0, 1.0]), (7, [2.0]), (100, [3.0]), (8, [1.0, 1.0]), (9, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("v", "q", "h", "cell", "rank", "score")})
    got = sorted(tuple(r) for r in neighbours.search(frame).collect())
    assert got == [(0, 1, 8, 0.5), (0, 2, 9, 0.5), (100, 1, 7, 1.0)]
    assert neighbours.search(frame.limit(0)).count() == 0 and neighbours.search(frame.where("vec_id = 8")).count() == 0


def test_the_heap_meets_cells_in_order():
    rng = np.random.default_rng(1)
    for k in (1, 2, 9):
        a, b, counts = rng.random(k), rng.random(k), rng.integers(0, 3, k * k)
        order = [c for c in np.argsort((a[:, None] + b[None]).ravel(), kind="stable").tolist() if counts[c]]
        assert neighbours.traverse(a, b, counts, 10**9) == order
        some = neighbours.traverse(a, b, counts, 5)
        assert some == order[: len(some)] and (counts[some].sum() >= 5 or some == order) and counts[some[:-1]].sum() < 5


def test_shards_are_bounded():
    counts = np.array([0, 3, 3, 3, 25, 0, 1, 9, 1])
    first, many, n = neighbours.shards(counts, 10)
    load = {}
    for cell, c in enumerate(counts.tolist()):
        for block in range(many[cell]) if c else ():
            load[first[cell] + block] = load.get(first[cell] + block, 0) + c / many[cell]
    assert set(load) == set(range(n)) and max(load.values()) <= 10 and many[4] == 3


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_draw(docs, target, share=5, least=20):
    """Rows (doc_id, n_features, weight, score, rank), with n-grams built as strings."""
    crcs = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    found = [(i, words_of(t)) for i, t in docs]
    s, t = [0] * 10000, [0] * 10000
    for _, w in found:
        for b in crcs(w):
            s[b] += 1
    for x in target:
        for b in crcs(words_of(x)):
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    rows = []
    for i, w in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in crcs(w))
        rows.append((i, len(crcs(w)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((-r[3], r[0] is not None, r[0] or 0, at) for at, r in enumerate(rows) if r[4] >= least)
    rank = {at: k + 1 for k, (*_, at) in enumerate(able[: share * len(able) // 100])}
    return [(*r[:4], rank.get(at)) for at, r in enumerate(rows)]


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_resampling(spark, sf, which, monkeypatch):
    monkeypatch.setattr(resample, "RANGE_ROWS", 50)
    docs = spark.read.parquet(f"{sf}/documents.parquet") if which == "table" else awkward(spark)
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    share = 5 if which == "table" else 40
    want = plain_draw([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [r.text for r in target.collect()], share)
    got = [tuple(r) for r in resample.resample(docs, target, share).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[4] is not None for r in want) > 5


def test_resampling_of_empty_tables(spark):
    docs = awkward(spark)
    assert resample.resample(empty(docs), docs).count() == 0
    none = resample.resample(docs, empty(docs)).collect()
    assert len(none) == docs.count() and sum(r["rank"] is not None for r in none) >= 1
    nulls = spark.createDataFrame([(1, None), (2, ""), (3, "?!")], "doc_id long, text string")
    assert {tuple(r)[1:3] + (r["rank"],) for r in resample.resample(nulls, nulls).collect()} == {(0, 0, None)}


def test_checksums_of_runs_in_parts(monkeypatch):
    rng = random.Random(1)
    texts = ["", "a", "A b", "x" * 500 + " y " + "z" * 300, "é 日本 Foo.bar\x00 \x7f q"] + ["".join(rng.choice("aB9 é.日\n") for _ in range(rng.randrange(200))) for _ in range(100)]
    for once in (8 << 20, 40, 3):
        monkeypatch.setattr(resample, "AT_ONCE", once)
        got, n = [[] for _ in texts], np.zeros(len(texts), int)
        for counts, owners, crcs in resample.features([t.encode() for t in texts]):
            n += counts
            for i, crc in zip(owners.tolist(), crcs.tolist(), strict=True):
                got[i].append(crc)
        for text, found, count in zip(texts, got, n, strict=True):
            w = words_of(text)
            assert sorted(found) == sorted(zlib.crc32(" ".join(w[i : i + k]).encode()) for k in (1, 2, 3) for i in range(len(w) - k + 1)) and count == len(w)
