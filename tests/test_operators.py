"""Operators against plain restatements, and every registered query against its SQL."""

import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolex import registry
from chronolex.functions.kernels import dtw, lcs
from chronolex.operators import cluster, dedup, index, similarity, temporal
from chronolex.sources import lists
from chronolex.streaming import counts as streaming

F1 = [[9, 9, 0, 0, 0], [0, 8, 7, 0, 0], [4, 8, 2, 0, 0], [0, 1, 4, 6, 2], [1, 0, 2, 8, 2], [0, 0, 2, 5, 5]]


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{t}'")
    frame = registry.QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    mine = sorted((tuple(r[k] for k in columns) for r in frame.collect()), key=str)
    found = c.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert mine == sorted((tuple(r[names.index(k)] for k in columns) for r in found.fetchall()), key=str)


def similar(a, b):
    if int(abs(len(a) - len(b)) / min(len(a), len(b))) > 0.5:
        return False
    x, y = set(a), set(b)
    share = len(x & y) / max(len(x), len(y))
    if share > 0.85 or share < 0.5:
        return share > 0.85
    a, b = [w for w in a if w in x & y], [w for w in b if w in x & y]
    return lcs(a, b) / min(len(a), len(b), 2000) > 0.5


def test_pairs_barrels_and_sample(spark):
    sf = "/root/testdata/sf0.001"
    docs = dedup.documents(spark.read.parquet(f"{sf}/documents.parquet"))
    words = {r.idx: r.words for r in docs.collect()}
    titles = {r.idx: r.title for r in docs.collect()}
    reps, members = dedup.representatives(docs)
    rep = {r.idx: r.rep for r in members.collect()}
    assert all(words[i] == words[r] for i, r in rep.items())
    heads = sorted(set(rep.values()))
    want = {(a, b) for a in heads for b in heads if a < b and similar(words[a], words[b])}
    assert {(r.a, r.b) for r in dedup.similar_pairs(reps).collect()} == want
    got = {r.idx for r in dedup.barrel_compare(docs.where("idx % 2 = 0"), docs.where("idx % 2 = 1")).collect()}
    assert got == {b for b in words if b % 2 and any(similar(words[a], words[b]) for a in words if a % 2 == 0)}
    order = [r.idx for r in docs.orderBy(F.md5(F.concat(F.lit(f"{0xDEADBEEF}:"), F.col("idx").cast("string"))), "idx").collect()]
    share = lambda a, b: len(set(words[a]) & set(words[b])) / max(len(set(words[a])), len(set(words[b])))
    half = {(a, b, share(a, b)) for a in heads for b in heads if a < b and share(a, b) >= 0.5}
    for options in ({}, {"block": 3}):
        assert {tuple(r) for r in dedup.overlaps(reps, **options).collect()} == half
    kept = []
    for i in order:
        if not any(similar(words[i], words[j]) or (titles[i] and titles[i] == titles[j]) for j in kept):
            kept.append(i)
    assert {r.idx for r in dedup.sample_unique(docs, 10_000).collect()} == set(kept)
    assert {r.idx for r in dedup.sample_unique(docs, 7).collect()} == set(kept[:7])
    assert {r.idx for r in dedup.sample_unique(docs, 60, batch=10).collect()} == set(kept[:60])


def test_keys_of_several_words_find_all_pairs(spark):
    """Few words in many documents: keys grow to several words; also two sets, and sizes from one word on."""
    rng = random.Random(5)
    sets = {i: rng.sample([f"w{k}" for k in range(17)], rng.choice([1, 2, 3, 4, 5, 7, 9, 12])) for i in range(90)}
    docs = spark.createDataFrame(list(sets.items()), "idx long, words array<string>")
    share = lambda a, b: len(set(sets[a]) & set(sets[b])) / max(len(sets[a]), len(sets[b]))
    want = {(a, b, share(a, b)) for a in sets for b in sets if a < b and share(a, b) >= 0.5}
    parts = dedup.meeting_rows(dedup.ranked_sets(docs), dear=0.05, worth=0.0)
    assert len(parts) > 3
    for options in ({}, {"dear": 0.05, "worth": 0.0, "block": 4}):
        assert {tuple(r) for r in dedup.overlaps(docs, **options).collect()} == want
    odd, even = docs.where("idx % 2 = 1"), docs.where("idx % 2 = 0")
    across = {(a, b, share(a, b)) for a in sets for b in sets if a % 2 and not b % 2 and share(a, b) >= 0.5}
    for options in ({"dear": 0.05, "worth": 0.0},):
        assert {tuple(r) for r in dedup.overlaps(odd, even, **options).collect()} == across


def test_meetings_grow_with_the_documents(spark):
    """Ten times the documents over the same words: rows of keys and meetings for each document grow far less."""
    rng = random.Random(9)
    cost = {}
    for n in (1000, 10_000):
        rows = [(i, [f"w{min(int(rng.expovariate(1 / 60)), 400)}" for _ in range(14)]) for i in range(n)]
        parts = dedup.meeting_rows(dedup.ranked_sets(spark.createDataFrame(rows, "idx long, words array<string>")))
        cost[n] = (sum(p.count() for p in parts) + dedup.meetings(parts, True).count()) / n
    assert cost[10_000] < 5 * cost[1000]


def test_blocks_find_all_pairs_and_shuffle_no_meetings(spark):
    """Documents met by blocks, in one set and across two, with several blocks of one size; no pair leaves a group but those found."""
    rng = random.Random(7)
    sets = {i: rng.sample([f"w{k}" for k in range(40)], rng.choice([1, 2, 3, 4, 5, 7, 9, 12, 12, 12, 25])) for i in range(160)}
    docs = spark.createDataFrame(list(sets.items()), "idx long, words array<string>")
    share = lambda a, b: len(set(sets[a]) & set(sets[b])) / max(len(sets[a]), len(sets[b]))
    want = {(a, b, share(a, b)) for a in sets for b in sets if a < b and share(a, b) >= 0.5}
    for words in (60, 10_000):
        found = dedup.overlaps(docs, keyed_upto=0, words=words)
        assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    odd, even = docs.where("idx % 2 = 1"), docs.where("idx % 2 = 0")
    across = {(a, b, share(a, b)) for a in sets for b in sets if a % 2 and not b % 2 and share(a, b) >= 0.5}
    assert sorted(tuple(r) for r in dedup.overlaps(odd, even, keyed_upto=0, words=60).collect()) == sorted(across)
    plan = dedup.block_overlaps(dedup.ranked_sets(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("CoGroup") == 1
    assert dedup.overlaps(docs.limit(0), keyed_upto=-1).collect() == []


def test_blocks_join_no_words_with_their_frequencies(spark, monkeypatch):
    """Beyond the keyed size words are ordered by a bounded table of buckets; whatever shares a bucket, or is counted in parts, all pairs are found."""
    rng = random.Random(11)
    sets = {i: rng.sample([f"w{k}" for k in range(60)], rng.choice([1, 2, 3, 8, 20, 33, 40, 41, 50])) + [f"own{i}x{k}" for k in range(i % 4)] for i in range(150)}
    docs = spark.createDataFrame(list(sets.items()), "idx long, words array<string>")
    share = lambda a, b: len(set(sets[a]) & set(sets[b])) / max(len(sets[a]), len(sets[b]))
    want = sorted((a, b, share(a, b)) for a in sets for b in sets if a < b and share(a, b) >= 0.5)
    labels, kept = [], dedup.stored
    monkeypatch.setattr(dedup, "stored", lambda d, label: (labels.append(label), kept(d, label))[1])
    for buckets, cells, events in ((1 << 20, 100_000, 2_000_000), (8, 300, 70)):
        for n, v in (("BUCKETS", buckets), ("CELLS", cells), ("EVENTS", events)):
            monkeypatch.setattr(dedup, n, v)
        assert sorted(tuple(r) for r in dedup.overlaps(docs, keyed_upto=0, words=700).collect()) == want
    odd, even = docs.where("idx % 2 = 1"), docs.where("idx % 2 = 0")
    across = sorted((a, b, share(a, b)) for a in sets for b in sets if a % 2 and not b % 2 and share(a, b) >= 0.5)
    assert sorted(tuple(r) for r in dedup.overlaps(odd, even, keyed_upto=0, words=700).collect()) == across
    assert set(labels) <= {"vocabulary", "block-pairs"}


def test_a_block_meets_itself_in_any_order_of_rows():
    """A cluster sends the two sides of a group in different orders: no pair is lost or found twice."""
    import pyarrow as pa

    rng = random.Random(2)
    sets = [sorted(rng.sample(range(40), 20)) for _ in range(60)]
    block = pa.table({"idx": pa.array(range(60)), "n": pa.array([20] * 60, pa.int32()), "lone": pa.array([0] * 60, pa.int32()), "set": pa.array(sets, pa.list_(pa.int64()))})
    want = [(a, b) for a in range(60) for b in range(a + 1, 60) if len(set(sets[a]) & set(sets[b])) >= 10]
    order = rng.sample(range(60), 60)
    found = dedup._met(block, block.take(pa.array(order)), True)
    assert sorted((min(p), max(p)) for p in zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True)) == want and want


def test_words_of_a_text_are_found_once(spark, sf):
    plan = dedup.documents(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_near_duplicates_in_rounds_leave_no_shuffled_files(spark, monkeypatch):
    """Groups and pairs met in several rounds give the same pairs; copies are dropped without a shuffle of words."""
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(30)] for _ in range(12)]
    texts = [[w if rng.random() > 0.15 else f"x{rng.randrange(50)}" for w in base[i % 12]] for i in range(60)] + base[:5] + base[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "idx long, words array<string>")
    reps, members = dedup.representatives(docs)
    plan = reps._jdf.queryExecution().executedPlan().toString()
    assert reps.count() == 65 and members.where("idx <> rep").count() == 5 and "Exchange hashpartitioning" not in plan
    monkeypatch.setattr(dedup, "BROADCAST_COPIES", 0)
    assert sorted(map(tuple, dedup.representatives(docs)[0].collect())) == sorted(map(tuple, reps.collect()))
    want, labels, kept = sorted(tuple(r) for r in dedup.similar_pairs(reps).collect()), [], dedup.stored
    monkeypatch.setattr(dedup, "stored", lambda d, label: (labels.append(label), kept(d, label))[1])
    monkeypatch.setattr(dedup, "ROUND", 1)
    assert sorted((r.a, r.b) for r in dedup.overlaps(reps, keyed_upto=0, words=60).where("overlap > 0.85").collect()) == [(r.a, r.b) for r in dedup.overlaps(reps).where("overlap > 0.85").orderBy("a", "b").collect()]
    assert labels.count("block-pairs") > 1
    band = dedup.overlaps(reps).where("overlap <= 0.85").withColumn("words", F.lit(60).cast("long"))
    close = sorted((r.a, r.b) for r in dedup.close_pairs(band, reps, reps, at_once=600).collect())
    assert labels.count("close-pairs") > 1 and close and set(close) <= set(want)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_pairs_of_whole_texts(spark, tmp_path):
    """`dup_pairs_full` compares whole texts: words beyond the first 2,000 common ones decide, either way. The operator's default keeps the reference's limit."""
    first, rest = range(2000), range(2000, 5000)
    orders = {0: [*first, *rest], 1: [*first, *reversed(rest)], 2: [*first, *rest], 3: [*reversed(first), *rest]}
    own = {i: " ".join(f"own{i}x{k}" for k in range(1200)) for i in orders}
    rows = [(i, " ".join(f"{'v' if i < 2 else 'w'}{k}" for k in order) + " " + own[i]) for i, order in orders.items()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in registry.QUERIES["dup_pairs_full"](spark, str(tmp_path)).collect()] == [(2, 3)]
    reps, _ = dedup.representatives(dedup.documents(spark.read.parquet(f"{tmp_path}/documents.parquet")))
    assert [tuple(r) for r in dedup.similar_pairs(reps).collect()] == [(0, 1)]
    assert "2000" not in registry.ORACLE_SQL["dup_pairs_full"] and "2000" in registry.ORACLE_SQL["barrel_compare"]


def test_copies_in_barrels_are_compared_once(spark, monkeypatch):
    """Groups of copies on both sides: all copies are named, one of each side is compared."""
    seen = []
    compare = dedup.similar_pairs
    monkeypatch.setattr(dedup, "similar_pairs", lambda left, right: (seen.append((left.count(), right.count())), compare(left, right))[1])
    rows = [(i, ["a", "b", "c"] if i % 4 < 2 else ["a", "b", "c", "d", "e"] if i % 4 == 2 else ["x", str(i)]) for i in range(40)]
    docs = spark.createDataFrame(rows, "idx long, words array<string>")
    got = sorted(r.idx for r in dedup.barrel_compare(docs.where("idx % 2 = 0"), docs.where("idx % 2 = 1")).collect())
    assert got == [i for i in range(40) if i % 4 == 1] and seen == [(2, 11)]


def test_a_sample_stops_at_its_size(spark, monkeypatch):
    """What is compared depends on n, not on the table."""
    seen = []
    compare = dedup.similar_pairs
    monkeypatch.setattr(dedup, "similar_pairs", lambda left, right=None: (seen.append(left.count() + (right.count() if right is not None else 0)), compare(left, right))[1])
    for n in (400, 4000):
        rows = spark.range(n).selectExpr("id as idx", "cast(id as string) as title", "array('a', cast(id as string), cast(id * 7 as string), cast(id * 11 as string), cast(id + 9999 as string)) as words")
        assert dedup.sample_unique(rows, 20).count() == 20
    assert max(seen) < 100


def plain_kmeans(rows, k, balanced=False):
    def distance(a, b):
        norm = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return 1 - sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm else 0.0

    centres, sizes, first = [rows[i * (len(rows) // k)] for i in range(k)], [0] * k, []
    for r in rows:
        over = [c for c in range(k) if (sizes[c] < len(rows) // k if balanced else sizes[c] > len(rows) // k)] or range(k)
        first.append(min(over, key=lambda c: (distance(r, centres[c]), c)))
        sizes[first[-1]] += 1
    sums = [[sum(x) for x in zip(*[r for r, c in zip(rows, first, strict=True) if c == j], strict=True)] or [0] * len(rows[0]) for j in range(k)]
    return [min(range(k), key=lambda c: (distance(r, sums[c]), c)) for r in rows]


def test_two_pass_k_means(spark):
    frame = spark.createDataFrame(list(enumerate(F1)), "row_idx long, vec array<int>")
    assert [r.cluster for r in cluster.k_means(frame, 2).orderBy("row_idx").collect()] == [0, 0, 0, 1, 1, 1]
    rows = [[(i * 7 + j * j) % 11 + 1 for j in range(4)] for i in range(90)]
    frame = spark.createDataFrame(list(enumerate(rows)), "row_idx long, vec array<int>")
    assert [r.cluster for r in cluster.k_means(frame, 4, chunk=16).orderBy("row_idx").collect()] == plain_kmeans(rows, 4)
    assert [r.cluster for r in cluster.k_means(frame, 4, balanced=True, chunk=16).orderBy("row_idx").collect()] == plain_kmeans(rows, 4, True)
    gaps = frame.selectExpr("row_idx * 3 - 50 as row_idx", "vec")
    assert [r.cluster for r in cluster.k_means(gaps, 4).orderBy("row_idx").collect()] == plain_kmeans(rows, 4)
    assert cluster.k_means(frame.limit(0), 4).count() == 0
    for bad in (frame.union(frame.limit(1)), frame.selectExpr("row_idx", "if(row_idx = 3, null, vec) as vec"), frame.selectExpr("row_idx", "if(row_idx = 3, array(1), vec) as vec")):
        with pytest.raises(ValueError, match="one length"):
            cluster.k_means(bad, 4)
    with pytest.raises(ValueError):
        cluster.k_means(frame, 90)


def test_parts_and_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat the dog"), (2, "a cat"), (3, None)], "doc_id long, text string")
    for part in ("names", "lengths", "counts", "postings", "postings.porter"):
        index.build_part(docs, part, str(tmp_path / "index"), 0)
    assert index.open_part(spark, str(tmp_path / "index")).columns == ["term", "doc_id", "positions"]
    with pytest.raises(ValueError):
        index.build_part(docs, "nothing", str(tmp_path / "index"))
    assert temporal.parse_query("$1850") == ("step", 1850) and temporal.parse_query("$2050")[0] == "term"
    docs.where("text is not null").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    streaming.keep_counts(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert {(r.term, r.tf) for r in streaming.totals(spark, str(tmp_path / "out")).collect()} == {("the", 2), ("cat", 2), ("dog", 1), ("a", 1)}
    table = spark.createDataFrame([("b", [1.0, 2.0]), ("a", [0.0, 3.0])], "term string, counts array<double>")
    lists.write_count_table(table, str(tmp_path / "counts"), "gzip")
    assert {(r.term, tuple(r.counts)) for r in lists.count_table(lists.lines(spark, str(tmp_path / "counts"))).collect()} == {("b", (1.0, 2.0)), ("a", (0.0, 3.0))}


def by_document(spark, sf):
    """Each term's counts over all documents, plainly."""
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    out = {}
    for i, r in enumerate(rows):
        for word, n in Counter(re.findall("[a-z0-9]+", r.text.lower())).items():
            out.setdefault(word, np.zeros(len(rows)))[i] = n
    return out


def test_word_pairs_over_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    plain = by_document(spark, sf)
    got = {(r.w1, r.w2): r for r in registry.QUERIES["word_pair_scores_by_document"](spark, sf).collect()}
    assert set(got) == {("the", "of"), ("of", "and")}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    points, length = similarity.on_document_axis(docs, ["the", "of", "and"])
    pairs = spark.createDataFrame([("the", "of"), ("of", "of"), ("of", "nosuchword"), ("nosuchword", "of")], "w1 string, w2 string")
    small = {(r.w1, r.w2): r for r in similarity.word_pairs_by_document(points, length, pairs, part=16).collect()}
    assert set(small) == {("the", "of"), ("of", "of")} and small["of", "of"].dtw == 0 and small["of", "of"].squared == math.inf
    assert small["the", "of"].dtw == got["the", "of"].dtw
    for (w1, w2), r in got.items():
        a, b = plain[w1], plain[w2]
        x, y = a / a.sum(), b / b.sum()
        js = sum(p * math.log(p / (p + q / 2)) for p, q in zip(x, y, strict=True) if p) + sum(q * math.log(q / (p + q / 2)) for p, q in zip(x, y, strict=True) if q)
        want = (-math.log(((a - b) ** 2).sum()), a @ b / math.sqrt((a @ a) * (b @ b)), 1 - 0.5 * js, -dtw(b, a[None])[0])
        assert (r.squared, r.cosine, r.js, r.dtw) == pytest.approx(want, abs=2e-6)


def test_word_pairs_with_long_gaps(spark):
    """Parts, and groups of parts, without any count: at the start, within, and as a short rest at the end."""
    cells = {"a": {70: 3, 71: 1, 260: 2, 409: 5}, "b": {75: 2, 258: 4, 300: 1, 399: 5}, "c": {5: 1}, "d": {400: 2}}
    points = spark.createDataFrame([(w, i, n) for w, c in cells.items() for i, n in c.items()], "term string, at long, tf long")
    pairs = [("a", "b"), ("b", "a"), ("c", "a"), ("a", "d"), ("d", "c")]
    for length in (410, 420, 433):
        dense = {w: np.array([float(c.get(i, 0)) for i in range(length)]) for w, c in cells.items()}
        for part, fold in ((8, 2), (64, 3), (4096, 256)):
            got = similarity.word_pairs_by_document(points, length, spark.createDataFrame(pairs, "w1 string, w2 string"), part=part, fold=fold)
            assert {(r.w1, r.w2): r.dtw for r in got.select("w1", "w2", "dtw").collect()} == {(x, y): -dtw(dense[y], dense[x][None])[0] for x, y in pairs}


def test_search_panel_warps_over_the_document_axis(spark):
    sf = "/root/testdata/sf0.001"
    plain = by_document(spark, sf)
    names = sorted(plain)
    cost = dict(zip(names, dtw(plain["the"], np.array([plain[t] for t in names])), strict=True))
    want = sorted(names, key=lambda t: (cost[t], t))[:20]
    got = sorted(registry.QUERIES["search_panel"](spark, sf).collect(), key=lambda r: r["rank"])
    assert [(r["rank"], r.term, r.score) for r in got] == [(0, "the", None)] + [(i + 1, t, -cost[t]) for i, t in enumerate(want)]
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    points, length = similarity.on_document_axis(spark.read.parquet(f"{sf}/documents.parquet"))
    small = similarity.similar_by_document(points, length, "the", part=16, terms_at_once=5, fold=3)  # more levels of parts
    assert [(r["rank"], r.term, r.score) for r in small.orderBy("rank").collect()] == [(i + 1, t, -cost[t]) for i, t in enumerate(want)]
    one_by_one = similarity.similar_by_document(points, length, "the", first=3)  # rounds of three, six, ... terms
    assert [(r["rank"], r.term, r.score) for r in one_by_one.orderBy("rank").collect()] == [(i + 1, t, -cost[t]) for i, t in enumerate(want)]
    for r in got:
        curve = [0] * 100
        for i, n in zip(ids, plain[r.term], strict=True):
            curve[i % 100] += int(n)
        assert r.curve == ",".join(map(str, curve))


def test_counts_of_all_shuffle_no_words(spark):
    rows = [(1, "A b a", 1850), (2, None, 1850), (3, "", 1851), (None, "b", 1852), (4, "running runs ran", None), (5, "12 x-12", 1853)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, year int")
    odd = spark.createDataFrame([*rows, (1, "a c", 1850), (None, "b b", 1852), (3, "z", 1860)], docs.schema)
    for d in (docs, odd, docs.limit(0)):
        assert sorted(map(str, index.counts_of_all(d).collect())) == sorted(map(str, index.counts(d).collect()))
    plan = index.counts_of_all(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    store = {(r.term, r.doc_id, r.year): (r.tf, r.total) for r in index.posting_store(odd).collect()}
    assert store["b", None, 1852] == (3, 4) and store["a", 1, 1850] == (3, 3) and store["z", 3, 1860] == (1, 1)
    stems = {(r.term, r.doc_id): r.tf for r in index.stemmed_counts(odd).collect()}
    assert stems["run", 4] == 2 and stems["ran", 4] == 1 and stems["b", None] == 3 and len(stems) == 9


def test_search_stops_at_terms_that_can_only_tie(spark, monkeypatch):
    """A curve of zeros is met at exactly a term's total: of many terms that occur once, the first by name are found in one round."""
    rounds, kept = [], similarity.stored

    def counted(df, label):
        rounds.append(label)
        return kept(df, label)

    monkeypatch.setattr(similarity, "stored", counted)
    points = spark.range(400).selectExpr("concat('w', lpad(cast(id as string), 3, '0')) as term", "id as at", "1L as tf")
    nothing = spark.createDataFrame([], "at long, q long")
    found = similarity.similar_by_document(points, 400, nothing, k=5, part=64)
    assert [(r["rank"], r.term, r.score) for r in found.orderBy("rank").collect()] == [(i + 1, f"w{i:03}", -1.0) for i in range(5)]
    assert rounds.count("round-scores") == 1


def test_words_on_the_document_axis_shuffle_texts_only(spark):
    docs = spark.createDataFrame([(7, "b a a"), (None, "a"), (3, "c a"), (7, "a"), (None, "a a"), (9, None)], "doc_id long, text string")
    points, length = similarity.on_document_axis(docs)
    assert length == 4 and sorted(tuple(r) for r in points.collect()) == [("a", 0, 3), ("a", 1, 1), ("a", 2, 3), ("b", 2, 1), ("c", 1, 1)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as large tables are joined
    try:
        plan = similarity.on_document_axis(docs)[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(term" in line]


def test_a_query_in_many_documents_is_not_broadcast(spark, monkeypatch):
    """What lies near the query's places is broadcast by their number, not by the size of a file; both ways give the same terms."""
    rng = np.random.default_rng(4)
    rows = [(f"t{t:02}", int(at), int(rng.integers(1, 4))) for t in range(30) for at in rng.choice(600, 300, replace=False)]
    points = spark.createDataFrame(rows, "term string, at long, tf long")
    plans, kept = [], similarity.stored

    def told(frame, label):
        if label == "least-costs":
            plans.append(frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        return kept(frame, label)

    monkeypatch.setattr(similarity, "stored", told)
    got = []
    for places in (100_000, 100):
        monkeypatch.setattr(similarity, "BROADCAST_PLACES", places)
        got.append([tuple(r) for r in similarity.similar_by_document(points, 600, "t03", k=5, part=64, fold=3).orderBy("rank").collect()])
    assert got[0] == got[1] and got[0][0][1:] == ("t03", 0.0)
    assert ["SortMergeJoin" in p for p in plans] == [False, True]


def test_search_panel_of_a_step(spark):
    sf = "/root/testdata/sf0.001"
    plain, ids = by_document(spark, sf), sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    size = Counter(i % 100 for i in ids)
    query = np.array([float(150 // size[i % 100]) if i % 100 >= 50 else 0.0 for i in ids])
    names = sorted(plain)
    cost = dict(zip(names, dtw(query, np.array([plain[t] for t in names])), strict=True))
    want = sorted(names, key=lambda t: (cost[t], t))[:20]
    got = sorted(registry.QUERIES["search_panel_of_a_step"](spark, sf).collect(), key=lambda r: r["rank"])
    assert [(r["rank"], r.term, r.score) for r in got] == [(0, "$1870", None)] + [(i + 1, t, -cost[t]) for i, t in enumerate(want)]
    assert got[0].curve == ",".join(str(150 // size[i] * size[i] if i >= 50 else 0) for i in range(100))
