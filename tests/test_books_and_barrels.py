"""Streams of books and barrels: awkward bytes, cut files, lost tasks' leavings."""

import bz2
import gzip
import os
import random
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronolex.functions.text import string_hash
from chronolex.sources import barrels, book_functions, books, lists

XML = '<metadata><title>A &amp; B</title><year>1850</year></metadata><text><w c="1">Hello</w> <w>wor&lt;ld</w><lb/> <w></w><w> 1850 </w></text>'


def test_elements_in_pieces_are_those_of_the_whole(monkeypatch):
    texts = [XML, "", "no tags", "a < b <w>x</w> > c", '<a t="x <b> y"><w>1</w>', "<w>é日😀</w>" * 50, '<a "unclosed <w>x</w>', "<", "<w>last"]
    for size in (1, 3, 7, 1 << 16):
        monkeypatch.setattr(book_functions, "PIECE", size)
        for t in texts:
            raw = t.encode()
            for packed in (raw, gzip.compress(raw), bz2.compress(raw), gzip.compress(raw[:5]) + gzip.compress(raw[5:])):
                if packed is raw or raw:
                    assert list(book_functions.elements(packed)) == list(books.elements(t)), (t, size)


def test_book_functions(spark):
    raw = XML.encode()
    rows = [("plain", raw), ("gz", gzip.compress(raw)), ("bz2", bz2.compress(raw)), ("cut", gzip.compress(raw)[:-9]), ("broken", b"\x1f\x8b" + b"x" * 50), ("empty", b""), ("none", None)]
    files = spark.createDataFrame(rows, "path string, content binary")
    words = book_functions.with_rows(files, book_functions.book_words).collect()
    assert {(r.path, r.position, r.word) for r in words} == {(p, i, w) for p in ("plain", "gz", "bz2") for i, w in enumerate(["Hello", "wor<ld", " 1850 "])}
    assert {(r.path, r.text) for r in book_functions.with_rows(files, book_functions.book_lines).where("line = 0").collect()} == {("empty", ""), *((p, "Hello wor<ld 1850") for p in ("plain", "gz", "bz2"))}
    maps = book_functions.as_map(book_functions.with_rows(files, book_functions.book_metadata), "path").collect()
    assert {r.path: r.metadata for r in maps} == {p: {"title": "A & B", "year": "1850"} for p in ("plain", "gz", "bz2")}


def test_runs_of_elements_are_found_at_once(monkeypatch):
    """Elements without a stray `<` come from one scan of a piece: the step by single tags meets only what is left at a piece's end."""
    stepped = []

    class Tags:
        def finditer(self, text, at=0):
            for m in books.TAG.finditer(text, at):
                stepped.append(m)
                yield m

    raw = ("<text>" + "".join(f'<w c="<{i}>">é{i}</w> ' for i in range(3000)) + "a < b <lb/><w>x</w></text>").encode()
    want = list(books.elements(raw.decode()))
    monkeypatch.setattr(book_functions, "TAG", Tags())
    for size in (1 << 10, 1 << 16):
        monkeypatch.setattr(book_functions, "PIECE", size)
        stepped.clear()
        assert list(book_functions.elements(raw)) == want and len(stepped) < 100


def test_rows_of_a_table_function_leave_in_batches(spark, monkeypatch):
    """One plan of Arrow batches without a row by row table function; batches that end within a file."""
    monkeypatch.setattr(book_functions, "ROWS", 3)
    files = spark.createDataFrame([(i, "x" * i, "<w>a</w>".encode() * i) for i in range(8)], "id long, other string, content binary")
    rows = book_functions.with_rows(files, book_functions.book_words)
    assert rows.dtypes == [("id", "bigint"), ("other", "string"), ("position", "int"), ("word", "string")]
    assert sorted(map(tuple, rows.collect())) == [(i, "x" * i, k, "a") for i in range(8) for k in range(i)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "PythonUDTF" not in plan


ODD = ["<w>", "</w>", '<w c="<1>">', "< w\n>", "<w/>", "<w />", "<pb>", "<lb />", "<lb/>", '< pb n="2">', "a", "é", "&amp;", "&lt;pb", "&x;", " ", "\x1c", "<", ">", '"', '<a t="<w>y">', '<a t="x', "<wx>", "<>", '<w"x">', "<hi>", "<pbx>"]


def odd_books():
    rng = random.Random(7)
    return [XML, "", *("".join(rng.choices(ODD[: rng.choice([17, 27])], k=rng.randrange(80))) for _ in range(300))]


def no_elements(raw):
    raise AssertionError("element by element")


def test_words_leave_a_run_at_once(monkeypatch):
    """Words are found by one scan of a run, as columns, without a tuple for each element; odd books, pieces of any size."""
    want = [list(enumerate(books.words(t))) for t in odd_books()]
    monkeypatch.setattr(book_functions, "elements", no_elements)
    for size in (1, 7, 1 << 16):
        monkeypatch.setattr(book_functions, "PIECE", size)
        assert [list(book_functions.BookWords().eval(t.encode())) for t in odd_books()] == want
    many = list(book_functions.BookWords().columns(("<text>" + "<w>é</w> " * 5000).encode()))
    assert len(many) < 10 and sum(len(words) for _, words in many) == 5000


def plain_lines(xml):
    lines = [[]]
    for name, raw in books.elements(xml):
        if name in ("pb", "lb"):
            lines.append([])
        elif name == "w" and (word := books.decoded(raw).strip()):
            lines[-1].append(word)
    return [(i, " ".join(words)) for i, words in enumerate(lines)]


def test_lines_are_joined_a_run_at_once(monkeypatch):
    """The same for lines: words with white space around or inside, with entities, breaks within and at the ends of runs."""
    odd = [*odd_books(), "<w> New  York </w><lb /><w>a</w><pb><w>&x; b</w>", "<lb /><lb /> <w>&lt;</w><w> < </w><lb />", "<w>a</w>" * 9 + "<lb />x</q>" + "<w> </w><w>b</w>" * 9]
    want = [plain_lines(t) for t in odd]
    monkeypatch.setattr(book_functions, "elements", no_elements)
    for size in (1, 7, 1 << 16):
        monkeypatch.setattr(book_functions, "PIECE", size)
        assert [list(book_functions.BookLines().eval(t.encode())) for t in odd] == want


def jvm_hash(word):
    h = 0
    raw = word.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = (h * 31 + int.from_bytes(raw[i : i + 2], "big")) & 0xFFFFFFFF
    return h - (h >> 31 << 32)


def test_hashes_of_all_scripts(spark):
    words = ["abc", "", "a", "é", "straße", "日本語", "😀x", "z" * 40, "été 1"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", string_hash(F.col("w")).alias("h")).collect()
    assert {r.w: r.h for r in got} == {w: jvm_hash(w) for w in words} and jvm_hash("abc") == 96354


def test_barrels_hash_words_in_arrays(spark, tmp_path, monkeypatch):
    """Hashes of a batch at once, for all scripts, empty and null lists; no interpreted loop over letters in the plan."""
    import pyarrow as pa

    words = ["abc", "", "a", "é", "straße", "日本語", "😀x", "z" * 40, "été 1", "the", ""]
    for some in (words, ["abc", "", "zz9"], ["", ""], [], words[3:7]):
        assert lists.word_hashes(pa.array(some, pa.string())).tolist() == [jvm_hash(w) for w in some]
    assert lists.word_hashes(pa.array(words, pa.string()).slice(2, 5)).tolist() == [jvm_hash(w) for w in words[2:7]]
    monkeypatch.setattr(lists, "string_hash", lambda w: F.raise_error(F.lit("letter by letter")), raising=False)
    docs = spark.createDataFrame([(1, words), (2, []), (3, ["b"]), (4, None)], "idx long, words array<string>").coalesce(1)
    lists.write_barrel(docs, str(tmp_path / "b"))
    got = {r.idx: r.words for r in lists.read_barrels(spark, str(tmp_path / "b")).collect()}
    assert got == {1: [str(jvm_hash(w)) for w in words], 2: [], 3: [str(jvm_hash("b"))], 4: None}


def test_postings_are_not_shuffled(spark):
    """One exchange, of the texts."""
    from chronolex.operators import index

    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, None)], "doc_id long, text string")
    found = index.positions(docs)
    assert sorted(map(tuple, found.collect())) == [("a", 1, [0, 2]), ("b", 1, [1]), ("b", 2, [0])]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    executed = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert executed.count("Exchange hashpartitioning") == 1 and "posexplode" in plan


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_binary_barrels(spark, tmp_path, compression):
    rows = [(i, [i * 7 - 3, -(1 << 31), (1 << 31) - 1][: i % 4]) for i in range(50)]
    frame = spark.createDataFrame(rows, "idx int, hashes array<int>").repartition(4)
    folder = f"{tmp_path}/b.barrel"
    barrels.write(frame, folder, compression)
    names = os.listdir(folder)
    assert len(names) == 4 and all(n.endswith(".barrel.gz" if compression == "gzip" else ".barrel") for n in names)
    assert sorted((r.idx, r.hashes) for r in barrels.read(spark, folder).collect()) == rows
    one = f"{folder}/{names[0]}"
    raw = open(one, "rb").read()
    raw = gzip.decompress(raw) if compression == "gzip" else raw
    assert lists.parse_barrel(raw) == [(r.idx, r.hashes) for r in barrels.read(spark, one).collect()] and struct.unpack(">i", raw[:4])[0] == len(lists.parse_barrel(raw))
    barrels.write(frame.where("idx < 3"), folder, compression)
    assert barrels.read(spark, folder).count() == 3
    (tmp_path / "cut.barrel").write_bytes(struct.pack(">iii", 1, 5, 9))
    with pytest.raises(Exception, match="ends before"):
        barrels.read(spark, f"{tmp_path}/cut.barrel").collect()
    assert not [n for n in os.listdir(folder) if n.startswith("_temporary")]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    frame = spark.range(20).select(F.col("id").cast("int").alias("idx"), F.when(F.col("id") == 13, F.raise_error(F.lit("lost")).cast("array<int>")).otherwise(F.array(F.lit(1))).alias("hashes"))
    with pytest.raises(Exception, match="lost"):
        barrels.write(frame, f"{tmp_path}/f.barrel")
    left = [n for _, _, files in os.walk(tmp_path) for n in files]
    assert not left


def test_places_meet_a_documents_masks_once(spark):
    """No row for each place and interval: postings meet one row a document; intervals across bins, nested and many."""
    from chronolex.operators import index

    rng = random.Random(3)
    spans = [(d, b, min(700, b + rng.choice([0, 1, 5, 63, 64, 65, 200]))) for d in range(6) for b in (rng.randrange(700) for _ in range(4 * d))]
    words = {d: [f"w{rng.randrange(30)}" for _ in range(700)] for d in range(7)}
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in words.items()], "doc_id long, text string")
    intervals = spark.createDataFrame([("hi", *s) for s in spans] + [("p", 6, 0, 700)], "tag string, doc_id long, begin int, end int")
    inside = index.inside(index.positions(docs), intervals, "hi")
    want = Counter((words[d][i], d) for d in words for i in {i for k, b, e in spans if k == d for i in range(b, e)})
    assert {(r.term, r.doc_id): r.tf for r in inside.collect()} == want
    plan = inside._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and plan.count("Generate explode") == 1  # words, and intervals to bins; not places


def test_words_inside_tags(spark, tmp_path):
    from chronolex.operators import index

    body = lambda inner: f"<metadata><title>x</title></metadata><text>{inner}</text>".encode()
    rows = [(1, "a b c d", body('<w>a</w><hi r="1"><w>b</w><hi><w>c</w></hi></hi><w>d</w>')), (2, "a a b", body("<w>a</w><hi><w>a</w><lb/><w>b</w>")), (3, "a", body("<hi></hi><w>a</w>")), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, content binary")
    found = {tuple(r) for r in index.extents(docs).where("tag = 'hi'").collect()}
    assert found == {("hi", 1, 1, 3), ("hi", 1, 2, 3), ("hi", 2, 1, 3), ("hi", 3, 0, 0)}
    path = index.build_part(docs, "extents", str(tmp_path / "index"))
    got = {tuple(r) for r in index.inside(index.positions(docs), spark.read.parquet(path), "hi").collect()}
    assert got == {("b", 1, 1), ("c", 1, 1), ("a", 2, 1), ("b", 2, 1)}
    assert {(r.term, r.tf) for r in index.inside(index.positions(docs), spark.read.parquet(path), "text").where("doc_id = 2").collect()} == {("a", 2), ("b", 1)}
    assert index.extents(docs.drop("content")).count() == 0
    long = spark.createDataFrame([(9, " ".join(f"w{i % 7}" for i in range(1000)), body("<p>" + "<w>x</w>" * 300 + "</p><q>" + "<w>x</w>" * 500 + "</q>" + "<w>x</w>" * 200))], "doc_id long, text string, content binary")
    inside = {r.term: r.tf for r in index.inside(index.positions(long), index.extents(long), "q").collect()}
    assert inside == {f"w{k}": sum(i % 7 == k for i in range(300, 800)) for k in range(7)}
