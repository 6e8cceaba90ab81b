"""Golden values of kernels, text functions, parser and stemmer."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolex.functions import kernels as k
from chronolex.functions import text
from chronolex.functions.stemmer import stem
from chronolex.sources import books, lists

XML = '<metadata><title>A &amp; B</title><year>1850</year></metadata><text><w c="1">Hello</w> <w>wor&lt;ld</w><lb/> <w></w><w> 1850 </w></text>'


def value(spark, *columns):
    a, b = F.array(*map(F.lit, [1, 2, 3, 4])), F.array(*map(F.lit, [2, 2, 1, 5]))
    return spark.range(1).select(*(c(a, b).alias(str(i)) for i, c in enumerate(columns))).first()


def test_kernels(spark):
    r = value(spark, k.cosine, k.squared, k.jensen_shannon, lambda a, b: k.jensen_shannon(b, a), lambda a, b: k.jensen_shannon(a, b, "standard"), k.earth_mover, lambda a, b: k.jensen_shannon(a, a), lambda a, b: k.squared(a, a))
    want = [0.9080252220734668, -1.791759469228055, -0.3642037603217002, -0.36372943316376394, 0.037440880811177135, -3.0, -0.4054651081, math.inf]
    assert all(x == y or abs(x - y) < 1e-9 for x, y in zip(r, want, strict=True))


def test_statistics(spark):
    a = F.array(*map(F.lit, [1, 2, 3, 4, 5, 7]))
    r = spark.range(1).select(k.moving_average(a).alias("m"), k.median(a).alias("md"), k.max_index(a).alias("x"), k.min_index(a).alias("n"), k.median(F.array(F.lit(1), F.lit(2)), "standard").alias("s")).first()
    assert (r.m, r.md, r.x, r.n, r.s) == ([3, 4], 3, 5, 0, 1.5)


def plain_dtw(a, b, w):
    n = len(a)
    d = [[math.inf] * (n + 1) for _ in range(n + 1)]
    d[0][0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - w), min(n, i + w) + 1):
            d[i][j] = abs(a[i - 1] - b[j - 1]) + min(d[i - 1][j], d[i][j - 1], d[i - 1][j - 1])
    return d[n][n]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_dynamic_programmes():
    assert [float(k.dtw(np.array([2, 2, 1, 5.0]), np.array([[1, 2, 3, 4.0]]), w)[0]) for w in (0, 1, 10)] == [4, 4, 4]
    assert float(k.dtw(np.array([1, 1, 2, 3.0]), np.array([[1, 2, 3, 4.0]]))[0]) == 1
    assert k.lcs(list("abcbdab"), list("bdcaba")) == 4
    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.randrange(9) for _ in range(20)] for _ in range(2))
        w = rng.randrange(12)
        assert float(k.dtw(np.array(b, float), np.array([a], float), w)[0]) == plain_dtw(a, b, w)
        assert k.lcs(a, b) == plain_lcs(a, b)


def test_year_resolvers(spark):
    cases = [("1850", None, 1850, 1850), ("[c1850]", None, 1850, 1850), ("1850-51", "1851", None, 1851), (None, "1919", 1919, 1919), ("1920", None, None, 1920), ("n.d.", "1850", None, 1850), (None, None, None, None)]
    frame = spark.createDataFrame([c[:2] for c in cases], "y string, d string")
    got = frame.select(text.retrieval_year(F.col("y"), F.col("d")), text.census_year(F.col("y"), F.col("d"))).collect()
    assert [tuple(r) for r in got] == [c[2:] for c in cases]


def test_words(spark):
    frame = spark.createDataFrame([("Hello",), ("wor<ld",), (" 1850 ",), ("1850",), ("185",), ("a",), ("Éa",), ("--",)], "w string")
    rows = frame.select(text.normalised(F.col("w")).alias("n"), text.filtered(F.col("w")).alias("f")).collect()
    assert [r.n for r in rows] == ["hello", "world", "1850", "1850", "185", "a", "éa", None]
    assert [r.f for r in rows] == ["hello", None, None, "1850", None, None, None, None]
    r = spark.range(1).select(text.string_hash(F.lit("abc")).alias("h"), text.clean_query(F.lit("Ab-c d!")).alias("q"), text.fraction(F.lit(1), F.lit(0)).alias("z"), text.harmonic_mean(F.lit(1.0), F.lit(3.0)).alias("m"), text.hex_id(F.lit(255)).alias("x"), text.book_path(F.lit("a_meta.xml.bz2")).alias("p")).first()
    assert tuple(r) == (96354, "Abc d", 0.0, 1.5, "000000ff", "a_mbtei.xml.gz")


def test_parser(spark, tmp_path):
    import bz2
    import gzip

    assert books.words(XML) == ["Hello", "wor<ld", " 1850 "]
    assert books.metadata(XML, ["title", "year"]) == {"title": "A &amp; B", "year": "1850"}
    assert books.metadata(XML) == {"title": "A & B", "year": "1850"}
    assert books.text('<w>a</w><lb /><w>b</w><pb n="2"/>') == "a\nb\n"
    (tmp_path / "a.gz").write_bytes(gzip.compress(XML.encode()))
    (tmp_path / "b.bz2").write_bytes(bz2.compress(XML.encode()))
    (tmp_path / "c.gz").write_bytes(gzip.compress(XML.encode())[:30])
    rows = {r.path[-4:]: r for r in books.read_books(spark, str(tmp_path)).collect()}
    assert rows["a.gz"].words == ["Hello", "wor<ld", " 1850 "] and rows[".bz2"].metadata["year"] == "1850" and rows["c.gz"].words == []


def test_lists(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a p\nb q 1850\n  7 word\nc r\n")
    n = lists.lines(spark, str(tmp_path / "l.txt"))
    assert [(r.ord, r.value) for r in n.orderBy("ord").collect()] == [(0, "a p"), (1, "b q 1850"), (2, "  7 word"), (3, "c r")]
    assert [tuple(r) for r in lists.id_paths(lists.line_range(n, 0, 2)).collect()] == [("a", "p")]
    assert [tuple(r) for r in lists.id_path_years(n.where("ord = 1")).collect()] == [("b", "q", 1850)]
    assert [tuple(r) for r in lists.word_counts(n.where("ord = 2")).collect()] == [("word", 7)]
    with pytest.raises(Exception, match="not a count"):
        lists.word_counts(n).collect()
    docs = [(3, [1, -5]), (9, [])]
    assert lists.parse_barrel(lists.barrel_bytes(docs)) == docs


def test_stems():
    words = "caresses ponies cats feed agreed hopping hoping happy relational generously running knightly skies dying consist consistency communism news".split()
    assert [stem(w) for w in words] == "caress poni cat feed agre hop hope happi relat generous run knight sky die consist consist communism news".split()


def test_shares_of_many_pairs_come_from_numbers(monkeypatch):
    """Words of a batch are numbered together before they are compared, over several pieces of it."""
    import pyarrow as pa

    rng, seen = random.Random(3), []
    rows = [([f"w{rng.randrange(9)}" for _ in range(rng.randrange(12))], [f"w{rng.randrange(9)}" for _ in range(rng.randrange(12))]) for _ in range(1500)]
    plain = k.lcs
    monkeypatch.setattr(k, "lcs", lambda a, b, limit: (seen.append({type(w) for w in a}), plain(a, b, limit))[1])
    words = pa.list_(pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array([a for a, _ in rows], words), pa.array([b for _, b in rows], words)], ["id", "a", "b"])
    for limit in (None, 3):
        (got,) = k._lcs_shares(limit)([batch])
        for share, (a, b) in zip(got.column(1).to_pylist(), rows, strict=True):
            x, y = [w for w in a if w in b][:limit], [w for w in b if w in a][:limit]
            assert share == (plain_lcs(x, y) / min(len(x), len(y)) if x else 0.0)
    assert all(t <= {int} for t in seen)
