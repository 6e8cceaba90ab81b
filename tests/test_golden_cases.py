"""Small cases worked out by hand, of rules that are easily misread."""

import pytest
from pyspark.sql import functions as F

from chronolex.operators import corpus, index, similarity, temporal, textindex
from chronolex.sources import books


def test_blocks_compare_and_sum_the_same_years(spark):
    """The last year of a block is in neither weight, total nor cosine; the query's own term is ranked too."""
    points = [("q", 1820, 1), ("q", 1821, 2), ("q", 1829, 9), ("c", 1820, 2), ("c", 1821, 4), ("c", 1829, 5), ("c", 1835, 7), ("d", 1822, 3), ("e", 1829, 8)]
    curves = spark.createDataFrame(points, "term string, year int, tf long")
    got = [tuple(r) for r in similarity.quantized(curves, "q", 10, 5).orderBy("start", "rank").collect()]
    assert got == [(1820, 1829, 1, "c", 1.0, 3, 6), (1820, 1829, 2, "q", 1.0, 3, 3), (1820, 1829, 3, "d", 0.0, 3, 3)]
    whole = [tuple(r) for r in similarity.quantized(curves, "q", 10, 5, drop_last=False, with_query=False).orderBy("rank").collect()]
    assert [r[3] for r in whole] == ["e", "c", "d"] and whole[1][5:] == (12, 11)


def test_text_index_compares_shares_of_a_year(spark):
    """Shares: a (1/4, 1/2), b (3/4, 0), c (0, 1/2); counts alone would put b far lower."""
    curves = spark.createDataFrame([("a", 1820, 1), ("b", 1820, 3), ("a", 1821, 10), ("c", 1821, 10)], "term string, year int, tf long")
    rank = lambda method: [(r["rank"], r.term, r.score) for r in textindex.find_similar(curves, "a", method, 3).collect()]
    assert rank("cos") == [(1, "a", 1.0), (2, "c", 0.894427), (3, "b", 0.447214)]
    assert rank("cos-diff") == [(1, "b", 0.552786), (2, "c", 0.105573), (3, "a", 0.0)]
    assert textindex.find_similar(curves, "A").count() == 0
    found, missing = textindex.exact(curves, ["a", "A", "x", "a"])
    assert sorted((r.ord, r.year, r.p) for r in found.collect()) == [(0, 1820, 0.25), (0, 1821, 0.5), (3, 1820, 0.25), (3, 1821, 0.5)]
    assert sorted(r.term for r in missing.collect()) == ["A", "x"]
    assert [(r.term, r.p, r.ord) for r in textindex.matching(curves, ["B"]).collect()] == [("b", 0.75, 0)]
    row = temporal.in_columns(found, "#", "p", "double", "ord").where("ord = 3").first()
    assert (row["#"], row["1820"], row["1821"], row["1919"]) == ("a", 0.25, 0.5, 0.0)


def test_every_term_is_ranked(spark):
    curves = spark.createDataFrame([("q", 1820, 1), ("r", 1820, 2), ("r", 1821, 1)], "term string, year int, tf long")
    for method, own in (("cosine", 1.0), ("squared", float("inf")), ("js-standard", 1.0), ("js-reference", 1.405465), ("earth-mover", 0.0), ("dtw", 0.0)):
        scores = {r.term: r.score for r in similarity.similar(curves, "q", method).collect()}
        assert set(scores) == {"q", "r"} and scores["q"] == own
        assert [r.term for r in similarity.similar(curves, "q", method, with_query=False).collect()] == ["r"]


def test_census_counts_books_that_exist(spark, tmp_path):
    rows = [
        ("a", "x/a_meta.xml.bz2", "a", "eng", "1850", None, True),
        ("b", "x/b_meta.xml.bz2", "other", "English", "n.d.", "1920", True),
        ("c", "x/c_meta.xml.bz2", "c", " ", None, None, True),
        ("d", "x/d_meta.xml.bz2", "d", "fre", "1851", None, False),
        ("e", "x/e_meta.xml.bz2", "e", "ger", "1921", None, None),
        ("f", "x/f_meta.xml", "f", "eng", "1852", None, True),
    ]
    table = spark.createDataFrame(rows, "id string, path string, identifier string, language string, year string, date string, exists boolean")
    assert corpus.census(table).first().asDict() == {"books": 4, "nonexistent": 2, "bad_metadata": 1, "no_language": 1, "non_english": 0, "no_date": 1}
    lines = corpus.dated_books(table)
    assert sorted(map(tuple, lines.collect())) == [("a", "x/a_mbtei.xml.gz", 1850), ("b", "x/b_mbtei.xml.gz", 1920)]
    corpus.date_lists(lines.union(spark.createDataFrame([("z", "x/z", 1921)], lines.schema)), f"{tmp_path}/lists")
    assert [r.value for r in spark.read.text(f"{tmp_path}/lists/year=1850").collect()] == ["x/a_mbtei.xml.gz"]
    assert spark.read.text(f"{tmp_path}/lists").count() == 2


def test_names_and_metadata(spark):
    docs = spark.createDataFrame([(3, "ark-3", "x"), (4, None, "y")], "doc_id long, identifier string, text string")
    assert [tuple(r) for r in index.names(docs).orderBy("doc_id").collect()] == [(3, "ark-3"), (4, "doc-4")]
    assert index.names(docs.drop("identifier")).select(F.max("name")).first()[0] == "doc-4"
    xml = "<metadata><title> A &amp; B </title><year></year><title>C</title></metadata><text><w>one</w></text>"
    assert books.metadata(xml) == {"title": " A & B \nC", "year": ""}
    assert books.metadata(xml, ["title", "year"]) == {"title": " A &amp; B "}


def test_inspect_counts_documents_without_words(spark, tmp_path):
    from chronolex.__main__ import inspect

    docs = spark.createDataFrame([(1, "rain falls"), (2, ""), (3, None)], "doc_id long, text string")
    for part in ("counts", "names"):
        index.build_part(docs, part, f"{tmp_path}/index")
    assert tuple(inspect(spark, f"{tmp_path}/index").first()) == (3, 2, 2, "counts names")
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        inspect(spark, f"{tmp_path}/none")


def test_substrings_by_runs_of_characters(spark):
    terms = ["a", "ab", "abc", "abcabc", "xabcx", "bca", "été", "naïve", ""]
    queries = ["abc", "ABCA", "b", "bc", "", "zzz", "abz", "té", "ï", "abcabcabc", "c", None]
    want = {(t, i) for t in terms for i, q in enumerate(queries) if q is not None and q.lower() in t}
    found = textindex.containing(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame(list(enumerate(queries)), "ord int, q string"))
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_many_substrings_are_one_plan(spark):
    terms = spark.range(3000).selectExpr("concat('w', cast(id * 7919 as string)) as term")
    queries = spark.range(10_000).selectExpr("cast(id as int) as ord", "cast(id as string) as q")
    found = textindex.containing(terms, queries)
    size = lambda df: len(df._jdf.queryExecution().analyzed().toString())
    assert size(found) < 1.1 * size(textindex.containing(terms, queries.where("ord < 3")))
    words = [r.term for r in terms.collect()]
    assert found.where("ord in (7, 79, 791, 7919)").count() == sum(q in w for w in words for q in ("7", "79", "791", "7919"))


def test_a_hot_term_is_in_several_files_and_joins_nothing(spark, tmp_path):
    docs = spark.range(5000).selectExpr("id as doc_id", "concat('the w', cast(id % 40 as string)) as text", "cast(1820 + id % 50 as int) as year")
    index.write_store(index.posting_store(docs), f"{tmp_path}/store", 6)
    store = spark.read.parquet(f"{tmp_path}/store")
    assert store.where("term = 'the'").select(F.input_file_name()).distinct().count() >= 2
    assert {(r.term, r.total) for r in store.select("term", "total").distinct().collect()} == {("the", 5000), *((f"w{i}", 125) for i in range(40))}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(index.threshold(store, 200)) and "GreaterThanOrEqual(total,200)" in plan(index.threshold(store, 200))
    assert index.threshold(store, 200).count() == 5000
    curves = plan(index.store_curves(store))
    assert curves.count("Exchange") == 1 and "Join" not in curves
    assert {(r.year, r.tf) for r in index.store_curves(store).where("term = 'the'").collect()} == {(1820 + i, 100) for i in range(50)}
    other = index.posting_store(docs.selectExpr("doc_id + 5000 as doc_id", "'the end' as text", "year"))
    both = index.merge_stores([store, other])
    assert both.where("term = 'the'").agg(F.min("total"), F.max("total"), F.count("*")).first()[:] == (10_000, 10_000, 10_000)
    undated = index.posting_store(docs.drop("year").limit(3))
    assert index.store_curves(undated).count() == 0 and undated.count() == 6


@pytest.mark.parametrize("split", ["1k", "7k", "128m"])
def test_line_numbers_under_any_split(spark, tmp_path, split):
    from chronolex.sources import lists

    want, before = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    for k in range(3):
        rows = [f"file {k} line {i} {'x' * (i % 37)}" for i in range(400)]
        (tmp_path / f"part{k}.txt").write_text("\n".join(rows) + "\n")
        want += rows
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        numbered = lists.lines(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")  # a later scan may be cut in another way
        assert [(r.ord, r.value) for r in numbered.orderBy("ord").collect()] == list(enumerate(want))
        assert [r.value for r in lists.line_range(numbered, 399, 2).orderBy("ord").collect()] == want[399:401]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
