"""The command line's tasks, one after the other on a small index."""

import gzip

import pytest

from chronolex.__main__ import TASKS, main
from chronolex.sources import lists


def test_tasks(spark, tmp_path, capsys):
    rows = [(i, f"rain falls {'hard' if i % 2 else 'softly'} rain", 1820 + i) for i in range(20)]
    docs, folder = f"{tmp_path}/docs", f"{tmp_path}/index"
    spark.createDataFrame(rows, "doc_id long, text string, year int").write.parquet(docs)
    for part in ("corpus", "counts"):
        assert main(["build-index-part", docs, part, folder]) == 0
    assert main(["make-date-counts", folder]) == 0
    got = TASKS["inspect"](spark, folder).first()
    assert (got.documents, got.terms, got.words) == (20, 4, 80)
    assert {r.tf for r in TASKS["postings-to-counts"](spark, f"{folder}/counts", f"{tmp_path}/often", "15").collect()} == {1, 2}
    assert TASKS["concat-postings"](spark, f"{tmp_path}/both", f"{folder}/counts", f"{folder}/counts").count() == 120
    assert TASKS["output-doc-csv"](spark, folder, "Rain").first()["1820"] == 2
    assert TASKS["comparison"](spark, folder, "rain", "2", "cosine").collect()[0].term == "falls"
    assert [r.term for r in TASKS["similar-quantized"](spark, folder, "rain", "20", "2").collect()] == ["falls", "rain"]
    hits = TASKS["similar-terms-cli"](spark, folder, "hard", "Rain").collect()
    assert [(h.term, h.doc_id, h.tf) for h in hits] == [("hard", i, 1) for i in range(1, 20, 2)] + [("rain", i, 2) for i in range(20)]
    panel = TASKS["term-plot-gui"](spark, folder, "rain", "2").collect()
    assert [(p["rank"], p.term) for p in panel] == [(0, "rain"), (1, "rain"), (2, "falls")] and panel[2].score == -20
    (tmp_path / "pairs").write_text("rain falls 0.5\nhard snow 0.1\n")
    scores = {r.w2: r for r in TASKS["eval-word-pairs"](spark, folder, f"{tmp_path}/pairs").collect()}
    assert (scores["falls"].human, scores["falls"].dtw, scores["falls"].document_dtw, round(scores["falls"].document_cosine, 9)) == (0.5, -20, -20, 1)
    assert scores["snow"].dtw is None and scores["snow"].document_squared is None
    assert main(["--to", f"{tmp_path}/csv", "similar-terms-cli", folder, "rain"]) == 0
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 20
    capsys.readouterr()
    assert main(["--lines", "similar-terms-cli", folder, "hard"]) == 0
    assert capsys.readouterr().out.splitlines()[0] == "1" + " " * 60 + "1821          1"
    assert main(["--lines", "similar-quantized", folder, "rain", "20", "2"]) == 0
    assert capsys.readouterr().out.splitlines() == ["1820-1839 - w=38:", "  falls 1.000 19", "  rain 1.000 38"]
    assert main(["--lines", "comparison", folder, "rain", "1", "cosine"]) == 0
    assert capsys.readouterr().out.splitlines() == ["falls 1.0"]
    assert main([]) == 2 and main(["nothing"]) == 2 and "unknown task nothing" in capsys.readouterr().err


def test_list_tasks(spark, tmp_path):
    file = lambda name, body: ((tmp_path / name).write_text(body), f"{tmp_path}/{name}")[1]
    listed = file("list", "a /x 1820\nb /y 1821\nc /z 1821\n")
    assert {r.value[0] for r in TASKS["take-from-list"](spark, listed, "9").collect()} == {"a", "b", "c"}
    assert TASKS["take-from-list"](spark, listed, "2").count() == 2
    assert [tuple(r) for r in TASKS["count-books-by-date"](spark, f"{tmp_path}/years", listed).collect()] == [(1820, 1), (1821, 2)]
    assert {r.value for r in spark.read.text(f"{tmp_path}/years/year=1821").collect()} == {"/y", "/z"}
    texts = file("texts", "The Rain of 1850\nfalls 123 to\nrain rain x\n")
    assert {tuple(r) for r in TASKS["filter-words"](spark, texts, "0", "2").collect()} == {("rain", 3), ("1850", 1)}
    assert {tuple(r) for r in TASKS["filter-words"](spark, texts, "1", "2").collect()} == {("falls", 1)}
    counts = [file("c0", "  12 rain\n3 sun\n7 train\n"), file("c1", "9 rain\n 4 sun\n7 train\n")]
    made = TASKS["create-txt-postings"](spark, f"{tmp_path}/txt", "5", *counts)
    assert {tuple(r) for r in made.collect()} == {("rain", 1820, 12), ("rain", 1821, 9), ("train", 1820, 7), ("train", 1821, 7)}
    with pytest.raises(ValueError):
        TASKS["create-txt-postings"](spark, f"{tmp_path}/txt", "5", counts[0])
    assert [r.term for r in TASKS["txt-find-similar"](spark, f"{tmp_path}/txt", "cos", "3", "rain").collect()] == ["rain", "train"]
    assert TASKS["txt-find-similar"](spark, f"{tmp_path}/txt", "cos", "3", "Rain").count() == 0
    exact = TASKS["txt-plot-exact"](spark, f"{tmp_path}/txt", "RAIN", "rain", "snow").collect()
    assert [(r["#"], r["1820"], r["1821"], r["1822"]) for r in exact] == [("rain", 12 / 19, 9 / 16, 0)]
    assert [(r["#"], r["1820"]) for r in TASKS["txt-plot-matching"](spark, f"{tmp_path}/txt", "Rain", "trai").collect()] == [("rain", 12 / 19), ("train", 7 / 19), ("train", 7 / 19)]


def test_book_tasks(spark, tmp_path):
    same, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, f"one\n{same}"), (2, f"two\n{same}"), (3, f"three\n{other}"), (4, f"\n{other} untitled"), (5, None), (6, "")]
    docs = f"{tmp_path}/docs"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(docs)
    chosen = {r.idx for r in TASKS["sample-book-list"](spark, docs, "9", f"{tmp_path}/sample").collect()}
    assert 3 in chosen and len(chosen) == 2 and 4 not in chosen
    barrel = lists.read_barrels(spark, f"{tmp_path}/sample/barrel").collect()
    assert {r.idx for r in barrel} == chosen and all(len(r.words) == 61 for r in barrel)
    legacy = tmp_path / "b.barrel.gz"
    legacy.write_bytes(gzip.compress(lists.barrel_bytes([(7, [int(w) for r in barrel if r.idx == 3 for w in r.words]), (8, [1, 2, 3])])))
    assert [r.idx for r in TASKS["barrel-cmp"](spark, f"{tmp_path}/sample/barrel", str(legacy)).collect()] == [7]
    books = f"{tmp_path}/books"
    spark.createDataFrame([("a", "a", "eng", "1850", None, True), ("b", "b", "fre", "n.d.", None, True)], "id string, identifier string, language string, year string, date string, exists boolean").write.parquet(books)
    assert TASKS["count-books"](spark, books).first().asDict() == {"books": 2, "nonexistent": 0, "bad_metadata": 0, "no_language": 0, "non_english": 1, "no_date": 1}
    assert sum(TASKS["count-books"](spark, books, "swarm", str(i), "3").first().books for i in (1, 2, 3)) == 2
    with pytest.raises(ValueError):
        TASKS["count-books"](spark, books, "swarm", "4", "3")
    listed = f"{tmp_path}/listed"
    spark.read.parquet(books).selectExpr("*", "concat('x/', id, '_meta.xml.bz2') as path").write.parquet(listed)
    assert [tuple(r) for r in TASKS["count-books"](spark, listed, "lines").collect()] == [("a", "x/a_mbtei.xml.gz", 1850)]
