"""Command line over index folders: python -m chronolex TASK ARGUMENT...; without a task, the list of them."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import corpus, dedup, index, similarity, temporal, textindex
from .sources import lists


def _curves(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/date-counts")


def inspect(spark: SparkSession, folder: str) -> DataFrame:
    """FOLDER: documents, those without words included, terms and words of an index, and its parts"""
    parts = index.parts(spark, folder)
    listed = next((p for p in ("corpus", "names", "lengths", "counts") if p in parts), None)
    if listed is None:
        raise FileNotFoundError(f"no part with documents in {folder}")
    counts = spark.read.parquet(f"{folder}/counts") if "counts" in parts else spark.createDataFrame([], "term string, tf long")
    documents = spark.read.parquet(f"{folder}/{listed}").agg((F.countDistinct("doc_id") if listed == "counts" else F.count("*")).alias("documents"))
    words = counts.agg(F.countDistinct("term").alias("terms"), F.coalesce(F.sum("tf"), F.lit(0)).cast("long").alias("words"))
    return documents.crossJoin(words).withColumn("parts", F.lit(" ".join(parts)))  # one row by one row


def build_index_part(spark: SparkSession, docs: str, part: str, folder: str, first: str = "0") -> DataFrame:
    """DOCS PART FOLDER [FIRST]: write a part from a Parquet table (doc_id, text)"""
    return spark.read.parquet(index.build_part(spark.read.parquet(docs), part, folder, int(first)))


def concat_postings(spark: SparkSession, out: str, *parts: str) -> DataFrame:
    """OUT PART...: merge parts over disjoint documents"""
    merged = index.concat([spark.read.parquet(p) for p in parts])
    if "total" in merged.columns:
        index.write_store(index.merge_stores([merged]), out)
    else:
        merged.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(out)
    return spark.read.parquet(out)


def postings_to_counts(spark: SparkSession, postings: str, out: str, least: str) -> DataFrame:
    """PART OUT LEAST: counts of the terms that occur LEAST times or more"""
    given = spark.read.parquet(postings)
    (index.threshold(given, int(least)) if "total" in given.columns else index.postings_to_counts(given, int(least))).write.parquet(out)
    return spark.read.parquet(out)


def make_date_counts(spark: SparkSession, folder: str) -> DataFrame:
    """FOLDER: the part date-counts from the part store, or from counts and corpus (doc_id, year)"""
    if index.STORE in index.parts(spark, folder):
        found = index.store_curves(spark.read.parquet(f"{folder}/{index.STORE}"))
    else:
        found = temporal.date_counts(spark.read.parquet(f"{folder}/counts"), spark.read.parquet(f"{folder}/corpus"))
    found.write.parquet(f"{folder}/date-counts")
    return _curves(spark, folder)


def output_doc_csv(spark: SparkSession, folder: str, *terms: str) -> DataFrame:
    """FOLDER TERM...: a row of yearly counts for each term"""
    return temporal.curves_csv(_curves(spark, folder), [t.lower() for t in terms])


def comparison(spark: SparkSession, folder: str, term: str, k: str, method: str = "dtw") -> DataFrame:
    """FOLDER TERM K [METHOD]: the K terms with the most similar curves"""
    return similarity.similar(_curves(spark, folder), term.lower(), method, int(k)).orderBy("rank")


def similar_quantized(spark: SparkSession, folder: str, term: str, years: str, k: str) -> DataFrame:
    """FOLDER TERM YEARS K: the K most similar terms within each block of YEARS years"""
    return similarity.quantized(_curves(spark, folder), term.lower(), int(years), int(k)).orderBy("start", "rank")


def barrel_cmp(spark: SparkSession, a: str, b: str) -> DataFrame:
    """A B: documents of barrel B that are similar to any of barrel A"""
    return dedup.barrel_compare(*(lists.read_barrels(spark, p).withColumn("title", F.lit("")) for p in (a, b)))


def sample_book_list(spark: SparkSession, docs: str, n: str, out: str) -> DataFrame:
    """DOCS N OUT: N documents with words and title, none a near-duplicate of another; OUT/dedup lists them, OUT/barrel holds their words"""
    table = spark.read.parquet(docs)
    admitted = dedup.documents(table, "title" if "title" in table.columns else None, titled=True)
    dedup.sample_unique(admitted, int(n)).write.mode("overwrite").parquet(f"{out}/dedup")
    chosen = spark.read.parquet(f"{out}/dedup")
    lists.write_barrel(admitted.join(F.broadcast(chosen) if int(n) <= 1_000_000 else chosen, "idx", "left_semi"), f"{out}/barrel")
    return chosen


def count_books(spark: SparkSession, books: str, mode: str = "", node: str = "1", nodes: str = "1") -> DataFrame:
    """BOOKS [swarm NODE NODES | lines]: counters over a Parquet table (id, identifier, language, year, date, exists), or over a worker's part (from 1);
    or the lines (id book-path year) of its dated books, from the column path"""
    table = spark.read.parquet(books)
    if mode == "lines":
        return corpus.dated_books(table)
    if mode == "swarm":
        if not 1 <= int(node) <= int(nodes):
            raise ValueError("NODE is 1 to NODES")
        table = table.where(F.pmod(F.xxhash64("id"), F.lit(int(nodes))) == int(node) - 1)
    elif mode:
        raise ValueError(f"unknown mode {mode}")
    return corpus.census(table)


def count_books_by_date(spark: SparkSession, out: str, listed: str) -> DataFrame:
    """OUT LIST: a list of paths below OUT for each year of the lines (id path year); gives the books of each year"""
    dated = lists.id_path_years(spark.read.text(listed))
    corpus.date_lists(dated, out)
    return dated.groupBy("year").agg(F.count("*").alias("books")).orderBy("year")


def eval_word_pairs(spark: SparkSession, folder: str, pairs: str) -> DataFrame:
    """FOLDER PAIRS: eight scores of each line (word word human), over years and over documents"""
    return similarity.word_pairs_on_both_axes(spark.read.parquet(f"{folder}/corpus"), _curves(spark, folder), lists.word_pairs(spark.read.text(pairs)))


def take_from_list(spark: SparkSession, listed: str, n: str) -> DataFrame:
    """LIST N: N lines in a seeded random order"""
    return corpus.sample_list(spark.read.text(listed), int(n), column="value")


def filter_words(spark: SparkSession, texts: str, worker: str, workers: str) -> DataFrame:
    """TEXTS WORKER WORKERS: words of a worker's lines (from 0) that pass the filter, with their counts"""
    mine = corpus.shard(lists.lines(spark, texts), int(worker), int(workers))
    words = mine.select(F.explode(F.split("value", " ")).alias("word"))
    return text.filter_words(words, "word").groupBy("term").agg(F.count("*").alias("n"))


def create_txt_postings(spark: SparkSession, out: str, threshold: str, *counts: str) -> DataFrame:
    """OUT THRESHOLD COUNTS COUNTS...: an index of the words whose count is above THRESHOLD in any of the files of lines (count word), one for each slot"""
    if len(counts) < 2:
        raise ValueError("two count files at least")
    slots = [lists.word_counts(spark.read.text(c)).select(F.col("word").alias("term"), F.lit(text.FIRST_YEAR + i).alias("year"), F.col("cnt").alias("tf")) for i, c in enumerate(counts)]
    textindex.create(index.concat(slots), int(threshold)).repartitionByRange("term").sortWithinPartitions("term", "year").write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def txt_find_similar(spark: SparkSession, folder: str, method: str, k: str, term: str) -> DataFrame:
    """INDEX cos|cos-diff K TERM: the K words ranked by likeness to TERM, or by the lack of it"""
    return textindex.find_similar(spark.read.parquet(folder), term, method, int(k)).orderBy("rank")


def txt_plot_exact(spark: SparkSession, folder: str, *terms: str) -> DataFrame:
    """INDEX TERM...: a row of yearly shares for each of the words, as written; words that are not there give none"""
    found, missing = textindex.exact(spark.read.parquet(folder), list(terms))
    for r in missing.orderBy("ord").collect():  # of the arguments
        print(f"{r['term']} was not found", file=sys.stderr)
    return temporal.in_columns(found, "#", "p", "double", "ord").orderBy("ord").drop("ord")


def txt_plot_matching(spark: SparkSession, folder: str, *parts: str) -> DataFrame:
    """INDEX PART...: the yearly shares of all words that contain one of the parts, for each part"""
    return temporal.in_columns(textindex.matching(spark.read.parquet(folder), list(parts)), "#", "p", "double", "ord").orderBy("ord", "#").drop("ord")


def similar_terms_cli(spark: SparkSession, folder: str, *terms: str) -> DataFrame:
    """FOLDER TERM...: the dated documents of each term, by year"""
    counts, docs = (spark.read.parquet(f"{folder}/{p}") for p in ("counts", "corpus"))
    hits = [temporal.date_search(counts, docs, t).withColumn("term", F.lit(t.lower())) for t in terms]
    return index.concat(hits).orderBy("term", "year", "doc_id")


def term_plot_gui(spark: SparkSession, folder: str, term: str, k: str = "20") -> DataFrame:
    """FOLDER TERM|$YYYY [K]: the curve of TERM, or of a step that starts in the year YYYY, and of the K terms closest to it over the documents, without a window"""
    return similarity.panel(spark.read.parquet(f"{folder}/corpus"), _curves(spark, folder), term, int(k)).orderBy("rank")


TASKS = {
    f.__name__.replace("_", "-"): f
    for f in (
        inspect, build_index_part, concat_postings, postings_to_counts, make_date_counts, output_doc_csv, comparison, similar_quantized, barrel_cmp, sample_book_list, count_books,
        count_books_by_date, eval_word_pairs, take_from_list, filter_words, create_txt_postings, txt_find_similar, txt_plot_exact, txt_plot_matching, similar_terms_cli, term_plot_gui,
    )
}


#: Tasks with a printed form of their own, for --lines.
LINES = {"comparison": lists.score_lines, "txt-find-similar": lists.score_lines, "similar-terms-cli": lists.hit_lines, "similar-quantized": lists.block_lines}


def main(arguments: list[str], rows: int = 100) -> int:
    """Runs a task: writes its whole result as CSV to the folder after --to, or else prints the first `rows` rows, as plain lines after --lines
    where the task has such a form; 2 without a known task."""
    folder, plain = None, arguments[:1] == ["--lines"]
    arguments = arguments[1:] if plain else arguments
    if len(arguments) > 1 and arguments[0] == "--to":
        folder, arguments = arguments[1], arguments[2:]
    if not arguments or arguments[0] not in TASKS:
        print(*([f"unknown task {arguments[0]}"] if arguments else []), "[--lines | --to FOLDER] TASK ARGUMENT..., tasks:", *(f"  {name} {f.__doc__}" for name, f in TASKS.items()), sep="\n", file=sys.stderr)
        return 2
    found = TASKS[arguments[0]](SparkSession.builder.getOrCreate(), *arguments[1:])
    if plain and arguments[0] in LINES:
        for r in LINES[arguments[0]](found).take(rows):
            print(r["value"])
    elif folder is None:
        found.show(rows, truncate=False)
    else:
        arrays = [c for c, t in found.dtypes if t.startswith("array")]
        lists.write_csv(found.select(*(F.array_join(c, ",").alias(c) if c in arrays else F.col(c) for c in found.columns)), folder)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
