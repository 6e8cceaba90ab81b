"""Registered queries of sinks and sources: whole tables written to files and read back, with SQL for what must return."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import corpus, dedup, index, temporal, textindex
from ..sources import book_functions, lists
from . import queries
from .queries import FREQ, POST, TOK, WORDS
from .storage import new_path


def index_part_file(s, d) -> DataFrame:
    """The part `counts`, written, and opened as the only one of the preferred parts that is there."""
    folder = new_path(s, "index")
    index.build_part(queries.docs(s, d), "counts", folder)
    return index.open_part(s, folder, ("counts+15", "counts"))


def _store(s, d) -> DataFrame:
    folder = new_path(s, "index")
    return s.read.parquet(index.build_part(queries.docs(s, d), index.STORE, folder))


def store_threshold(s, d) -> DataFrame:
    """The counts of frequent terms from a written posting store."""
    return index.threshold(_store(s, d), queries.LEAST)


def store_curves(s, d) -> DataFrame:
    """Curves from a written posting store."""
    return index.store_curves(_store(s, d))


def merged_stores(s, d) -> DataFrame:
    """Two stores over disjoint documents, written, merged, and written again."""
    everything, paths = queries.docs(s, d), [new_path(s, "index") for _ in range(3)]
    for i in range(2):
        index.build_part(everything.where(f"doc_id % 2 = {i}"), index.STORE, paths[i])
    index.write_store(index.merge_stores([s.read.parquet(f"{p}/{index.STORE}") for p in paths[:2]]), paths[2])
    return s.read.parquet(paths[2])


def substrings_of_words(s, d) -> DataFrame:
    """(term, ord): the words that contain each of some thousand substrings: parts' names without their first and last letter."""
    names = queries.table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("name")).where("length(name) > 3").distinct()
    asked = names.select(F.xxhash64("name").alias("h"), F.substring("name", F.lit(2), F.length("name") - 2).alias("q")).select("q").distinct()
    terms = queries.docs(s, d).select(F.explode(text.tokens(F.col("text"))).alias("term")).distinct()
    return textindex.containing(terms, asked.select(F.col("q").alias("ord"), "q"))


def lengths_part_file(s, d) -> DataFrame:
    folder = new_path(s, "index")
    index.build_part(queries.docs(s, d), "lengths", folder)
    return index.open_part(s, folder, ("lengths",))


def count_table_lines(s, d) -> DataFrame:
    """Lines `term c0 ... c99`, gzipped."""
    path = new_path(s, "count-table")
    lists.write_count_table(temporal.dense(queries.frequent(s, d)).withColumnRenamed("curve", "counts"), path, "gzip")
    table = lists.count_table(lists.lines(s, path))
    return table.select("term", F.array_join(F.transform("counts", lambda x: x.cast("long")), ",").alias("counts"))


def word_count_lines(s, d) -> DataFrame:
    """Lines `  count word` of all words."""
    path = new_path(s, "word-counts")
    totals = queries.curves(s, d).groupBy("term").agg(F.sum("tf").alias("n"))
    totals.select(F.format_string("%7d %s", "n", "term").alias("value")).write.option("compression", "bzip2").text(path)
    return lists.word_counts(s.read.text(path))


def numbered_lines(s, d) -> DataFrame:
    """(ord, value): lines keep their order over the files they were written to."""
    path = new_path(s, "lines")
    lines = queries.table(s, d, "orders").select("o_orderkey", F.concat_ws(" ", "o_orderkey", "o_custkey", F.year("o_orderdate")).alias("value"))
    lines.repartitionByRange(7, "o_orderkey").sortWithinPartitions("o_orderkey").select("value").write.text(path)
    return lists.lines(s, path)


def year_list_files(s, d) -> DataFrame:
    """Lists of paths in one folder a year, read back; years past the range are in none."""
    path = new_path(s, "year-lists")
    books = queries.docs(s, d).select(F.concat(F.lit("books/"), "doc_id").alias("path"), (F.col("year") + 5).alias("year"))
    corpus.date_lists(books, path)
    return s.read.schema("value string, year int").text(path).select(F.col("value").alias("path"), "year")


def barrel_file(s, d) -> DataFrame:
    """(idx, words, hashes): the number of a document's words, and the sum of the hashes the barrel holds for them."""
    path = new_path(s, "words")
    lists.write_barrel(dedup.documents(queries.table(s, d, "documents")), path)
    total = F.aggregate("words", F.lit(0).cast("long"), lambda t, w: t + w.cast("long"))
    return lists.read_barrels(s, path).select("idx", F.size("words").cast("long").alias("words"), total.alias("hashes"))


def barrel_binary_file(s, d) -> DataFrame:
    """The same by way of gzipped binary barrels."""
    path = new_path(s, "words.barrel")
    lists.write_barrel(dedup.documents(queries.table(s, d, "documents")), path, binary=True)
    total = F.aggregate("words", F.lit(0).cast("long"), lambda t, w: t + w.cast("long"))
    return lists.read_barrels(s, path).select("idx", F.size("words").cast("long").alias("words"), total.alias("hashes"))


def _books(s, d) -> DataFrame:
    """(doc_id, content): documents as book XML: metadata, then their words, a line break after every 50th."""
    words = F.filter(text.tokens(F.col("text")), lambda w: w != "")
    body = F.array_join(F.transform(words, lambda w, i: F.concat(F.lit('<w c="<'), i, F.lit('>">'), w, F.lit("</w>"), F.when(i % 50 == 49, "<lb />").otherwise(" "))), "")
    head = F.concat(F.lit("<metadata><identifier>"), "doc_id", F.lit("</identifier><source> A &amp; "), F.coalesce("source", F.lit("")), F.lit("&#8212; </source><source>two</source></metadata><text>"))
    return queries.table(s, d, "documents").select("doc_id", F.concat(head, F.coalesce(body, F.lit("")), F.lit("</text>")).cast("binary").alias("content"))


def book_words(s, d) -> DataFrame:
    """(doc_id, position, word): every word of every book."""
    return book_functions.with_rows(_books(s, d), book_functions.book_words)


def book_lines(s, d) -> DataFrame:
    """(doc_id, line, text): every line of every book."""
    return book_functions.with_rows(_books(s, d), book_functions.book_lines)


def book_metadata(s, d) -> DataFrame:
    """(doc_id, identifier, source): the metadata block; a repeated tag's values are joined."""
    maps = book_functions.as_map(book_functions.with_rows(_books(s, d), book_functions.book_metadata), "doc_id")
    return maps.select("doc_id", *(F.col("metadata")[k].alias(k) for k in ("identifier", "source")))


def words_inside_a_tag(s, d) -> DataFrame:
    """(term, doc_id, tf): words inside <hi>, the third to seventh of every ten of a book, by the written part `extents`."""
    words = F.filter(text.tokens(F.col("text")), lambda w: w != "")
    marked = F.transform(words, lambda w, i: F.concat(F.when(i % 10 == 2, "<hi>").otherwise(""), F.lit("<w>"), w, F.lit("</w>"), F.when(i % 10 == 6, "</hi>").otherwise("")))
    docs = queries.table(s, d, "documents").select("doc_id", "text", F.concat(F.lit("<text>"), F.coalesce(F.array_join(marked, " "), F.lit("")), F.lit("</text>")).cast("binary").alias("content"))
    path = index.build_part(docs, "extents", new_path(s, "index"))
    return index.inside(index.positions(docs), s.read.parquet(path), "hi")


def id_path_lines(s, d) -> DataFrame:
    """(id, path) of the lines of two fields, and their numbers in a range of lines."""
    path = new_path(s, "id-paths")
    i = F.col("o_orderkey")
    line = F.concat_ws(" ", i, F.concat(F.lit("x/"), i), F.when(i % 5 == 0, "more"))
    queries.table(s, d, "orders").select(i, line.alias("value")).repartitionByRange(5, i).sortWithinPartitions(i).select("value").write.text(path)
    return lists.id_paths(lists.line_range(lists.lines(s, path), 100, 1000))


def word_pair_lines(s, d) -> DataFrame:
    """(w1, w2, human) of lines of two words and a number."""
    path = new_path(s, "pairs")
    line = F.format_string(" %s  %s %s", "p_brand", F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_size").cast("string"))
    queries.table(s, d, "part").select(F.regexp_replace(line, "#", "").alias("value")).write.text(path)
    return lists.word_pairs(s.read.text(path))


def titled_documents(s, d) -> DataFrame:
    """(idx, title, n): documents that are admitted for having words and a title."""
    return dedup.documents(queries.table(s, d, "documents"), titled=True).select("idx", "title", F.size("words").cast("long").alias("n"))


def curves_csv_file(s, d) -> DataFrame:
    path = new_path(s, "csv")
    lists.write_csv(temporal.curves_csv(queries.curves(s, d), ["the", "of", "die"]), path, "gzip")
    columns = ", ".join(f"`{y}` long" for y in range(1820, 1920))
    return s.read.option("header", True).schema(f"Document string, {columns}").csv(path)


QUERIES = {f.__name__: f for f in (index_part_file, store_threshold, store_curves, merged_stores, substrings_of_words, lengths_part_file, count_table_lines, word_count_lines, numbered_lines, year_list_files, barrel_file, barrel_binary_file, book_words, book_lines, book_metadata, words_inside_a_tag, id_path_lines, word_pair_lines, titled_documents, curves_csv_file)}

ORACLE_SQL = {
    "index_part_file": f"WITH {POST} SELECT * FROM post",
    "store_threshold": queries.ORACLE_SQL["term_totals_having"],
    "store_curves": queries.ORACLE_SQL["term_year_curve"],
    "merged_stores": f"WITH {POST} SELECT term, doc_id, CAST(1820 + doc_id % 100 AS INTEGER) AS year, tf, CAST(sum(tf) OVER (PARTITION BY term) AS BIGINT) AS total FROM post",
    "substrings_of_words": f"WITH {TOK}, v AS (SELECT DISTINCT term FROM tok), n AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part), a AS (SELECT DISTINCT lower(substring(name, 2, length(name) - 2)) AS q, substring(name, 2, length(name) - 2) AS ord FROM n WHERE length(name) > 3) SELECT term, ord FROM v JOIN a ON contains(term, q)",
    "lengths_part_file": queries.ORACLE_SQL["doc_lengths"],
    "count_table_lines": f"WITH {FREQ}, t AS (SELECT DISTINCT term FROM freq), y AS (SELECT CAST(unnest(range(1820, 1920)) AS INTEGER) AS y) SELECT t.term AS term, string_agg(CAST(coalesce(tf, 0) AS VARCHAR), ',' ORDER BY y) AS counts FROM t CROSS JOIN y LEFT JOIN freq ON freq.term = t.term AND freq.year = y GROUP BY t.term",
    "word_count_lines": f"WITH {TOK} SELECT term AS word, count(*) AS cnt FROM tok GROUP BY term",
    "numbered_lines": "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ord, concat_ws(' ', o_orderkey, o_custkey, year(o_orderdate)) AS value FROM orders",
    "year_list_files": "SELECT 'books/' || CAST(doc_id AS VARCHAR) AS path, CAST(1825 + doc_id % 100 AS INTEGER) AS year FROM documents WHERE doc_id % 100 <= 95",
    "barrel_file": f"""WITH {WORDS}, n AS (SELECT idx, unnest(words) AS w FROM d), v AS (SELECT w, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(w, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM (SELECT DISTINCT w FROM n))
        SELECT idx, count(*) AS words, CAST(sum(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) AS BIGINT) AS hashes FROM n JOIN v USING (w) GROUP BY idx""",
    "book_words": "WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents) SELECT doc_id, CAST(unnest(range(len(ws))) AS INTEGER) AS position, unnest(ws) AS word FROM t",
    "book_lines": "WITH t AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '[a-z0-9]+'), []) AS ws FROM documents), l AS (SELECT doc_id, ws, unnest(range(len(ws) // 50 + 1)) AS i FROM t) SELECT doc_id, CAST(i AS INTEGER) AS line, array_to_string(ws[i * 50 + 1 : i * 50 + 50], ' ') AS text FROM l",
    "book_metadata": "SELECT doc_id, CAST(doc_id AS VARCHAR) AS identifier, ' A & ' || coalesce(source, '') || ' ' || chr(10) || 'two' AS source FROM documents",
    "words_inside_a_tag": "WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents), p AS (SELECT doc_id, unnest(ws) AS term, unnest(range(len(ws))) AS pos FROM t) SELECT term, doc_id, count(*) AS tf FROM p WHERE pos % 10 BETWEEN 2 AND 6 GROUP BY ALL",
    "id_path_lines": "WITH o AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT CAST(k AS VARCHAR) AS id, 'x/' || CAST(k AS VARCHAR) AS path FROM o WHERE i BETWEEN 100 AND 1099 AND k % 5 <> 0",
    "word_pair_lines": "SELECT replace(p_brand, '#', '') AS w1, split_part(p_name, ' ', 1) AS w2, CAST(p_size AS DOUBLE) AS human FROM part",
    "titled_documents": f"WITH {WORDS} SELECT idx, title, len(words) AS n FROM d WHERE title <> ''",
    "curves_csv_file": queries.ORACLE_SQL["curves_csv"],
}
ORACLE_SQL["barrel_binary_file"] = ORACLE_SQL["barrel_file"]
