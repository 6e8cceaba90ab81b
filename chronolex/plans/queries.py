"""Registered queries over the driver tables, with equivalent SQL.

The tables have no dated text. Corpus A is `documents` with a synthetic year,
1820 + doc_id % 100. Corpus B is the words of part names by the ship date of their line
items. Corpus C is `events`: the event type by day. Terms are ASCII words, lower-case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels, text
from ..operators import cluster, corpus, dedup, index, similarity, temporal, textindex
from ..sources import books

LEAST, QUERY, K = 15, "the", 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus A: doc_id, text, year (synthetic)."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", (1820 + F.col("doc_id") % 100).cast("int").alias("year"))


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, year, tf) in one aggregation: words are counted by year without a postings table."""
    words = docs(spark, sf_dir).select("year", F.explode(text.tokens(F.col("text"))).alias("term"))
    return words.groupBy("term", "year").agg(F.count("*").alias("tf"))


def frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.frequent(curves(spark, sf_dir), LEAST)


def part_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus B: (term, year, tf) with year = 1820 + months since January 1995."""
    item = table(spark, sf_dir, "lineitem").select("l_partkey", ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1 + 1820).cast("int").alias("year"))
    by_part = item.groupBy("l_partkey", "year").agg(F.count("*").alias("n"))
    names = table(spark, sf_dir, "part").select("p_partkey", F.explode(text.tokens(F.col("p_name"))).alias("term"))
    return by_part.join(names, F.col("l_partkey") == F.col("p_partkey")).groupBy("term", "year").agg(F.sum("n").alias("tf"))


def event_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus C: (term, curve) of event types over all days from the first to the last."""
    days = table(spark, sf_dir, "events").where("ts is not null").select(F.col("event_type").alias("term"), F.to_date("ts").alias("day")).groupBy("term", "day").agg(F.count("*").alias("n"))
    first, last = days.agg(F.min("day"), F.max("day")).first()
    maps = days.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("day", "n"))).alias("m"))
    return maps.select("term", F.transform(F.sequence(F.lit(first), F.lit(last)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0).cast("long"))).alias("curve"))


# --- index ---------------------------------------------------------------------------


def postings_counts(s, d):
    return index.counts_of_all(docs(s, d))


def term_totals_having(s, d):
    return index.postings_to_counts(index.counts(docs(s, d)), LEAST)


def doc_lengths(s, d):
    return index.lengths(docs(s, d))


def vocab_stats(s, d):
    return index.describe(docs(s, d))


def positions_postings(s, d):
    return index.positions(docs(s, d)).select("term", "doc_id", F.array_join("positions", ",").alias("positions"))


def concat_postings(s, d):
    all_docs = docs(s, d)
    return index.concat([index.counts(all_docs.where("doc_id % 2 = 0")), index.counts(all_docs.where("doc_id % 2 = 1"))])


def stemmed_postings(s, d):
    return index.stemmed_counts(docs(s, d))


# --- time ----------------------------------------------------------------------------


def term_year_curve(s, d):
    return temporal.date_counts(index.counts(docs(s, d)), docs(s, d))


def dated_search_topk(s, d):
    hits = temporal.date_search(index.counts(docs(s, d)), docs(s, d), QUERY)
    return hits.orderBy(F.desc("tf"), "doc_id").limit(K)


def hits_by_year(s, d):
    return temporal.by_year(temporal.date_search(index.counts(docs(s, d)), docs(s, d), QUERY)).select("year", "documents", F.col("tf").cast("long").alias("tf"))


def docs_of_year(s, d):
    return temporal.docs_of_year(docs(s, d), 1850)


def curve_dense(s, d):
    return temporal.dense(frequent(s, d)).select("term", F.array_join("curve", ",").alias("curve"))


def curves_csv(s, d):
    return temporal.curves_csv(curves(s, d), ["the", "of", "die"])


def year_prob(s, d):
    return temporal.probabilities(curves(s, d)).select("term", "year", F.round("p", 9).alias("p"))


def step_function_scatter(s, d):
    return temporal.scatter(s, temporal.step_function(s, 1870, 150), docs(s, d))


# --- likeness ------------------------------------------------------------------------


def _similar(method):
    def query(s, d):
        return similarity.similar(frequent(s, d), QUERY, method, K)

    return query


def similar_dtw_parts(s, d):
    return similarity.similar(part_months(s, d), "red", "dtw", K)


def quantized_topk(s, d):
    return similarity.quantized(curves(s, d), QUERY, 10, 5)


def word_pair_scores(s, d):
    pairs = s.createDataFrame([("the", "of"), ("of", "and"), ("die", "der"), ("la", "que")], "w1 string, w2 string")
    scores = similarity.word_pairs(curves(s, d), pairs)
    return scores.select("w1", "w2", *(F.round(c, 6).alias(c) for c in ("squared", "cosine", "js", "dtw")))


def word_pair_scores_by_document(s, d):
    """The same over the axis of all documents."""
    pairs = [("the", "of"), ("of", "and")]
    points, length = similarity.on_document_axis(docs(s, d), sorted({w for p in pairs for w in p}))
    scores = similarity.word_pairs_by_document(points, length, s.createDataFrame(pairs, "w1 string, w2 string"))
    return scores.select("w1", "w2", *(F.round(c, 6).alias(c) for c in ("squared", "cosine", "js", "dtw")))


def word_pair_scores_on_both_axes(s, d):
    """The eight scores of each pair."""
    pairs = s.createDataFrame([("the", "of"), ("of", "and")], "w1 string, w2 string")
    scores = similarity.word_pairs_on_both_axes(docs(s, d), curves(s, d), pairs)
    return scores.select("w1", "w2", *(F.round(c, 6).alias(c) for c in scores.columns[2:]))


def search_panel(s, d):
    """The query's curve (rank 0), then those of its 20 closest terms by warping over the document axis."""
    return similarity.panel(docs(s, d), curves(s, d), QUERY, 20)


def search_panel_of_a_step(s, d):
    """The same for the step function that starts in 1870."""
    return similarity.panel(docs(s, d), curves(s, d), "$1870", 20)


# --- text index ----------------------------------------------------------------------


def txt_create_threshold(s, d):
    return textindex.create(curves(s, d), 5).select("term", "year", "tf")


def txt_exact(s, d):
    return textindex.exact(curves(s, d), ["the", "une", "The", "nosuchword"])[0].select("term", "year", F.round("p", 9).alias("p"))


def txt_matching(s, d):
    return textindex.matching(curves(s, d), ["ingthe", "THE"]).select("term", "year", F.round("p", 9).alias("p"), "ord")


def txt_find_similar(s, d):
    return textindex.find_similar(frequent(s, d), QUERY, "cos", 10)


def txt_find_different(s, d):
    return textindex.find_similar(frequent(s, d), QUERY, "cos-diff", 10)


# --- statistics, filters, census -----------------------------------------------------


def moving_average(s, d):
    return event_curves(s, d).select("term", F.array_join(kernels.moving_average(F.col("curve"), 5), ",").alias("averages"))


def curve_summary_stats(s, d):
    return corpus.statistics(event_curves(s, d), base=1)


def token_filter(s, d):
    words = table(s, d, "documents").select(F.explode(F.split("text", "[ \n]")).alias("w"))
    return text.filter_words(words, "w").groupBy("term").agg(F.count("*").alias("n"))


def token_normaliser(s, d):
    words = table(s, d, "pages").select(F.explode(F.split("html", "[ \n]")).alias("w"))
    return words.select(text.normalised(F.col("w")).alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("n"))


def _metadata(s, d):
    """Synthetic metadata of every document, in the shapes that the two resolvers tell apart."""
    i = F.col("doc_id")
    y = (1790 + i % 160).cast("string")
    year = F.when(i % 6 == 0, y).when(i % 6 == 1, F.concat(F.lit("[c"), y, F.lit("]"))).when(i % 6 == 2, F.concat(y, F.lit("-51"))).when(i % 6 == 3, F.lit("n.d."))
    date = F.when(i % 4 < 3, (1800 + i % 140).cast("string"))
    return table(s, d, "documents").select("doc_id", year.alias("year"), date.alias("date"))


def year_resolver_retrieval(s, d):
    return _metadata(s, d).select("doc_id", text.retrieval_year(F.col("year"), F.col("date")).alias("resolved")).where("resolved is not null")


def year_resolver_census(s, d):
    return _metadata(s, d).select("doc_id", text.census_year(F.col("year"), F.col("date")).alias("resolved")).where("resolved is not null")


def census_counters(s, d):
    m = _metadata(s, d).join(table(s, d, "documents").select("doc_id", "lang"), "doc_id")
    i = F.col("doc_id")
    book = m.select(i.cast("string").alias("id"), F.when(i % 10 == 1, "other").otherwise(i.cast("string")).alias("identifier"), F.when(i % 9 == 2, " ").when(F.col("lang") == "en", " English").otherwise(F.col("lang")).alias("language"), "year", "date", (i % 8 != 3).alias("exists"))
    return corpus.census(book)


def dated_books(s, d):
    """The census's lines; some metadata files have another ending, some books no year."""
    i = F.col("doc_id")
    path = F.concat(F.lit("books/"), i, F.when(i % 7 == 4, "_meta.xml").otherwise("_meta.xml.bz2"))
    return corpus.dated_books(_metadata(s, d).select(i.cast("string").alias("id"), path.alias("path"), "year", "date", (i % 8 != 3).alias("exists")))


def sample_list(s, d):
    return corpus.sample_list(table(s, d, "pages").select("url"), 20, column="url")


def shard_lines(s, d):
    return corpus.shard(table(s, d, "pages").select(F.col("page_id").alias("ord"), "url"), 1, 3)


# --- near duplicates -----------------------------------------------------------------


def _reps(s, d):
    return dedup.representatives(dedup.documents(table(s, d, "documents")))


def dup_overlap_pairs(s, d):
    return dedup.overlaps(_reps(s, d)[0]).select("a", "b", F.round("overlap", 6).alias("overlap"))


def dup_members(s, d):
    return _reps(s, d)[1]


def dup_pairs_full(s, d):
    """Whole texts are compared; the barrels and the sample count the first 2,000 common words, as the reference does."""
    return dedup.similar_pairs(_reps(s, d)[0], limit=None)


def dup_titles(s, d):
    return dedup.title_edges(dedup.documents(table(s, d, "documents")))


def barrel_compare(s, d):
    """Documents of the second barrel (odd ids) that are similar to any of the first (even ids)."""
    everything = dedup.documents(table(s, d, "documents"))
    return dedup.barrel_compare(everything.where("idx % 2 = 0"), everything.where("idx % 2 = 1"))


def unique_sample(s, d):
    return dedup.sample_unique(dedup.documents(table(s, d, "documents")), 100)


# --- clusters, parser ----------------------------------------------------------------


def kmeans_two_pass(s, d):
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("row_idx"), F.col("embedding").alias("vec"))
    return cluster.k_means(rows, 8)


def parse_tags(s, d):
    """(page_id, title): the first <title> of each page, by the parser."""
    pages = table(s, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"))
    parsed = pages.mapInArrow(_titles, "page_id long, title string")
    return parsed


def _titles(batches):
    import pyarrow as pa

    for batch in batches:
        rows = [(int(p), books.metadata(c.decode("utf-8", "replace"), ["title"]).get("title")) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["page_id", "title"])


QUERIES = {
    f.__name__: f
    for f in (
        postings_counts, term_totals_having, doc_lengths, vocab_stats, positions_postings, concat_postings, stemmed_postings, term_year_curve, dated_search_topk, hits_by_year,
        docs_of_year, curve_dense, curves_csv, year_prob, step_function_scatter, similar_dtw_parts, quantized_topk, word_pair_scores, word_pair_scores_by_document, word_pair_scores_on_both_axes, search_panel, search_panel_of_a_step,
        txt_create_threshold, txt_exact, txt_matching, txt_find_similar, txt_find_different, moving_average, curve_summary_stats, token_filter, token_normaliser, year_resolver_retrieval,
        year_resolver_census, census_counters, dated_books, sample_list, shard_lines, dup_overlap_pairs, dup_members, dup_pairs_full, dup_titles, barrel_compare, unique_sample, kmeans_two_pass, parse_tags,
    )
}
for _name, _method in (("cosine", "cosine"), ("cosdiff", "cos-diff"), ("squared", "squared"), ("js_reference", "js-reference"), ("js_standard", "js-standard"), ("emd", "earth-mover"), ("dtw", "dtw")):
    QUERIES[f"similar_{_name}"] = _similar(_method)


TOK = "tok AS (SELECT doc_id, CAST(1820 + doc_id % 100 AS INTEGER) AS year, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)"
POST = f"{TOK}, post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL)"
CUR = f"{TOK}, cur AS (SELECT term, year, count(*) AS tf FROM tok GROUP BY ALL)"
FREQ = f"{CUR}, freq AS (SELECT cur.* FROM cur JOIN (SELECT term FROM cur GROUP BY term HAVING sum(tf) >= {LEAST}) USING (term)), q AS (SELECT year, tf AS q FROM freq WHERE term = '{QUERY}'), oth AS (SELECT * FROM freq)"
RANK = "ranked AS (SELECT CAST(row_number() OVER (ORDER BY round(score, 9) DESC, term) AS INTEGER) AS rank, term, round(score, 6) AS score FROM scored) SELECT * FROM ranked WHERE rank <= "
SPARSE = f"WITH {FREQ}, nd AS (SELECT term, CAST(sum(tf * tf) AS BIGINT) AS n, CAST(sum(tf * coalesce(q, 0)) AS BIGINT) AS dot FROM oth LEFT JOIN q USING (year) GROUP BY term), own AS (SELECT CAST(sum(q * q) AS BIGINT) AS o FROM q)"
SHARES = f"""WITH {FREQ}, sh AS (SELECT term, year, tf / sum(tf) OVER (PARTITION BY year) AS p FROM freq), qs AS (SELECT year, p AS q FROM sh WHERE term = '{QUERY}'),
    sums AS (SELECT term, sum(p * p) AS n, sum(p * coalesce(q, 0)) AS dot FROM sh LEFT JOIN qs USING (year) GROUP BY term), own AS (SELECT sum(q * q) AS o FROM qs)"""
DAYS = "e AS (SELECT event_type AS term, CAST(ts AS DATE) AS day FROM events WHERE ts IS NOT NULL), days AS (SELECT t.term, d.day, coalesce(n, 0) AS n FROM (SELECT DISTINCT term FROM e) t CROSS JOIN (SELECT CAST(unnest(range(min(day), max(day) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM e) d LEFT JOIN (SELECT term, day, count(*) AS n FROM e GROUP BY ALL) USING (term, day))"
CSV_YEARS = ", ".join(f'CAST(coalesce(sum(tf) FILTER (year = {y}), 0) AS BIGINT) AS "{y}"' for y in range(1820, 1920))
META = """meta AS (SELECT doc_id, lang,
    CASE doc_id % 6 WHEN 0 THEN CAST(1790 + doc_id % 160 AS VARCHAR) WHEN 1 THEN '[c' || CAST(1790 + doc_id % 160 AS VARCHAR) || ']' WHEN 2 THEN CAST(1790 + doc_id % 160 AS VARCHAR) || '-51' WHEN 3 THEN 'n.d.' END AS year,
    CASE WHEN doc_id % 4 < 3 THEN CAST(1800 + doc_id % 140 AS VARCHAR) END AS date FROM documents), dig AS (SELECT *, regexp_replace(year, '[^0-9]', '', 'g') AS yd, regexp_replace(date, '[^0-9]', '', 'g') AS dd FROM meta),
    four AS (SELECT *, coalesce(CASE WHEN length(yd) = 4 THEN CAST(yd AS INTEGER) END, CASE WHEN length(dd) = 4 THEN CAST(dd AS INTEGER) END) AS resolved FROM dig)"""
WORDS = "w AS (SELECT doc_id AS idx, regexp_extract_all(lower(text), '[a-z0-9]+') AS words, trim(lower(split_part(text, chr(10), 1))) AS title FROM documents), d AS (SELECT * FROM w WHERE len(words) > 0), k AS (SELECT *, min(idx) OVER (PARTITION BY array_to_string(words, ' ')) AS rep FROM d)"


def _js(middle: str, lone: str) -> str:
    return f"""WITH {FREQ}, tot AS (SELECT term, sum(tf) AS t FROM oth GROUP BY term), qt AS (SELECT sum(q) AS t FROM q),
        r AS (SELECT oth.term, q / (SELECT t FROM qt) AS p, tf / tot.t AS x FROM oth JOIN q USING (year) JOIN tot ON tot.term = oth.term),
        sums AS (SELECT term, sum(p * ln(p / ({middle})) + x * ln(x / ({middle}))) AS dd, sum(p) AS p, sum(x) AS x FROM r GROUP BY term),
        scored AS (SELECT term, 1 - 0.5 * (coalesce(dd, 0) + ({lone}) * ln(2.0::DOUBLE)) AS score FROM tot LEFT JOIN sums USING (term)), {RANK}{K}"""


ORACLE_SQL = {
    "postings_counts": f"WITH {POST} SELECT * FROM post",
    "concat_postings": f"WITH {POST} SELECT * FROM post",
    "term_totals_having": f"WITH {POST}, t AS (SELECT term, CAST(sum(tf) AS BIGINT) AS total FROM post GROUP BY term HAVING sum(tf) >= {LEAST}) SELECT term, doc_id, tf, total FROM post JOIN t USING (term)",
    "doc_lengths": "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS BIGINT) AS length FROM documents",
    "vocab_stats": f"WITH {TOK} SELECT (SELECT count(*) FROM documents) AS documents, count(DISTINCT term) AS terms, count(*) AS words FROM tok",
    "positions_postings": "WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents), p AS (SELECT doc_id, unnest(ws) AS term, unnest(range(len(ws))) AS pos FROM t) SELECT term, doc_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM p GROUP BY ALL",
    "term_year_curve": f"WITH {CUR} SELECT * FROM cur",
    "dated_search_topk": f"WITH {POST} SELECT doc_id, CAST(1820 + doc_id % 100 AS INTEGER) AS year, tf FROM post WHERE term = '{QUERY}' ORDER BY tf DESC, doc_id LIMIT {K}",
    "hits_by_year": f"WITH {POST} SELECT CAST(1820 + doc_id % 100 AS INTEGER) AS year, count(*) AS documents, CAST(sum(tf) AS BIGINT) AS tf FROM post WHERE term = '{QUERY}' GROUP BY 1",
    "docs_of_year": "SELECT doc_id, CAST(1850 AS INTEGER) AS year FROM documents WHERE doc_id % 100 = 30",
    "curve_dense": f"WITH {FREQ} SELECT term, string_agg(CAST(coalesce(tf, 0) AS VARCHAR), ',' ORDER BY y) AS curve FROM (SELECT DISTINCT term FROM freq) t CROSS JOIN (SELECT CAST(unnest(range(1820, 1920)) AS INTEGER) AS y) LEFT JOIN freq ON freq.term = t.term AND freq.year = y GROUP BY t.term".replace("SELECT term, string_agg", "SELECT t.term AS term, string_agg"),
    "curves_csv": f"WITH {CUR} SELECT term AS \"Document\", {CSV_YEARS} FROM cur WHERE term IN ('the', 'of', 'die') GROUP BY term",
    "year_prob": f"WITH {CUR} SELECT term, year, round(tf / sum(tf) OVER (PARTITION BY year), 9) AS p FROM cur",
    "step_function_scatter": "WITH y AS (SELECT doc_id, CAST(1820 + doc_id % 100 AS INTEGER) AS year FROM documents), n AS (SELECT year, CASE WHEN year >= 1870 THEN 150 ELSE 0 END // count(*) AS tf FROM y GROUP BY year) SELECT doc_id, year, CAST(tf AS BIGINT) AS tf FROM y JOIN n USING (year) WHERE tf > 0",
    "similar_cosine": f"{SPARSE}, scored AS (SELECT term, dot / (sqrt(o::DOUBLE) * sqrt(n::DOUBLE)) AS score FROM nd, own), {RANK}{K}",
    "similar_cosdiff": f"{SPARSE}, scored AS (SELECT term, 1 - dot / (sqrt(o::DOUBLE) * sqrt(n::DOUBLE)) AS score FROM nd, own), {RANK}{K}",
    "txt_find_similar": f"{SHARES}, scored AS (SELECT term, dot / (sqrt(o) * sqrt(n)) AS score FROM sums, own), {RANK}10",
    "txt_find_different": f"{SHARES}, scored AS (SELECT term, 1 - dot / (sqrt(o) * sqrt(n)) AS score FROM sums, own), {RANK}10",
    "similar_squared": f"{SPARSE}, scored AS (SELECT term, CASE WHEN n + o - 2 * dot = 0 THEN 'inf'::DOUBLE ELSE 0.0 - ln((n + o - 2 * dot)::DOUBLE) END AS score FROM nd, own), {RANK}{K}",
    "similar_js_reference": _js("p + x / 2", "1 - coalesce(x, 0)"),
    "similar_js_standard": _js("(p + x) / 2", "2 - coalesce(x, 0) - coalesce(p, 0)"),
    "similar_emd": f"WITH {FREQ}, spine AS (SELECT CAST(unnest(range(1820, 1920)) AS INTEGER) AS year), run AS (SELECT t.term, sum(coalesce(q, 0) - coalesce(tf, 0)) OVER (PARTITION BY t.term ORDER BY spine.year) AS r FROM (SELECT DISTINCT term FROM oth) t CROSS JOIN spine LEFT JOIN oth ON oth.term = t.term AND oth.year = spine.year LEFT JOIN q ON q.year = spine.year), scored AS (SELECT term, 0.0 - sum(abs(r))::DOUBLE AS score FROM run GROUP BY term), {RANK}{K}",
    "quantized_topk": f"""WITH {CUR}, qq AS (SELECT year, tf AS q FROM cur WHERE term = '{QUERY}'),
        c AS (SELECT term, (year - 1820) // 10 AS b, tf, coalesce(q, 0) AS q FROM cur LEFT JOIN qq USING (year) WHERE (year - 1820) % 10 < 9),
        o AS (SELECT (year - 1820) // 10 AS b, CAST(sum(q) AS BIGINT) AS query_weight, CAST(sum(q * q) AS BIGINT) AS own FROM qq WHERE (year - 1820) % 10 < 9 GROUP BY 1),
        s AS (SELECT term, b, sum(tf * q)::BIGINT AS dot, sum(tf * tf)::BIGINT AS n, sum(tf)::BIGINT AS candidate_total FROM c GROUP BY ALL),
        r AS (SELECT *, dot / (sqrt(own::DOUBLE) * sqrt(n::DOUBLE)) AS score FROM s JOIN o USING (b)),
        k AS (SELECT *, CAST(row_number() OVER (PARTITION BY b ORDER BY round(score, 9) DESC, term) AS INTEGER) AS rank FROM r)
        SELECT CAST(1820 + b * 10 AS INTEGER) AS start, CAST(1829 + b * 10 AS INTEGER) AS end, rank, term, round(score, 6) AS score, query_weight, candidate_total FROM k WHERE rank <= 5""",
    "txt_create_threshold": f"WITH {CUR} SELECT cur.* FROM cur JOIN (SELECT term FROM cur GROUP BY term HAVING max(tf) > 5) USING (term)",
    "txt_exact": f"WITH {CUR}, p AS (SELECT term, year, round(tf / sum(tf) OVER (PARTITION BY year), 9) AS p FROM cur) SELECT * FROM p WHERE term IN ('the', 'une', 'The', 'nosuchword')",
    "txt_matching": f"WITH {CUR}, p AS (SELECT term, year, round(tf / sum(tf) OVER (PARTITION BY year), 9) AS p FROM cur) SELECT p.*, CAST(o AS INTEGER) AS ord FROM p JOIN (VALUES (0, 'ingthe'), (1, 'the')) v(o, s) ON contains(term, s)",
    "moving_average": f"WITH {DAYS}, m AS (SELECT term, day, sum(n) OVER w AS s, count(*) OVER w AS c FROM days WINDOW w AS (PARTITION BY term ORDER BY day ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT term, string_agg(CAST(CAST(s AS BIGINT) // 5 AS VARCHAR), ',' ORDER BY day) AS averages FROM m WHERE c = 5 GROUP BY term",
    "curve_summary_stats": f"WITH {DAYS}, l AS (SELECT term, list(n ORDER BY day) AS c, list(n ORDER BY n) AS o FROM days GROUP BY term) SELECT term, CAST(list_sum(c) AS BIGINT) AS total, round(list_sum(c) / len(c), 6) AS mean, round(list_var_pop(c), 6) AS variance, CAST((o[(len(o) + 1) // 2] + o[len(o) // 2 + 1]) // 2 AS BIGINT) AS median, list_max(c) AS most, list_min(c) AS least, CAST(list_position(c, list_max(c)) AS INTEGER) AS most_at, CAST(list_position(c, list_min(c)) AS INTEGER) AS least_at FROM l",
    "token_filter": f"WITH w AS (SELECT unnest(regexp_split_to_array(text, '[ \\n]')) AS w FROM documents) SELECT lower(w) AS term, count(*) AS n FROM w WHERE regexp_full_match(w, '[A-Za-z]{{2,}}|[0-9]{{2}}|[0-9]{{4}}') AND lower(w) NOT IN {text.STOP_WORDS} GROUP BY 1",
    "token_normaliser": r"WITH w AS (SELECT regexp_replace(lower(unnest(regexp_split_to_array(html, '[ \n]'))), '[^\p{L}\p{Nd}]', '', 'g') AS term FROM pages) SELECT term, count(*) AS n FROM w WHERE term <> '' GROUP BY 1",
    "year_resolver_retrieval": f"WITH {META}, r AS (SELECT doc_id, TRY_CAST(coalesce(yd, dd) AS INTEGER) AS resolved FROM dig) SELECT * FROM r WHERE resolved BETWEEN 1820 AND 1919",
    "year_resolver_census": f"WITH {META} SELECT doc_id, resolved FROM four WHERE resolved IS NOT NULL",
    "census_counters": f"WITH {META}, b AS (SELECT *, doc_id % 8 <> 3 AS ex, CASE WHEN doc_id % 9 = 2 THEN ' ' WHEN lang = 'en' THEN ' English' ELSE lang END AS language FROM four) SELECT count(*) FILTER (ex) AS books, count(*) FILTER (NOT ex) AS nonexistent, count(*) FILTER (ex AND doc_id % 10 = 1) AS bad_metadata, count(*) FILTER (ex AND (language IS NULL OR trim(language) = '')) AS no_language, count(*) FILTER (ex AND trim(language) <> '' AND NOT starts_with(trim(lower(language)), 'eng')) AS non_english, count(*) FILTER (ex AND resolved IS NULL) AS no_date FROM b",
    "dated_books": f"WITH {META} SELECT CAST(doc_id AS VARCHAR) AS id, 'books/' || CAST(doc_id AS VARCHAR) || '_mbtei.xml.gz' AS path, resolved AS year FROM four WHERE doc_id % 8 <> 3 AND doc_id % 7 <> 4 AND resolved IS NOT NULL",
    "sample_list": "SELECT url FROM pages ORDER BY md5(concat_ws(':', '13', url)), url LIMIT 20",
    "shard_lines": "SELECT page_id AS ord, url FROM pages WHERE page_id % 3 = 1",
    "dup_members": f"WITH {WORDS} SELECT idx, rep FROM k",
    "dup_titles": f"WITH {WORDS}, t AS (SELECT idx, min(idx) OVER (PARTITION BY title) AS a FROM d WHERE title <> '') SELECT a, idx AS b FROM t WHERE a < idx",
    "dup_overlap_pairs": f"WITH {WORDS}, v AS (SELECT DISTINCT idx, unnest(words) AS w FROM k WHERE idx = rep), n AS (SELECT idx, count(*) AS n FROM v GROUP BY idx), c AS (SELECT x.idx AS a, y.idx AS b, count(*) AS c FROM v x JOIN v y ON x.w = y.w AND x.idx < y.idx GROUP BY ALL) SELECT a, b, round(c / greatest(na.n, nb.n), 6) AS overlap FROM c JOIN n na ON na.idx = a JOIN n nb ON nb.idx = b WHERE c / greatest(na.n, nb.n) >= 0.5",
    "parse_tags": "SELECT page_id, nullif(regexp_extract(html, '<title[^>]*>([^<]*)<', 1), '') AS title FROM pages",
}
