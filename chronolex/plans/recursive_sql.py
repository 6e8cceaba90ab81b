"""SQL of the queries whose dynamic programmes and sequential choices are recursive."""

from __future__ import annotations

from .queries import CUR, FREQ, RANK, WORDS, K

BAND = 10


def warped(n: str) -> str:
    """CTE `warp` (key, d, e) over `sides` (key, a, b), curves of n places. Step d holds, for each difference k of row and
    column, the cost of the last cell met on that diagonal: cells of one d depend only on steps before."""
    i, j = "(d + 1 + k) // 2", "(d + 1 - k) // 2"
    inside = f"{i} BETWEEN 1 AND {n} AND {j} BETWEEN 1 AND {n}"
    cell = f"abs(a[{i}] - b[{j}]) + least(e[k + {BAND}], e[k + {BAND + 1}], e[k + {BAND + 2}])"
    step = f"CASE WHEN (d + 1 + k) % 2 <> 0 THEN e[k + {BAND + 1}] WHEN {inside} THEN {cell} ELSE 'inf'::DOUBLE END"
    return f"""warp AS (SELECT key, 0 AS d, list_transform(range(-{BAND}, {BAND + 1}), lambda k: CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END) AS e FROM sides
        UNION ALL SELECT key, d + 1, list_transform(range(-{BAND}, {BAND + 1}), lambda k: {step}) FROM warp JOIN sides USING (key) WHERE d < 2 * {n}),
        cost AS (SELECT key, e[{BAND + 1}] AS cost FROM warp JOIN sides USING (key) WHERE d = 2 * {n})"""


def _dense(table: str) -> str:
    return f"dense AS (SELECT t.term, list(coalesce(tf, 0)::DOUBLE ORDER BY y) AS c FROM (SELECT DISTINCT term FROM {table}) t CROSS JOIN (SELECT unnest(range(1820, 1920)) AS y) LEFT JOIN {table} x ON x.term = t.term AND x.year = y GROUP BY t.term)"


def _similar_dtw(tables: str, table: str, query: str) -> str:
    sides = f"sides AS (SELECT term AS key, c AS a, (SELECT c FROM dense WHERE term = '{query}') AS b FROM dense)"
    return f"WITH RECURSIVE {tables}, {_dense(table)}, {sides}, {warped('100')}, scored AS (SELECT key AS term, 0.0 - cost AS score FROM cost), {RANK}{K}"


def _pair_scores(tables: str, pairs: list[tuple[str, str]], n: str) -> str:
    values = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    return f"""WITH RECURSIVE {tables}, sides AS (SELECT w1 || ' ' || w2 AS key, w1, w2, x.c AS a, y.c AS b FROM (VALUES {values}) v(w1, w2) JOIN dense x ON x.term = w1 JOIN dense y ON y.term = w2),
        {warped(n)}, cells AS (SELECT key, unnest(a) AS a, unnest(b) AS b FROM sides),
        shares AS (SELECT *, a / sum(a) OVER (PARTITION BY key) AS p, b / sum(b) OVER (PARTITION BY key) AS x FROM cells),
        sums AS (SELECT key, sum((a - b) * (a - b)) AS d, sum(a * b) AS ab, sum(a * a) AS aa, sum(b * b) AS bb,
            sum(CASE WHEN p > 0 THEN p * ln(p / (p + x / 2)) ELSE 0 END + CASE WHEN x > 0 THEN x * ln(x / (p + x / 2)) ELSE 0 END) AS js FROM shares GROUP BY key)
        SELECT w1, w2, round(0.0 - ln(d), 6) AS squared, round(ab / (sqrt(aa) * sqrt(bb)), 6) AS cosine, round(1 - 0.5 * js, 6) AS js, round(0.0 - cost, 6) AS dtw FROM sides JOIN sums USING (key) JOIN cost USING (key)"""


PARTS = """item AS (SELECT l_partkey, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 + 1820 AS INTEGER) AS year FROM lineitem),
    name AS (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS term FROM part),
    months AS (SELECT term, year, count(*) AS tf FROM item JOIN name ON l_partkey = p_partkey GROUP BY ALL)"""
ASKED = f"asked AS (SELECT * FROM cur WHERE term IN ('the', 'of', 'and', 'die', 'der', 'la', 'que')), {_dense('asked')}"
PLACES = """tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), post AS (SELECT term, doc_id, count(*) AS tf FROM tok WHERE term IN ('the', 'of', 'and') GROUP BY ALL),
    dense AS (SELECT t.term, list(coalesce(tf, 0)::DOUBLE ORDER BY d.doc_id) AS c FROM (SELECT DISTINCT term FROM post) t CROSS JOIN (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN post ON post.term = t.term AND post.doc_id = d.doc_id GROUP BY t.term)"""

# `near` (a, b): near-duplicates among the first documents of equal word sequences. `lcs` holds for each length the
# least place in b's words at which a common subsequence of that length with a's words so far can end.
NEAR = f"""{WORDS}, v AS (SELECT DISTINCT idx, unnest(words) AS w FROM k WHERE idx = rep), n AS (SELECT idx, count(*) AS n FROM v GROUP BY idx),
    c AS (SELECT x.idx AS a, y.idx AS b, count(*) AS c FROM v x JOIN v y ON x.w = y.w AND x.idx < y.idx GROUP BY ALL),
    o AS (SELECT a, b, c / greatest(na.n, nb.n) AS share, ka.words AS wa, kb.words AS wb FROM c JOIN n na ON na.idx = a JOIN n nb ON nb.idx = b JOIN d ka ON ka.idx = a JOIN d kb ON kb.idx = b
        WHERE c / greatest(na.n, nb.n) >= 0.5 AND floor(abs(len(ka.words) - len(kb.words)) / least(len(ka.words), len(kb.words))) <= 0.5),
    band AS MATERIALIZED (SELECT a, b, list_filter(wa, lambda w: list_contains(wb, w)) AS x, list_filter(wb, lambda w: list_contains(wa, w)) AS y FROM o WHERE share <= 0.85),
    size AS MATERIALIZED (SELECT a, b, least(len(x), 2000) AS steps, least(len(x), len(y), 2000) AS least FROM band),
    xs AS (SELECT a, b, unnest(x[1:2000]) AS w, generate_subscripts(x[1:2000], 1) AS i FROM band),
    ys AS (SELECT a, b, w, list(j ORDER BY j) AS js FROM (SELECT a, b, unnest(y[1:2000]) AS w, generate_subscripts(y[1:2000], 1) AS j FROM band) GROUP BY ALL),
    met AS MATERIALIZED (SELECT a, b, i, js FROM xs LEFT JOIN ys USING (a, b, w)),
    lcs AS (SELECT a, b, 0 AS i, []::BIGINT[] AS ends FROM size
        UNION ALL SELECT lcs.a, lcs.b, lcs.i + 1, list_filter(list_transform(range(1, len(ends) + 2), lambda k: least(ends[k], list_min(list_filter(js, lambda p: p > coalesce(ends[k - 1], 0))))), lambda p: p IS NOT NULL)
        FROM lcs JOIN met ON met.a = lcs.a AND met.b = lcs.b AND met.i = lcs.i + 1),
    near AS MATERIALIZED (SELECT a, b FROM o WHERE share > 0.85 UNION ALL SELECT a, b FROM lcs JOIN size USING (a, b) WHERE i = steps AND len(ends) / least > 0.5)"""

# The same over all common words.
NEAR_WHOLE = NEAR.replace("least(len(x), 2000)", "len(x)").replace("least(len(x), len(y), 2000)", "least(len(x), len(y))").replace("[1:2000]", "")

ORACLE_SQL = {
    "similar_dtw": _similar_dtw(FREQ, "freq", "the"),
    "similar_dtw_parts": _similar_dtw(PARTS, "months", "red"),
    "word_pair_scores": _pair_scores(f"{CUR}, {_dense('cur')}", [("the", "of"), ("of", "and"), ("die", "der"), ("la", "que")], "100").replace("FROM cur)", "FROM cur WHERE term IN ('the', 'of', 'and', 'die', 'der', 'la', 'que'))"),
    "word_pair_scores_by_document": _pair_scores(PLACES, [("the", "of"), ("of", "and")], "len(a)"),
    "dup_pairs_full": f"WITH RECURSIVE {NEAR_WHOLE} SELECT a, b FROM near",
    "barrel_compare": f"WITH RECURSIVE {NEAR}, even AS (SELECT DISTINCT rep FROM k WHERE idx % 2 = 0), hit AS (SELECT rep FROM even UNION SELECT b FROM near JOIN even ON rep = a UNION SELECT a FROM near JOIN even ON rep = b) SELECT idx FROM k WHERE idx % 2 = 1 AND rep IN (SELECT rep FROM hit)",
    "unique_sample": f"""WITH RECURSIVE {NEAR}, edges AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near UNION ALL SELECT DISTINCT rep, rep FROM k),
        conflict AS (SELECT x.idx AS a, y.idx AS b FROM edges JOIN k x ON x.rep = a JOIN k y ON y.rep = b UNION SELECT x.idx, y.idx FROM k x JOIN k y ON x.title = y.title WHERE x.title <> ''),
        against AS MATERIALIZED (SELECT a AS idx, list(b) AS others FROM conflict GROUP BY a),
        line AS MATERIALIZED (SELECT idx, others, row_number() OVER (ORDER BY md5('3735928559:' || CAST(idx AS VARCHAR)), idx) AS turn FROM against),
        pick AS (SELECT 0::BIGINT AS turn, []::BIGINT[] AS kept UNION ALL
            SELECT line.turn, CASE WHEN list_has_any(kept, others) THEN kept ELSE list_append(kept, idx) END FROM pick JOIN line ON line.turn = pick.turn + 1 WHERE len(kept) < 100)
        SELECT unnest(kept) AS idx FROM (SELECT kept FROM pick ORDER BY turn DESC LIMIT 1)""",
    "kmeans_two_pass": """WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), n AS (SELECT count(*) // 8 AS size FROM v),
        seed AS (SELECT CAST(place // size AS INTEGER) AS i, x AS c FROM v, n WHERE place % size = 0 AND place // size < 8),
        near AS (SELECT place, x, i, sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(c, c)) AS norm, list_dot_product(x, c) AS dot FROM v, seed),
        free AS MATERIALIZED (SELECT place, arg_min(i, (CASE WHEN norm = 0 THEN 0 ELSE 1 - dot / norm END, i)) AS cluster FROM near GROUP BY place),
        upto AS (SELECT *, count(*) OVER (PARTITION BY cluster ORDER BY place) AS c FROM free), over_ AS (SELECT place, cluster FROM upto, n WHERE c > size ORDER BY place LIMIT 1),
        first AS (SELECT place, coalesce((SELECT o.cluster FROM over_ o WHERE free.place > o.place), cluster) AS cluster FROM free),
        sums AS (SELECT cluster, pos, sum(x) AS s FROM (SELECT cluster, unnest(x) AS x, generate_subscripts(x, 1) AS pos FROM first JOIN v USING (place)) GROUP BY ALL),
        centre AS (SELECT i, list(coalesce(s, 0) ORDER BY p.pos) AS c FROM (SELECT CAST(unnest(range(8)) AS INTEGER) AS i) CROSS JOIN (SELECT DISTINCT pos FROM sums) p LEFT JOIN sums ON cluster = i AND sums.pos = p.pos GROUP BY i),
        last AS (SELECT vec_id, i, sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(c, c)) AS norm, list_dot_product(x, c) AS dot FROM v, centre)
        SELECT vec_id AS row_idx, arg_min(i, (CASE WHEN norm = 0 THEN 0 ELSE 1 - dot / norm END, i)) AS cluster FROM last GROUP BY vec_id""",
}
ORACLE_SQL["word_pair_scores_on_both_axes"] = f"""SELECT * FROM ({ORACLE_SQL["word_pair_scores"]}) y
    JOIN (SELECT w1, w2, squared AS document_squared, cosine AS document_cosine, js AS document_js, dtw AS document_dtw FROM ({ORACLE_SQL["word_pair_scores_by_document"]})) d USING (w1, w2)"""
