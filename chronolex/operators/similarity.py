"""Ranking terms by the likeness of their curves to a query's, exact top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.text import FIRST_YEAR, YEARS, tokens
from ..plans.storage import stored
from . import index
from .temporal import curve_of, dense, parse_query, scatter, step_function

#: Places of the document axis that one task warps at a time.
PART = 4096
#: Neighbouring parts whose costs one group joins.
FOLD = 256
#: Groups (a part of the axis for some terms) that one task warps.
GROUPS = 8
#: Terms up to which a list of them is broadcast (a term and a long each).
BROADCAST_TERMS = 500_000
#: Places of a query up to which what lies near them is broadcast. Spark would go by the size of the stored file, a hundredth of what it becomes.
BROADCAST_PLACES = 100_000

METHODS = ("cosine", "cos-diff", "squared", "js-reference", "js-standard", "earth-mover", "dtw")


def frequent(curves: DataFrame, least: int) -> DataFrame:
    """Curves of terms whose total is at least `least`."""
    whole = curves.groupBy("term").agg(F.sum("tf").alias("t"), F.collect_list(F.struct("year", "tf")).alias("years")).where(F.col("t") >= least)
    return whole.select("term", F.inline("years"))


def best(scored: DataFrame, k: int) -> DataFrame:
    """(rank, term, score): the k highest; ties by nine digits of the score, then term."""
    order = [F.desc(F.round("score", 9)), F.asc("term")]
    top = scored.select("term", "score").orderBy(*order).limit(k)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "term", F.round("score", 6).alias("score"))


def scored(curves: DataFrame, query: str | list[int], method: str, band: int = 10, with_query: bool = True) -> DataFrame:
    """(term, score) of every term, the query's own among them unless with_query=False. Sparse curves are joined by year with the query's (one row a year at most)."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    q = curve_of(curves, query) if isinstance(query, str) else list(query)
    others = curves if with_query or not isinstance(query, str) else curves.where(F.col("term") != query)
    if not any(q):
        return others.select("term", F.lit(0.0).alias("score")).limit(0)
    if method == "dtw":
        return kernels.with_dtw(dense(others), q, band=band).select("term", "score")
    if method == "earth-mover":
        constant = F.array(*(F.lit(x).cast("long") for x in q))
        return dense(others).select("term", kernels.earth_mover(constant, F.col("curve")).alias("score"))
    spark = curves.sparkSession
    total = float(sum(q))
    mine = F.broadcast(spark.createDataFrame([(FIRST_YEAR + i, x) for i, x in enumerate(q) if x], "year int, q long"))
    met, tf, share = F.col("q").isNotNull(), F.col("tf"), F.col("q") / total
    joined = others.join(mine, "year", "left")
    if method.startswith("js"):
        # With x = tf / t and m = p + x/2 or (p + x)/2, all terms follow from sums over the term's years, once t is known;
        # the years are kept as a list of at most as many entries as the query has.
        sums = joined.groupBy("term").agg(F.sum("tf").alias("t"), F.collect_list(F.when(met, F.struct(share.alias("p"), tf.alias("tf")))).alias("both"))

        def part(s: Column, e: Column) -> Column:
            p, x = e["p"], e["tf"] / F.col("t")
            m = p + x / 2 if method == "js-reference" else (p + x) / 2
            return F.struct((s["d"] + p * F.ln(p / m) + x * F.ln(x / m)).alias("d"), (s["p"] + p).alias("p"), (s["x"] + x).alias("x"))

        zero = F.struct(*(F.lit(0.0).alias(c) for c in "dpx"))
        full = sums.select("term", F.aggregate("both", zero, part).alias("s")).select("term", "s.*")
        lone = (1 - F.col("x")) if method == "js-reference" else (1 - F.col("x")) + (1 - F.col("p"))
        return full.select("term", (1 - 0.5 * (F.col("d") + lone * F.ln(F.lit(2.0)))).alias("score"))
    full = joined.groupBy("term").agg(F.sum(tf * tf).alias("n"), F.sum(tf * F.coalesce("q", F.lit(0))).alias("dot"))
    own = sum(x * x for x in q)
    if method == "squared":
        d = F.col("n") + own - 2 * F.col("dot")
        return full.select("term", F.when(d == 0, F.lit(float("inf"))).otherwise(0.0 - F.ln(d.cast("double"))).alias("score"))
    cosine = F.col("dot") / (F.sqrt(F.lit(float(own))) * F.sqrt(F.col("n").cast("double")))
    return full.where("n > 0").select("term", (cosine if method == "cosine" else 1 - cosine).alias("score"))


def similar(curves: DataFrame, query: str | list[int], method: str, k: int = 20, with_query: bool = True) -> DataFrame:
    return best(scored(curves, query, method, with_query=with_query), k)


def quantized(curves: DataFrame, query: str, size: int = 10, k: int = 5, drop_last: bool = True, first: int = FIRST_YEAR, years: int = YEARS, with_query: bool = True) -> DataFrame:
    """The k best terms by cosine within each block of `size` years. By default a block's last year is left out, and the query's own term takes part.

    (start, end, rank, term, score, query_weight, candidate_total): sums of the query's and of the candidate's counts over the years compared.
    """
    spark = curves.sparkSession
    q = curve_of(curves, query, first, years)
    width = size - 1 if drop_last else size
    rows = [(b, first + b * size + i, q[b * size + i]) for b in range(years // size) for i in range(width) if q[b * size + i]]
    if not rows:
        return spark.createDataFrame([], "start int, end int, rank int, term string, score double, query_weight long, candidate_total long")
    mine = spark.createDataFrame(rows, "block int, year int, q long")
    place = F.floor((F.col("year") - first) / size).cast("int")
    inside = (F.col("year") >= first) & ((F.col("year") - first) % size < width)
    others = curves.where(inside) if with_query else curves.where(inside & (F.col("term") != query))
    others = others.withColumn("block", place).join(F.broadcast(mine.select("year", "q")), "year", "left")
    # All blocks' sums in one aggregation by term.
    weights = {b: [x for c, _, x in rows if c == b] for b, _, _ in rows}
    tf, q = F.col("tf"), F.coalesce("q", F.lit(0))
    sums = [F.sum(F.when(F.col("block") == b, x)).alias(f"{n}{b}") for b in weights for n, x in (("n", tf * tf), ("dot", tf * q), ("total", tf))]
    whole = others.groupBy("term").agg(*sums)
    each = [
        F.struct(F.lit(b).alias("block"), F.lit(sum(w)).cast("long").alias("query_weight"), F.lit(sum(x * x for x in w)).cast("long").alias("own"), F.col(f"n{b}").alias("n"), F.col(f"dot{b}").alias("dot"), F.col(f"total{b}").alias("candidate_total"))
        for b, w in weights.items()
    ]
    scored_ = whole.select("term", F.inline(F.filter(F.array(*each), lambda x: x["n"] > 0)))
    scored_ = scored_.withColumn("score", F.col("dot") / (F.sqrt(F.col("own").cast("double")) * F.sqrt(F.col("n").cast("double"))))
    w = Window.partitionBy("block").orderBy(F.desc(F.round("score", 9)), "term")
    top = scored_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    start = (F.lit(first) + F.col("block") * size).cast("int")
    return top.select(
        start.alias("start"), (start + size - 1).cast("int").alias("end"), "rank", "term", F.round("score", 6).alias("score"), "query_weight", "candidate_total"
    )


def word_pairs(curves: DataFrame, pairs: DataFrame) -> DataFrame:
    """Scores of each (w1, w2) over one axis: squared, cosine, JS (as the reference divergence), DTW; pairs missing a curve give no row."""
    full = dense(curves.join(F.broadcast(pairs.select(F.explode(F.array("w1", "w2")).alias("term")).distinct()), "term", "left_semi"))
    a, b = (full.select(F.col("term").alias(w), F.col("curve").alias(c)) for w, c in (("w1", "a"), ("w2", "b")))
    both = pairs.join(a, "w1").join(b, "w2")
    scores = both.select("w1", "w2", kernels.squared(F.col("a"), F.col("b")).alias("squared"), kernels.cosine(F.col("a"), F.col("b")).alias("cosine"), (1 - kernels.jensen_shannon(F.col("a"), F.col("b"))).alias("js"), "a", "b")
    return with_pair_dtw(scores)


def with_pair_dtw(pairs: DataFrame, band: int = 10) -> DataFrame:
    """`pairs` with its last two array columns replaced by minus their warping distance, `dtw`."""
    import numpy as np
    import pyarrow as pa

    keep = pairs.dtypes[:-2]

    def run(batches):
        for batch in batches:
            out = [0.0 - float(kernels.dtw(np.array(b, float), np.array([a], float), band)[0]) for a, b in zip(*(c.to_pylist() for c in batch.columns[-2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.float64())], [*batch.schema.names[:-2], "dtw"])

    return pairs.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in keep), "dtw double"]))


def on_document_axis(docs: DataFrame, terms: list[str] | None = None) -> tuple[DataFrame, int]:
    """(term, at, tf), `at` being the place of a document's id among all distinct ids, and the number of these. Null counts as an id, the first."""
    places, length = index.ranked(docs, "doc_id")
    key = F.struct("doc_id").alias("key")  # null equals null in it
    # Texts are dealt by id, for the join and for the words' counts: only they are shuffled.
    placed = docs.select(key, "text").repartition("key").join(places.select(key, "at"), "key")
    words = placed.select("key", "at", F.explode(tokens(F.col("text"))).alias("term"))
    words = words if terms is None else words.where(F.col("term").isin(terms))  # of few given terms
    return words.groupBy("term", "key", "at").agg(F.count("*").alias("tf")).select("term", "at", "tf"), length


def word_pairs_by_document(points: DataFrame, length: int, pairs: DataFrame, band: int = 10, part: int = PART, fold: int = FOLD) -> DataFrame:
    """`word_pairs` over the document axis, from sparse (term, at, tf); pairs missing a curve give no row."""
    one = pairs.select("w1", "w2").distinct()
    sides = one.select("w1", "w2", F.posexplode(F.array("w1", "w2")).alias("side", "term"))
    side = [F.sum(F.when(F.col("side") == i, F.col("tf")).otherwise(0)).alias(n) for i, n in enumerate("ab")]
    cells = stored(points.join(F.broadcast(sides), "term").groupBy("w1", "w2", "at").agg(*side), "pair-cells")
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    sums = {"ta": a, "tb": b, "aa": a * a, "bb": b * b, "ab": a * b, "d": (a - b) * (a - b)}
    totals = stored(cells.groupBy("w1", "w2").agg(*(F.sum(c).alias(n) for n, c in sums.items())).where("ta > 0 and tb > 0"), "pair-totals")
    x, y = a / F.col("ta"), b / F.col("tb")
    middle = x + y / 2
    js = F.when(x > 0, x * F.ln(x / middle)).otherwise(0.0) + F.when(y > 0, y * F.ln(y / middle)).otherwise(0.0)
    divergence = cells.join(totals, ["w1", "w2"]).groupBy("w1", "w2").agg(F.sum(js).alias("js"))
    whole = totals.join(divergence, ["w1", "w2"]).join(_pair_warp(cells, length, band, part, fold), ["w1", "w2"])
    scores = whole.select(
        "w1",
        "w2",
        F.when(F.col("d") == 0, F.lit(float("inf"))).otherwise(0.0 - F.ln("d")).alias("squared"),
        (F.col("ab") / (F.sqrt("aa") * F.sqrt("bb"))).alias("cosine"),
        (1 - 0.5 * F.col("js")).alias("js"),
        "dtw",
    )
    return pairs.join(scores, ["w1", "w2"])


def word_pairs_on_both_axes(docs: DataFrame, curves: DataFrame, pairs: DataFrame) -> DataFrame:
    """Eight scores of each (w1, w2): of `word_pairs` over the years and, as document_squared etc., over all documents (doc_id, text); null where a word is missing."""
    keys, names = ["w1", "w2"], ["squared", "cosine", "js", "dtw"]
    words = pairs.select(F.explode(F.array(*keys)).alias("term")).where("term is not null").distinct()
    points, length = on_document_axis(docs)
    points = points.join(words, "term", "left_semi")
    documents = word_pairs_by_document(points, length, pairs.select(*keys)).select(*keys, *(F.col(n).alias(f"document_{n}") for n in names))
    years = word_pairs(curves, pairs.select(*keys)).select(*keys, *names)
    return pairs.join(years.distinct(), keys, "left").join(documents.distinct(), keys, "left")


def _pair_warp(cells: DataFrame, length: int, band: int, part: int, fold: int) -> DataFrame:
    """(w1, w2, dtw): each part of the axis gives the least costs from every place of the band to every other, which then are joined in order."""
    import numpy as np
    import pyarrow as pa

    width = 2 * band + 1
    low, high = (F.floor(F.greatest(F.lit(0), F.least(F.lit(length - 1), F.col("at") + d)) / part).cast("int") for d in (-band, band))
    parts = cells.select("w1", "w2", F.explode(F.sequence(low, high)).alias("part"), F.struct("at", "a", "b").alias("cell")).groupBy("w1", "w2", "part").agg(F.collect_list("cell").alias("cells"))

    def crossed(batches):
        for batch in batches:
            out = []
            for number, found in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                start, values = number * part, found.values
                n = min(part, length - start)
                at, a, b = (values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                rows, window = np.zeros((1, n)), np.zeros(n + 2 * band)
                inside = (at >= start) & (at < start + n)
                rows[0, at[inside] - start] = a[inside]
                inside = (at >= start - band) & (at < start + n + band)
                window[at[inside] - start + band] = b[inside]
                identity = np.where(np.eye(width) > 0, 0.0, np.inf)
                out.append(carry_warp(identity, rows, window, start, band).ravel().tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.float64()))], ["w1", "w2", "part", "costs"])

    carry_warp = kernels.carry_warp
    return _join_costs(parts.mapInArrow(crossed, "w1 string, w2 string, part int, costs array<double>"), ["w1", "w2"], length, band, part, fold)


def _join_costs(costs: DataFrame, keys: list[str], length: int, band: int, part: int, fold: int = FOLD) -> DataFrame:
    """(keys, dtw): the least costs of each key's parts (keys, part, costs) joined in order, `fold` at a time until one is left, so no group grows with the axis. A part without costs has no counts."""
    import numpy as np
    import pyarrow as pa

    width, carry_warp = 2 * band + 1, kernels.carry_warp

    def level(size: int, numbers: int):
        def joined(batches):
            for batch in batches:
                out = []
                for group, found in zip(batch.columns[-2].to_pylist(), batch.columns[-1], strict=True):
                    places, values = (found.values.field(c) for c in ("part", "costs"))  # a group has up to `fold` matrices: no Python floats
                    known = dict(zip(places.to_pylist(), values.flatten().to_numpy().reshape(-1, width, width), strict=True))
                    whole = np.where(np.eye(width) > 0, 0.0, np.inf)
                    for number in range(group * fold, min(group * fold + fold, numbers)):
                        n = min(size, length - number * size)
                        if number in known:
                            whole = (whole[:, :, None] + known[number]).min(axis=1)
                        elif n > 2 * width:  # every place is reached from every other
                            whole = np.repeat(whole.min(axis=1, keepdims=True), width, axis=1)
                        else:
                            whole = carry_warp(whole, np.zeros((1, n)), np.zeros(n + 2 * band), number * size, band)
                    out.append(whole.ravel().tolist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "costs"])

        return joined

    kinds, size = costs.dtypes, part
    while (numbers := -(-length // size)) > 1:
        groups = costs.groupBy(*keys, F.floor(F.col("part") / fold).cast("int").alias("group")).agg(F.collect_list(F.struct("part", "costs")).alias("found"))
        costs = groups.mapInArrow(level(size, numbers), ", ".join(f"{n} {t}" for n, t in kinds))
        size *= fold
    return costs.select(*keys, (0.0 - F.element_at("costs", band * width + band + 1)).alias("dtw"))


def similar_by_document(points: DataFrame, length: int, query: str | DataFrame, k: int = 20, band: int = 10, part: int = PART, terms_at_once: int = 16, fold: int = FOLD, first: int = 0) -> DataFrame:
    """(rank, term, score): the k terms whose document curves warp at least cost to the query's: a term's (which is itself ranked), or a curve
    given as a table (at, q) of its places that are not zero.

    A term's least possible cost is bounded twice. By totals: a count meets at most as many places as the band is wide, so neither curve can
    cover more than that multiple of its total in the other. By an envelope in both directions: every place of the query must meet a count within
    the band, and every count a place of the query. The first round warps the `first` terms (2k if 0) by the bound of totals, which needs no join
    with the axis; only terms whose bound is within the k-th cost of these get the envelope bound. Further rounds go in order of that, as many
    terms and then each time twice as many: a round takes only terms whose bound and name come before the k-th cost and term so far, and the first round without any
    is the last. A task warps some terms over a few parts of the axis.
    """
    import numpy as np
    import pyarrow as pa

    points = stored(points, "document-points")
    spark, width = points.sparkSession, 2 * band + 1
    own = points.where(F.col("term") == query).select("at", F.col("tf").alias("q")) if isinstance(query, str) else query.select("at", F.col("q").cast("long").alias("q")).where("q <> 0")
    own = stored(own, "query-points")
    weight, asked = own.agg(F.coalesce(F.sum("q"), F.lit(0)), F.count("*")).first()
    near = own.select(F.explode(F.sequence(F.col("at") - band, F.col("at") + band)).alias("at"), "q").groupBy("at").agg(F.collect_list("q").alias("near"))
    tf, none = F.col("tf"), F.lit(0).cast("long")
    met = F.coalesce(F.aggregate("near", none, lambda s, q: s + F.least(q, tf)), none)
    over = F.greatest(none, tf - F.coalesce(F.array_max("near"), none))
    by_totals = F.greatest(F.lit(weight) - width * F.sum("tf"), F.sum("tf") - F.lit(width * weight)).cast("double").alias("least")
    coarse = stored(points.groupBy("term").agg(by_totals), "total-costs")
    numbers = -(-length // part)
    low, high = (F.floor(F.greatest(F.lit(0), F.least(F.lit(length - 1), F.col("at") + d)) / part).cast("int") for d in (-band, band))
    windows = own.select(F.explode(F.sequence(low, high)).alias("part"), F.struct("at", "q").alias("c")).groupBy("part").agg(F.collect_list("c").alias("window"))
    windows = stored(windows, "query-windows")
    carry_warp, first_warp = kernels.carry_warp, kernels.first_warp

    def warped(terms: int):
        def run(batches):
            for batch in batches:
                out = []
                for number, bucket, cells, window in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                    start, many = number * part, min(terms_at_once, terms - bucket * terms_at_once)
                    n = min(part, length - start)
                    rows, places = np.zeros((many, n)), np.zeros(n + 2 * band)
                    if cells.is_valid:
                        row, at, tf = (cells.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                        rows[row, at - start] = tf
                    if window.is_valid:
                        at, q = (window.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
                        places[at - start + band] = q
                    costs = np.full((many, width, width), np.inf)
                    if number == 0:  # the axis begins at one place
                        costs[:, band] = carry_warp(first_warp(many, band), rows, places, 0, band)
                    else:
                        costs[:, np.arange(width), np.arange(width)] = 0.0
                        costs = carry_warp(costs.reshape(-1, width), np.repeat(rows, width, axis=0), places, start, band)
                    costs = costs.reshape(many, -1).tolist()
                    out += [(bucket * terms_at_once + i, number, c) for i, c in enumerate(costs)]
                columns = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.list_(pa.float64())), strict=True)], ["number", "part", "costs"])

        return run

    def costs(chosen: DataFrame, label: str) -> DataFrame:
        places, terms = index.ranked(chosen, "term")
        numbered = places.select("term", F.col("at").alias("number"))
        side = F.broadcast(numbered) if terms <= BROADCAST_TERMS else numbered
        buckets = -(-terms // terms_at_once)
        tasks = max(1, -(-numbers * buckets // GROUPS))  # a task's groups fit in memory, whatever the length of the axis
        cells = points.join(side, "term").select(
            F.floor(F.col("at") / part).cast("int").alias("part"), F.floor(F.col("number") / terms_at_once).cast("int").alias("bucket"), F.struct(F.pmod("number", F.lit(terms_at_once)).alias("row"), "at", "tf").alias("c")
        )
        cells = cells.repartition(tasks, "part", "bucket").groupBy("part", "bucket").agg(F.collect_list("c").alias("cells"))
        each = spark.range(numbers * buckets).select(F.floor(F.col("id") / max(1, buckets)).cast("int").alias("part"), F.pmod("id", F.lit(max(1, buckets))).cast("int").alias("bucket"))
        groups = each.join(windows, "part", "left").repartition(tasks, "part", "bucket").join(cells, ["part", "bucket"], "left").select("part", "bucket", "cells", "window")
        found = _join_costs(groups.mapInArrow(warped(terms), "number long, part int, costs array<double>"), ["number"], length, band, part, fold)
        return stored(found.join(side, "number").select("term", F.col("dtw").alias("score")), label)

    def enveloped(terms: DataFrame) -> DataFrame:
        side = F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms
        bound = F.greatest(F.lit(weight) - F.sum(met), F.sum(over)).cast("double").alias("least")
        beside = F.broadcast(near) if asked <= BROADCAST_PLACES else near.hint("merge")
        return stored(points.join(side, "term", "left_semi").join(beside, "at", "left").groupBy("term").agg(bound), "least-costs")

    def within(bounds: DataFrame, upto: Row | None, known: DataFrame) -> DataFrame:
        top = known.orderBy(F.desc("score"), "term").limit(k)
        kth = top.agg(F.count("*").alias("n"), F.max(F.struct((0.0 - F.col("score")).alias("cost"), "term")).alias("last")).first()
        rest = bounds if upto is None else bounds.where((F.col("least") > upto["least"]) | ((F.col("least") == upto["least"]) & (F.col("term") > upto["term"])))
        # Costs are whole numbers, and equal ones go by term: a later term that can only reach the k-th cost is out.
        return rest.where(F.struct("least", "term") < F.struct(F.lit(kth["last"]["cost"]), F.lit(kth["last"]["term"]))) if kth["n"] == k else rest

    def one_round(bounds: DataFrame, size: int) -> tuple[DataFrame | None, Row | None]:
        some = stored(bounds.orderBy("least", "term").limit(size), "round-terms")
        upto = some.orderBy(F.desc("least"), F.desc("term")).first()
        return (None, None) if upto is None else (costs(some.select("term"), "round-scores"), upto)

    size = first or 2 * k
    known, upto = one_round(coarse, size)
    if known is None:
        return best(points.select("term", F.lit(0.0).alias("score")).limit(0), k)
    bounds, upto = enveloped(stored(within(coarse, upto, known).select("term"), "bounded-terms")), None
    while True:
        scores, upto = one_round(within(bounds, upto, known), size)
        if scores is None:
            return best(known, k)
        known, size = known.unionByName(scores), 2 * size


def panel(docs: DataFrame, curves: DataFrame, query: str, k: int = 20, weight: int = 150) -> DataFrame:
    """(rank, term, score, curve): the query's yearly curve (rank 0), then those of its k closest terms by warping over the document axis.

    A query `$YYYY` with a year of the domain is a step: `weight` for that year and each later one, spread evenly over the year's documents
    (doc_id, text, year), what is left of the division dropped.
    """
    spark = docs.sparkSession
    kind, asked = parse_query(query)
    points, length = on_document_axis(docs)
    if kind == "step":
        spread = stored(scatter(spark, step_function(spark, asked, weight), docs), "step-query")
        places, _ = index.ranked(docs, "doc_id")
        curve = spread.join(places, "doc_id").groupBy("at").agg(F.max("tf").alias("q"))
        by_year = {r["year"]: r["tf"] for r in spread.groupBy("year").agg(F.sum("tf").alias("tf")).collect()}  # a row a year
        line = ",".join(str(by_year.get(FIRST_YEAR + i, 0)) for i in range(YEARS))
        asked, top = query, similar_by_document(points, length, curve, k)
    else:
        line, top = None, similar_by_document(points, length, asked, k)
    own = spark.createDataFrame([(0, asked, None, line)], "rank int, term string, score double, line string")
    rows = own.unionByName(top.select("rank", "term", "score", F.lit(None).cast("string").alias("line")))
    # One pass over the words for all curves, the query's own among them; a term without words has zeros.
    asked_for = F.broadcast(rows.where("line IS NULL").select("term").distinct())
    found = dense(curves.join(asked_for, "term", "left_semi")).select("term", F.array_join("curve", ",").alias("curve"))
    none = F.lit(",".join("0" * YEARS))
    return rows.join(found, "term", "left").select("rank", "term", "score", F.coalesce("line", "curve", none).alias("curve"))
