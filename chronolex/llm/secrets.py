"""Secret scan with a trigram inverted index, in DataFrame expressions only.

From each rule's regex a Boolean trigram query is derived (which trigrams any match
must hold). The index keeps, for the trigrams of all queries, the documents that hold
them (lower-case); intersecting the postings of a query's clauses gives the candidate
documents of a rule, and only these are verified with the regex itself. A rule whose
regex forces no trigram (a bare run of hex digits) is run over every text.

Matches are leftmost and do not overlap within a rule; failing matches (captured part
too short) use up their text as well. Positions are code points, end exclusive.

Cases: null text is an empty text. Repeated rows and repeated or null ids are each
scanned in full: the index key is a hash of the id, rows that share a key share
candidates, and verification decides. A document with very many matches costs time in
proportion to the square of their number, without any limit on them. An empty table
gives no rows. Further columns are ignored by `scan`, and kept by `spans` and `redact`
whatever their names.

The index may be written once (`write_index`) and read by later scans, of the same
documents with other rules; a scan without one makes the postings of its own trigrams.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, free_names, quoted, stored

try:
    import re._parser as sre
except ImportError:  # before Python 3.11
    import sre_parse as sre

#: Candidate rows (a long and a long each) up to which they are broadcast: 2 million are 32 MB.
BROADCAST_ROWS = 2_000_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `pattern` is a regex with the same meaning to Java and Python; `group` of it needs `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base kinds, in their order of ties.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
# Public formats of further keys.
MORE = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE

Clause = frozenset[str]
EXACT_AT_MOST = 64


def _absorb(clauses: set[Clause]) -> set[Clause]:
    return {c for c in clauses if not any(o < c for o in clauses)}


def _grams(text: str) -> Clause:
    text = text.lower()
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> set[Clause]:
    """Clauses of trigrams: every match holds all trigrams of some clause. {empty clause}: nothing is forced."""

    def both(a: set[Clause], b: set[Clause]) -> set[Clause]:
        joined = _absorb({x | y for x, y in product(a, b)})
        return joined if len(joined) <= 256 else a

    def of_strings(strings: set[str]) -> set[Clause]:
        return _absorb({_grams(s) for s in strings})

    def visit(items) -> tuple[set[str] | None, set[Clause]]:
        """(all strings the items can match, if few; trigram clauses)."""
        run, query, exact = {""}, {frozenset()}, True

        def flush() -> None:
            nonlocal run, query
            query = both(query, of_strings(run))
            run = {""}

        for op, arg in items:
            name, strings, inner = str(op), None, {frozenset()}
            if name == "LITERAL":
                strings = {chr(arg)}
            elif name == "IN":
                chars: set[str] | None = set()
                for kind, value in arg:
                    if str(kind) == "LITERAL":
                        chars.add(chr(value))
                    elif str(kind) == "RANGE" and value[1] - value[0] < 16:
                        chars |= {chr(c) for c in range(value[0], value[1] + 1)}
                    else:
                        chars = None
                        break
                strings = chars if chars and len(chars) <= 16 else None
            elif name == "SUBPATTERN":
                strings, inner = visit(arg[-1])
            elif name == "BRANCH":
                parts = [visit(x) for x in arg[1]]
                strings = set().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None
                inner = _absorb(set().union(*(q if s is None else of_strings(s) for s, q in parts)))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, body = arg
                s, q = visit(body)
                if s is not None and high <= 3:
                    strings = {"".join(x) for n in range(low, high + 1) for x in product(s, repeat=n)}
                elif low:
                    inner = q if s is None else of_strings(s)
            elif name == "AT":
                continue
            if strings is not None and len(run) * len(strings) <= EXACT_AT_MOST:
                run = {a + b for a in run for b in strings}
            else:
                flush()
                exact = False
                query = both(query, inner if strings is None else of_strings(strings))
        if exact:
            return run, of_strings(run)
        flush()
        return None, query

    return visit(sre.parse(pattern))[1]


def queries(rules: tuple[Rule, ...]) -> tuple[dict[int, set[Clause]], list[str]]:
    """Trigram query of each rule that forces trigrams, and all trigrams of them."""
    found = {i: q for i, r in enumerate(rules) if frozenset() not in (q := trigram_query(r.pattern))}
    return found, sorted(set().union(*(c for q in found.values() for c in q)) if found else set())


def index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings (gram int, key long) of the trigrams, each row once for each trigram it holds, so rows with one key may repeat a posting. Needs `key` and `text`."""
    low = docs.select("key", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams))))
    return low.select("key", F.explode(held).alias("gram"))


def write_index(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> None:
    """Write the postings of every trigram (low, trigram string, key long), clustered by trigram, for scans with any rules."""
    low = docs.select(F.xxhash64(key).alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    at = F.sequence(F.lit(1), F.length("low") - 2, F.lit(1))
    grams = F.when(F.length("low") > 2, F.array_distinct(F.transform(at, lambda i: F.substring(F.col("low"), i, F.lit(3)))))
    postings = low.select("key", F.explode(grams).alias("trigram")).distinct()
    postings.repartitionByRange("trigram", "key").sortWithinPartitions("trigram", "key").write.parquet(path)


def read_index(spark: SparkSession, path: str, grams: list[str]) -> DataFrame:
    """Postings (gram int, key long) of these trigrams from a written index; only their files' ranges are read."""
    at = F.array_position(F.array(*map(F.lit, grams)), F.col("trigram")) - 1
    return spark.read.parquet(path).where(F.col("trigram").isin(grams)).select("key", at.cast("int").alias("gram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): documents in which all trigrams of a clause occur; rules has a bit for each rule."""
    spark = postings.sparkSession
    found, grams = queries(rules)
    number = {g: i for i, g in enumerate(grams)}
    rows = [(i, 1 << i, c, number[g], len(clause)) for i, q in found.items() for c, clause in enumerate(sorted(q, key=sorted)) for g in clause]
    needs = spark.createDataFrame(rows, "rule int, bit long, clause int, gram int, need int")  # as long as the rules
    met = postings.join(F.broadcast(needs), "gram").groupBy("key", "rule", "bit", "clause", "need").agg(F.count_distinct("gram").alias("n")).where("n = need")
    return met.groupBy("key").agg(F.bit_or("bit").alias("rules"))


def _matches(text: Column, rule: Rule, number: int) -> Column:
    """array<struct<start, end, rank>> of one rule in a text."""
    span = "array<struct<start:int,end:int,rank:int>>"
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    lengths = F.zip_with(
        F.zip_with(whole, kept, lambda w, k: F.struct(F.length(w).alias("n"), (F.length(k) >= rule.least).alias("ok"))),
        F.transform(gaps, F.length),
        lambda m, gap: F.struct(gap.alias("gap"), m["n"].alias("n"), m["ok"].alias("ok")),
    )
    state = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("spans"))

    def step(s: Column, m: Column) -> Column:
        start = s["at"] + m["gap"]
        end = start + F.coalesce(m["n"], F.lit(0))
        new = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(number).alias("rank")))
        return F.struct(end.alias("at"), F.when(m["ok"], F.concat(s["spans"], new)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(lengths, state, step, lambda s: s["spans"])


def _long_runs(rule: Rule) -> Rule:
    """A rule whose regex is one run, with its least length in the regex: the same spans, without the short runs' cost."""
    if rule.group == 0 and rule.least > 1 and (m := re.fullmatch(r"((?:[A-Za-z0-9])*)(\[[^\]]*\])\+", rule.pattern)):
        return Rule(rule.kind, f"{m[1]}{m[2]}{{{rule.least - len(m[1])},}}")
    return rule


def spans(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS, index_path: str | None = None
) -> DataFrame:
    """All columns of `docs`, and last the spans: array of (start, end, rank of the rule), by start, then rule.

    With `index_path`, candidates come from the index written there for these documents.
    """
    key_name, rules_name, spans_name = free_names(docs.columns, "_key", "_rules", "_spans")
    keyed = docs.withColumn(key_name, F.xxhash64(quoted(key)))
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    found, grams = queries(rules)
    if found:
        made = index(keyed.select(F.col(key_name).alias("key"), body.alias("text")), grams) if index_path is None else read_index(docs.sparkSession, index_path, grams)
        hits = candidates(made, rules).select(F.col("key").alias(key_name), F.col("rules").alias(rules_name))
        stored_hits = stored(hits, "secret-candidates")
        side = F.broadcast(stored_hits) if stored_hits.count() <= broadcast_rows else stored_hits
        keyed = keyed.join(side, key_name, "left")
    else:
        keyed = keyed.withColumn(rules_name, F.lit(0).cast("long"))
    none = F.array().cast("array<struct<start:int,end:int,rank:int>>")
    each = []
    for i, rule in enumerate(rules):
        run = _long_runs(rule)
        wanted = body.rlike(run.pattern)
        if i in found:
            wanted = F.coalesce(F.col(rules_name).bitwiseAND(F.lit(1 << i)) != 0, F.lit(False)) & wanted
        each.append(F.when(wanted, _matches(body, run, i)).otherwise(none))
    return keyed.select(*columns_of(docs), F.array_sort(F.flatten(F.array(*each)), _by_start).alias(spans_name))


def _by_start(a: Column, b: Column) -> Column:
    x, y = (s["start"].cast("long") * 64 + s["rank"] for s in (a, b))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def _written(array: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def _of_rank(rank: int, span: Column) -> Column:
    return span["rank"] == rank


def scan(docs: DataFrame, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """A row for each document: counts of the base kinds, digest of their spans, and all spans as text."""
    rules = BASE + tuple(more)
    found = spans(docs.select("doc_id", F.col("text").cast("string").alias("text")), rules).select("doc_id", "_spans")
    base = F.filter("_spans", lambda s: s["rank"] < len(BASE))
    counts = [F.size(F.filter("_spans", partial(_of_rank, i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_written(base, rules), 256).alias("base_sha256"), _written(F.col("_spans"), rules).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """`docs` with every found secret replaced by `mark`; overlapping secrets become one mark. Texts without secrets stay as they are."""
    found = spans(docs, rules, text)
    at, body = F.col(found.columns[-1]), F.col(quoted(text))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, m: Column) -> Column:
        new = F.concat(s["out"], F.substring(body, s["at"] + 1, m["start"] - s["at"]), F.lit(mark))
        return F.struct(F.greatest(s["at"], m["end"]).alias("at"), F.when(m["start"] >= s["at"], new).otherwise(s["out"]).alias("out"))

    done = F.aggregate(at, state, step, lambda s: F.concat(s["out"], F.substring(body, s["at"] + 1, F.lit(2**31 - 1))))
    out = F.when(F.size(at) > 0, done).otherwise(body).alias(text)
    return found.select(*(out if c == text else quoted(c) for c in docs.columns))
