"""Language identification by interpolated Kneser-Ney character models.

One model for each language, of order `ORDER`, over lower-case letters with runs of
anything else as one space. Counts are kept as sorted arrays of 64-bit n-gram hashes;
the models of all languages share one array for each order, whose rows hold the
interpolated log-probabilities of every language, so a position is looked up once.
A text gets the language of the lowest cross-entropy per character.

Rejection is calibrated on documents left out of the counts. A text's excess is the
number of standard deviations (for its length) by which its cross-entropy lies above the
mean of its language's left-out documents; it is rejected above the excess that the share
`FALSE_REJECTS` of the left-out documents of all languages exceed. With fewer documents
than that share can be read from, the limit is a quarter beyond the largest excess.

Learning uses a bounded sample, chosen by a hash of id and text: of each language at most
`DOCUMENTS_PER_LANGUAGE` documents (four fifths of them, if they are few) for the counts,
and the others, up to `SAMPLED_PER_LANGUAGE` in all, for the calibration. The models grow
with the number of languages; more than `LANGUAGES_AT_MOST` of them raise an error.

Cases: null text, or text without any letter: `und`, score 0, rejected. No labelled
row: every text is `und` and rejected. A language with a single document rejects nothing.
Ties between languages go to the first in alphabetical order. Very long texts are scored
in pieces, each with the symbols before it as context: the result is that of the whole
text. Repeated rows are each scored; an empty table gives no rows. Further columns stay
as they are; a result whose name is taken gets an underscore behind its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_of, free_names, hash_share, stored

ORDER, BASE = 4, np.uint64(0x9E3779B97F4A7C15 | 1)
DOCUMENTS_PER_LANGUAGE, SAMPLED_PER_LANGUAGE, LANGUAGES_AT_MOST = 400, 2000, 1000
FALSE_REJECTS = 0.001
SHARPNESS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
PIECE, CELLS = 1 << 16, 1 << 20
SPACE = np.uint32(32)

_alphabet: list[np.ndarray] = []


def alphabet() -> np.ndarray:
    """For each code point, its symbol: the lower-case letter, or a space for anything else. One by one, so that a text's pieces read as the text does."""
    if not _alphabet:
        _alphabet.append(np.fromiter((ord(c.lower()[0]) if (c := chr(i)).isalpha() else 32 for i in range(0x110000)), np.uint32, 0x110000))
    return _alphabet[0]


def symbols(text: str, begun: bool = False, after_letter: bool = False) -> tuple[np.ndarray, int]:
    """(a space and then the text's symbols, with one space for each run of others; number of letters).

    For a piece within a text, `begun` says whether a letter came before, `after_letter` whether one came just before.
    """
    codes = alphabet()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    is_letter = codes != SPACE
    n = int(is_letter.sum())
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    if len(keep):
        keep[0] |= after_letter
    codes = codes[keep]
    return (codes if begun or not n else np.concatenate([[SPACE], codes])).astype(np.uint32), n


def rolling(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that ends at each position from order-1 on."""
    c = codes.astype(np.uint64) + np.uint64(1)
    n = len(c) - order + 1
    out = c[:n].copy()
    for k in range(1, order):
        out *= BASE
        out += c[k : n + k]
    return out


def grams(codes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams: sorted hashes, counts, hash of all but the last symbol, hash of all but the first."""
    h = rolling(codes, order)
    hashes, first, counts = np.unique(h, return_index=True, return_counts=True)
    if order == 1:
        return hashes, counts, np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), np.uint64)
    shorter = rolling(codes, order - 1)
    return hashes, counts, shorter[first], shorter[first + 1]


def at(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions of keys in a sorted hash array, -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1)
    i = np.searchsorted(table, keys)
    i[i == len(table)] = 0
    return np.where(table[i] == keys, i, -1)


@dataclass
class Models:
    """hashes[k], log2 probabilities [k][row, language] of (k+1)-grams; contexts[k], back-off log2 weights of k-gram contexts."""

    languages: list[str]
    hashes: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    unseen: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    noise: np.ndarray
    limit: float = 8.0
    sharpness: float = 8.0

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """log2 probability of each symbol that has a full context, for each language."""
        order = len(self.hashes)
        n = len(codes) - order + 1
        out = np.empty((n, len(self.languages)), np.float32)
        rows = np.arange(n)
        extra = None
        for k in range(order - 1, -1, -1):
            grams_here = rolling(codes[order - 1 - k :], k + 1)[rows] if k < order - 1 else rolling(codes, order)
            found = at(self.hashes[k], grams_here)
            hit = found >= 0
            value = self.logp[k][found[hit]]
            out[rows[hit]] = value if extra is None else value + extra[hit]
            rows = rows[~hit]
            if not len(rows):
                return out
            extra = np.zeros((len(rows), len(self.languages)), np.float32) if extra is None else extra[~hit]
            if k:
                context = at(self.contexts[k], rolling(codes[order - 1 - k : len(codes) - 1], k)[rows])
                extra += np.where((context >= 0)[:, None], self.backoff[k][np.maximum(context, 0)], np.float32(0))
        out[rows] = extra + self.unseen
        return out

    def decide(self, bits: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """From summed log2 probabilities and symbol counts: language index, score, cross-entropy, rejected."""
        entropy = -bits / np.maximum(symbols, 1)[:, None]
        best = entropy.argmin(1)
        weights = np.exp2(-self.sharpness * (entropy - entropy.min(1, keepdims=True)))
        lowest = entropy.min(1)
        return best, 1 / weights.sum(1), lowest, self.excess(best, lowest, symbols) > self.limit

    def excess(self, best: np.ndarray, entropy: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """By how many standard deviations for its length a text lies above its language's mean."""
        return (entropy - self.mean[best]) / np.sqrt(self.spread[best] ** 2 + self.noise[best] ** 2 / np.maximum(symbols, 1))

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: summed log2 probabilities by language, symbols scored, letters.

        A piece of a text takes the symbols before it as its context, so pieces add up to the whole text.
        """
        order, n = len(self.hashes), len(texts)
        at_once = max(1024, min(PIECE, CELLS // len(self.languages)))
        bits, counts, letter_counts = np.zeros((n, len(self.languages))), np.zeros(n, np.int64), np.zeros(n, np.int64)
        held: list[np.ndarray] = []
        owners: list[int] = []

        def flush() -> None:
            if not held:
                return
            values = self.positions(np.concatenate(held))
            ends = np.cumsum([len(x) for x in held])
            starts = ends - [len(x) for x in held]
            # Positions whose context crosses into the piece before are not the piece's own.
            totals = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, 0, dtype=np.float64)])
            for i, a, b in zip(owners, starts.tolist(), (ends - order + 1).tolist(), strict=True):
                bits[i] += totals[b] - totals[a]
            held.clear()
            owners.clear()

        size = 0
        for i, text in enumerate(texts):
            context, after_letter = np.full(order - 1, SPACE), False
            for a in range(0, len(text), at_once):
                piece = text[a : a + at_once]
                codes, found = symbols(piece, counts[i] > 0, after_letter)
                after_letter = piece[-1].isalpha()
                letter_counts[i] += found
                if not len(codes):
                    continue
                counts[i] += len(codes)
                held.append(np.concatenate([context, codes]))
                owners.append(i)
                context = held[-1][len(held[-1]) - order + 1 :]
                size += len(codes)
                if size > at_once:
                    flush()
                    size = 0
        flush()
        return bits, counts, letter_counts

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, rejected) of each text."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        bits, counts, found = self.sums(texts)
        best, score, entropy, rejected = self.decide(bits, counts)
        none = found == 0
        names = [("und" if no else self.languages[b]) for no, b in zip(none, best, strict=True)]
        return names, np.where(none, 0.0, score), np.where(none, 0.0, entropy), rejected | none


def fit(samples: dict[str, list[str]], order: int = ORDER) -> Models:
    """Models from texts by language, not yet calibrated: nothing with a letter is rejected."""
    languages = sorted(samples)
    streams = {}
    for language in languages:
        pad = np.full(order - 1, SPACE)
        streams[language] = np.concatenate([pad, *(np.concatenate([symbols(t)[0], pad]) for t in samples[language])]).astype(np.uint32)
    if not languages:
        return Models([], *([] for _ in range(4)), *(np.zeros(0) for _ in range(4)))
    alphabet = len(np.unique(np.concatenate(list(streams.values())))) + 1
    top = [grams(streams[x], order) for x in languages]
    tables: list[list[tuple]] = [[] for _ in range(order)]
    for k in range(order):
        for x, language in enumerate(languages):
            if k == order - 1:
                tables[k].append(top[x])
                continue
            hashes, _, prefix, suffix = grams(streams[language], k + 1)
            # Continuation count: distinct symbols seen before the n-gram.
            longer = grams(streams[language], k + 2)
            follow, before = np.unique(longer[3], return_counts=True)
            found = at(follow, hashes)
            tables[k].append((hashes, np.where(found >= 0, before[np.maximum(found, 0)], 0), prefix, suffix))
    unseen = np.log2(np.full(len(languages), 1.0 / alphabet)).astype(np.float32)
    hashes_all, logp_all, contexts_all, backoff_all = [], [], [], []
    lower: np.ndarray | None = None
    for k in range(order):
        union = np.unique(np.concatenate([t[0] for t in tables[k]]))
        suffix_of, prefix_of = np.zeros(len(union), np.uint64), np.zeros(len(union), np.uint64)
        contexts = np.unique(np.concatenate([t[2] for t in tables[k]]))
        gamma = np.ones((len(contexts), len(languages)))
        first = np.zeros((len(union), len(languages)))
        for x, (hashes, counts, prefix, suffix) in enumerate(tables[k]):
            i = at(union, hashes)
            suffix_of[i], prefix_of[i] = suffix, prefix
            once, twice = int((counts == 1).sum()), int((counts == 2).sum())
            discount = once / (once + 2 * twice) if once and twice else 0.5
            c = at(contexts, prefix)
            total = np.bincount(c, counts, len(contexts))
            kinds = np.bincount(c, counts > 0, len(contexts))
            used = total > 0
            gamma[used, x] = discount * kinds[used] / total[used]
            first[i, x] = np.where(total[c] > 0, np.maximum(counts - discount, 0) / np.maximum(total[c], 1), 0)
        c = at(contexts, prefix_of)
        below = np.full((len(union), len(languages)), 1.0 / alphabet) if lower is None else lower[at(hashes_all[-1], suffix_of)]
        probability = first + gamma[c] * below
        hashes_all.append(union)
        logp_all.append(np.log2(probability).astype(np.float32))
        contexts_all.append(contexts)
        backoff_all.append(np.log2(gamma).astype(np.float32))
        lower = probability
    # An unseen symbol: the unigram's left-over mass, spread evenly.
    unseen = unseen + backoff_all[0][0]
    n = len(languages)
    return Models(languages, hashes_all, logp_all, contexts_all, backoff_all, unseen, np.full(n, np.inf), np.ones(n), np.ones(n))


EVIDENCE = ("truth", "own", "best", "lowest", "symbols", *(f"loss{s:g}" for s in SHARPNESS))


def evidence(models: Models, truth: list[str], texts: list[str]) -> np.ndarray:
    """A row of `EVIDENCE` for each text of a known language that has a letter: what calibration needs of it."""
    bits, counts, found = models.sums(texts)
    at = np.array([models.languages.index(x) for x in truth], np.int64)
    entropy = -bits / np.maximum(counts, 1)[:, None]
    own, lowest = entropy[np.arange(len(texts)), at], entropy.min(1)
    losses = [np.log(np.exp2(-s * (entropy - lowest[:, None])).sum(1)) + s * np.log(2) * (own - lowest) for s in SHARPNESS]
    return np.stack([at, own, entropy.argmin(1), lowest, counts, *losses], 1)[found > 0]


def calibrated(models: Models, seen: np.ndarray, false_rejects: float = FALSE_REJECTS) -> Models:
    """Set the sharpness of scores and the limit of rejection from the evidence of left-out texts."""
    truth, best = seen[:, 0].astype(int), seen[:, 2].astype(int)
    for x in range(len(models.languages)):
        e, n = seen[truth == x, 1], seen[truth == x, 4]
        if not len(e):
            continue
        models.mean[x] = np.median(e)
        off = e - models.mean[x]
        # Spread that stays for long texts, and noise that falls with the square root of the length.
        models.spread[x] = max(0.05, np.sqrt((off[n >= np.median(n)] ** 2).mean()))
        models.noise[x] = max(1.0, np.sqrt((off**2 * n).mean()))
    judged = np.isfinite(models.mean[best]) if len(seen) else np.zeros(0, bool)
    if judged.any():
        over = np.sort(models.excess(best[judged], seen[judged, 3], seen[judged, 4]))
        rank = int(np.ceil((len(over) + 1) * (1 - false_rejects)))
        models.limit = float(over[rank - 1]) if rank <= len(over) else float(max(4.0, 1.25 * over[-1]))
        models.sharpness = SHARPNESS[int(seen[:, 5:].mean(0).argmin())]
    return models


def learn(
    labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = DOCUMENTS_PER_LANGUAGE, sampled: int = SAMPLED_PER_LANGUAGE, false_rejects: float = FALSE_REJECTS
) -> Models:
    """Fit on a bounded sample of the labelled rows (non-null text and language), calibrate on the rest of the sample."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES_AT_MOST + 1).collect()}
    if len(counts) > LANGUAGES_AT_MOST:
        raise ValueError(f"more than {LANGUAGES_AT_MOST} languages")
    if not counts:
        return fit({})
    wanted = [(x, min(1.0, 2.0 * sampled / n), min(per_language, -(-4 * min(n, sampled) // 5))) for x, n in counts.items()]
    shares = spark.createDataFrame(wanted, "lang string, share double, fitted int")  # a row for each language
    some = rows.join(F.broadcast(shares), "lang").where(hash_share(11, "key", "text") < F.col("share"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("key", "text", F.lit(11)), "key", "text"))
    sample = stored(some.withColumn("number", number).where(F.col("number") <= sampled), "language-sample")
    samples: dict[str, list[tuple[int, str]]] = {}
    for r in sample.where("number <= fitted").select("lang", "number", "text").collect():
        samples.setdefault(r["lang"], []).append((r["number"], r["text"]))
    models = fit({x: [t for _, t in sorted(found)] for x, found in samples.items()})
    shared = spark.sparkContext.broadcast(models)  # bounded by the sample

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                found = evidence(shared.value, *(batch.column(c).slice(a, 200).to_pylist() for c in (0, 1)))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.T], list(EVIDENCE))

    left_out = sample.where("number > fitted").select("lang", "text").where(F.col("lang").isin(models.languages))
    seen = left_out.mapInArrow(weighed, ", ".join(f"`{c}` double" for c in EVIDENCE)).toArrow()  # `sampled` rows a language
    return calibrated(models, np.stack([c.to_numpy() for c in seen.columns], 1), false_rejects)


def identify(docs: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """All columns of `docs`, then lang_pred, score, cross_entropy and rejected. Only `text` is read for the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample
    names = free_names(docs.columns, "lang_pred", "score", "cross_entropy", "rejected")
    where = docs.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                texts = ["" if t is None else t for t in part.column(where).to_pylist()]
                language, value, entropy, rejected = shared.value.predict(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(language, pa.string()), pa.array(value, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected)], [*part.schema.names, *names])

    results = zip(names, (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()), strict=True)
    return docs.select(columns_of(docs)).mapInArrow(score, T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in results)]))
