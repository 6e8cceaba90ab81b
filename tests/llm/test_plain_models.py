"""The language and quality models against plain programs: dictionaries, one symbol or word at a time."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from chronolex.llm import language_id, linear, quality
from chronolex.llm.common import id_remainder

MASK = (1 << 64) - 1


def letters(text):
    """A space, then lower-case letters with one space for each run of anything else; leading others left out."""
    out = " "
    for c in text:
        if c.isalpha():
            out += c.lower()[0]
        elif len(out) > 1 and out[-1] != " ":
            out += " "
    return out


def plain_language(texts, order, alphabet):
    """p(n-gram): interpolated Kneser-Ney probability of its last symbol after the others, seen or not."""
    pad = " " * (order - 1)
    stream = pad + "".join(letters(t) + pad for t in texts)
    tables = {order: Counter(stream[i : i + order] for i in range(len(stream) - order + 1))}
    for k in range(1, order):
        tables[k] = Counter(g[1:] for g in {stream[i : i + k + 1] for i in range(len(stream) - k)})
    discount, totals, kinds = {}, defaultdict(Counter), defaultdict(Counter)
    for k, table in tables.items():
        once, twice = (sum(c == x for c in table.values()) for x in (1, 2))
        discount[k] = once / (once + 2 * twice) if once and twice else 0.5
        for g, c in table.items():
            totals[k][g[:-1]] += c
            kinds[k][g[:-1]] += 1

    def p(g):
        k = len(g)
        if not k:
            return 1 / alphabet
        total, lower = totals[k][g[:-1]], p(g[1:])
        if not total:
            return lower
        return max(tables[k][g] - discount[k], 0) / total + discount[k] * kinds[k][g[:-1]] / total * lower

    return p


def test_whole_decisions_of_language_id(spark, sf):
    """Language, score, cross-entropy and rejection of texts in and out of the sample, with back-off to unseen n-grams, contexts and symbols."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null and length(text) < 900").orderBy("doc_id").limit(160).collect()
    samples = defaultdict(list)
    for r in rows[:120]:
        samples[r.lang].append(r.text)
    models = language_id.fit(dict(samples))
    models = language_id.calibrated(models, language_id.evidence(models, [r.lang for r in rows[120:]], [r.text for r in rows[120:]]), false_rejects=0.05)
    alphabet = len(set("".join(letters(t) for ts in samples.values() for t in ts))) + 1
    plain = {x: plain_language(ts, language_id.ORDER, alphabet) for x, ts in samples.items()}
    texts = [r.text for r in rows[100:]] + ["qxzj vkwq jjxz", "日本語の文章です", "a", "  ...Ä?", "12 34", "", "The the THE, the - end.  ", "naïve façade " * 9]
    language, score, entropy, rejected = models.predict(texts)
    for i, text in enumerate(texts):
        if not any(c.isalpha() for c in text):
            assert (language[i], score[i], entropy[i], rejected[i]) == ("und", 0.0, 0.0, True)
            continue
        s = letters(text)
        padded = " " * (language_id.ORDER - 1) + s
        bits = {x: -sum(math.log2(p(padded[j : j + language_id.ORDER])) for j in range(len(s))) / len(s) for x, p in plain.items()}
        best = min(sorted(bits), key=bits.get)
        x = models.languages.index(best)
        excess = (bits[best] - models.mean[x]) / math.sqrt(models.spread[x] ** 2 + models.noise[x] ** 2 / len(s))
        assert language[i] == best and entropy[i] == pytest.approx(bits[best], abs=1e-4)
        assert score[i] == pytest.approx(1 / sum(2 ** (-models.sharpness * (b - bits[best])) for b in bits.values()), abs=1e-3)
        assert rejected[i] == (excess > models.limit) or abs(excess - models.limit) < 1e-3
    assert any(rejected[: len(rows) - 100]) or rejected[len(rows) - 100]


def plain_features(text, bits, fold):
    """Distinct hashed unigrams and bigrams of words and of runs of punctuation."""
    raw = text.encode()
    raw = raw.lower() if fold else raw
    hashes, last = [], None
    for m in re.finditer(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\t-\r ]+", raw):
        h, power = 0, 1
        for b in m[0]:
            h, power = (h + (b + 1) * power) & MASK, power * linear.BASE & MASK
        h ^= h >> 29
        h = h * int(linear.MIX) & MASK
        word = bool(re.match(rb"[0-9A-Za-z_\x80-\xff]", m[0]))
        hashes.append(int(linear.REPEAT) if word and h == last else h)
        last = h
    pairs = [(a * 3 + (b ^ 0x94D049BB133111EB)) * int(linear.MIX) & MASK for a, b in zip(hashes, hashes[1:], strict=False)]
    return {((h ^ h >> 32) * int(linear.MIX) & MASK) >> 64 - bits for h in hashes + pairs}


def plain_ftrl(examples, classes, rounds, alpha=0.3, beta=1.0, l1=2.0, l2=1.0):
    """{feature: weights} after `rounds` passes, one example at a time; None is the bias, without l1."""
    z, n = defaultdict(lambda: [0.0] * classes), defaultdict(lambda: [0.0] * classes)

    def weight(f, c):
        least = 0.0 if f is None else l1
        if abs(z[f][c]) <= least:
            return 0.0
        return (math.copysign(least, z[f][c]) - z[f][c]) / ((beta + math.sqrt(n[f][c])) / alpha + l2)

    for _ in range(rounds):
        for found, truth in examples:
            at = [*found, None]
            w = {f: [weight(f, c) for c in range(classes)] for f in at}
            score = [sum(w[f][c] for f in at) for c in range(classes)]
            e = [math.exp(s - max(score)) for s in score]
            for c in range(classes):
                g = e[c] / sum(e) - (c == truth)
                for f in at:
                    square = n[f][c] + g * g
                    z[f][c] += g - (math.sqrt(square) - math.sqrt(n[f][c])) / alpha * w[f][c]
                    n[f][c] = square
    return {f: [weight(f, c) for c in range(classes)] for f in list(z)}


def test_features_are_those_of_a_plain_program():
    texts = ["one two, two two ### x", "", "été Wort-Wort", "A_1 a_1 ...!? ...!? end\x0bof", "\x00\x7f z"]
    for fold in (True, False):
        row, feature, _ = linear.features(*linear.utf8_buffers(pa.array(texts)), 18, fold)
        for i, t in enumerate(texts):
            assert set(feature[row == i].tolist()) == plain_features(t, 18, fold), t


def test_quality_scores_are_sparse_dot_products_of_plain_ftrl(spark, sf):
    """Weights of a small training, and the scores of every document with them, in and out of the training."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs.join(labels, "doc_id").where(id_remainder("doc_id", 5) != 0).where("length(text) < 1500").orderBy("doc_id").limit(50).collect()
    model = linear.train(pa.array([r.text for r in rows]), [int(r.quality) for r in rows], fold=False, updates=200)
    rounds = min(20, max(3, -(-200 // len(rows))))
    plain = plain_ftrl([(sorted(plain_features(r.text, 18, False)), int(r.quality)) for r in rows], 2, rounds)
    assert np.abs(model.bias - plain[None]).max() < 1e-6
    for f, w in plain.items():
        if f is not None:
            assert np.abs(model.weights[f] - w).max() < 1e-6
    assert (np.abs(model.weights).sum(1) > 0).sum() == sum(any(w) for f, w in plain.items() if f is not None)
    some = docs.where("length(text) < 3000").orderBy("doc_id").limit(150)
    texts = {r.doc_id: r.text for r in some.collect()}
    for r in quality.score(some, model).collect():
        z = [sum(plain.get(f, (0.0, 0.0))[c] for f in plain_features(texts[r.doc_id], 18, False)) + plain[None][c] for c in (0, 1)]
        assert r.score == pytest.approx(1 / (1 + math.exp(z[0] - z[1])), abs=1e-5)
