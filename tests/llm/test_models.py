"""Learned operators: held-out accuracy, awkward rows, and what they must not read."""

import random
import re
import textwrap
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolex.llm import language_id, licenses, linear, mixing, quality, queries
from chronolex.llm.common import stored

from .corpus import awkward, empty


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_language_accuracy_and_rules(spark, sf, docs):
    found = queries.op1_language_id(spark, sf)
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and 0.15 < len(held) / len(rows) < 0.35
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and np.mean([r.rejected for r in rows]) < 0.01


def test_language_of_awkward_rows(spark, docs):
    models = language_id.learn(docs)
    frame = awkward(spark).withColumn("Rejected", F.lit("old"))
    found = language_id.identify(frame, models)
    assert found.columns == [*frame.columns, "lang_pred_", "score_", "cross_entropy", "rejected_"]
    assert sorted(map(str, found.select(frame.columns).collect())) == sorted(map(str, frame.collect()))
    rows = {r.doc_id: r for r in found.collect()}
    assert rows[0].lang_pred_ == rows[1].lang_pred_ == rows[6].lang_pred_ == "und" and rows[0].score_ == 0.0 and rows[0].rejected_
    assert rows[2].lang_pred_ in models.languages and rows[2].lang_pred_ == rows[3].lang_pred_
    assert language_id.identify(empty(docs), models).count() == 0
    none = language_id.learn(docs.where("lang is null"))
    assert {r.lang_pred for r in language_id.identify(docs.limit(3), none).collect()} == {"und"}


def test_language_pieces_do_not_change_the_result(docs, monkeypatch):
    models = language_id.learn(docs)
    text = " ".join(r.text for r in docs.orderBy("doc_id").limit(20).collect())
    texts = [text, "", "short text", "... 12  " * 500 + "ends" + " !" * 700 + "AΣ İß" * 300, "x" * 2000, "?" * 3000]
    whole = models.sums(texts)
    for piece in (1024, 1500):
        monkeypatch.setattr(language_id, "PIECE", piece)
        parts = models.sums(texts)
        assert (whole[1] == parts[1]).all() and (whole[2] == parts[2]).all()
        assert np.allclose(whole[0], parts[0], rtol=1e-9, atol=1e-6)


def plain_kneser_ney(texts, order):
    """{n-gram: interpolated probability} for every n-gram seen, by dictionaries."""
    pad = " " * (order - 1)
    stream = pad + "".join(" " + " ".join(re.findall("[^\\W\\d_]+", t.lower())) + (" " if not t[-1:].isalpha() else "") + pad for t in texts)
    top = Counter(stream[i : i + order] for i in range(len(stream) - order + 1))
    tables = {order: top}
    for k in range(1, order):
        longer = {stream[i : i + k + 1] for i in range(len(stream) - k)}
        tables[k] = Counter(g[1:] for g in longer)
        for i in range(len(stream) - k + 1):
            tables[k].setdefault(stream[i : i + k], 0)
    probability = {"": None}
    for k in range(1, order + 1):
        once, twice = (sum(c == x for c in tables[k].values()) for x in (1, 2))
        discount = once / (once + 2 * twice) if once and twice else 0.5
        totals, kinds = Counter(), Counter()
        for g, c in tables[k].items():
            totals[g[:-1]] += c
            kinds[g[:-1]] += c > 0
        for g, c in tables[k].items():
            t = totals[g[:-1]]
            lower = probability[g[1:]] if k > 1 else None
            probability[g] = (max(c - discount, 0) / t, discount * kinds[g[:-1]] / t, lower) if t else (0.0, 1.0, lower)
    return probability


def test_models_equal_plain_kneser_ney():
    texts = {"a": ["abab abba, baba abab", "bab ab. Abba!", "aab"], "b": ["cdcd dccd cdc ddcc", "dcd cab cc"]}
    m = language_id.fit(texts, order=3)
    alphabet = len(set("".join(texts["a"] + texts["b"]).lower()) & set("abcd ")) + 1

    def value(entry):
        first, gamma, lower = entry
        return first + gamma * (1 / alphabet if lower is None else value(lower))

    for x, language in enumerate(m.languages):
        plain = plain_kneser_ney(texts[language], 3)
        for k in (1, 2, 3):
            for gram in (g for g in plain if len(g) == k):
                at = np.searchsorted(m.hashes[k - 1], language_id.rolling(np.array([*map(ord, gram)], np.uint32), k)[0])
                assert 2.0 ** m.logp[k - 1][at, x] == pytest.approx(value(plain[gram]), rel=1e-5)


def test_kneser_ney_sums_to_one():
    samples = {"a": ["abab abba baba abab " * 8] * 3, "b": ["cdcd dccd cdc ddcc " * 8] * 3}
    m = language_id.fit(samples, order=3)
    symbols = [ord(c) for c in "abcd "]
    for context in ("ab", "ba", "cd", " a"):
        codes = [np.array([*map(ord, context), s], np.uint32) for s in symbols]
        p = np.exp2(np.array([m.positions(c)[0] for c in codes]).astype(float)).sum(0)
        assert (p < 1.001).all() and (p > 0.7).all()  # the rest is left for unseen symbols


def test_language_rejects_what_no_model_accounts_for(spark, docs):
    """Shuffled letters, random letters, other scripts and languages go; the stated share of real documents, and no more, does too."""
    models, rng = language_id.learn(docs), random.Random(5)
    texts = [r.text for r in docs.where("text is not null").orderBy("doc_id").limit(300).collect()]
    shuffled = ["".join(rng.sample(t, len(t))) for t in texts if len(t) > 200]
    noise = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz    ", k=rng.randrange(150, 900))) for _ in range(50)]
    foreign = ["日本語の文章です。" * 20, "Questo è un testo italiano con molte parole diverse. " * 8, "qxzj vkwq jjxz qqzx wvkj zzxq " * 20]
    assert np.mean(models.predict(shuffled)[3]) > 0.97 and models.predict(noise)[3].all() and models.predict(foreign)[3].all()
    rejected = language_id.identify(docs, models).where("rejected and text is not null").count()
    assert rejected <= 5 * language_id.FALSE_REJECTS * docs.count()


def test_rejection_limit_is_the_stated_quantile():
    m = language_id.Models(["a"], [], [], [], [], np.zeros(1), np.full(1, np.inf), np.ones(1), np.ones(1))
    rng = np.random.default_rng(1)
    e = 2 + 0.1 * rng.standard_normal(5000)
    seen = np.stack([0 * e, e, 0 * e, e, 0 * e + 10_000, *(0 * e for _ in language_id.SHARPNESS)], 1)
    m = language_id.calibrated(m, seen, false_rejects=0.01)
    assert 0.005 < (m.excess(np.zeros(5000, int), e, seen[:, 4]) > m.limit).mean() <= 0.01
    few = language_id.calibrated(m, seen[:20], false_rejects=0.01)
    assert few.limit >= 1.25 * few.excess(np.zeros(20, int), e[:20], seen[:20, 4]).max() - 1e-9


def test_quality_on_held_out(spark, sf):
    labels = {r[0]: r[1] for r in duckdb.connect().execute(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall()}
    rows = queries.op6_quality(spark, sf).collect()
    held = [(labels[r.doc_id], r) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([q == r.predicted for q, r in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_quality_of_awkward_rows(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(awkward(spark), labels).collect()
    assert len(rows) == awkward(spark).count()
    assert len({r.score for r in rows if r.doc_id in (0, 1, 6)}) == 1
    assert {r.score for r in quality.classify(awkward(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty(docs), labels).count() == 0


def test_features_do_not_depend_on_the_batch():
    import pyarrow as pa

    texts = ["one two, two two ### x", "", "été Wort-Wort", "one two, two two ### x"]
    both = linear.features(*linear.utf8_buffers(pa.array(texts)), 18, True)
    for i, t in enumerate(texts):
        own = linear.features(*linear.utf8_buffers(pa.array([t])), 18, True)
        assert sorted(both[1][both[0] == i]) == sorted(own[1]) and both[2][i] == own[2][0] == len(t.split())


def test_mixing_meets_its_targets(spark, sf):
    rows = queries.op7_mixing(spark, sf)
    sums = rows.agg(*(F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in ("clean", "junk", "toxic"))).first().asDict()
    total = sum(sums.values())
    for d, w in mixing.TARGETS.items():
        assert abs(sums[d] / total - w) < 0.02
    assert rows.where("rate < 0").count() == 0 and rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_mixing_meets_a_small_target_of_a_large_domain(spark, monkeypatch):
    """Rates near 0 and near 1 are not rounded: their domains' totals are the targets."""
    monkeypatch.setattr(mixing, "learn", lambda docs, labelled: Sure())
    docs = spark.createDataFrame([(i, "clean word" if i % 2 else "junk word") for i in range(400)], "doc_id long, text string")
    rows = mixing.mix(docs, docs.limit(1), {"clean": 0.97, "junk": 0.03}, total=400.0)
    got = {r.kind: r for r in rows.groupBy(F.split("text", " ")[0].alias("kind")).agg(F.sum(F.col("rate") * F.col("n_tokens")).alias("n"), F.sum("copies").alias("copies")).collect()}
    assert abs(got["clean"].n - 388) < 0.1 and abs(got["junk"].n - 12) < 0.1
    assert got["junk"].copies > 0


def test_mixing_repeats_scarce_domains(spark, monkeypatch):
    """Clean documents are all kept where there is little junk, and the junk is repeated."""
    monkeypatch.setattr(mixing, "learn", lambda docs, labelled: Sure())
    docs = spark.createDataFrame([(i, "junk word" if i < 4 else "clean word") for i in range(400)], "doc_id long, text string")
    rows = mixing.mix(docs, docs.limit(1), {"clean": 0.9, "junk": 0.1}).collect()
    assert all(abs(r.rate - (11 if r.doc_id < 4 else 1)) < 1e-3 for r in rows)
    assert sum(r.copies for r in rows if r.doc_id >= 4) >= 395


class Sure:
    """A model that knows each text's domain by its first word."""

    classes = ("clean", "junk")

    def of_arrow(self, column):
        texts = column.to_pylist()
        return np.array([[1.0, 0.0] if t.startswith("clean") else [0.0, 1.0] for t in texts]), np.array([len(t.split()) for t in texts], np.int64)


@pytest.mark.parametrize("case", ["free", "bound", "unreachable"])
def test_mixing_solver_equals_least_squares(spark, case):
    """`solve` reaches the least squared distance of any nonnegative rates, as slow plain gradient steps find it."""
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.4, 0.4, 0.4], 300)
    if case == "unreachable":  # every document is half of the first domain at least
        p[:, 0] += 1
        p /= p.sum(1, keepdims=True)
    n = rng.integers(1, 500, 300)
    total = float((n @ p).min()) if case != "bound" else 40.0 * n.sum()
    weights = {"a": 0.8, "b": 0.15, "c": 0.05} if case != "unreachable" else {"a": 0.1, "b": 0.6, "c": 0.3}
    soft = stored(spark.createDataFrame([(int(k), *map(float, x)) for k, x in zip(n, p, strict=True)], "n long, p0 double, p1 double, p2 double"), "soft")
    fit = mixing.solve(soft, list(weights), weights, total)
    assert np.allclose(fit.goal, np.array(list(weights.values())) * total)
    rates = np.array([r[0] for r in soft.select(mixing.rate_of([F.col(f"p{c}") for c in range(3)], fit.steps)).collect()])
    rows = np.array([tuple(r) for r in soft.collect()])
    assert (rates >= 0).all() and np.allclose((rates * rows[:, 0]) @ rows[:, 1:], fit.totals)
    r, scale = np.ones(300), 1 / np.linalg.eigvalsh((n[:, None] * p).T @ p).max()
    for _ in range(20_000):
        r = np.maximum(0, r - scale * (p @ ((r * n) @ p - fit.goal)))
    best = np.sum(((r * n) @ p - fit.goal) ** 2)
    assert np.sum((fit.totals - fit.goal) ** 2) <= best * 1.02 + (1e-5 * total) ** 2
    assert (fit.gap > 0.05) == (case == "unreachable")


def test_mixing_says_when_it_misses(spark, monkeypatch):
    monkeypatch.setattr(mixing, "learn", lambda docs, labelled: Sure())
    docs = spark.createDataFrame([(i, "clean word") for i in range(50)], "doc_id long, text string")
    with pytest.warns(UserWarning, match="misses its targets"):
        rows = mixing.mix(docs, docs.limit(1), {"clean": 0.5, "junk": 0.5}).collect()
    assert all(abs(r.rate - 1) < 1e-6 for r in rows)


def test_mixing_of_awkward_rows(spark, sf, docs):
    domains = mixing.domains(spark.read.parquet(f"{sf}/labels.parquet"))
    labelled = stored(awkward(spark).select("doc_id").where("doc_id is not null").distinct().withColumn("label", F.when(F.col("doc_id") % 2 == 0, "clean").otherwise("junk")), "labelled")
    targets = {"clean": 0.5, "junk": 0.5}
    kept = mixing.mixed(awkward(spark), labelled, targets)
    assert kept.columns == awkward(spark).columns
    own = {tuple(r) for r in awkward(spark).collect()}
    assert own >= {tuple(r) for r in kept.collect()}  # other columns of the results' names stay as they are
    rates = mixing.mix(awkward(spark), labelled, targets)
    assert rates.columns[-2:] == ["rate", "copies_"] and rates.where("copies <> 0").count() == 0 and rates.count() == awkward(spark).count()
    assert mixing.mixed(awkward(spark), domains.limit(0), targets).count() == awkward(spark).count()
    assert mixing.mixed(empty(docs), domains, mixing.TARGETS).count() == 0
    with pytest.raises(ValueError, match="no labelled"):
        mixing.mixed(awkward(spark), labelled, {"other": 1.0}).count()


def test_licences(spark, sf, docs):
    model = licenses.learn(docs)
    lines = [
        ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("Released under the MIT License.", "MIT"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"),
        ("A driver needs a valid license to operate a vehicle on public roads.", None),
    ]
    frame = spark.createDataFrame([(i, f"some words\n{t}\nmore words") for i, (t, _) in enumerate(lines)] + [(9, None), (10, "")], "doc_id long, text string").withColumn("p", F.lit(1))
    got = {r.doc_id: r for r in licenses.scan(frame, model).where("confirmed").collect()}
    assert {i: r.family for i, r in got.items()} == {i: f for i, (_, f) in enumerate(lines) if f}
    assert all(r.paragraph == 1 for r in got.values())
    assert licenses.scan(empty(docs), model).count() == 0
    # every licence line of the corpus, by its wording, and nothing else
    plain = duckdb.connect().execute(f"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM '{sf}/documents.parquet')
        SELECT doc_id FROM l WHERE regexp_matches(p, '^(Licensed under|Released under the MIT|This work is licensed)')""").fetchall()
    found = licenses.scan(docs, model).where("confirmed").select("doc_id").collect()
    assert sorted(r.doc_id for r in found) == sorted(r[0] for r in plain)


def test_licences_in_wrapped_lines_and_near_misses(spark, docs):
    model = licenses.learn(docs)
    assert model.held_out["false_names"] <= licenses.FALSE_NAMES and model.held_out["recall"] > 0.85
    notices = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts]
    rows = [(i, "Some Program, by its authors\n\n" + "\n".join(textwrap.wrap(t, 72)) + "\n\nint main() {}") for i, (_, t) in enumerate(notices)]
    rows += [(100 + i, "\n".join(f" * {x}" for x in textwrap.wrap(t, 66))) for i, (_, t) in enumerate(notices)]
    other = ["Licensed under the Eclipse Public License, version 2.0.", "Licensed under the Foo Public License, version 2.0.", "Released under the OpenLDAP Public License.", "Licensed under the Q Public License, version 1.0.", *licenses.OTHERS]
    rows += [(200 + i, t) for i, t in enumerate(other)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in licenses.scan(frame, model).where("confirmed").collect():
        found.setdefault(r.doc_id, set()).add(r.family)
    assert found == {base + i: {f} for i, (f, _) in enumerate(notices) for base in (0, 100)}


def test_licence_scan_equals_the_plain_model(spark, docs):
    """Paragraphs, probabilities and overlaps of the plan against one paragraph after the other."""
    model, weights = licenses.learn(docs), licenses.template_weights()
    rng = random.Random(9)
    notices = [t for ts in licenses.TEMPLATES.values() for t in ts] + list(licenses.OTHERS + licenses.ALIKE)
    texts = [" ".join(licenses._altered(t.split(), rng)) for t in notices] + ["\n".join(textwrap.wrap(t, w)) for t in notices for w in (50, 90)]
    texts += [r.text for r in docs.orderBy("doc_id").limit(60).collect()] + ["\n\n.\n", "no end" * 20 + "\n*\nlicense", None, "a" * 200 + "\nGPL", "copyright " * 40_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as paragraph", "0.5 as probability", "'k' as key")
    frame = frame.union(frame.where("doc_id < 3"))
    want = []
    for i, text in [*enumerate(texts), *enumerate(texts[:3])]:
        for number, p in enumerate(licenses.paragraphs_of(text or "")):
            words = licenses.words_of(p)
            if not set(words) & set(model.strong):
                assert model.probabilities(words)[:-1].max() < model.threshold
                continue
            probability = model.probabilities(words)
            named = model.classes[int(probability[:-1].argmax())]
            family = named if probability[:-1].max() >= model.threshold and not licenses.is_relative(words, named) else licenses.UNKNOWN
            best = {n: max(licenses.overlap(set(words), set(licenses.words_of(t)), weights) for t in ts) for n, ts in (*licenses.TEMPLATES.items(), *((t, (t,)) for t in licenses.OTHERS))}
            own = best.get(family, 0.0)
            sure = family != licenses.UNKNOWN and own >= licenses.LEAST_OVERLAP and own >= max(best.values()) - 1e-9
            want.append((i, number, family, round(float(probability[:-1].max()), 6), round(own, 6), sure))
    got = [(r.doc_id, r.paragraph, r.family, round(r.probability, 6), round(r.overlap, 6), r.confirmed) for r in licenses.scan(frame, model).collect()]
    assert sorted(got) == sorted(want)


def test_licences_of_awkward_rows(spark, docs):
    model = licenses.learn(awkward(spark))
    assert licenses.scan(awkward(spark), model).where("confirmed").count() == 0
    assert licenses.train([]).classes[-1] == licenses.UNKNOWN


#: Relatives of the families, other licences, and tags; none of these texts is among the notices learned from but the first five.
RELATIVES = """Licensed under CC BY-ND 4.0.|CC BY-NC-ND 4.0.|CC BY-NC-SA 4.0.|Creative Commons Attribution-NoDerivatives 4.0 International|Educational Community License, Version 2.0
Licensed under the Educational Community License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.|Licensed under CC BY-NC-ND 3.0.
This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.|Creative Commons Attribution-NonCommercial-NoDerivs 2.5|Released under the MIT-0 License.
SPDX-License-Identifier: MIT-0|SPDX-License-Identifier: 0BSD|SPDX-License-Identifier: BSL-1.0|SPDX-License-Identifier: CC-BY-NC-ND-4.0|SPDX-License-Identifier: ECL-2.0|SPDX-License-Identifier: EUPL-1.2
SPDX-License-Identifier: GFDL-1.3-or-later|SPDX-License-Identifier: OFL-1.1|SPDX-License-Identifier: Apache-1.1|SPDX-License-Identifier: MPL-1.1|Licensed under the Apache Software License, version 1.0.
Licensed under the Mulan Permissive Software License, version 2.|Released under the W3C Software License.|Released under the Python Software Foundation License, version 2.|Released under the Ruby License.
Licensed under the Nokia Open Source License.|Licensed under the Sleepycat License.|Licensed under the Netscape Public License, version 1.1.|Licensed under the Reciprocal Public License 1.5.
Licensed under the Sun Industry Standards Source License.|Licensed under the Elastic License 2.0.|Licensed under the Parity Public License 7.0.0.|Released under the LaTeX Project Public License, version 1.3.
Licensed under the Affero Attribution Assurance License.|Licensed under the GNU Verbatim Copying License.|Licensed under the Zope Public License, version 2.1.|Licensed under the CeCILL Free Software License Agreement.
Dual licensed under the Cryptix General License.|Licensed under the Creative Commons Sampling Plus License.|Licensed under the Intel ACPI license.""".replace("\n", "|").split("|")
NAMED = {
    "// SPDX-License-Identifier: MIT": "MIT", "SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "# SPDX-License-Identifier: BSD-3-Clause": "BSD", "SPDX-License-Identifier: GPL-2.0-only": "GPL", "The MIT License (MIT)": "MIT",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.': "MIT",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE': "BSD",
    "GNU GENERAL PUBLIC LICENSE": "GPL", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.": "CC-BY-SA", "Licensed under CC BY 4.0.": "CC-BY", "Licensed under CC BY-NC 4.0": "CC-BY-NC",
    "Copyright 2020 by the publisher. All rights reserved.": "proprietary", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
}


def test_relatives_of_licences_are_unknown_and_tags_are_found(spark, docs):
    model = licenses.learn(docs)
    texts = [*RELATIVES, *NAMED]
    assert len(RELATIVES) >= 36
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {texts[r.doc_id]: (r.family, r.confirmed) for r in licenses.scan(frame, model).collect()}
    assert {t: got[t] for t in RELATIVES if got.get(t, (licenses.UNKNOWN, False)) != (licenses.UNKNOWN, False)} == {}
    assert {t: got.get(t) for t in NAMED} == {t: (f, True) for t, f in NAMED.items()}
