"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are the text's lines, wrapped ones put together: a line of 40 to 120 characters
that does not end a sentence goes on in the next one, unless that has no letter or digit.

Sparse logistic regression (softmax over licence families and an unknown class) on word
unigrams and bigrams is trained on altered copies of public licence notices and, as
unknown, on notices of other licences, sentences that only sound alike, and paragraphs of
a bounded sample of the corpus. The probability needed to name a family is calibrated by
cross-validation over whole notices: at most the share `FALSE_NAMES` of the other
licences' and like-sounding notices, none of them seen in training, reaches it; below it
a paragraph stays `unknown`. A named family is confirmed if one of its templates is found
in the paragraph (or the paragraph in it) to `LEAST_OVERLAP`, words weighed by how few
licences use them, and no other licence's template is found better.

What a paragraph has beyond the template counts too: the words of a licence's name in it
(those before `license`, behind `CC`, `Attribution` or an SPDX tag, a version number) must
all be of the named family's wording; one that is not is a relative of the family, such as
a NoDerivatives or Educational Community licence, and stays `unknown`.

The scan itself is DataFrame expressions. Features are strong words (those that spoke for
a family in a first training) and bigrams that hold one; a paragraph without any has no
feature and is unknown by its bias alone, so only texts with a strong word are looked at,
without loss. Candidates are classified once for each distinct paragraph, so a line that a
third of the corpus repeats costs one classification.

Cases: null and empty texts have no paragraph and give no row. Repeated rows give their
rows again. An empty table gives no rows. Paragraphs of any length are taken whole.
Further columns are ignored. Ties between families go to the first in alphabetical order.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_share, sample_fraction, stored

UNKNOWN = "unknown"
SAMPLE_DOCUMENTS, SAMPLE_PARAGRAPHS = 300, 3000
BROADCAST_ROWS = 500_000
FALSE_NAMES, LEAST_OVERLAP, FOLDS, BLOCK = 0.05, 0.7, 4, 16

#: A line break within a wrapped paragraph, for Java and Python alike (Java reads it with UNIX line ends).
WRAPPED = r"^(?=[^\n]*[A-Za-z0-9])([^\n]{39,119}[^\n.:;!?\s])[ \t]*\n(?=[^\n]*[A-Za-z0-9])"

# Wording of public licences and of the usual notices that name them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "This project is licensed under the MIT license, see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GPL version 2 or later.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "GNU GENERAL PUBLIC LICENSE",
        "This code is licensed under the GNU General Public License version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "Released under the LGPL version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "Released under the AGPL version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause \"Simplified\" License.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under the Creative Commons Attribution-NonCommercial License.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
        "Released under CC0 1.0 Universal, public domain dedication.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "ISC": (
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "proprietary": (
        "Copyright by the publisher. All rights reserved.",
        "No part of this publication may be reproduced, stored or transmitted in any form without the prior written permission of the publisher.",
    ),
}
# Notices of other licences, which are of no family here.
OTHERS = (
    "Licensed under the Eclipse Public License, version 2.0.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which accompanies this distribution.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This software is provided as-is, without any express or implied warranty, under the zlib license.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Released under the Artistic License 2.0.",
    "Licensed under the Microsoft Public License.",
    "Licensed under the Open Software License version 3.0.",
    "Licensed under the Common Public License, version 1.0.",
    "Released under the PostgreSQL License.",
    "Made available under the Open Database License.",
    "Licensed under the Business Source License 1.1.",
    "Licensed under the Server Side Public License, version 1.",
    "This work is made available under the Free Art License 1.3.",
    "Licensed under CC BY-ND 4.0.",
    "Licensed under CC BY-NC-SA 4.0.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License.",
    "Released under the Zero-Clause BSD license.",
    "Licensed under the MIT No Attribution license.",
    "Released under the X11 License.",
    "Licensed under the Academic Free License version 3.0.",
    "Do What The Fuck You Want To Public License.",
    "Licensed under the Apache License, Version 1.1.",
    "Subject to the Mozilla Public License Version 1.1.",
)
#: Words that end a licence's name to the left of `license`, or to the right of a lead.
ENDS = "the|a|an|this|that|its|under|of|is|by|to|in|on|or|and|see|with|for|at|as|your|our|copy|valid|which|licensed|released|available|made|terms|subject|provided"
NAME_BEFORE = f"((?: (?!(?:{ENDS}) )[a-z0-9]+){{1,4}}) licen[sc]es?(?= )"
NAME_BEHIND = r" (?:cc|commons|attribution|identifier)((?: (?!(?:under|the|a|an|this|is|in|to|of|see|for|licen[sc]e|international|unported|[0-9]+) )[a-z0-9]+){1,5})(?= )"
#: A version, and the families whose name holds one.
VERSION = r" (?:apache|apache licen[sc]e|mpl|mozilla public licen[sc]e)(?: version| v)? ([0-9]+)(?= )"
VERSIONED = ("Apache-2.0", "MPL-2.0")
NUMBERED, UNVERSIONED = r" (?:mit|isc|unlicense) ([0-9]+)(?= )", ("MIT", "ISC", "Unlicense")
#: Words of a name that say nothing about the family: numbers, and how a licence is named or tagged.
NEUTRAL = frozenset({"spdx", "license", "licence", "identifier", "file", "software", "source", "code", "open", "full", "following", "project", "v", "international", "unported", "generic"})
# Paragraphs that only sound like licences.
ALIKE = (
    "A driver needs a valid license to operate a vehicle on public roads.",
    "The version of the story that was released last year is different.",
    "He asked for permission to use the software at work.",
    "The general public was invited to the free exhibition at the foundation.",
    "Apache is the name of several related peoples of the southwest.",
    "The creative industry makes use of common resources under the law.",
    "Students at MIT published a paper on the source of the error.",
    "This program was first shown on television and distributed in many countries.",
    "A copy of the letter can be found in the file, with conditions and terms of the sale.",
    "The warranty of the machine does not cover any damage by its owner.",
)


def words_of(paragraph: str) -> list[str]:
    return re.findall("[a-z0-9]+", paragraph.lower())


def paragraphs_of(text: str) -> list[str]:
    return re.sub(WRAPPED, r"\1 ", text, flags=re.M).split("\n")


def ngrams_of(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def wording(family: str) -> set[str]:
    """All words of a family's notices."""
    return {w for t in TEMPLATES.get(family, ()) for w in words_of(t)}


def is_relative(words: list[str], family: str) -> bool:
    """Whether a licence's name in a paragraph has a word, or a version, that is none of the family's."""
    line, own = f" {' '.join(words)} ", wording(family) | NEUTRAL
    names = [w for pattern in (NAME_BEFORE, NAME_BEHIND) for found in re.findall(pattern, line) for w in found.split()]
    return any(w not in own and not w.isdigit() for w in names) or (family in VERSIONED and any(v != "2" for v in re.findall(VERSION, line))) or (family in UNVERSIONED and bool(re.search(NUMBERED, line)))


def relative(words: Column, family: Column) -> Column:
    """`is_relative` as an expression."""
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    names = F.flatten(F.array(*(F.flatten(F.transform(F.regexp_extract_all(line, F.lit(p), F.lit(1)), lambda x: F.split(F.trim(x), " "))) for p in (NAME_BEFORE, NAME_BEHIND))))
    own = F.create_map(*(x for f in sorted(TEMPLATES) for x in (F.lit(f), F.array(*map(F.lit, sorted(wording(f) | NEUTRAL))))))
    odd = F.exists(F.filter(names, lambda w: ~w.rlike("^[0-9]+$")), lambda w: ~F.array_contains(F.try_element_at(own, family), w))
    version = family.isin(*VERSIONED) & F.exists(F.regexp_extract_all(line, F.lit(VERSION), F.lit(1)), lambda v: v != "2")
    return odd | version | (family.isin(*UNVERSIONED) & line.rlike(NUMBERED))


@dataclass
class Classifier:
    classes: list[str]
    vocabulary: list[str]
    weights: np.ndarray
    bias: np.ndarray
    strong: list[str]
    threshold: float
    #: shares of left-out notices of other licences named, and of new altered copies of families' notices named rightly
    held_out: dict[str, float] = field(default_factory=dict)

    def probabilities(self, words: list[str]) -> np.ndarray:
        """Of the classes, for one paragraph."""
        number = {g: i for i, g in enumerate(self.vocabulary)}
        z = self.weights[[number[g] for g in ngrams_of(words) if g in number]].sum(0) + self.bias
        p = np.exp(z - z.max())
        return p / p.sum()


def _altered(words: list[str], rng: random.Random) -> list[str]:
    """A copy with some words dropped, some replaced by nonsense, perhaps cut short."""
    out = [w if rng.random() > 0.06 else "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for w in words if rng.random() > 0.06 or len(words) < 8]
    if len(out) > 16 and rng.random() < 0.4:
        a = rng.randrange(len(out) // 3)
        out = out[a : a + max(12, len(out) // 2)]
    return out


def _descend(rows: list[tuple[int, np.ndarray]], features: int, classes: int, epochs: int, rate: float, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression in blocks of `BLOCK` rows."""
    weights, bias = np.zeros((features, classes)), np.zeros(classes)
    blocks = []
    for start in range(0, len(rows), BLOCK):
        some = rows[start : start + BLOCK]
        blocks.append((np.array([c for c, _ in some]), np.repeat(np.arange(len(some)), [len(at) for _, at in some]), np.concatenate([at for _, at in some])))
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for c, row, at in blocks:
            z = np.tile(bias, (len(c), 1))
            np.add.at(z, row, weights[at])
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(c)), c] -= 1
            np.add.at(weights, at, -step * p[row])
            bias -= step * 0.1 * p.sum(0)
        weights *= 1 - decay * len(rows)
    return weights, bias


def _fit(examples: list[tuple[str, list[str]]], everyday: dict[str, float], epochs: int = 12, rate: float = 0.3, decay: float = 1e-5) -> Classifier:
    """Softmax regression: once over all n-grams that recur in notices and are not everyday words, to find the strong
    words, then over the n-grams that hold one."""
    classes = [*sorted(TEMPLATES), UNKNOWN]
    featured = [(classes.index(c), ngrams_of(w)) for c, w in examples]
    often: dict[str, int] = {}
    for c, f in featured:
        if classes[c] != UNKNOWN:
            for g in f:
                often[g] = often.get(g, 0) + 1
    vocabulary = sorted(g for g, n in often.items() if n >= 4 and everyday.get(g, 0) <= 0.02)

    def trained(names: list[str], times: int) -> tuple[np.ndarray, np.ndarray]:
        number = {g: i for i, g in enumerate(names)}
        rows = [(c, np.array(sorted(number[g] for g in f if g in number), np.int64)) for c, f in featured]
        return _descend(rows, len(names), len(classes), times, rate, decay)

    weights, _ = trained(vocabulary, epochs // 3)
    strong = {g for i, g in enumerate(vocabulary) if " " not in g and weights[i, :-1].max() > 0.3}
    names = [g for g in vocabulary if strong & set(g.split())]
    weights, bias = trained(names, epochs)
    return Classifier(classes, names, weights, bias, sorted(strong), 1.0)


def train(others: list[str], copies: int = 12, false_names: float = FALSE_NAMES) -> Classifier:
    """The classifier, its threshold calibrated on notices left out as a whole, in `FOLDS` folds."""
    rng = random.Random(3)
    notices = [(c, t) for c, ts in sorted(TEMPLATES.items()) for t in ts] + [(UNKNOWN, t) for t in (*OTHERS, *ALIKE)]
    made = [(c, [words_of(t) if i == 0 else _altered(words_of(t), rng) for i in range(copies)]) for c, t in notices]
    known = [frozenset(words_of(t)) for ts in TEMPLATES.values() for t in ts]
    plain = [w for p in others if (w := words_of(p)) and all(len(set(w) & k) < 0.5 * len(k) for k in known)]
    counts: dict[str, int] = {}
    for w in plain:
        for g in ngrams_of(w):
            counts[g] = counts.get(g, 0) + 1
    everyday = {g: n / len(plain) for g, n in counts.items()}

    def examples(left_out: int | None) -> list[tuple[str, list[str]]]:
        out = [(c, w) for i, (c, copied) in enumerate(made) if left_out is None or i % FOLDS != left_out for w in copied]
        out += [(UNKNOWN, w) for i, w in enumerate(plain) if left_out is None or i % FOLDS != left_out]
        random.Random(7).shuffle(out)
        return out

    near = []
    for fold in range(FOLDS):
        model = _fit(examples(fold), everyday)
        for w in (w for i, (c, copied) in enumerate(made) if i % FOLDS == fold and c == UNKNOWN for w in copied):
            p = model.probabilities(w)[:-1]
            near.append(0.0 if is_relative(w, model.classes[int(p.argmax())]) else float(p.max()))
    model = _fit(examples(None), everyday)
    alone = np.exp(model.bias - model.bias.max())
    floor = max(0.5, float(alone[:-1].max() / alone.sum()) + 1e-6)  # bias alone names nothing
    model.threshold = float(np.clip(np.quantile(near, 1 - false_names, method="higher") + 1e-6, floor, 0.99))
    fresh = [(model.classes.index(c), model.probabilities(_altered(words_of(t), rng))) for c, t in notices if c != UNKNOWN for _ in range(4)]
    named = [p[:-1].argmax() == c and p[c] >= model.threshold for c, p in fresh]
    model.held_out = {"false_names": float(np.mean(np.array(near) >= model.threshold)), "recall": float(np.mean(named))}
    return model


def learn(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, paragraphs: int = SAMPLE_PARAGRAPHS) -> Classifier:
    """Train with the paragraphs of about `documents` documents (chosen by a hash of id and text) as other text."""
    share = sample_fraction(docs.count(), documents)
    sample = docs.where(hash_share(31, "doc_id", "text") < share).select(F.explode(F.split("text", "\n")).alias("p")).where("length(p) > 0").distinct()
    rows = sample.orderBy(F.xxhash64("p"), "p").limit(paragraphs).collect()
    return train([r["p"] for r in rows])


def template_weights() -> dict[str, float]:
    """Of each word of a notice, one over the number of licences (families, or other notices) that use it."""
    users: dict[str, set[str]] = {}
    for name, texts in (*TEMPLATES.items(), *((t, (t,)) for t in OTHERS)):
        for t in texts:
            for w in words_of(t):
                users.setdefault(w, set()).add(name)
    return {w: 1 / len(u) for w, u in users.items()}


def overlap(words: set[str], template: set[str], weights: dict[str, float]) -> float:
    """Weight of the common words over that of the template, or of the paragraph where that weighs less (but 0.8 at least)."""
    weigh = lambda ws: sum(weights.get(w, 1.0) for w in ws)
    return weigh(words & template) / min(weigh(template), max(weigh(words), 0.8))


def _words(p: Column) -> Column:
    return F.regexp_extract_all(F.lower(p), F.lit("[a-z0-9]+"), F.lit(0))


def scan(docs: DataFrame, model: Classifier, least_overlap: float = LEAST_OVERLAP, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, paragraph (number from 0), family, probability, overlap, confirmed: for every paragraph with a word that speaks for a licence."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    strong = F.exists(_words(F.col("p")), lambda w: w.isin(model.strong))
    spellings = "|".join(sorted(model.strong, key=lambda w: (len(w), w)))
    some = f"(?<![a-z0-9])(?:{spellings})(?![a-z0-9])"
    lines = texts.where(F.lower("text").rlike(some)).select("doc_id", F.posexplode(F.split(F.regexp_replace("text", f"(?md){WRAPPED}", "$1 "), "\n")).alias("paragraph", "p"))
    candidates = stored(lines.where(F.lower("p").rlike(some)).where(strong), "licence-paragraphs")
    distinct = candidates.select(F.md5("p").alias("key"), "p").groupBy("key").agg(F.first("p").alias("p")).withColumn("words", _words(F.col("p")))
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1, F.lit(1)), lambda i: F.concat_ws(" ", F.get("words", i - 1), F.get("words", i)))
    grams = F.array_distinct(F.when(F.size("words") > 1, F.concat("words", pairs)).otherwise(F.col("words")))
    k = len(model.classes)
    table = [(g, [float(x) for x in model.weights[i]]) for i, g in enumerate(model.vocabulary)]
    weights = spark.createDataFrame(table, "gram string, w array<double>")  # as long as the templates' wording
    sums = [F.sum(F.get("w", F.lit(c))).alias(f"z{c}") for c in range(k)]
    dots = distinct.select("key", F.explode(grams).alias("gram")).join(F.broadcast(weights), "gram").groupBy("key").agg(*sums)
    z = F.array(*(F.col(f"z{c}") + float(model.bias[c]) for c in range(k)))
    powers = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    shares = dots.select("key", powers.alias("e")).withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, b: a + b))
    best = F.array_max(F.slice("e", 1, k - 1))
    named = shares.select("key", F.get(F.array(*map(F.lit, model.classes)), (F.array_position("e", best) - 1).cast("int")).alias("named"), (best / F.col("total")).alias("probability"))
    family = F.when(F.col("probability") >= model.threshold, F.col("named")).otherwise(UNKNOWN)
    judged = distinct.select("key", "words").join(named, "key").withColumn("family", family)
    judged = judged.withColumn("family", F.when((F.col("family") != UNKNOWN) & relative(F.col("words"), F.col("family")), UNKNOWN).otherwise(F.col("family")))
    compared = judged.withColumn("found", F.when(F.col("family") != UNKNOWN, _overlaps(F.array_distinct("words"))))
    own = F.coalesce(F.array_max(F.transform(F.filter("found", lambda t: t["family"] == F.col("family")), lambda t: t["overlap"])), F.lit(0.0))
    other = F.coalesce(F.array_max(F.transform(F.filter("found", lambda t: t["family"] != F.col("family")), lambda t: t["overlap"])), F.lit(0.0))
    judged = compared.select("key", "family", "probability", own.alias("overlap"), ((F.col("family") != UNKNOWN) & (own >= least_overlap) & (own >= other - 1e-9)).alias("confirmed"))
    verdicts = stored(judged, "licence-verdicts")
    side = F.broadcast(verdicts) if verdicts.count() <= broadcast_rows else verdicts
    found = candidates.withColumn("key", F.md5("p")).join(side, "key")
    return found.select("doc_id", F.col("paragraph").cast("int").alias("paragraph"), "family", "probability", "overlap", "confirmed")


def _overlaps(words: Column) -> Column:
    """array<struct<family, overlap>> of a paragraph's distinct words with every template; other licences' have a family of their own."""
    import json

    weights = template_weights()
    rows = []
    for name, texts in (*TEMPLATES.items(), *((f"other {i}", (t,)) for i, t in enumerate(OTHERS))):
        for t in texts:
            own = sorted(set(words_of(t)))
            rows.append({"family": name, "words": own, "weights": [weights[w] for w in own], "total": sum(weights[w] for w in own)})
    templates = F.from_json(F.lit(json.dumps(rows)), "array<struct<family:string,words:array<string>,weights:array<double>,total:double>>")
    names = sorted(weights)
    known, values = F.array(*map(F.lit, names)), F.array(*(F.lit(weights[w]) for w in names))
    add = lambda a, b: a + b
    weigh = F.aggregate(F.transform(words, lambda w: F.coalesce(F.get(values, (F.array_position(known, w) - 1).cast("int")), F.lit(1.0))), F.lit(0.0), add)

    def share(t: Column) -> Column:
        common = F.aggregate(F.zip_with(t["words"], t["weights"], lambda w, x: F.when(F.array_contains(words, w), x).otherwise(0.0)), F.lit(0.0), add)
        return F.struct(t["family"].alias("family"), (common / F.least(t["total"], F.greatest(weigh, F.lit(0.8)))).alias("overlap"))

    return F.transform(templates, share)
