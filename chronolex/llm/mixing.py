"""Mixing to target weights with soft membership.

A classifier learned from a labelled table predicts each document's posterior over
domains. A document of n words with posterior p adds n * p to the domains' expected
totals. Nonnegative document rates r minimise the squared distance between the
expected totals, sum of r * n * p, and the targets, by projected gradient steps: the
gradient of a rate, over the document's size, is p . (total - target). A step divides it
by the domains' second moments over the documents with positive rate (so a step without
projection ends at the targets), then projects onto r >= 0; plain gradient steps of three
lengths are tried in the same pass, and the best is taken. The shortest of them, over the
largest moment, comes nearer unless the rates are optimal. A step needs one distributed sum, of as many numbers as there are pairs of domains; each document's rate follows from the few step
vectors, so rates are never shuffled or collected. Each text is classified once.

Targets are shares; their total is that at which the domain with the greatest target
keeps its tokens, unless a total is given: scarcer domains are repeated (rates above 1),
more plentiful ones thinned. Where no rates meet the targets, or the rounds do not
suffice, the nearest rates found are used, and a warning names the gap.

A rate becomes a whole number of copies: its floor, and one more if a hash of id and text
falls below the fraction. Rates are used as fitted: rounding those near a whole number
would move the totals off their targets.

Cases: null and empty texts have no words and no effect on totals; their rate follows
their posterior. Without labels every rate is 1. A domain with target but no labelled
document is left out with a warning; if none is left, an error is raised. Repeated rows count each; an empty table gives no rows. Columns of the
table stay as they are; a result whose name is taken gets an underscore behind its name.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_of, free_names, hash_share, quoted, stored
from .linear import Model, learn

#: Fixed targets of the queries: labels give three domains.
TARGETS = {"clean": 0.94, "junk": 0.03, "toxic": 0.03}


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, label): toxic, junk (low quality), or clean."""
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", kind.alias("label"))


@dataclass
class Fit:
    """Step vectors of the projected gradient, and the domains' totals and targets they lead to."""

    steps: list[np.ndarray]
    totals: np.ndarray
    goal: np.ndarray

    @property
    def gap(self) -> float:
        """The largest miss of a domain, as a share of the whole target."""
        return float(np.abs(self.totals - self.goal).max() / max(self.goal.sum(), 1e-300))


def rate_of(posterior: list[Column], steps: list[np.ndarray]) -> Column:
    """A document's rate from its posterior: 1, then every step."""
    rate = F.lit(1.0)
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate - sum(p * float(x) for p, x in zip(posterior, step, strict=True)))
    return rate


def solve(soft: DataFrame, classes: list[str], targets: dict[str, float], total: float | None = None, tolerance: float = 1e-6, rounds: int = 40) -> Fit:
    """Rates that bring the totals of `soft` (n, p0, p1, ...; a stored table) as near to the targets as nonnegative ones can."""
    missing = [d for d, w in targets.items() if w > 0 and d not in classes]
    if missing:
        raise ValueError(f"no labelled document of {missing}")
    k = len(classes)
    p = [F.col(f"p{c}") for c in range(k)]

    def sums(steps: list[np.ndarray], choices: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each choice of a further step: (totals, second moments over documents of positive rate). One pass."""
        frame = soft.withColumn("before", rate_of(p, steps))
        rates = [F.greatest(F.lit(0.0), F.col("before") - sum(x * float(v) for x, v in zip(p, step, strict=True))) for step in choices]
        frame = frame.select("n", *p, *(r.alias(f"r{i}") for i, r in enumerate(rates)))
        each = []
        for i in range(len(choices)):
            rate, active = F.col(f"r{i}"), F.when(F.col(f"r{i}") > 0, F.col("n")).otherwise(0)
            each += [F.sum(rate * F.col("n") * x) for x in p] + [F.sum(active * p[a] * p[b]) for a in range(k) for b in range(k)]
        row = [float(x or 0) for x in frame.agg(*(s.alias(f"s{i}") for i, s in enumerate(each))).first()]
        width = k + k * k
        return [(np.array(row[a : a + k]), np.array(row[a + k : a + width]).reshape(k, k)) for a in range(0, len(row), width)]

    ((have, moments),) = sums([], [np.zeros(k)])
    weights = np.array([targets.get(d, 0.0) for d in classes])
    weights = weights / weights.sum()
    if have.sum() == 0:
        return Fit([], have, have)
    goal = weights * (total if total is not None else have[weights.argmax()] / weights.max())
    largest = np.linalg.eigvalsh(moments).max()
    steps: list[np.ndarray] = []
    for _ in range(rounds):
        gap = have - goal
        if np.abs(gap).max() <= tolerance * goal.sum():
            break
        plain = gap / np.linalg.eigvalsh(moments).max() if moments.any() else gap / largest
        choices = [np.linalg.lstsq(moments + 1e-9 * np.trace(moments) * np.eye(k), gap, rcond=None)[0], 16 * plain, 4 * plain, gap / largest]
        new, new_moments, step = min(((*found, choice) for found, choice in zip(sums(steps, choices), choices, strict=True)), key=lambda x: np.sum((x[0] - goal) ** 2))
        if np.sum((new - goal) ** 2) > (1 - 1e-4) * gap @ gap:
            break
        have, moments = new, new_moments
        steps.append(step)
    return Fit(steps, have, goal)


def memberships(docs: DataFrame, model: Model | None, names: list[str], keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of `docs`, then under `names` the number of words and the posterior of each class."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 2**18 rows at most

    def classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            if shared.value is None:
                extra = [pa.array([len((t or "").split()) for t in texts.to_pylist()], pa.int64())]
            else:
                p, words = shared.value.of_arrow(texts)
                extra = [pa.array(words, pa.int64()), *(pa.array(p[:, c]) for c in range(p.shape[1]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *extra], [*batch.schema.names[1:], *names])

    kept = docs.select(*map(quoted, keep))
    kinds = [T.LongType(), *(T.DoubleType() for _ in names[1:])]
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, t) for n, t in zip(names, kinds, strict=True))])
    (read,) = free_names(keep, "read")
    return docs.select(F.col(quoted(text)).cast("string").alias(read), *map(quoted, keep)).mapInArrow(classified, schema)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None, seed: int = 5, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all, if None), then n_tokens (words), a posterior p_<domain> for each domain, rate and copies."""
    keep = docs.columns if keep is None else keep
    model = learn(docs, labelled)
    classes = list(model.classes) if model else []
    *names, rate, copies, chance = free_names(docs.columns, "n_tokens", *(f"p_{d}" for d in classes), "rate", "copies", "chance")
    soft = stored(memberships(docs.withColumn(chance, hash_share(seed, "doc_id", "text")), model, names, [*keep, chance]), "memberships")
    p = [F.col(quoted(n)) for n in names[1:]]
    steps: list[np.ndarray] = []
    if model:
        known = {d: w for d, w in targets.items() if d in classes and w > 0}
        if len(known) < sum(w > 0 for w in targets.values()) and known:
            warnings.warn(f"no labelled document of {sorted(set(targets) - set(known))}: these targets are left out", stacklevel=2)
            targets = known
        fit = solve(soft.select(F.col(quoted(names[0])).alias("n"), *(c.alias(f"p{i}") for i, c in enumerate(p))), classes, targets, total)
        steps = fit.steps
        if fit.gap > 0.001:
            warnings.warn(f"mixing misses its targets by {fit.gap:.2%} of the whole: {dict(zip(classes, fit.totals - fit.goal, strict=True))}", stacklevel=2)
    out = soft.withColumn(rate, rate_of(p, steps))
    whole = F.floor(rate)
    number = (whole + (F.col(chance) < F.col(rate) - whole).cast("int")).cast("int")
    return out.select(*map(quoted, keep), *map(quoted, names), rate, number.alias(copies))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **options) -> DataFrame:
    """The rows of `docs`, each as often as its copies say."""
    rows = mix(docs, labelled, targets, **options)
    copies = F.col(quoted(rows.columns[-1]))
    (each,) = free_names(rows.columns, "each")
    repeated = rows.where(copies > 0).withColumn(each, F.explode(F.array_repeat(F.lit(1), copies)))
    return repeated.select(columns_of(docs))
