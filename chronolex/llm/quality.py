"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL.

Learning uses a bounded sample of labelled documents (`SAMPLE_AT_MOST` of linear.py)
with their whole texts; every text is scored as a sparse dot product.

Cases: null and empty texts have no features and get the score of the bias. Without
any label, or with labels of one kind, the score is that kind's share (0.5 if none).
Repeated rows are scored alike; further columns are ignored; an empty table gives no
rows. A document labelled twice in different ways is learned both ways.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder
from .linear import Model, learn


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """From labels (doc_id, quality); never from lang, source or the id."""
    return learn(docs, labels.select("doc_id", F.col("quality").cast("int").alias("label")), fold=False)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and the probability of label 1 for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**18 rows at most
    one = model.classes.index(1) if model and 1 in model.classes else None

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value is None:
                value = pa.array([0.5] * batch.num_rows, pa.float64())
            elif one is None:
                value = pa.array([0.0] * batch.num_rows, pa.float64())
            else:
                value = pa.array(shared.value.of_arrow(batch.column(1))[0][:, one], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), value], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scored, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """Learn from labels outside the held-out fold, score every document."""
    model = fit(docs, labels.where(id_remainder("doc_id", folds) != 0))
    s = score(docs, model)
    return s.select("doc_id", (id_remainder("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
