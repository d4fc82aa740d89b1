"""Recall of the index on vectors of unequal norms and unequal cells, without the floor that opens small tables whole."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from voluma.llm import neighbours


def recall(spark, x):
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)
    got = collections.defaultdict(set)
    for r in neighbours.search(frame, frame.where(F.col("id") % 50 == 0), least=0).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, len(x), 50):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-score)[:20].tolist()))
    return hits / (20 * len(range(0, len(x), 50)))


@pytest.mark.parametrize("sigma", [0.0, 0.3, 0.7])
def test_recall_by_norms(spark, sigma):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 64))
    x *= np.exp(sigma * rng.normal(size=3000))[:, None] / np.linalg.norm(x, axis=1)[:, None]
    assert recall(spark, x) >= 0.9


def test_recall_with_unequal_cells(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64))
    x[:1500] = x[0] + 0.2 * x[:1500]  # half of all in one cluster
    assert recall(spark, x) >= 0.9
