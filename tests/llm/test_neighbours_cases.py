"""Defined cases of the neighbour search, and that clustered vectors open little of the index."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from voluma.llm import neighbours


def lists(rows):
    out = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_fewer_candidates_than_asked_and_extra_columns(spark, tmp_path):
    rows = [(0, [1.0, 0.0], 1, "a", 5), (1, [0.5, 0.5], 1, "b", 6), (2, [0.5, 0.5], 2, None, 7), (None, [9.0, 9.0], 2, "c", 8), (20, [0.0, 0.0], 2, "d", 9), (40, [1.0, 2.0, 3.0], 2, "e", 9)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, block string, rank int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = neighbours.op3_neighbours(spark, str(tmp_path))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert lists(got.collect()) == {0: [(1, 1, 0.5), (2, 2, 0.5)]}


def test_query_rows_that_share_an_id(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, (-x[0]).tolist()), (0, x[0].tolist())]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    got = neighbours.search(frame, frame.where("id = 0"), k=5).collect()
    assert len(got) == 10  # two vectors of the id, the repeated one once
    want = []
    for v in (x[0], -x[0]):
        score = x[1:] @ v
        want += [(int(i) + 1, pytest.approx(score[i])) for i in np.argsort(-score)[:5]]
    assert sorted((r["vec_id"], r["score"]) for r in got) == sorted(want, key=lambda w: (w[0], w[1].expected))


def test_clusters_open_little(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(0, 40, 6000)] + 0.05 * rng.normal(size=(6000, 32))
    goals = []
    monkeypatch.setattr(neighbours, "probe_cells", lambda index, probes, k, f=neighbours.probe_cells: goals.append((index, f(index, probes, k))) or goals[-1][1])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)
    got = lists(neighbours.search(frame, frame.where(F.col("id") % 60 == 0)).collect())
    index, cells = goals[0]
    counts = {(r["c1"], r["c2"]): r["count"] for r in index.groupBy("c1", "c2").count().collect()}
    assert all(sum(counts[c] for c in set(found)) < 0.1 * 6000 for found in cells.values())
    hits = 0
    for q in range(0, 6000, 60):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len({v for _, v, _ in got[q]} & set(np.argsort(-score)[:20].tolist()))
    assert hits >= 0.9 * 100 * 20
