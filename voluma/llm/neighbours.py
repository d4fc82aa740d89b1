"""Approximate nearest neighbours by an inverted multi-index.

Each half of the vectors gets one more coordinate that brings it to the largest norm of the halves, zero for
queries, so that the nearest by distance has the largest inner product whatever the norms. It is quantised by its own
centroids, fitted on a bounded sample (``SAMPLE`` vectors by hash of their id, a parameter); every vector is indexed under its pair of centroids. A query walks the
pairs by rising summed distance with a heap until the cells it has opened hold ``goal`` vectors, then the
vectors of those cells are ranked by the exact inner product in double precision.

The goal is measured, not set: ``PROBES`` queries (by hash of their id) are searched by brute force in one scan of the
index, and the goal is the least at which their walks open the asked share ``recall`` of their true neighbours.
Directions without structure in 64 dimensions need 0.4 of 50,000 vectors for a recall of 0.93, and a falling share of
more; clustered vectors need far less.

Scale: cells are grouped by their first centroid and dealt into parts of about ``PART`` vectors, known from cell counts
(centroids squared numbers, which is also all that is broadcast). Queries are dealt into blocks of about ``PART / 4``
that are near each other (by their nearest first centroid), and a part is copied only to the blocks with a query that
opens it. Each part meets a block in a task-bounded cogroup that returns at most ``k`` rows a query; a window with
group limit merges them. A vector repeated any number of times only makes more parts.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components,
and rows without an id, take no part, neither as queries nor as candidates; rows that share a ``vec_id`` are each
candidates, of which a query leaves out its own id; query rows that share an id have a list each, unless their vectors
are equal too; with fewer than k candidates all are returned; extra columns are left out; an empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voluma.llm.common import cut, map_rows, read, small_batches

SAMPLE = 20_000
PART = 4096
#: Queries searched by brute force to find how many vectors a walk must open.
PROBES = 64


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v) of the vectors that take part, as doubles."""
    v = F.col(f"`{vector_column}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").where(finite & nonzero)


def centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Lloyd's means of the rows of ``x``; empty ones stay where they were."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        for j in range(len(c)):
            if (mine := near == j).any():
                c[j] = x[mine].mean(axis=0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c**2).sum(axis=1) - 2 * x @ c.T, axis=1)


def completed(x: np.ndarray, top: float) -> np.ndarray:
    """``x`` with a last coordinate that makes every row's squared norm ``top``."""
    return np.column_stack([x, np.sqrt(np.maximum(0.0, top - (x**2).sum(axis=1)))])


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, goal: float) -> Iterator[tuple[int, int]]:
    """Pairs of centroids by rising summed distance until the cells hold ``goal`` vectors; counts: by pair."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    da, db = first[a].tolist(), second[b].tolist()
    a, b = a.tolist(), b.tolist()
    heap, found = [(da[0] + db[0], 0, 0)], 0
    while heap and found < goal:
        _, i, j = heapq.heappop(heap)
        if n := counts[a[i]][b[j]]:
            found += n
            yield a[i], b[j]
        if j + 1 < len(b):
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))


def probe_cells(index: DataFrame, probes: list, k: int) -> dict[int, list[tuple[int, int]]]:
    """The cells of the true ``k`` best of ``index`` (id, v, c1, c2) for each of ``probes``, by a scan."""
    ids, x = np.array([p["id"] for p in probes]), np.array([p["v"] for p in probes])

    def best(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.zeros((len(ids), 0))] + [np.zeros((len(ids), 0), dtype=np.int32)] * 2
        for frame in batches:
            if len(frame):
                score = x @ np.stack(frame["v"].to_list()).T
                score[ids[:, None] == frame["id"].to_numpy()] = -np.inf
                cells = [np.broadcast_to(frame[c].to_numpy(), score.shape) for c in ("c1", "c2")]
                held = [np.concatenate(pair, axis=1) for pair in zip(held, [score, *cells], strict=True)]
                top = np.argsort(-held[0], axis=1, kind="stable")[:, :k]
                held = [np.take_along_axis(h, top, axis=1) for h in held]
        n = held[0].shape[1]
        yield pd.DataFrame({"q": np.repeat(np.arange(len(ids), dtype=np.int32), n), "score": held[0].ravel(), "c1": held[1].ravel(), "c2": held[2].ravel()})

    found = index.mapInPandas(best, "q int, score double, c1 int, c2 int").where(F.col("score") > float("-inf"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "c1", "c2")
    out: dict[int, list[tuple[int, int]]] = {}
    for r in found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).collect():  # PROBES * k rows
        out.setdefault(r["q"], []).append((r["c1"], r["c2"]))
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.93, sample: int = SAMPLE, least: int = 200) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (id, v) its ``k`` best of ``vectors`` (id, v) with another id.

    A walk opens at least ``least`` vectors, and as many as a share of ``recall`` of the true neighbours takes.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    lengths = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if not lengths:
        return spark.createDataFrame([], schema)
    width, total = lengths["n"], lengths["count"]
    vectors, queries = (x.where(F.size("v") == width) for x in (vectors, queries))
    queries = queries.withColumn("key", F.xxhash64("id", "v")).dropDuplicates(["id", "key"])
    chosen = np.array([r["v"] for r in vectors.orderBy(F.xxhash64("id"), "id").limit(sample).collect()])
    half, pairs = max(1, width // 2), int(min(256, max(4, 2 ** round(np.log2(max(1, total) / 12) / 2))))
    halves = lambda x: (x[:, :half], x[:, half:] if width > 1 else np.zeros((len(x), 1)))
    square = lambda start, n: F.max(F.aggregate(F.slice("v", start, n), F.lit(0.0), lambda s, x: s + x * x))
    tops = list(vectors.agg(square(1, half).alias("one"), square(half + 1, width - half).alias("two")).first())
    books = [centroids(completed(y, top), pairs) for y, top in zip(halves(chosen), tops, strict=True)]
    sizes = [len(b) for b in books]

    def quantise(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            x = np.stack(frame["v"].to_list()) if len(frame) else np.zeros((0, width))
            one, two = (completed(y, top) for y, top in zip(halves(x), tops, strict=True))
            yield pd.DataFrame({"id": frame["id"], "v": frame["v"], "c1": nearest(one, books[0]).astype(np.int32), "c2": nearest(two, books[1]).astype(np.int32)})

    def distances(v: np.ndarray) -> list[np.ndarray]:
        return [(b**2).sum(axis=1) - 2 * y[0] @ b[:, :-1].T for b, y in zip(books, halves(np.asarray(v)[None]), strict=True)]

    index = cut(vectors.mapInPandas(quantise, "id long, v array<double>, c1 int, c2 int"))
    counts = np.zeros(sizes, dtype=np.int64)
    for r in index.groupBy("c1", "c2").count().collect():  # at most 256 x 256 rows
        counts[r["c1"], r["c2"]] = r["count"]
    parts = [int(max(1, -(-n // PART))) for n in counts.sum(axis=1)]
    table = counts.tolist()

    probes, opened_at = queries.orderBy(F.xxhash64("id"), "id", "key").limit(PROBES).collect(), [0]
    for q, cells in probe_cells(index, probes, k).items():
        sums = np.add.outer(*distances(probes[q]["v"])).ravel()
        order = np.argsort(sums, kind="stable")
        position = np.empty(len(sums))
        position[order] = np.cumsum(counts.ravel()[order])
        opened_at += [position[a * sizes[1] + b] for a, b in cells]
    goal = max(least, float(np.quantile(opened_at, recall, method="higher")))

    def near(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield frame.assign(near=[int(distances(v)[0].argmin()) for v in frame["v"]])

    dealt = queries.mapInPandas(near, "id long, v array<double>, key long, near int")
    load = np.zeros(sizes[0], dtype=np.int64)
    for r in dealt.groupBy("near").count().collect():  # at most 256 rows
        load[r["near"]] = r["count"]
    axis = np.linalg.svd(books[0] - books[0].mean(axis=0), full_matrices=False)[2][0]
    line = np.argsort(books[0] @ axis)
    ends = np.cumsum(load[line])
    first, last = np.zeros(sizes[0], dtype=np.int64), np.zeros(sizes[0], dtype=np.int64)
    first[line], last[line] = (ends - load[line]) * 4 // PART, np.maximum(ends - 1, 0) * 4 // PART
    span = np.maximum(last - first, 0) + 1

    def walked(rows: Iterable[dict]) -> Iterator[tuple]:
        for r in rows:
            opened: dict[int, np.ndarray] = {}
            for a, b in walk(*distances(r["v"]), table, goal):
                if a not in opened:
                    opened[a] = np.zeros(sizes[1], dtype=bool)
                opened[a][b] = True
            block = first[r["near"]] + r["key"] % span[r["near"]]
            yield r["id"], r["v"], r["key"], int(block), [(a, np.packbits(s).tobytes()) for a, s in opened.items()]

    dealt = dealt.repartition(max(1, -(-int(load.sum()) // 512)), "key")  # by number: small rows with much work are not to be coalesced
    asked = cut(map_rows(dealt, "id long, v array<double>, key long, block long, opened array<struct<c1:int,seconds:binary>>", walked, out_rows=512))
    every = F.expr("explode(sequence(0, parts - 1))").alias("part")
    to = asked.select(F.col("block").alias("asked_by"), F.explode("opened.c1").alias("c1")).distinct().withColumn("parts", F.get(F.lit(parts), F.col("c1")))
    to = to.select("c1", every, F.col("asked_by").alias("block"))
    asked = asked.select("id", "v", "key", "block", F.inline("opened")).withColumn("parts", F.get(F.lit(parts), F.col("c1"))).select("id", "v", "key", "block", "c1", "seconds", every)
    part = (F.expr("pmod(xxhash64(id, v), 1000000)") % F.get(F.lit(parts), F.col("c1"))).cast("int")  # keys of one type on both sides: equal numbers of other types hash apart
    spread = index.withColumn("part", part).join(to, ["c1", "part"])

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros((0, 3), dtype=np.int64)], [np.zeros(0)]
        if len(left) and len(right):
            x, ids, second = np.stack(right["v"].to_list()), right["id"].to_numpy(), right["c2"].to_numpy()
            for start in range(0, len(left), 128):
                some = left.iloc[start : start + 128]
                own, key, v = some["id"].to_numpy(), some["key"].to_numpy(), np.stack(some["v"].to_list())
                opened = np.stack([np.unpackbits(np.frombuffer(s, dtype=np.uint8), count=sizes[1]) for s in some["seconds"]]).astype(bool)
                rough = np.where(opened[:, second] & (ids != own[:, None]), v @ x.T, -np.inf)
                if len(ids) > k:  # all that may be among the best by the exact scores
                    last = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k, None]
                    rough[rough < last - 1e-9 * (1 + np.abs(rough).max(axis=1, initial=0, where=rough > -np.inf)[:, None])] = -np.inf
                row, at = np.nonzero(rough > -np.inf)
                score = (x[at] * v[row]).sum(axis=1)
                order = np.lexsort((ids[at], -score, row))
                row, at, score = row[order], at[order], score[order]
                best = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, at = row[best], at[best]
                found[0].append(np.stack([own[row], key[row], ids[at]], axis=1))
                found[1].append(score[best])
        numbers = np.concatenate(found[0])
        return pd.DataFrame({"query_id": numbers[:, 0], "key": numbers[:, 1], "vec_id": numbers[:, 2], "score": np.concatenate(found[1])})

    keys = ["c1", "part", "block"]
    met = asked.groupBy(*keys).cogroup(spread.select("id", "v", "c2", *keys).groupBy(*keys)).applyInPandas(rank, "query_id long, key long, vec_id long, score double")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(vectors, vectors.where(F.col("id") % 20 == 0))
