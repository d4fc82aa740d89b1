"""The pipeline's SimHash near-dedup stage against the five-word Jaccard similarity of every pair."""

import random

import numpy as np

import corpus_pipeline
from voluma.llm import common, nearcopies

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string"


def brute(rows, least_similarity=0.8):
    sets = [set(nearcopies.shingles(t or "").tolist()) for _, t in rows]
    least = -(1 << 63)
    up = {(i if i is not None else least): (i if i is not None else least) for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if len(sets[a] & sets[b]) >= least_similarity * len(sets[a] | sets[b]):
                x, y = find(least if i is None else i), find(least if j is None else j)
                up[max(x, y)] = min(x, y)
    return sorted(i for i in up if find(i) == i)


def kept(df):
    return sorted(-(1 << 63) if r["doc_id"] is None else r["doc_id"] for r in corpus_pipeline.near_copies(df.sparkSession, df, DATA).collect())


def test_near_copies_on_data(spark):
    docs = common.read(spark, DATA, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert kept(docs) == brute(rows)


def test_near_copies_in_large_groups(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "CELL", 8)
    rng = random.Random(4)
    rows = [(None, "a b"), (1, "a b"), (2, None), (3, ""), (4, "x y z"), (5, "x y w")]
    for group in range(3):
        base = [str(rng.randrange(10**6)) for _ in range(300)]
        for k in range(40):
            mine = list(base)
            for _ in range(rng.randrange(9)):
                mine[rng.randrange(300)] = str(rng.randrange(10**6))
            rows.append((10 + 100 * group + k, " ".join(mine)))
    rows.append((12, "x y z"))  # an id given twice joins what its rows are like
    got, want = kept(spark.createDataFrame(rows, COLUMNS).repartition(3)), brute(rows)
    # nothing but near copies goes; of pairs at the least similarity a few share no anchor or are not the nearest
    assert set(want) <= set(got) and len(got) <= len(want) + 0.02 * len(rows)
    sure = brute(rows, 0.9)
    assert len(got) <= len(sure)


def test_sure_copies_all_go(spark):
    rng = random.Random(6)
    rows = []
    for group in range(60):
        base = [str(rng.randrange(10**6)) for _ in range(300)]
        rows.append((10 * group, " ".join(base)))
        for k in range(1, 4):
            mine = list(base)
            for _ in range(k):
                mine[rng.randrange(300)] = "changed"
            rows.append((10 * group + k, " ".join(mine)))
    assert kept(spark.createDataFrame(rows, COLUMNS).repartition(3)) == [10 * g for g in range(60)]


def test_wide_fingerprint_is_the_majority():
    found = nearcopies.shingles(" ".join(map(str, range(700))))
    x = (found[:, None] ^ nearcopies._XOR) * nearcopies._TIMES[0]
    x = (x ^ (x >> np.uint64(32))) * nearcopies._TIMES[1]
    x ^= x >> np.uint64(32)
    for k, word in enumerate(nearcopies.wide(found).tolist()):
        ones = [sum(v >> b & 1 for v in x[:, k].tolist()) for b in range(64)]
        assert word == sum(1 << b for b in range(64) if 2 * ones[b] > len(found))


def test_forest_spans_what_near_pairs_span():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (4, nearcopies.WORDS), dtype=np.uint64)
    words = np.repeat(base, 25, axis=0)
    for row in words:
        for bit in rng.integers(0, 64 * nearcopies.WORDS, rng.integers(0, 45)):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    links = nearcopies.forest(words)
    assert len(links) == 96 and len({b for _, b, _ in links}) == 96
    for a, b, bits in links:
        assert bits == np.bitwise_count(words[a] ^ words[b]).sum() <= nearcopies.MAY and a // 25 == b // 25
