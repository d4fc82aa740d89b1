"""The pipeline, stage by stage, against the stages' definitions."""

import collections

import pytest

import corpus_pipeline
from voluma.llm import common, lines, nearcopies, packing, quality

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = common.read(spark, DATA, "documents"), []
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages(spark, staged):
    start, good, deduped, single, mixed, packed = staged
    for df in (good, deduped, single, mixed):
        assert df.columns == start.columns
    model = quality.fit(start, common.read(spark, DATA, "labels"))
    scores = {i: float(model.scores(quality.statistics(t or "")[None])[0]) for i, t in texts(start).items()}
    assert set(texts(good)) == {i for i, s in scores.items() if s >= 0.7}
    import hashlib

    want = {r[0]: r[3] for r in lines.brute(list(texts(good).items()))}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts(deduped).items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in deduped.collect())
    fps = {i: set(nearcopies.shingles(t).tolist()) for i, t in texts(deduped).items()}
    up = {i: i for i in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in fps.items():
        for j, b in fps.items():
            if len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    assert set(texts(single)) == {i for i in fps if find(i) == i}
    assert 0 < mixed.count() < single.count() and set(texts(mixed)) <= set(texts(single))
    encode = packing.encoder()
    got = collections.Counter()
    for r in packed.collect():
        got[r["doc_id"]] += r["length"]
    assert got == {i: len(encode(t)) + 1 for i, t in texts(mixed).items()}


def test_run(spark, staged):
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, DATA).select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert got == sorted(tuple(r) for r in staged[-1].select("doc_id", "piece", "start", "length", "ids_crc32").collect())


def test_extra_columns_and_nulls(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, "x", 1), (2, "a b c", "en", "s", 5, None, None)], "doc_id long, text string, lang string, source string, n_chars long, n_lines string, near_id int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "near_id"]
    docs.collect()
