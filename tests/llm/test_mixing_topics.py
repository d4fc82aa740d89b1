"""Topics from the content, and what targets that can't be met together leave."""

import collections

import pytest

from voluma.llm import common, mixing

DATA = "/root/testdata/sf0.01"


def test_topics_are_even_and_shared_by_near_copies(spark):
    docs = common.read(spark, DATA, "documents").select("doc_id", "text", "lang", "source")
    longer = docs.selectExpr("doc_id + 1000000 AS doc_id", "concat(text, ' one more') AS text", "lang", "source")
    rows = mixing.mixture(docs.union(longer)).select("doc_id", "text", "lang", "mixture.topic").collect()
    count = collections.Counter(r["topic"] for r in rows if r["text"])
    assert set(count) == {str(k) for k in range(8)} and max(count.values()) < 0.25 * len(rows)
    for lang in ("en", "de", "fr", "es"):  # a language does not decide the topic
        own = collections.Counter(r["topic"] for r in rows if r["lang"] == lang)
        assert max(own.values()) < 0.4 * sum(own.values())
    topic = {r["doc_id"]: r["topic"] for r in rows}
    long = [r["doc_id"] for r in rows if r["text"] and len(r["text"]) > 1000 and r["doc_id"] < 1000000]
    assert sum(topic[i] == topic[i + 1000000] for i in long) > 0.85 * len(long)  # by chance: one in eight


def test_topic_by_definition(spark):
    text = "one two two three  four\tfive six"
    frame = spark.createDataFrame([(1, text, "x", "s"), (2, "two seven", "x", "s"), (3, None, "x", "s")], "doc_id long, text string, lang string, source string")
    hashes = {r["w"]: r["b"] for r in spark.createDataFrame([(w,) for w in (text + " seven").split()], "w string").selectExpr("w", f"pmod(xxhash64(w), {mixing.BUCKETS}) AS b").collect()}
    shares = []
    for t in (text, "two seven", ""):
        own = set(t.split())
        shares.append([sum(hashes[w] == b for w in own) / max(1, len(own)) for b in range(mixing.BUCKETS)])
    mean = [sum(x) / 3 for x in zip(*shares)]
    for r in mixing.mixture(frame).select("doc_id", "mixture.topic", "mixture.tokens").collect():
        rest = [a - m for a, m in zip(shares[r["doc_id"] - 1], mean)]
        along = [sum(a * s for a, s in zip(rest, row)) for row in mixing._signs(8)]
        assert along[int(r["topic"])] == pytest.approx(max(along))
        assert r["tokens"] == {1: 8, 2: 3, 3: 1}[r["doc_id"]]


def test_residual(spark):
    rows = [(k, "w " * (k % 7), "a" if k % 2 else "b", "a" if k % 2 else "b") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    table = lambda n, a: spark.createDataFrame([("a", a), ("b", 1 - a)], f"{n} string, share double")
    fit = lambda a: mixing.mixture(docs, targets={"source": table("source", 0.5), "lang": table("lang", a), "topic": table("topic", 0.5)}, topic="lang").select("mixture.residual").first()[0]
    assert fit(0.5) < 1e-3
    assert fit(0.7) > 0.05  # source and language are the same column
