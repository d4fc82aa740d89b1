"""Substring dedup against the definition where rows share ids, texts and passages, and with a sketch of many blocks."""

import collections
import hashlib
import random

import pytest

from voluma.llm import common, substrings

PASSAGES = [" ".join(f"w{p}x{k}" for k in range(80)) for p in range(6)]


def given(seed, n=120):
    rng = random.Random(seed)
    rows = [(2, PASSAGES[0]), (1, PASSAGES[0]), (2, " ".join(f"own{k}" for k in range(60))), (None, PASSAGES[1]), (3, PASSAGES[1] + " tail")]
    for k in range(n):
        parts = [" ".join(f"u{seed}d{k}n{j}" for j in range(rng.randrange(70)))]
        for _ in range(rng.randrange(4)):
            words = rng.choice(PASSAGES).split()
            start = rng.randrange(40)
            parts.append(" ".join(words[start : start + rng.randrange(30, 80)]))
        rng.shuffle(parts)
        rows.append((rng.randrange(60), "  ".join(parts)))
    rows += [rows[rng.randrange(len(rows))] for _ in range(20)] + [(70 + k, PASSAGES[2] + f" end{k}") for k in range(40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_bits", [None, 9])
def test_rows_that_share_ids_and_passages(spark, block_bits):
    rows = given(3)
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, substring_id int").repartition(5)
    out = substrings.dedup_substrings(docs, block_bits=block_bits)
    assert out.columns == ["doc_id", "text", "substring_id", "substrings"]
    got = collections.Counter((common.NULL_ID if r[0] is None else r[0], r[3][0], r[3][1], hashlib.sha256(r[3][2].encode()).hexdigest()) for r in out.collect())
    want = collections.Counter((common.NULL_ID if i is None else i, *x) for i, *x in substrings.brute(rows))
    assert got == want


def test_of_two_texts_of_one_id_each_loses_its_own_words(spark):
    rows = [(1, PASSAGES[0]), (2, PASSAGES[0]), (2, PASSAGES[3])]
    out = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r[0], r[2][1]) for r in out) == [(1, 0), (2, 0), (2, 80)]


def test_sketch_loses_no_repeated_minimiser_and_few_others_stay(spark):
    rng = random.Random(4)
    texts = [[rng.randrange(1 << 62) for _ in range(50)] for _ in range(400)]
    for k in range(0, 400, 4):
        texts[k][:5] = texts[(k + 7) % 400][:5]
    count = collections.Counter(x for t in texts for x in set(t))
    heads = spark.createDataFrame([(k, k, sorted(set(t))) for k, t in enumerate(texts)], "id long, t1 long, least array<long>").repartition(3)
    for bits in (None, 10):
        found = {(r["id"], x) for r in substrings.repeated_minimisers(heads, bits).collect() for x in r["least"]}
        must = {(k, x) for k, t in enumerate(texts) for x in set(t) if count[x] > 1}
        assert must <= found and len(found) <= len(must) + 0.12 * sum(map(len, texts))
