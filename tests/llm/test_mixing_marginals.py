"""The expected sample's marginals, also where cells are taken whole."""

import collections
import random

import pytest

from voluma.llm import mixing


def marginals(rows):
    """For each dimension the categories' tokens and expected tokens of the sample."""
    out = [collections.defaultdict(lambda: [0, 0.0]) for _ in range(3)]
    for r in rows:
        for d, name in enumerate(mixing.DIMENSIONS):
            out[d][r[name]][0] += r["tokens"]
            out[d][r[name]][1] += r["tokens"] * r["probability"]
    return out


def reachable(there, whole):
    """Tempered targets of ``whole`` tokens, none over what is there."""
    asked, full = {k: n**0.7 for k, n in there.items()}, set()
    while True:
        left = whole - sum(there[k] for k in full)
        raised = sum(v for k, v in asked.items() if k not in full)
        want = {k: there[k] if k in full else left * v / raised for k, v in asked.items()}
        more = {k for k in want if want[k] > there[k]}
        if not more:
            return want
        full |= more


def hold(rows):
    whole = 0.6 * sum(r["tokens"] for r in rows)
    for by in marginals(rows):
        want = reachable({k: n for k, (n, _) in by.items()}, whole)
        for k, (_, got) in by.items():
            assert got == pytest.approx(want[k], rel=3e-3)


def mixed(docs):
    return mixing.mixture(docs).select("mixture.*").collect()


def test_marginals_with_a_large_and_a_tiny_source(spark):
    rng = random.Random(5)
    rows = []
    for i in range(4000):
        source = "tiny" if i % 500 == 0 else "large" if i % 20 < 7 else f"s{rng.randrange(5)}"
        lang = rng.choices(["en", "de", "fr", "es"], [70, 20, 7, 3])[0]
        rows.append((i, " ".join(str(rng.randrange(10**6)) for _ in range(rng.randrange(1, 12))), lang, source))
    rows = mixed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    hold(rows)
    assert all(r["probability"] > 0.99 for r in rows if r["source"] == "tiny")
