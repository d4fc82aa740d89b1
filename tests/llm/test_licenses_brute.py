"""The license scan against alignments from every start, without refusals, on mutations of every template."""

import random

import pytest

from voluma.llm import licenses


def every_start(scanner, text):
    words, out = licenses.words_of(text), []
    for template in scanner.templates:
        done = -1
        for first in range(len(words)):
            if first > done and (x := scanner.found(words, first, template)):
                done = x[3]
                out.append(x)
    return out


def mutated(words, share, rng):
    out = []
    for w in words:
        draw = rng.random()
        if draw < share / 2:
            continue
        out.append("zz%d" % rng.randrange(99) if draw < share else w)
        if rng.random() < share / 2:
            out.append(rng.choice(["the", "of", "software", "license", "inserted"]))
    return out


@pytest.mark.parametrize("k", range(len(licenses.TEMPLATES)))
def test_same_as_every_start(k):
    rng = random.Random(k)
    name, must, text = licenses.TEMPLATES[k]
    scanner = licenses.Scanner([(name, must, text)])
    found = 0
    for share in (0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3):
        for _ in range(2):
            parts = [[rng.choice(["some", "other", "license", "the", "of", "words"]) for _ in range(rng.randrange(12))]]
            for _ in range(rng.randrange(1, 3)):
                parts += [mutated(text.split(), share, rng), ["between"] * rng.randrange(4)]
            given = " ".join(w for p in parts for w in p)
            got = list(scanner.stretches(given))
            assert got == every_start(scanner, given)
            found += len(got)
    assert found >= 2


def test_whole_texts():
    scanner, rng = licenses.Scanner(), random.Random(1)
    for name, _, text in licenses.whole_texts():
        given = " ".join(["before"] * 5 + mutated(text.split(), 0.02, rng) + ["behind"] * 5)
        best = max(scanner.scan(given), key=lambda x: x[4])
        assert best[0] == name and best[5] > 0.9


def test_versions_are_told_apart():
    names = lambda t: {x[0] for x in licenses.Scanner().scan(t)}
    assert names("This work is licensed under the GNU General Public License, version 2.") == {"GPL-2.0"}
    assert names("This work is licensed under the GNU General Public License, version 3.") == {"GPL-3.0"}
    assert names("Licensed under CC BY-NC 4.0.") == {"CC-BY-NC-4.0"}
    assert names("Licensed under the Apache License, Version 1.1.") == set()


def test_thousands_of_notices_in_one_text(spark):
    text = "Released under the MIT License. Licensed under the Apache License, Version 2.0. " * 3000
    frame = spark.createDataFrame([(1, text, "x"), (None, "Licensed under the MIT License.", None), (2, None, "y"), (2, "", "z")], "doc_id long, text string, license string")
    rows = licenses.scan_licenses(frame).collect()
    assert sorted((r["doc_id"] or 0, r["license"]) for r in rows) == [(0, "MIT")] + [(1, "Apache-2.0")] * 3000 + [(1, "MIT")] * 3000
