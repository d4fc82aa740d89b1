"""The training-data operators against brute force, and their defined edge cases, on small tables."""

import binascii
import collections
import hashlib
import math
import random
import uuid

import numpy as np
import pytest

from voluma.llm import common, components, licenses, lines, mixing, neighbours, packing, quality, registry, simhash, substrings, syncmers, warc

DATA = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, id long, kept string, n_lines int, fp string, mixture double, score int, block string"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))


PASSAGE = words(70, 1)
ROWS = [
    (None, "null id\n" + words(30, 2)),
    (0, None),
    (1, ""),
    (2, "x"),
    (3, words(3, 3)),
    (4, words(200, 4) + " " + PASSAGE),
    (5, PASSAGE + "\n" + words(90, 5)),
    (6, words(200, 4) + " " + PASSAGE),
    (6, words(200, 4) + " " + PASSAGE),
    (7, "Shared line number one.\n  SHARED line number one. \nother\r\n" + words(10, 6)),
    (8, "shared LINE number one.\n" + words(60, 7)),
    (9, "\tShared line number one.\n" + words(60, 8) + " é ü 漢字"),
    (10, words(20000, 9)),
    (11, "  \n\n \t"),
    (12, words(60, 8) + " " + PASSAGE + " " + PASSAGE),
    (13, " ".join(words(300, 10).split()[:-1] + ["changed"])),
    (14, words(300, 10)),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, None if i == 3 else f"s{(i or 0) % 2}", len(t or ""), 1, "k", 2, "f", 0.5, 3, "b") for i, t in rows], DOCUMENTS)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    table(spark).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(99, 1, 0), (4, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    page = "<html>" + "p" * 200
    spark.createDataFrame([(None, None, "null id"), (1, "u1", page), (2, "u2", page), (3, None, None), (4, "a\r\nb", "x" * 99), (5, "u", "x" * 99), (6, "u", "é" * 60), (7, "u", "é" * 60), (7, "u", page)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    table(spark, []).write.parquet(f"{path}/documents.parquet")
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("pages", "page_id long, url string, html string"), ("embeddings", "vec_id long, embedding array<float>, label int")):
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).collect() == []


def test_lines(spark, folder):
    got = sorted(map(tuple, lines.op10_line_dedup(spark, folder).collect()), key=repr)
    want = lines.brute(ROWS)
    assert got == sorted(want, key=repr)
    dropped = {r[0]: r[2] for r in want}
    assert dropped[7] == 2 and dropped[8] == 1 and dropped[9] == 0
    kept = lines.dedup_lines(table(spark))
    assert kept.columns == [*DOCUMENTS.replace(",", "").split()[::2], "kept_text", "n_lines_", "n_dropped"]


def test_lines_on_data(spark):
    docs = [tuple(r) for r in common.read(spark, DATA, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, lines.op10_line_dedup(spark, DATA).collect())) == sorted(lines.brute(docs))


def near_brute(rows, shingle=4, most=4):
    nodes = [(common.NULL_ID if i is None else i, simhash.fingerprint(t or "", shingle)) for i, t in rows]
    up = {i: i for i, _ in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in nodes:
        for j, b in nodes:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= most:
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, format(f & (2**64 - 1), "016x"), find(i)) for i, f in nodes)


def test_simhash(spark, folder):
    real = lambda x: None if x == common.NULL_ID else x
    for path, rows in ((folder, ROWS), (DATA, [tuple(r) for r in common.read(spark, DATA, "documents").select("doc_id", "text").collect()])):
        got = sorted(map(tuple, simhash.op4_simhash(spark, path).collect()), key=repr)
        assert got == sorted(((real(i), f, real(c)) for i, f, c in near_brute(rows)), key=repr)


def test_simhash_fingerprint():
    import xxhash

    text = "The  quick\tBrown fox JUMPS over É the"
    w = ["the", "quick", "brown", "fox", "jumps", "over", "É", "the"]
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(5)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) & (2**64 - 1) == want
    assert simhash.fingerprint("") == 0 == simhash.fingerprint(" \n")
    assert simhash.fingerprint("one two") == np.uint64(xxhash.xxh64_intdigest(b"one two", 42)).astype(np.int64)


def test_anchors_cover_every_pair():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = int(rng.integers(0, 2**63))
        b = a
        for bit in rng.choice(64, size=4, replace=False):
            b ^= 1 << int(bit)
        both = np.array([a, b], dtype=np.uint64).view(np.int64)
        key, row = simhash.anchors(both)
        assert set(key[row == 0]) & set(key[row == 1])


def test_near_links_in_large_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 16)
    rng = np.random.default_rng(6)
    fps = set()
    for base in rng.integers(0, 2**63, size=5):
        for _ in range(120):
            x = int(base)
            for bit in rng.choice(12, size=int(rng.integers(0, 5)), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(3)
    links = simhash.near_links(frame, 4)
    edges = [tuple(r) for r in links.collect()]
    assert len(edges) < 31 * 6 * len(fps)  # a link for each anchor and part at most
    roots = {r["u"]: r["v"] for r in components.stars(spark.createDataFrame(edges, "u long, v long")).collect()}
    got = {f: roots.get(f, f) for f in fps}
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(fps):
        for b in fps[:k]:
            if bin(a ^ b).count("1") <= 4:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert got == {f: find(f) for f in fps}


def test_drop_near_copies(spark):
    kept = simhash.drop_near_copies(table(spark))
    assert kept.columns == table(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {None, 2, 3, 4, 10}.issubset(ids) and 6 not in ids and 14 not in ids
    assert len({0, 1, 11} & set(ids)) == 1


def test_components_of_a_long_chain(spark):
    chain = [(k, k + 1) for k in range(60)] + [(200, 201), (201, 200)]
    got = {r["u"]: r["v"] for r in components.stars(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {201: 200}


def test_substrings(spark, folder):
    for path, rows in ((folder, ROWS), (DATA, [tuple(r) for r in common.read(spark, DATA, "documents").select("doc_id", "text").collect()])):
        got = sorted((tuple(r) for r in substrings.op5_substrings(spark, path).collect()), key=repr)
        assert got == sorted(((None if i == common.NULL_ID else i, *x) for i, *x in substrings.brute(rows)), key=repr)
    assert substrings.brute(ROWS)[6][2] == 70


def test_sliding_least_and_rolling():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1000, 200).astype(np.uint64)
    for width in (1, 2, 7, 25, 200):
        assert substrings.sliding_least(x, width).tolist() == [x[i : i + width].min() for i in range(len(x) - width + 1)]
    roll = substrings.Rolling(0x9E3779B97F4A7C15)
    y = np.concatenate([x, x[50:120]])
    h = roll(y, 10)
    assert (h[50:110] == h[200:260]).all() and len(set(h[:190].tolist())) == 190


def test_quality(spark, folder):
    rows = quality.op6_quality(spark, folder).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"]: r["held_out"] for r in rows if r["doc_id"] is not None} == {i: binascii.crc32(str(i).encode()) % 4 == 2 for i, _ in ROWS if i is not None}
    kept = quality.keep_good(table(spark), common.read(spark, folder, "labels"))
    assert kept.columns == table(spark).columns


def test_quality_on_held_out_labels(spark):
    path = "/root/testdata/sf0.01"
    marks = {r["doc_id"]: r["quality"] for r in common.read(spark, path, "labels").collect()}
    rows = [r for r in quality.op6_quality(spark, path).collect() if r["held_out"] and r["doc_id"] in marks]
    scores, y = np.array([r["score"] for r in rows]), np.array([marks[r["doc_id"]] for r in rows])
    assert quality.auc(scores, y) > 0.97
    assert np.mean((scores >= 0.7) == y) > 0.95


def test_quality_fit_is_the_pooled_formula():
    rng = np.random.default_rng(1)
    xs = [rng.normal(size=(200, 3)), rng.normal(size=(300, 3)) * [1, 2, 3] + 2]
    m = quality.model_of(np.array([200.0, 300.0]), np.stack([x.sum(0) for x in xs]), np.stack([x.T @ x for x in xs]), 0.0, 0.0)
    p = rng.normal(size=(5, 3))
    want = []
    for x, mean, factor in zip(xs, m.means, m.factors, strict=True):
        cov = np.cov(x.T, bias=True)
        assert np.allclose(factor @ factor.T, cov, atol=1e-4)
        d = p - mean
        want.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.log(np.linalg.det(cov)))
    assert np.allclose(m.scores(p), 1 / (1 + np.exp(-(want[1] - want[0] + math.log(1.5)))), atol=1e-3)
    assert quality.model_of(np.zeros(2), np.zeros((2, 3)), np.zeros((2, 3, 3))).scores(p).tolist() == [0.5] * 5


def rake_brute(cells, goals, sweeps=200):
    w, total = dict(cells), sum(cells.values())
    for _ in range(sweeps):
        for d, goal in enumerate(goals):
            sums = collections.Counter()
            for c, x in w.items():
                sums[c[d]] += x
            w = {c: x * goal[c[d]] * total / sums[c[d]] for c, x in w.items()}
    return w


def test_mixing(spark):
    path = "/root/testdata/sf0.01"
    rows = mixing.op9_mixing(spark, path).collect()
    assert len(rows) == common.read(spark, path, "documents").count()
    cells = collections.Counter()
    for r in rows:
        cells[r["source"], r["lang"], r["topic"]] += r["n_tokens"]
    goals = []
    for d in range(3):
        raised = collections.Counter()
        for c, n in cells.items():
            raised[c[d]] += n
        raised = {k: v**0.7 for k, v in raised.items()}
        goals.append({k: v / sum(raised.values()) for k, v in raised.items()})
    want = rake_brute(cells, goals)
    for r in rows:
        c = (r["source"], r["lang"], r["topic"])
        assert r["weight"] == pytest.approx(want[c] / cells[c], rel=2e-3)
    expected = sum(r["probability"] * r["n_tokens"] for r in rows)
    assert expected == pytest.approx(0.6 * sum(cells.values()), rel=1e-3)
    assert all(0 <= r["probability"] <= 1 for r in rows)


def test_mixing_edges(spark, folder):
    rows = {r["doc_id"]: r for r in mixing.op9_mixing(spark, folder).collect()}
    assert rows[0]["n_tokens"] == 1 == rows[1]["n_tokens"] and rows[2]["n_tokens"] == 2
    assert rows[3]["source"] == "" and rows[3]["lang"] == ""
    only = mixing.mixture(table(spark), targets={"source": spark.createDataFrame([("s1", 1.0)], "source string, share double")}, share=1.0)
    for r in only.select("doc_id", only.columns[-1]).collect():
        assert r[1]["sampled"] == (r[1]["source"] == "s1")
    assert mixing.mix(table(spark)).columns == table(spark).columns


def check_packing(rows, docs):
    encode = packing.encoder()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r)
    for bin_ in by.values():
        at = 0
        for r in sorted(bin_, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    got = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want = collections.Counter()
    for i, text in docs:
        ids = np.array([*encode(text or ""), 0], dtype="<u4")
        for k, (start, length) in enumerate(packing.cuts(len(ids))):
            want[i, k, start, length, binascii.crc32(ids[start : start + length].tobytes())] += 1
    assert got == want
    return len(by), -(-sum(r["length"] for r in rows) // 2048)


def test_packing(spark, folder):
    n, least = check_packing(packing.op1_packing(spark, folder).collect(), ROWS)
    assert n <= least + 1
    docs = [tuple(r) for r in common.read(spark, DATA, "documents").select("doc_id", "text").collect()]
    n, least = check_packing(packing.op1_packing(spark, DATA).collect(), docs)
    assert n <= least + 1


def test_packing_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 50)
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 1500, 700).tolist()
    rows = packing.pack(spark.createDataFrame(list(enumerate(sizes)), "item long, length int")).collect()
    assert sorted(r["item"] for r in rows) == list(range(700))
    fill = collections.Counter()
    for r in rows:
        fill[r["sequence_id"]] += sizes[r["item"]]
    assert max(fill.values()) <= 2048
    assert len(fill) <= len(packing.best_fit(sizes, sorted(range(700), key=lambda i: -sizes[i]), [], 2048)) * 1.03  # blocks of 50 pieces are far smaller than in earnest


def test_genetic_steps():
    rng = random.Random(3)
    sizes = [rng.randint(200, 900) for _ in range(120)]
    plain = packing.best_fit(sizes, range(120), [], 2048)
    other = packing.best_fit(sizes, sorted(range(120), key=lambda i: -sizes[i]), [], 2048)
    child = packing.crossover(sizes, plain, other, 2048, rng)
    assert sorted(i for b in child for i in b) == list(range(120)) and all(sum(sizes[i] for i in b) <= 2048 for b in child)
    evolved = packing.evolve(sizes, [], 2048, 1)
    assert len(set(evolved)) <= len(other)


def test_tokenizers_agree():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    encode = packing.encoder()
    for text in ("", " ", "Hello  world\n\n x", "it's 3.14 — «naïve» déjà-vu\t\r\n", "漢字 and العربية 🙂", "<|endoftext|> plain", "a" * 300, "  x \x1c y"):
        assert encode(text) == whole.encode(text, add_special_tokens=False).ids


def test_syncmers(spark, folder):
    rows = syncmers.op2_syncmers(spark, folder).collect()
    order = sorted([(common.NULL_ID if i is None else i, t or "") for i, t in ROWS], key=lambda x: (-x[0], x[1]))
    want = collections.Counter()
    for k, (i, t) in enumerate(order):
        half = len(t) // 2
        edited = t[: len(t) - half] + order[(k + 1) % len(order)][1][:half]
        want[None if i == common.NULL_ID else i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["fingerprint"] == by[1]["fingerprint"] and by[4]["fingerprint"] == by[6]["fingerprint"] != by[5]["fingerprint"]
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
    assert by[14]["near_next"] > 0.9 and 0.2 < by[10]["near_edited"] < 0.6 and by[10]["near_next"] < 0.05


def test_syncmers_by_definition(spark):
    import xxhash

    def seeded(values):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), h)
        return h - (1 << 64) if h >> 63 else h

    text = words(80, 21)
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in text.split()]
    h = [x - (1 << 64) if x >> 63 else x for x in h]
    want = []
    for i in range(len(h) - 4):
        inner = [seeded(h[j : j + 2]) for j in range(i, i + 4)]
        if min(inner) in (inner[0], inner[3]):
            want.append((i, seeded(h[i : i + 5])))
    got = spark.createDataFrame([(text,)], "text string").select(syncmers.anchors(syncmers.text_or_empty()).alias("a")).first()["a"]
    assert [(r["pos"], r["hash"]) for r in got] == want


@pytest.mark.parametrize("size", [1, 3, 500])
def test_next_document_across_ranges(spark, monkeypatch, size):
    monkeypatch.setattr(syncmers, "RANGE_ROWS", size)
    ids = [3, 5, 8, 100, -4, 7, 1000, 6]
    rows = syncmers.with_next(spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")).collect()
    order = sorted(ids, reverse=True)
    assert {r["id"]: r["next_text"] for r in rows} == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}
    assert len(rows) == len(ids)


def test_warc(spark, folder):
    got = sorted((tuple(r) for r in warc.op7_warc(spark, folder).collect()), key=repr)
    rows = [(None, "null id"), (1, "<html>" + "p" * 200), (2, "<html>" + "p" * 200), (3, ""), (4, "x" * 99), (5, "x" * 99), (6, "é" * 60), (7, "é" * 60), (7, "<html>" + "p" * 200)]
    want = []
    for i, html in rows:
        data = html.encode()
        first = min((j for j, h in rows if h == html and j is not None), default=None)
        again = len(data) >= 100 and first < i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=repr)


def test_warc_round_trip(spark, tmp_path):
    pages = common.read(spark, "/root/testdata/sf0.1", "pages")
    manifest = warc.write_archives(pages, f"file://{tmp_path}/warc", archive_bytes=1000)
    back = {r["page_id"]: r for r in warc.read_archives(manifest).collect()}
    given = {r["page_id"]: r for r in pages.collect()}
    assert back.keys() == given.keys() and manifest.count() > 1
    for i, r in back.items():
        if r["record_type"] == "response":
            assert bytes(r["payload"]).decode() == (given[i]["html"] or "") and r["url"] == given[i]["url"]
    with open(manifest.first()["path"].removeprefix("file://"), "rb") as file:
        head = file.read(8)
    assert head[:4] == (0x184D2A5D).to_bytes(4, "little") and int.from_bytes(head[4:], "little") > 1000


def test_neighbours(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 16)).astype(np.float32)
    x[100:500] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0] * 15 + [None]), (2080, [float("inf")] * 16), (2100, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = collections.defaultdict(list)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # one partition would hide keys that hash apart
    found = neighbours.op3_neighbours(spark, str(tmp_path)).collect()
    spark.conf.unset(coalesce)
    for r in found:
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    d = x.astype(np.float64)
    hits = 0
    for q in range(0, 1200, 20):
        score = (d * d[q]).sum(axis=1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(1200), -score))[:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(m[2] == pytest.approx(score[m[1]], rel=1e-12) for m in mine)
        hits += len({m[1] for m in mine} & set(best.tolist()))
    assert hits >= 0.95 * 60 * 20 and set(got) == set(range(0, 1200, 20))


def test_walk_is_in_order_and_whole():
    rng = np.random.default_rng(9)
    a, b, counts = rng.random(7), rng.random(9), rng.integers(0, 3, (7, 9))
    found = list(neighbours.walk(a, b, counts.tolist(), 10**9))
    sums = [a[i] + b[j] for i, j in found]
    assert sums == sorted(sums) and len(found) == (counts > 0).sum()


def test_licenses(spark):
    mit = licenses.TEMPLATES[8][2]
    docs = [(1, None), (2, "words without a notice"), (3, "x y\nReleased under the MIT License.\nmore text\nReleased under the MIT License."), (4, "LICENSED under the apache license version 2.0"), (5, words(500, 3) + " " + mit.replace("free of charge, ", "at no charge, ") + " " + words(50, 4)), (6, "Licensed under the Foo License.")]
    rows = licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = collections.Counter((r["doc_id"], r["license"]) for r in rows)
    assert found == {(3, "MIT"): 2, (4, "Apache-2.0"): 1, (5, "MIT"): 1}
    long = next(r for r in rows if r["doc_id"] == 5)
    assert 0.9 < long["coverage"] < 1 and long["first_word"] == 500


def test_patience_alignment():
    a, b = "p x q a b c r d e s".split(), "a b z c d e".split()
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and [j for _, j in pairs] == [0, 1, 3, 4, 5]
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.choice("abcdefg") for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    assert licenses.rising([(0, 3), (1, 1), (2, 2), (3, 5), (4, 4)]) in ([(1, 1), (2, 2), (4, 4)], [(1, 1), (2, 2), (3, 5)])


def test_oracles_match(spark):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in registry.ORACLES.items():
        df = registry.QUERIES[name](spark, DATA)
        columns = sorted(df.columns)
        assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, db.sql(f"SELECT {', '.join(columns)} FROM ({sql}) AS q").fetchall()))


def test_cut_reads_back(spark):
    df = spark.range(10).selectExpr("id", "id % 3 AS k")
    first = common.cut(df)
    second = common.cut(first.where("k = 1"), instead_of=first)
    assert sorted(r["id"] for r in second.collect()) == [1, 4, 7]
    assert common.fresh(df, "ID", "k") == ["ID_", "k_"] and uuid.uuid4()
