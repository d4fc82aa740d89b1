"""Queries that SQL cannot express, row by row against their definitions; and the line query's SQL where rows share ids."""

import binascii
import hashlib

import numpy as np
import pytest
import xxhash

from voluma.llm import common, lines, quality, registry, syncmers

DATA = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), h)
    return signed(h)


def prints(text):
    """The fingerprint's numbers by the definition."""
    import re

    words = re.split("[ \t-\r]+", text.strip(" \t\n\x0b\x0c\r"))
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    inner = [chained(h[j : j + 2]) for j in range(len(h) - 1)]
    found = []
    for i in range(len(h) - 4):
        if min(inner[i : i + 4]) in (inner[i], inner[i + 3]):
            found.append(chained(h[i : i + 5]))
    if len(h) < syncmers.SHORT:
        found += [chained([x]) for x in h]
    if not found:
        found = [chained(h)]
    return [(x & 0x7FFFFFFF) | 0x80000000 for x in found]


def likeness(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def test_syncmer_query_row_by_row(spark):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in common.read(spark, DATA, "documents").collect()), reverse=True)
    rows = {r["doc_id"]: r for r in syncmers.op2_syncmers(spark, DATA).collect()}
    assert len(rows) == len(docs)
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, following = prints(text), prints(edited), prints(after)
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == "".join(f"{x:X}" for x in own) and r["edited_fingerprint"] == "".join(f"{x:X}" for x in changed)
        assert r["near_edited"] == pytest.approx(likeness(own, changed)) and r["near_next"] == pytest.approx(likeness(own, following))


def test_quality_query_row_by_row(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in common.read(spark, DATA, "documents").collect()}
    labels = {r["doc_id"]: r["quality"] for r in common.read(spark, DATA, "labels").collect()}
    out = lambda i: binascii.crc32(str(i).encode()) % 4 == 2
    x = {i: quality.statistics(t) for i, t in docs.items()}
    parts = [np.stack([x[i] for i, y in labels.items() if y == k and i in x and not out(i)]) for k in range(2)]
    n = np.array([len(p) for p in parts])
    means = [p.mean(axis=0) for p in parts]
    own = [np.cov(p.T, bias=True) for p in parts]
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    scores = []
    for p, mean, cov in zip(n, means, own, strict=True):
        s = 0.5 * cov + 0.5 * pooled
        s = 0.98 * s + 0.02 * np.diag(np.diag(s)) + 1e-6 * np.trace(pooled) / len(s) * np.eye(len(s))
        rest = np.stack(list(x.values())) - mean
        scores.append(-0.5 * np.einsum("ij,ij->i", rest, np.linalg.solve(s, rest.T).T) - 0.5 * np.linalg.slogdet(s)[1] + np.log(p))
    want = dict(zip(x, 1 / (1 + np.exp(-np.clip(scores[1] - scores[0], -500, 500))), strict=True))
    for r in quality.op6_quality(spark, DATA).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-5, abs=1e-9)
        assert r["held_out"] == out(r["doc_id"]) and r["predicted"] == (r["score"] >= 0.7)


def test_line_query_and_its_sql_where_rows_share_ids(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    line = "a line of over twenty letters"
    rows = [(1, f"{line}\nown one"), (1, f"{line}\nown two"), (2, f"{line}\nown three"), (3, "other"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(db.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({registry.ORACLES['op10_line_dedup']}) AS q").fetchall())
    assert sorted(map(tuple, lines.op10_line_dedup(spark, str(tmp_path)).collect())) == want == sorted(lines.brute(rows))
    assert [r[2] for r in want] == [1, 1, 0, 0, 0]
