"""Quality classifier: regularised quadratic discriminant over document statistics.

A document becomes a fixed vector of transformed statistics (logs of lengths and smoothed logits of
shares), computed over its whole text. Each class gets a mean and a covariance that is shrunk towards the
pooled covariance and towards its own diagonal; the Cholesky factors are computed once and cached with the
model. The score is the logistic of the Mahalanobis log-density difference plus the log prior odds.

Scale: the labels meet their texts first (broadcast where they are few, else by a join that AQE can split), so statistics for the fit are computed of labelled training rows alone. The
fit needs only their counts, sums and outer products, which partitions emit and one small aggregate adds up; it uses
every labelled training row and holds nothing but d x d numbers. Scoring is a scan without shuffle.

Defined cases: null or empty text has the statistics of no words and is scored as such; very long texts are scored
whole, one at a time; ``with_scores`` replaces a column of the given name; an empty table has no scores; a label that is
neither 0 nor 1, and labels without a document, take no part; rows labelled twice count twice; with fewer
than two training rows of a class every score is the share of label 1 (or 0.5 without labels).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voluma.llm.common import cut_with, fresh, id_or_least, map_rows, read, text_or_empty

#: Labelled training rows up to which they are broadcast to the texts (some MB); more meet them by a shuffle.
MOST_BROADCAST = 1 << 18
_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "stop": b".",
    "comma": b",;:",
    "shout": b"!?",
    "quote": b"'\"()",
    "dash": b"-/",
    "mark": b"#$%&*+<=>@[]\\^_`{|}~",
    "line": b"\n\r",
    "space": b" \t",
    "wide": range(128, 256),
}
_TABLE = np.zeros((256, len(_CLASSES)))
for _i, _bytes in enumerate(_CLASSES.values()):
    _TABLE[list(_bytes), _i] = 1
_MARKS = frozenset(b"!#$%&*+<=>@^_`{|}~")
NAMES = [f"share_{k}" for k in _CLASSES] + ["chars", "words", "word_length", "longest", "distinct", "top", "marked", "short", "capital", "lines", "line_length", "distinct_lines", "echo"]


def statistics(text: str) -> np.ndarray:
    """The transformed statistics of a text."""
    data = text.encode()
    n = len(data)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) @ _TABLE
    shares = np.log((counts + 0.5) / (n - counts + 0.5 + 0.002 * n + 1))
    words = data.split()
    k = len(words)
    seen: dict[bytes, int] = {}
    marked = short = capital = 0
    for w in words:
        seen[w] = seen.get(w, 0) + 1
        marked += w[-1] in _MARKS
        short += len(w) <= 3
        capital += 65 <= w[0] <= 90
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = lambda x, of: math.log((x + 0.5) / (of - x + 0.5))
    more = [
        math.log1p(n),
        math.log1p(k),
        math.log1p(n / (k + 1)),
        math.log1p(max(map(len, words), default=0)),
        math.log((len(seen) + 1) / (k + 1)) / math.log(k + 2),
        share(max(seen.values(), default=0), k),
        share(marked, k),
        share(short, k),
        share(capital, k),
        math.log1p(len(lines)),
        math.log1p(n / (len(lines) + 1)),
        share(len(set(lines)), len(lines)),
        share(sum(a == b for a, b in pairwise(words)), max(k - 1, 0)),
    ]
    return np.concatenate([shares, more])


def forward(factor: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of ``factor @ z = right`` for a lower triangle, by forward substitution."""
    z = np.empty_like(right)
    for k in range(len(factor)):
        z[k] = (right[k] - factor[k, :k] @ z[:k]) / factor[k, k]
    return z


@dataclass(frozen=True)
class Model:
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_odds: float
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets, strict=True):
            z = forward(factor, (x - mean).T)
            density.append(-0.5 * (z**2).sum(axis=0) - 0.5 * log_det)
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.log_odds, -500, 500)))


def model_of(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, pooled: float = 0.5, diagonal: float = 0.02) -> Model:
    """The model of the classes' counts, sums and sums of outer products; ``pooled`` and ``diagonal`` are the shrinkage weights."""
    d = sums.shape[1]
    if counts.min() < 2:
        total = counts.sum()
        return Model(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), 0.0, float(counts[1] / total) if total else 0.5)
    means = sums / counts[:, None]
    own = [p / n - np.outer(m, m) for p, n, m in zip(products, counts, means, strict=True)]
    both = (counts[0] * own[0] + counts[1] * own[1]) / counts.sum()
    factors = []
    for cov in own:
        s = (1 - pooled) * cov + pooled * both
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + 1e-6 * max(np.trace(both) / d, 1e-6) * np.eye(d)
        factors.append(np.linalg.cholesky(s))
    factors = np.stack(factors)
    log_dets = 2 * np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1)
    return Model(means, factors, log_dets, math.log(counts[1] / counts[0]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, pooled: float = 0.5, diagonal: float = 0.02) -> Model:
    """The model of all labelled rows that aren't held out."""
    marks = labels.where(F.col("quality").isin(0, 1) & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).select(id_or_least().alias("id"), F.col("quality").cast("int").alias("y"))
    marks, (n,) = cut_with(marks, [F.count("*")])
    d = len(NAMES)

    def moments(rows: Iterable[dict]) -> Iterator[tuple]:
        parts = {}
        for r in rows:
            x = statistics(r["text"])
            n, s, p = parts.get(r["y"], (0, np.zeros(d), np.zeros((d, d))))
            parts[r["y"]] = n + 1, s + x, p + np.outer(x, x)
        for y, (n, s, p) in parts.items():
            yield y, [float(n), *s, *p.ravel()]

    known = docs.select(id_or_least().alias("id"), text_or_empty().alias("text")).join(F.broadcast(marks) if n <= MOST_BROADCAST else marks, "id")
    added = map_rows(known, "y int, m array<double>", moments).select("y", F.posexplode("m").alias("i", "m")).groupBy("y", "i").agg(F.sum("m").alias("m"))
    sums = np.zeros((2, 1 + d + d * d))
    for r in added.collect():  # 2 x (1 + d + d * d) numbers, whatever the input
        sums[r["y"], r["i"]] = r["m"]
    return model_of(sums[:, 0], sums[:, 1 : 1 + d], sums[:, 1 + d :].reshape(2, d, d), pooled, diagonal)


def with_scores(docs: DataFrame, model: Model, column: str) -> DataFrame:
    """``docs`` with the score of each row's text in ``column``."""

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        x = np.stack([statistics(t) for t in texts]) if len(texts) else np.zeros((0, len(NAMES)))
        return pd.Series(model.scores(x))

    return docs.withColumn(column, score(text_or_empty()))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """``docs`` that the classifier accepts."""
    (score,) = fresh(docs, "quality_score")
    return with_scores(docs, fit(docs, labels), score).where(F.col(score) >= least).drop(score)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, fit(docs, read(spark, sf_dir, "labels")), "score")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def auc(scores: np.ndarray, labels: np.ndarray) -> float:
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], labels[order]
    edges = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    rank = np.zeros(len(s))
    for a, b in pairwise([*edges, len(s)]):
        rank[a:b] = (a + b + 1) / 2
    ones = y.sum()
    return float((rank[y == 1].sum() - ones * (ones + 1) / 2) / max(1, ones * (len(y) - ones)))
