"""Connected components of a link table that is larger than any one machine.

Alternating large-star and small-star rounds (each a pre-aggregated minimum and a join that AQE can
split) contract every component to a star around its smallest node. Each round ends in a table in the shared folder, so
lineage stays short and a lost executor costs one round. No join broadcasts, so the driver holds no edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voluma.llm.common import by_merge, cut_with


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` and ``m`` of their u; on a key of its own, so that AQE can split the join's nodes of many edges."""
    keyed = least.select((-1 - F.col("u")).alias("k"), "m")
    return edges.withColumn("k", -1 - F.col("u")).join(by_merge(keyed), "k").drop("k")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come as u > v; every u links its smaller neighbours, and itself, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = _with_least(edges, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v")))


def stars(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v): each node of ``links`` (u, v: long) that isn't the smallest of its component, and that smallest."""
    state = [F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("u", "v", F.lit(1)))]
    edges, before = cut_with(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), state)
    for _ in range(most_rounds):
        if not before[0]:
            return edges
        edges, now = cut_with(_small_star(_large_star(edges).distinct()).distinct(), state, instead_of=edges)
        if now == before:
            return edges
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
