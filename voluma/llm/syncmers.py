"""Document fingerprints from closed syncmers over words.

A run of ``k`` words is an anchor if the least hash among its inner ``s``-word runs stands at its first or last
place. Whether a run is chosen depends on its own words alone, so equal passages have equal anchors wherever
they stand, and every window of neighbouring runs holds one. The fingerprint is the anchors' hashes in the
order of their positions, eight hexadecimal digits each; likeness is the share of distinct anchors that two
fingerprints have in common. DataFrame functions only.

The next document, in falling doc_id, comes from one shuffle by ranges of doc_id (bounds are approximate
quantiles, at most ``MOST_RANGES`` numbers); the largest document of each range is copied to the range above,
so that no window crosses ranges.

Defined cases: null or empty text is one empty word; very long texts are fingerprinted whole; extra columns are left
out; an empty table gives an empty result; texts of fewer than ``SHORT`` words have their single words as anchors too; a longer text without an anchor has the hash of all its
words as its one; rows that share a ``doc_id`` follow each other by text; a
null id is the smallest; the only document is its own next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voluma.llm.common import NULL_ID, id_or_least, read, text_or_empty

K, S = 5, 2
#: Texts of fewer words have their single words as anchors too.
SHORT = 20
MOST_RANGES = 20_000
RANGE_ROWS = 2048
_SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _word_hashes(text: Column) -> Column:
    return F.transform(F.split(F.trim(text, F.lit(_SPACES)), "[\\x20\\x09-\\x0D]+"), lambda w: F.xxhash64(w))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<pos:int,hash:long>>: the closed syncmers of ``text``; a long text without any has one, of position 0."""

    def of(h: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(1), F.size(h) - (s - 1)), lambda i: F.xxhash64(*[F.get(h, i + (j - 1)) for j in range(s)]))

        def chosen(g: Column) -> Column:
            at = lambda i, j: F.get(g, i + j)
            last = k - s
            edge = lambda i: F.least(*[at(i, j) for j in range(last + 1)]) == F.least(at(i, 0), at(i, last))
            starts = F.filter(F.sequence(F.lit(0), F.size(h) - k), edge)
            return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(h, i + j) for j in range(k)]).alias("hash")))

        none = F.array().cast("array<struct<pos:int,hash:bigint>>")
        found = F.when(F.size(h) >= k, let(inner, chosen)).otherwise(none)
        whole = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(h).alias("hash")))
        single = F.transform(h, lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x).alias("hash")))
        return let(found, lambda a: F.when(F.size(h) < SHORT, F.concat(a, single)).when(F.size(a) > 0, a).otherwise(whole))

    return let(_word_hashes(text), of)


def fingerprint(text: Column, k: int = K, s: int = S) -> Column:
    """array<long>: the anchors' hashes by position, each with 31 bits and a leading one."""
    return F.transform(anchors(text, k, s), lambda a: a["hash"].bitwiseAND(0x7FFFFFFF).bitwiseOR(0x80000000))


def as_text(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda x: F.hex(x)), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of the distinct anchors of either that both have."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(id, pos, hash) of every anchor, for positional matching by a join on hash."""
    return docs.select(id_or_least().alias("id"), F.inline(anchors(text_or_empty())))


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the rising ``bounds`` lie below ``value``, by halving."""
    if not bounds:
        return F.lit(0)
    table = F.lit(bounds).cast("array<bigint>")
    steps = F.lit([1 << b for b in range(len(bounds).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= len(bounds)) & (F.get(table, n + step - 1) < value), n + step).otherwise(n))


def with_next(docs: DataFrame) -> DataFrame:
    """(id, text, next_text): each document and the next by falling id; the first follows the last."""
    known = docs.select(id_or_least().alias("id"), text_or_empty().alias("text"))
    rows = known.count()
    ranges = max(1, min(MOST_RANGES, -(-rows // RANGE_ROWS)))
    bounds: list[int] = []
    if ranges > 1:
        quantiles = known.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
        bounds = sorted(set(quantiles))
    placed = known.withColumn("range", _range_of(F.col("id"), bounds))
    tops = {r["range"]: r["top"] for r in placed.groupBy("range").agg(F.max("id").alias("top")).collect()}  # at most MOST_RANGES rows
    filled = sorted(tops) or [0]
    above = {r: filled[(i + 1) % len(filled)] for i, r in enumerate(filled)}
    slots = range(len(bounds) + 1)
    top = F.get(F.lit([tops.get(r, NULL_ID) for r in slots]).cast("array<bigint>"), F.col("range"))
    up = F.get(F.lit([above.get(r, r) for r in slots]), F.col("range"))
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("guest"))
    guest = F.struct(up.alias("range"), F.lit(1).alias("guest"))
    dealt = placed.withColumn("at", F.explode(F.when(F.col("id") == top, F.array(own, guest)).otherwise(F.array(own))))
    order = Window.partitionBy("at.range").orderBy("at.guest", F.desc("id"), "text")
    led = dealt.select("id", "text", "at").withColumn("next_text", F.lead("text").over(order))
    return led.where("at.guest = 0").select("id", "text", "next_text")


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_next(read(spark, sf_dir, "documents"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    texts = pairs.withColumns({"n_chars": n.cast("long"), "edited": edited})
    prints = texts.select(
        F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("own"),
        fingerprint(F.col("edited")).alias("changed"),
        fingerprint(F.col("next_text")).alias("following"),
    )
    return prints.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
