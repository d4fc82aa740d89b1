"""SimHash near-dedup by anchor-point covering.

Fingerprints are 64-bit majorities over word-shingle hashes. Two that differ in at most four (or five)
bits differ in at most two bits in one of their halves. The anchors of a half are the words of the
perfect Hamming code of length 31 and covering radius 1 over its low 31 bits. Some point lies within one
bit of both fingerprints, and an anchor lies within one bit of that point, so both fingerprints lie within
the covering radius plus half the half's threshold, two bits, of a common anchor: each is replicated to the
1 or 16 anchors at that distance, by syndrome, and only fingerprints at the same anchor are compared. No
pair within the threshold is lost.

Scale: equal fingerprints are collapsed first, so copies never meet each other. Anchors held by one
fingerprint are dropped before comparing; an anchor with more than ``CELL`` fingerprints is dealt into
part-by-part cells that are compared separately, so no task holds a whole large group. A cell gives the
star of each of its components, at most one link for a fingerprint, never all pairs. Components come from
star contraction, with checkpoints. Joins sort and merge: nothing whose rows grow with the table is broadcast, so the
driver holds none of it.

Defined cases: null or empty text has fingerprint zero and links like any other; fewer words than a
shingle are one shingle; a bit that exactly half the hashes have is 0; very long texts are held one at a time; a
``doc_id`` given twice is one node with the links of both rows; the smallest id (null is smallest and comes back as
null) names a component; extra columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voluma.llm.common import NULL_ID, by_merge, cut, fresh, id_or_least, map_rows, read, text_or_empty
from voluma.llm.components import stars

SEED = 42
#: Fingerprints of one part of an anchor; a cell compares at most two parts.
CELL = 2048
_BLOCK = 1 << 15


def fingerprint(text: str, shingle: int = 4) -> int:
    """The majority of the shingles' XXH64, as a signed 64-bit number."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
        n = 1
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
        n = len(hashes)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, _BLOCK):
        block = np.array(hashes[start : start + _BLOCK], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(id, fp) for each row."""

    def run(rows: Iterable[dict]) -> Iterator[tuple]:
        for r in rows:
            yield r["id"], fingerprint(r["text"], shingle)

    return map_rows(docs.select(id_or_least().alias("id"), text_or_empty().alias("text")), "id long, fp long", run)


def _flips() -> np.ndarray:
    """For each syndrome the masks that lead to the code words within two bits; -1 pads."""
    table = np.full((32, 16), -1, dtype=np.int64)
    table[0, 0] = 0
    for s in range(1, 32):
        pairs = [(p, p ^ s) for p in range(1, 32) if p < p ^ s]
        table[s, : 1 + len(pairs)] = [1 << (s - 1)] + [1 << (p - 1) | 1 << (q - 1) for p, q in pairs]
    return table


def _syndromes() -> list[np.ndarray]:
    """For each byte of a 31-bit word the XOR of the positions (from 1) of its set bits."""
    out = []
    for byte in range(4):
        table = np.zeros(256, dtype=np.int64)
        for bit in range(8):
            position = 8 * byte + bit + 1
            if position <= 31:
                table[(np.arange(256) >> bit) & 1 == 1] ^= position
        out.append(table)
    return out


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) for every anchor within two bits of each half; the half is bit 31 of the anchor."""
    flips, tables = _flips(), _syndromes()
    keys, rows = [], []
    for half in range(2):
        word = (fps.view(np.uint64) >> np.uint64(32 * half)).astype(np.int64) & 0x7FFFFFFF
        syndrome = tables[0][word & 255] ^ tables[1][word >> 8 & 255] ^ tables[2][word >> 16 & 255] ^ tables[3][word >> 24 & 255]
        masks = flips[syndrome]
        row, column = np.nonzero(masks >= 0)
        keys.append((word[row] ^ masks[row, column]) | half << 31)
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for start in range(0, len(fps), 2048):
            part = fps[start : start + 2048]
            key, row = anchors(part)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["anchor", "fp"])


def _forest(fps: np.ndarray, side: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(root, node) for each component of links within ``most`` bits; between the sides only, where there are two."""
    cross = side[0] != side[-1]
    left, left_side = fps, side
    roots, nodes = [], []
    while len(left) > 1:
        root, queue = left[0], [(left[0], left_side[0])]
        left, left_side = left[1:], left_side[1:]
        while queue and len(left):
            f, s = queue.pop()
            near = np.bitwise_count((left ^ f).view(np.uint64)) <= most
            if cross:
                near &= left_side != s
            if near.any():
                found = left[near]
                roots.append(np.full(len(found), root))
                nodes.append(found)
                queue += zip(found, left_side[near], strict=True)
                left, left_side = left[~near], left_side[~near]
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty, *roots]), np.concatenate([empty, *nodes])


def _cells(most: int):
    """Links of the cells of a partition sorted by (anchor, a, b, part); a cell may span batches, none is larger than two parts."""

    def links(keys: np.ndarray, fps: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(fps), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(fps)))
        small = np.repeat(sizes <= 8, sizes) & (keys[:, 1] == keys[:, 2])
        segment = np.cumsum(new)
        us, vs = [], []
        for k in range(1, 8):
            if k >= len(fps):
                break
            at = np.flatnonzero((segment[k:] == segment[:-k]) & small[k:])
            at = at[np.bitwise_count((fps[at] ^ fps[at + k]).view(np.uint64)) <= most]
            us.append(fps[at])
            vs.append(fps[at + k])
        for start, size in zip(starts, sizes, strict=True):
            if size > 1 and not small[start]:
                u, v = _forest(fps[start : start + size], part[start : start + size], most)
                us.append(u)
                vs.append(v)
        empty = [np.zeros(0, dtype=np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(empty + us)), pa.array(np.concatenate(empty + vs))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1)
            rows = rows if held is None else np.concatenate([held, rows])
            last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
            whole = last[-1] + 1 if len(last) else 0
            if whole:
                yield links(rows[:whole, :3], np.ascontiguousarray(rows[:whole, 4]), rows[:whole, 3])
            held = rows[whole:]
        if held is not None:
            yield links(held[:, :3], np.ascontiguousarray(held[:, 4]), held[:, 3])

    return run


def near_links(fps: DataFrame, most: int = 4) -> DataFrame:
    """(u, v): links that connect what the pairs of distinct fingerprints within ``most`` bits connect."""
    if not 0 <= most <= 5:
        raise ValueError("anchors of radius two cover a threshold of 0 to 5 bits")
    placed = fps.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    met = placed.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    dealt = placed.join(by_merge(met), "anchor").select("anchor", "fp", F.ceil(F.col("n") / CELL).cast("long").alias("parts"))
    dealt = dealt.withColumn("part", F.when(F.col("parts") > 1, F.expr("pmod(xxhash64(fp), parts)")).otherwise(F.lit(0)).cast("long"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = dealt.select("anchor", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "fp")
    sorted_cells = cells.repartition("anchor", "a", "b").sortWithinPartitions("anchor", "a", "b", "part", "fp")
    return sorted_cells.mapInArrow(_cells(most), "u long, v long")


def near_components(docs: DataFrame, shingle: int = 4, most: int = 4) -> DataFrame:
    """(id, fp, component) for each row of ``docs``; component is the smallest id that near links reach."""
    each = cut(fingerprints(docs, shingle))
    by_id = each.groupBy("id").agg(F.min("fp").alias("v"), F.max("fp").alias("u"))  # rows that share an id link what they hold
    distinct = each.groupBy("fp").agg(F.min("id").alias("head"))
    links = near_links(distinct, most).union(each.join(by_merge(by_id.where("u <> v")), "id").select(F.col("fp").alias("u"), "v"))
    star = stars(links).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = distinct.join(by_merge(star), "fp", "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))
    named = cut(rooted.groupBy("root").agg(F.min("head").alias("component")))  # a table of its own, so that AQE can split the join's large components
    return each.join(by_merge(rooted.join(by_merge(named), "root").select("fp", "component")), "fp").select("id", "fp", "component")


def keep_ids(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``stay`` (id); of rows that share an id the one whose values have the smallest hash."""
    key, own = fresh(docs, "near_id", "near_row")
    kept = docs.withColumn(key, id_or_least()).join(stay.select(F.col("id").alias(key)), key, "left_semi")
    ids = docs.select(id_or_least().alias("id")).groupBy("id").count().agg(F.max("count")).first()[0]
    if (ids or 0) < 2:
        return kept.drop(key)
    hashed = kept.withColumn(own, F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))
    least = hashed.groupBy(key).agg(F.min(own).alias(own))
    return hashed.join(least, [key, own], "left_semi").dropDuplicates([key]).drop(key, own)


def drop_near_copies(docs: DataFrame, shingle: int = 4, most: int = 4) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each component; of rows that share that id, one."""
    return keep_ids(docs, near_components(docs, shingle, most).where("id = component").select("id").distinct())


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_components(read(spark, sf_dir, "documents"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), real("component").alias("component_id"))
