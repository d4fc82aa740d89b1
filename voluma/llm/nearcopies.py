"""SimHash near-dedup for documents: wide fingerprints, anchor-point covering, links confirmed on the whole shingle sets.

The similarity is the Jaccard similarity of five-word shingles, 0.8 or more. At 0.8, a bit of two SimHash
fingerprints differs with probability 0.15, too often for one word of 64 bits, so a document has ``WORDS`` of them
over its distinct shingles. Every half of a word is replicated to the anchors of the Hamming code within radius two
(``simhash.anchors``), and fingerprints are compared per anchor: first one word, to drop those that met by chance,
then, once for anchors of the same members, all words. A cell links its members by a forest of at most one link
each: near ones to a root at once, others through their nearest. Links are then confirmed by the exact similarity,
so no pair below it is joined. Pairs that share no anchor are lost: by calculation 3 % of pairs at exactly 0.8,
0.4 % at 0.85, 0.01 % at 0.9; a group is lost only where no chain of its pairs is left.

Scale: equal shingle sets are collapsed first, so exact copies never meet each other. What moves is four numbers for
each anchor, and for the documents with near ones all words and, once a link, their shingles. An anchor that a sample
of the anchors (an estimate that only plans the work; results don't depend on it) shows with over ``CELL`` members
is dealt into part-by-part cells. Links are confirmed in rounds, one for each component so far, so that a group of
thousands needs about one confirmed link a document. Components come from star contraction.

Defined cases: null or empty text is one empty shingle, fewer words than a shingle are one shingle; very long texts
are held one at a time; rows that share a ``doc_id`` are one node with the links of each; the smallest id (null is
smallest) of a component stays, of rows that share it the one of the smallest text hash; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voluma.llm.common import cut, cut_with, id_or_least, map_rows, small_batches, text_or_empty
from voluma.llm.components import stars
from voluma.llm.simhash import anchors, keep_ids

SHINGLE, LEAST = 5, 0.8
WORDS = 8
#: Differing bits of one word, and of all words, up to which a pair may be similar enough; and up to which it nearly surely is.
MAY_ONE, MAY, SURE = 22, 106, 53
#: Members of one part of an anchor; a cell compares at most two parts.
CELL = 2048
#: Anchors of which one in ``SAMPLE_RATE`` is counted to find those with many members; up to ``FEW`` are all counted.
SAMPLE_RATE, FEW = 64, 1 << 22
#: Rows of the table of large anchors up to which it is broadcast (a megabyte).
MOST_BROADCAST = 1 << 16
#: Rounds after which all links that are left are confirmed at once.
ROUNDS = 3
_rng = np.random.default_rng(11)
_XOR = _rng.integers(0, 2**64, WORDS, dtype=np.uint64)
_TIMES = _rng.integers(0, 2**64, (2, WORDS), dtype=np.uint64) | np.uint64(1)
_LANES = np.uint64(0x0101010101010101)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct XXH64 of the shingles, at least one."""
    words = text.encode().lower().split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined)], dtype=np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    return np.unique(np.array([digest(joined[a : b - 1]) for a, b in zip([0, *ends], ends[size - 1 :], strict=False)], dtype=np.uint64))


def wide(found: np.ndarray) -> np.ndarray:
    """The words of the fingerprint of a shingle set: for each bit the majority of as many hashes of each shingle."""
    n = len(found)
    ones = np.zeros((WORDS, 64), dtype=np.int64)
    for start in range(0, n, 255):  # counts of a byte's width, eight bits of a word at a time
        x = (found[start : start + 255, None] ^ _XOR) * _TIMES[0]
        x = (x ^ (x >> np.uint64(32))) * _TIMES[1]
        x ^= x >> np.uint64(32)
        for bit in range(8):
            counts = ((x >> np.uint64(bit)) & _LANES).sum(axis=0, dtype=np.uint64)
            ones[:, bit::8] += counts[:, None].view(np.uint8)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _key(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _signed(rows: Iterable[dict]) -> Iterator[tuple]:
    for r in rows:
        found = shingles(r["text"])
        yield r["id"], _key(found), wide(found).view(np.int64)


def _sets(rows: Iterable[dict]) -> Iterator[tuple]:
    for r in rows:
        yield r["id"], shingles(r["text"]).tobytes()


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, WORDS)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, node, word) for each anchor of each (node, words); word is the first."""
    for batch in batches:
        nodes, words = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _flat(batch.column(1))
        for start in range(0, len(nodes), 512):
            keys, rows = [], []
            for k in range(WORDS):
                key, row = anchors(np.ascontiguousarray(words[start : start + 512, k]))
                keys.append(key | k << 32)
                rows.append(row + start)
            row = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(nodes[row]), pa.array(words[row, 0])], names=["anchor", "node", "word"])


def _groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[np.ndarray, list, list[np.ndarray]]]:
    """Whole groups of rows with one first number, of a partition sorted by it: where they start, then each column."""
    held: list[pa.RecordBatch] = []

    def out(table: pa.Table) -> tuple:
        arrays = [table.column(k).combine_chunks() for k in range(columns)]
        keys = arrays[0].to_numpy(zero_copy_only=False)
        return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), arrays, keys

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        last = np.flatnonzero(keys != keys[-1])
        whole = last[-1] + 1 if len(last) else 0
        if held and (whole or held[-1].column(0)[-1].as_py() != keys[0]):
            yield out(pa.Table.from_batches([*held, batch.slice(0, whole)]))
            held = []
        elif whole:
            yield out(pa.Table.from_batches([batch.slice(0, whole)]))
        held.append(batch.slice(whole))
    if held:
        yield out(pa.Table.from_batches(held))


def _near_one(word: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Which members of a cell have another, of the other part where there are two, within MAY_ONE bits."""
    cross, near = part.min() != part.max(), np.zeros(len(word), dtype=bool)
    for at in range(len(word)):
        if not near[at]:
            close = np.bitwise_count((word ^ word[at]).view(np.uint64)) <= MAY_ONE
            close[at] = False
            if cross:
                close &= part != part[at]
            if close.any():
                near |= close
                near[at] = True
    return near


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, node, word) of the members that have a near one in their cell; rows come sorted by (cell, node)."""
    for starts, arrays, cell in _groups(batches, 4):
        part, node, word = (a.to_numpy(zero_copy_only=False).astype(np.int64) for a in arrays[1:])
        sizes = np.diff(np.append(starts, len(cell)))
        small = np.repeat(sizes <= 8, sizes)
        near = np.zeros(len(cell), dtype=bool)
        for k in range(1, 8):
            if k >= len(cell):
                break
            at = np.flatnonzero((cell[k:] == cell[:-k]) & small[k:])
            at = at[np.bitwise_count((word[at] ^ word[at + k]).view(np.uint64)) <= MAY_ONE]
            near[at] = near[at + k] = True
        for start, size in zip(starts[sizes > 8], sizes[sizes > 8], strict=True):
            near[start : start + size] = _near_one(word[start : start + size], part[start : start + size])
        yield pa.RecordBatch.from_arrays([pa.array(x[near]) for x in (cell.astype(np.int64), node, word)], names=["cell", "node", "word"])


def forest(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(a, b, bits) for the links of a forest over fingerprints within MAY bits: within SURE at once, others by the nearest."""
    out = []
    left = np.arange(len(words))
    while len(left):
        queue, left = [left[0]], left[1:]
        bits = np.full(len(left), MAY + 1)
        to = np.zeros(len(left), dtype=np.int64)
        while len(left):
            if queue:
                at = queue.pop()
                d = np.bitwise_count(words[left] ^ words[at]).sum(axis=1, dtype=np.int64)
                closer = d < bits
                bits[closer], to[closer] = d[closer], at
                take = d <= SURE
            else:
                take = np.arange(len(left)) == bits.argmin()
                if bits.min() > MAY:
                    break
            out += zip(to[take].tolist(), left[take].tolist(), bits[take].tolist(), strict=True)
            queue += left[take].tolist()
            left, bits, to = left[~take], bits[~take], to[~take]
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, bits): the forest of each cell of (cell, node, words), sorted by (cell, node)."""
    for starts, arrays, cell in _groups(batches, 3):
        node, words = arrays[1].to_numpy(zero_copy_only=False).astype(np.int64), _flat(arrays[2]).view(np.uint64)
        rows = []
        for start, end in zip(starts, np.append(starts[1:], len(cell)), strict=True):
            rows += [(node[start + a], node[start + b], d) for a, b, d in forest(words[start:end]) if node[start + a] != node[start + b]]
        u, v, d = (np.array(x, dtype=np.int64) for x in (zip(*rows, strict=True) if rows else ((), (), ())))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(d)], names=["u", "v", "bits"])


def near_links(heads: DataFrame) -> DataFrame:
    """(u, v, bits): links of ``heads`` (node, words) that may be similar enough."""
    small_batches(heads.sparkSession)
    heads = heads.select("node", "words")
    schema = "anchor long, node long, word long"
    placed = heads.mapInArrow(_replicate, schema)
    most = heads.count() * WORDS * 32
    rate = 1 if most <= FEW else SAMPLE_RATE
    some = heads.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(rate)) == 0).mapInArrow(_replicate, schema)
    large, (count,) = cut_with(some.groupBy("anchor").agg((F.count("*") * rate).alias("n")).where(F.col("n") > CELL), [F.count("*")])
    cells = placed.select(F.col("anchor").alias("cell"), F.lit(0).alias("part"), "node", "word")
    if count:
        dealt = placed.join(F.broadcast(large) if count <= MOST_BROADCAST else large, "anchor", "left")
        parts = F.coalesce(F.ceil(F.col("n") / CELL).cast("int"), F.lit(1))
        dealt = dealt.withColumn("parts", parts).withColumn("part", F.expr("pmod(xxhash64(node, 7), parts)").cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cell = F.when(F.col("parts") > 1, F.xxhash64("anchor", F.least("part", "other"), F.greatest("part", "other"))).otherwise(F.col("anchor"))
        cells = dealt.select(cell.alias("cell"), "part", "node", "word")
    met = cut(cells.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(_meet, "cell long, node long, word long"))
    sums = met.groupBy("cell").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node", "word")).alias("one"), F.bit_xor(F.xxhash64("node", "word", F.lit(1))).alias("two"))
    once = sums.groupBy("n", "one", "two").agg(F.min("cell").alias("cell")).select((-1 - F.col("cell")).alias("key"))
    members = met.withColumn("key", -1 - F.col("cell")).join(once, "key")  # a key of its own, so that AQE can split large cells
    full = members.join(heads.withColumn("word", F.col("words")[0]), ["node", "word"]).select(F.col("key").alias("cell"), "node", "words")
    found = full.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(_links, "u long, v long, bits long")
    return found.groupBy("u", "v").agg(F.min("bits").alias("bits"))


def similar(pairs: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """The ``pairs`` (u, v, cu, cv) whose texts, of ``texts`` (id, text), have a similarity of ``least`` or more."""
    wanted = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    sets = map_rows(texts.join(wanted, "id", "left_semi"), "id long, found binary", _sets, out_rows=256)
    side = lambda n: sets.select(F.col("id").alias(n), F.col("found").alias(f"{n}_found"))
    met = pairs.join(side("v"), "v").join(side("u"), "u").select("u_found", "v_found", "u", "v", "cu", "cv")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = []
            for one, two in zip(batch.column(0), batch.column(1), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in (one, two))
                both = len(np.intersect1d(a, b, assume_unique=True)) if min(len(a), len(b)) >= least * max(len(a), len(b)) - 1e-9 else 0
                stay.append(both >= least * (len(a) + len(b) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays(batch.columns[2:], names=["u", "v", "cu", "cv"]).filter(pa.array(stay, pa.bool_()))

    return met.mapInArrow(confirm, "u long, v long, cu long, cv long")


def confirmed(links: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): links enough to connect what the similar ones of ``links`` connect, confirmed in rounds.

    A round tries one link to a smaller component for each component so far (cu and cv are those of u and v), a sure one
    and to the smallest if there is a choice, so that a large group meets in one; the last one tries all that are left.
    """
    count, good = [F.count("*")], None
    left, n = cut_with(links.withColumns({"cu": F.col("u"), "cv": F.col("v")}), count)
    for number in range(ROUNDS):
        if not n[0]:
            break
        one = left.groupBy(F.greatest("cu", "cv")).agg(F.min(F.struct((F.col("bits") > SURE).alias("doubt"), F.least("cu", "cv"), "u", "v", "cu", "cv")).alias("x"))
        tried = cut(one.select("x.u", "x.v", "x.cu", "x.cv")) if number + 1 < ROUNDS else left.drop("bits")
        found = cut(similar(tried, texts))
        good = found if good is None else good.union(found)
        if number + 1 == ROUNDS:
            break
        star = stars(found.select(F.col("cu").alias("u"), F.col("cv").alias("v"))).select(F.col("u").alias("node"), F.col("v").alias("root"))
        rest = left.join(tried.select("u", "v"), ["u", "v"], "left_anti")
        for end in ("cu", "cv"):
            rest = rest.join(star.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        left, n = cut_with(rest.where("cu <> cv").select("u", "v", "bits", "cu", "cv"), count, instead_of=left)
    empty = links.sparkSession.createDataFrame([], "u long, v long")
    return empty if good is None else good.select("u", "v")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each component; of rows that share that id, one."""
    texts = docs.select(id_or_least().alias("id"), text_or_empty().alias("text"))
    signed = cut(map_rows(texts, "id long, key binary, words array<long>", _signed, out_rows=1024))
    heads = cut(signed.groupBy("key").agg(F.min("id").alias("node"), F.first("words").alias("words")))
    named = signed.select("id", "key").join(heads.select("key", "node"), "key")
    often = signed.groupBy("id").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    shared = named.join(often.where("low <> high").select("id"), "id", "left_semi")  # rows that share an id link what they hold
    star = stars(confirmed(near_links(heads), texts).union(shared.select(F.col("id").alias("u"), F.col("node").alias("v"))))
    gone = named.where("id <> node").select("id").union(star.select(F.col("u").alias("id"))).distinct()
    return keep_ids(docs, signed.select("id").distinct().join(gone, "id", "left_anti"))
