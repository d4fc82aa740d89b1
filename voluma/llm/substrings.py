"""Substring dedup: word windows that start in an earlier document are removed, by a count-min prefilter.

Every window of 50 words has a minimiser, the least hash among its 26-word grams; equal windows have equal
minimisers, and neighbouring windows mostly share theirs. Of equal texts only the first takes part: the later ones
are covered whole, and their windows start nowhere earlier than the first's do. Pass 1 counts, for each partition,
the texts of each minimiser in sparse count-min counters that saturate at two; the partition sketches are merged
block by block. A minimiser's estimate is never below the count of any window it stands for, so windows estimated
once are single. The cells estimated repeated are a table, which each text's minimisers meet by semi-joins. Pass 2
emits only windows whose minimiser is estimated repeated, as 96-bit hashes, and groups them exactly: the smallest
document of each window is an aggregate with map-side combine, joined back on a key of its own so that AQE splits
hot windows. Covered positions are gathered by row, where the words are dropped. Nothing is lost to the sketch.

Scale: the sketch's width is four times the minimisers, whatever their number; it lies in blocks that are merged in
a task each, and nothing of it goes to the driver or is broadcast. What moves is the text once (both joins on a row
use one exchange), a number for each minimiser (about one in 13 words) and the windows estimated repeated.

Defined cases: null or empty text has no words and keeps the empty text; texts under 50 words have no
windows; very long texts are held one at a time; of rows that share a ``doc_id`` none is earlier than another, and
each loses its own covered words; a null id is the earliest; a window repeated inside one document alone stays; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voluma.llm.common import NULL_ID, cut, fresh, id_or_least, read, small_batches, text_or_empty

ROWS = 2
#: A block of the sketch has 2 ** 20 cells, or more where there would be over 2 ** 12 blocks.
_BLOCK_BITS, _MOST_BLOCK_BITS = 20, 26
_HELD = 1 << 20
#: Odd multipliers of the rolling hashes, any will do.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Odd multipliers that spread minimisers over the cells of each row.
_MIXERS = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)


class Rolling:
    """Hashes of all runs of consecutive words, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __call__(self, words: np.ndarray, length: int) -> np.ndarray:
        if len(words) >= len(self.up):
            size = 2 * len(words) + 2
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(size, b, dtype=np.uint64)), dtype=np.uint64) for b in (self.base, self.inverse))
        sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * self.down[: len(words)], out=sums[1:])
        x = (sums[length:] - sums[: len(sums) - length]) * self.up[: len(sums) - length]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by block prefixes and suffixes."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


class Windows:
    """A document's windows: their hashes and minimisers."""

    def __init__(self, window: int) -> None:
        self.window, self.gram = window, window // 2 + 1
        self.first, self.second = map(Rolling, _BASES)

    def words(self, text: str) -> np.ndarray | None:
        words = text.encode().split()
        if len(words) < self.window:
            return None
        digest = xxhash.xxh3_64_intdigest
        return np.array([digest(w) for w in words], dtype=np.uint64)

    def minimisers(self, words: np.ndarray) -> np.ndarray:
        return sliding_least(self.first(words, self.gram), self.window - self.gram + 1)

    def hashes(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.first(words, self.window).view(np.int64), (self.second(words, self.window) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _cell(minimisers: np.ndarray, row: int, width: int) -> np.ndarray:
    """Cells of a row, mixed anew for each: minimisers are small numbers, whose upper bits are no fair draw."""
    x = (minimisers ^ (minimisers >> np.uint64(32))) * np.uint64(_MIXERS[row])
    return (x ^ (x >> np.uint64(32))) & np.uint64(width - 1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            yield from batch.slice(start, 256).to_pylist()


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch with its flattened minimisers and how many each row has."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("least"))
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        yield batch, flat, np.diff(column.offsets.to_numpy(zero_copy_only=False))


def _signed(window: int):
    """(id, t1, t2, least): the distinct minimisers of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Windows(window)
        for batch in batches:
            least = []
            for text in batch.column(3).to_pylist():
                words = of.words(text)
                least.append([] if words is None else np.unique(of.minimisers(words).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(least, pa.list_(pa.int64()))], names=["id", "t1", "t2", "least"])

    return run


def _sketches(width: int, block_bits: int):
    """(block, cells, twice): sparse counters of the partition's minimisers; twice marks counts of two or more."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(held)
        rows = []
        for row in range(ROWS):
            cells, counts = np.unique(_cell(keys, row, width), return_counts=True)
            block = (cells >> np.uint64(block_bits)).astype(np.int64)
            edges = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            for a, b in zip(edges, np.append(edges[1:], len(cells)), strict=True):
                inside = (cells[a:b] & np.uint64((1 << block_bits) - 1)).astype("<u4")
                rows.append((int(block[a]) * ROWS + row, inside.tobytes(), np.packbits(counts[a:b] > 1).tobytes()))
        blocks, cells, twice = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(cells, pa.binary()), pa.array(twice, pa.binary())], names=["block", "cells", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, flat, _ in _numbers(batches):
            if len(flat):
                held.append(flat)
                n += len(flat)
            if n >= _HELD:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return run


def _merge(block_bits: int):
    """(row, cell): for the rows of a partition sorted by block, the cells counted twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, block = np.zeros(1 << block_bits, dtype=np.uint8), None

        def out() -> Iterator[pa.RecordBatch]:
            cells = np.flatnonzero(counts > 1) + (block // ROWS << block_bits)
            for start in range(0, len(cells), 1 << 15):
                part = cells[start : start + (1 << 15)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block % ROWS, dtype=np.int32)), pa.array(part)], names=["row", "cell"])

        for batch in batches:
            for b, cells, twice in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if b != block:
                    if block is not None:
                        yield from out()
                    block = b
                    counts[:] = 0
                at = np.frombuffer(cells, dtype="<u4")
                more = 1 + np.unpackbits(np.frombuffer(twice, dtype=np.uint8))[: len(at)]
                counts[at] = np.minimum(counts[at] + more, 2)
        if block is not None:
            yield from out()

    return run


def _placed(width: int):
    """(id, t1, least, cell0, cell1) for each minimiser of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, sizes in _numbers(batches):
            own = [np.repeat(batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64), sizes) for k in range(2)]
            cells = [_cell(flat, row, width).view(np.int64) for row in range(ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*own, flat.view(np.int64), *cells)], names=["id", "t1", "least", "cell0", "cell1"])

    return run


def _windows(window: int, names: tuple[str, str, str, str]):
    """(h1, h2, id, t1, pos) of the windows estimated repeated; names: of the id, the text's hash, the text and the minimisers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Windows(window)
        held, n = [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["h1", "h2", "id", "t1", "pos"])
        for r in _rows(batches):
            i, t1, text, repeated = (r[k] for k in names)
            if (words := of.words(text or "")) is None:
                continue
            at = np.flatnonzero(np.isin(of.minimisers(words).view(np.int64), np.array(repeated, dtype=np.int64)))
            h1, h2 = of.hashes(words)
            held.append((h1[at], h2[at], np.full(len(at), i), np.full(len(at), t1), at.astype(np.int32)))
            n += len(at)
            if n >= 1 << 15:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return run


def _text_hashes(text: Column) -> dict[str, Column]:
    return {"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(7), text)}


def repeated_minimisers(heads: DataFrame, block_bits: int | None = None) -> DataFrame:
    """(id, t1, least): of each row of ``heads`` (id, t1, least) the minimisers that the sketch estimates repeated."""
    minimisers = heads.agg(F.sum(F.size("least"))).first()[0] or 0
    width = 1 << (4 * minimisers + 1).bit_length()
    bits = block_bits or min(_MOST_BLOCK_BITS, max(_BLOCK_BITS, width.bit_length() - 12))
    width = max(width, 1 << bits)
    blocks = ROWS * (width >> bits)
    sketches = heads.mapInArrow(_sketches(width, bits), "block long, cells binary, twice binary")
    merged = cut(sketches.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(_merge(bits), "row int, cell long"))
    placed = heads.mapInArrow(_placed(width), "id long, t1 long, least long, cell0 long, cell1 long")
    for row in range(ROWS):
        placed = placed.join(merged.where(F.col("row") == row).select(F.col("cell").alias(f"cell{row}")), f"cell{row}", "left_semi")
    return placed.groupBy("id", "t1").agg(F.collect_list("least").alias("least"))


def covered(docs: DataFrame, names: tuple[str, str], window: int = 50, block_bits: int | None = None) -> DataFrame:
    """(id, t1, starts): for each row that loses words, known by its id and its text's hash, the starts of its covered windows.

    ``docs`` has both in the columns ``names``. A later copy of a whole text has the one start -1.
    """
    small_batches(docs.sparkSession)
    key, own = names
    texts = docs.select(F.col(f"`{key}`").alias("id"), *[c.alias(n) for n, c in _text_hashes(text_or_empty()).items()], text_or_empty().alias("text"))
    signed = cut(texts.mapInArrow(_signed(window), "id long, t1 long, t2 long, least array<long>"))
    heads = cut(signed.groupBy("t1", "t2").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.first("least").alias("least")).select("id", "t1", "least", "t2", "last"))
    again = repeated_minimisers(heads.where(F.size("least") > 0).select("id", "t1", "least"), block_bits)
    (least,) = fresh(docs, "substring_least")
    again = again.select(F.col("id").alias(key), F.col("t1").alias(own), F.col("least").alias(least))
    found = docs.join(again, [key, own]).mapInArrow(_windows(window, (key, own, "text", least)), "h1 long, h2 int, id long, t1 long, pos int")
    first = found.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    first = first.select(F.bitwise_not("h1").alias("k1"), "h2", "first")  # another key than the aggregate's: an exchange that AQE can split
    late = found.withColumn("k1", F.bitwise_not("h1")).join(first, ["k1", "h2"]).where("id > first")
    starts = late.groupBy("id", "t1").agg(F.collect_list("pos").alias("starts"))
    later = heads.where("id < last").select("t1", "t2", F.col("id").alias("first"))
    copies = signed.where(F.size("least") > 0).join(later, ["t1", "t2"]).where("id > first").select("id", "t1", F.array(F.lit(-1)).alias("starts")).distinct()
    return starts.unionByName(copies)


def remove(words: list[bytes], starts, window: int) -> list[bytes]:
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + window, len(words)), -1)
    stay = np.cumsum(edges[:-1]) == 0
    return [w for w, s in zip(words, stay, strict=True) if s]


def dedup_substrings(docs: DataFrame, window: int = 50, block_bits: int | None = None) -> DataFrame:
    """``docs`` and a last struct column (n_words, n_removed, kept): kept is the words left, joined by one space."""
    key, own, starts, out = fresh(docs, "substring_id", "substring_text", "substring_starts", "substrings")
    keyed = docs.withColumns({key: id_or_least(), own: _text_hashes(text_or_empty())["t1"]})
    gone = covered(keyed, (key, own), window, block_bits).toDF(key, own, starts)

    @F.pandas_udf("struct<n_words:long,n_removed:long,kept:string>")
    def keep(texts, covered_at):
        import pandas as pd

        rows = []
        for text, at in zip(texts, covered_at, strict=True):
            words = text.encode().split()
            if at is None:
                kept = words
            elif len(at) and at[0] < 0:
                kept = []
            else:
                kept = remove(words, np.asarray(at, dtype=np.int64), window)
            rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    joined = keyed.join(gone, [key, own], "left")
    return joined.withColumn(out, keep(text_or_empty(), F.col(f"`{starts}`"))).select(*[F.col(f"`{c}`") for c in docs.columns], out)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "substrings.n_words", "substrings.n_removed", F.sha2(F.col("substrings.kept"), 256).alias("kept_sha256"))


def brute(rows: list[tuple[int | None, str | None]], window: int = 50) -> list[tuple]:
    """The same by the definition, on one machine, for tests."""
    first: dict[tuple, int] = {}
    split = [(NULL_ID if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            first[w] = min(first.get(w, i), i)
    out = []
    for (given, _), (i, words) in zip(rows, split, strict=True):
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((given, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out
