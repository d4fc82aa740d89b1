"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm.

Documents become token ids and an end id; only documents longer than a sequence are cut, into whole
sequences with the shorter piece first. Whole pieces are sequences of their own. The others are dealt by
hash into blocks of about ``BLOCK`` pieces. Each block is evolved by ``ISLANDS`` islands (rows of their own,
so tasks of their own) from randomised best-fit-decreasing packings: crossover injects whole well-filled
bins of one parent into the other, drops the bins that hold duplicates, and best-fits the displaced pieces in
falling length. Between epochs each island's elite migrates to the next island of its block. Bins that stay
under ``OPEN`` full are opened, and their pieces packed anew across blocks, level after level, so the
blocks' remainders don't add up.

Scale: what moves is one small row a piece; a block's rows are bounded by its hash share; texts and ids are
read once and never shuffled. Every level starts from a table in the shared folder.

Where the first packing, plain best-fit decreasing, already has as few bins as the total length allows, nothing is left
to evolve; the mixed lengths of documents mostly are such a case, hard lengths (a third to a half of a sequence) are not.

Defined cases: a null or empty text is the end id alone; very long texts are cut, none is dropped; equal texts are packed each; rows that share a
``doc_id`` are packed each; extra columns are left out; an empty table gives no sequences.
"""

from __future__ import annotations

import base64
import bisect
import random
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voluma.llm.common import NULL_ID, cut, id_or_least, map_rows, read, text_or_empty

CAPACITY = 2048
BLOCK = 4096
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 12
POPULATION = 6
#: Few pieces get more generations: this number divided by theirs.
SMALL = 4000
#: Bins filled less than this share are opened and packed anew at the next level.
OPEN = 0.97
_MOST_LEVELS = 6
#: Letters and marks up to here are the same classes in both tokenizer libraries.
_PLAIN = re.compile("[^\u0000-ɏ‐-‧€]")
#: The byte-level pattern of the vocabulary, in its possessive form (fixed value).
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def encoder(json_path: str | None = None, ranks_path: str | None = None):
    """text -> ids as the JSON tokenizer gives them; the rank file of the same vocabulary serves plain Latin text faster."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        return whole.encode(text, add_special_tokens=False).ids if _PLAIN.search(text) else fast.encode_ordinary(text)

    return encode


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``length`` tokens."""
    first = length % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def run(rows: Iterable[dict]) -> Iterator[tuple]:
        encode = encoder(json_path, ranks_path)
        for r in rows:
            ids = np.array([*encode(r["text"]), end_id], dtype="<u4")
            for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                yield r["id"], k, start, length, zlib.crc32(ids[start : start + length].tobytes())

    known = docs.select(id_or_least().alias("id"), text_or_empty().alias("text"))
    return map_rows(known, "doc_id long, piece int, start long, length long, ids_crc32 long", run)


def best_fit(sizes: list[int], items: Iterable[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """``bins`` with ``items``, in their order, each in the fullest bin that takes it."""
    free = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in items:
        at = bisect.bisect_left(free, (sizes[i], -1))
        if at < len(free):
            room, k = free.pop(at)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        bisect.insort(free, (room - sizes[i], k))
    return bins


def fitness(sizes: list[int], bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the mean square of their fill."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(sizes: list[int], mother: list[list[int]], father: list[list[int]], capacity: int, chance: random.Random) -> list[list[int]]:
    """Well-filled bins of ``father`` whole, those of ``mother`` that hold none of their items, and the rest best-fitted."""
    ranked = sorted(father, key=lambda b: -sum(sizes[i] for i in b))
    injected = [list(b) for b in ranked[: max(1, len(ranked) // 2)] if chance.random() < 0.5] or [list(ranked[0])]
    taken = {i for b in injected for i in b}
    clean = [list(b) for b in mother if taken.isdisjoint(b)]
    placed = taken.union(*clean) if clean else taken
    displaced = sorted((i for b in mother for i in b if i not in placed), key=lambda i: -sizes[i])
    # a few of the worst bins are opened too, so that a child may lose one
    clean.sort(key=lambda b: -sum(sizes[i] for i in b))
    while clean and chance.random() < 0.7:
        displaced += clean.pop()
    blur = chance.choice((0.0, 0.0, 0.1, 0.3)) * capacity
    displaced.sort(key=lambda i: -sizes[i] + chance.random() * blur)
    return best_fit(sizes, displaced, injected + clean, capacity)


def evolve(sizes: list[int], elites: list[list[int]], capacity: int, seed: int) -> list[int]:
    """The bin of each item after some generations; ``elites`` are packings in the same form."""
    chance = random.Random(seed)
    least = -(-sum(sizes) // capacity)
    population = []
    for e in elites:
        bins: dict[int, list[int]] = {}
        for i, b in enumerate(e):
            bins.setdefault(b, []).append(i)
        population.append(list(bins.values()))
    while len(population) < POPULATION:
        blur = 0.05 * len(population) * capacity if population else 0  # the first packing is plain best-fit decreasing
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i] + chance.random() * blur)
        population.append(best_fit(sizes, order, [], capacity))
        if len(population[-1]) == least:
            break
    score = lambda bins: fitness(sizes, bins, capacity)
    population.sort(key=score, reverse=True)
    for _ in range(GENERATIONS + SMALL // (len(sizes) + 1)):
        if len(population[0]) == least or len(population) < 2:
            break
        children = [crossover(sizes, *chance.sample(population, 2), capacity, chance) for _ in range(POPULATION // 2)]
        apart = {score(bins): bins for bins in population + children}  # packings of equal fill count once, or the population becomes one
        population = [apart[s] for s in sorted(apart, reverse=True)[:POPULATION]]
    out = [0] * len(sizes)
    for k, b in enumerate(population[0]):
        for i in b:
            out[i] = k
    return out


def _solve(blocks: DataFrame, capacity: int, count: int) -> DataFrame:
    """(block, items, sizes, solution): each of ``count`` blocks' best packing, evolved on islands with migration."""
    schema = "block long, island int, bins int, fill double, solution array<int>"

    def epoch(number: int):
        def run(rows: Iterable[dict]) -> Iterator[tuple]:
            for r in rows:
                sizes = r["sizes"]
                elites = sorted(r["elites"] or [], key=lambda e: e["island"])
                own = [e["solution"] for e in elites if e["island"] == r["island"]]
                own += [elites[(k - 1) % len(elites)]["solution"] for k, e in enumerate(elites) if e["island"] == r["island"]]
                found = evolve(sizes, own, capacity, seed=hash((r["block"], r["island"], number)))
                bins: dict[int, int] = {}
                for i, b in enumerate(found):
                    bins[b] = bins.get(b, 0) + sizes[i]
                yield r["block"], r["island"], len(bins), sum((x / capacity) ** 2 for x in bins.values()), found

        return run

    islands = F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)]))
    elites = None
    for number in range(EPOCHS):
        fed = blocks.withColumn("elites", F.lit(None).cast("array<struct<island:int,solution:array<int>>>")) if elites is None else blocks.join(elites, "block")
        fed = fed.select("block", "sizes", "elites", islands.alias("island")).repartition(count * ISLANDS, "block", "island")  # by number: small rows with much work are not to be coalesced
        evolved = cut(map_rows(fed, schema, epoch(number), out_rows=8))
        elites = evolved.groupBy("block").agg(F.collect_list(F.struct("island", "solution")).alias("elites"))
    best = evolved.groupBy("block").agg(F.min_by("solution", F.struct("bins", -F.col("fill"), "island")).alias("solution"))
    return blocks.join(best, "block")


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(item, sequence_id, offset) for items (item, length) of less than ``capacity``; item is a unique long."""
    done, rest = [], cut(items.select("item", F.col("length").cast("int").alias("length")))
    n = rest.count()
    for level in range(_MOST_LEVELS):
        count = max(1, -(-n // BLOCK))
        dealt = rest.withColumn("block", F.expr(f"pmod(xxhash64(item, {level}), {count})"))
        blocks = cut(dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("length", "item"))).alias("x")).select("block", F.col("x.item").alias("items"), F.col("x.length").alias("sizes")))
        each = _solve(blocks, capacity, count).select("block", F.explode(F.arrays_zip("items", "sizes", "solution")).alias("x")).select("block", "x.*")
        bins = each.groupBy("block", "solution").agg(F.sort_array(F.collect_list(F.struct("items", "sizes"))).alias("x"), F.sum("sizes").alias("fill"))
        bins = bins.withColumn("sequence_id", F.lit(level << 56) + F.col("block") * (1 << 20) + F.col("solution"))
        bins = cut(bins.select("sequence_id", "fill", "x"))
        opened = (F.col("fill") < OPEN * capacity) & F.lit(count > 1 and level + 1 < _MOST_LEVELS)
        left = bins.where(opened).agg(F.coalesce(F.sum(F.size("x")), F.lit(0))).first()[0]
        if left > 0.8 * n:
            opened, left = F.lit(False), 0
        done.append(bins.where(~opened))
        if not left:
            break
        rest, n = bins.where(opened).select(F.explode("x").alias("x")).select(F.col("x.items").alias("item"), F.col("x.sizes").alias("length")), left
    spread = reduce(DataFrame.unionByName, done).select("sequence_id", F.posexplode("x").alias("at", "one"), "x")
    before = F.aggregate(F.slice(F.col("x.sizes"), F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda a, s: a + s)
    return spread.select(F.col("one.items").alias("item"), "sequence_id", before.alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, **tokenizer) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    numbered = cut(pieces(docs, capacity, **tokenizer).withColumn("item", F.monotonically_increasing_id()))  # the numbers are fixed as written
    numbered = numbered.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
    whole = numbered.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    part = numbered.where(F.col("length") < capacity)
    packed = part.join(pack(part.select("item", "length"), capacity), "item")
    return packed.unionByName(whole).drop("item")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
