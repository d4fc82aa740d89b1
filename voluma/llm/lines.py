"""Line dedup: lines that many documents hold leave all of them but one.

Method: lines are normalised and exploded as 128-bit hashes, once for each document; an aggregate with
map-side combine counts the documents of each hash; hashes at the threshold are joined back (AQE splits
the hot ones) and gathered by document; the document's own lines are then dropped in place, which
reassembles the rest by position without shuffling a line.

Defined cases: null or empty text is one empty line; each row is a document, so a ``doc_id`` given
twice counts twice and both rows keep their lines where that id is the largest; a key repeated inside a
document counts once there, and all its lines go or stay together; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voluma.llm.common import NULL_ID, cut, fresh, id_or_least, map_rows, read, text_or_empty

_EDGES = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 16-byte hash of the line's key, or None if the key is shorter than ``min_chars`` code points."""
    key = line.strip(_EDGES).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(id, drop): for each document id the hashes of the line keys it loses."""

    def keys(rows: Iterable[dict]) -> Iterator[tuple]:
        for r in rows:
            for key in {line_key(x, min_chars) for x in r["text"].encode().split(b"\n")} - {None}:
                yield r["id"], key

    held = map_rows(docs.select(id_or_least().alias("id"), text_or_empty().alias("text")), "id long, line binary", keys)
    hot = held.groupBy("line").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    hot = cut(hot.select("line", "keeper"))  # a table of its own, so that AQE can split the join's hot lines
    lost = held.join(hot, "line").where(F.col("id") != F.col("keeper"))
    return lost.groupBy("id").agg(F.collect_set("line").alias("drop"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with kept text; three columns more: ``kept_text``, ``n_lines``, ``n_dropped`` (each with '_' appended while its name is taken)."""
    key, kept, n_lines, n_dropped = fresh(docs, "line_dedup_key", "kept_text", "n_lines", "n_dropped")
    lost = shared_lines(docs, min_chars, min_docs).withColumnRenamed("id", key)
    drop, found = fresh(docs, "line_dedup_drop", "line_dedup_found")
    joined = docs.withColumn(key, id_or_least()).join(lost.withColumnRenamed("drop", drop), key, "left").drop(key)

    @F.pandas_udf("struct<kept:string,lines:long,dropped:long>")
    def keep(texts, drops):
        import pandas as pd

        out = []
        for text, gone in zip(texts, drops, strict=True):
            lines = text.encode().split(b"\n")
            if gone is None:
                out.append((text, len(lines), 0))
                continue
            gone = {bytes(x) for x in gone}
            stay = [x for x in lines if line_key(x, min_chars) not in gone]
            out.append((b"\n".join(stay).decode(), len(lines), len(lines) - len(stay)))
        return pd.DataFrame(out, columns=["kept", "lines", "dropped"])

    out = joined.withColumn(found, keep(text_or_empty(), F.col(drop)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(found)["kept"].alias(kept), F.col(found)["lines"].alias(n_lines), F.col(found)["dropped"].alias(n_dropped))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def brute(rows: list[tuple[int | None, str | None]], min_chars: int = 20, min_docs: int = 3) -> list[tuple]:
    """The same by the definition, on one machine, for tests."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = [(NULL_ID if i is None else i, (t or "").split("\n")) for i, t in rows]
    keyed = [[x.strip(" \t\n\x0b\x0c\r").translate(lower) for x in held] for _, held in split]
    holders: dict[str, list[int]] = {}
    for (i, _), keys in zip(split, keyed, strict=True):
        for k in set(keys):
            holders.setdefault(k, []).append(i)
    out = []
    for (given, _), (i, held), keys in zip(rows, split, keyed, strict=True):
        stay = [x for x, k in zip(held, keys, strict=True) if len(k) < min_chars or len(holders[k]) < min_docs or max(holders[k]) == i]
        out.append((given, len(held), len(held) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out
