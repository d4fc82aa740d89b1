"""A training-data pipeline: quality filter, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on every document its predecessor kept, and returns a
DataFrame that ``run`` writes as Parquet to the shared folder and reads again as the next stage's documents.
All but the last return the columns of documents. It is deleted together with the folder it builds on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voluma.llm.common import delete, read, scratch, shared_dir
from voluma.llm.lines import dedup_lines
from voluma.llm.mixing import mix
from voluma.llm.nearcopies import drop_near_copies
from voluma.llm.packing import pack_documents
from voluma.llm.quality import keep_good

#: Some stages draw on hashes and trained scores that SQL cannot express; tests hold run() against the stages' brute-force versions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that three or more share (the largest doc_id keeps them); n_chars follows the text."""
    deduped = dedup_lines(docs)
    kept = deduped.columns[len(docs.columns)]
    columns = {"text": F.col(kept).alias("text"), "n_chars": F.length(kept).cast("long").alias("n_chars")}
    return deduped.select(*[columns.get(c, F.col(f"`{c}`")) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies, five-word Jaccard 0.8 or more."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the tempered source, language and topic shares."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage leaves behind is deleted once the next one is written."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
