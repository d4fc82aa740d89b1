"""What the training-data operators share: reading, cutting lineage, naming, Arrow plumbing.

Conventions that hold for every operator in this package
--------------------------------------------------------
* A document is a row. Columns are taken by name; columns an operator does not know pass through
  (where whole rows are returned) or are left out (where a digest is returned).
* A null text is the empty text. A null identifier is the smallest identifier.
* An empty table gives an empty result with the same schema.
* Arrow batches have ``ARROW_ROWS`` rows at most: the session's ``spark.sql.execution.arrow.maxRecordsPerBatch`` is lowered
  to that and stays so, because what an operator returns runs after it has returned. The session's bound of 64 MB a batch
  is not enough where a task has a Python worker beside a JVM of little memory.
* Intermediate tables lie in the shared folder; inside ``scratch`` they are deleted at its end.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; with documents of a few KB that is a few MB at a time.
ARROW_ROWS = 1000
#: The identifier that stands for null inside the operators.
NULL_ID = -(1 << 63)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it; a temporary one in local tests."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="voluma-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


#: The folder of the innermost ``scratch``, if there is one.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared storage."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for the tables cut inside, deleted at the end; what is computed from them must be written by then."""
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)
        delete(spark, folder)


def cut(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """The same rows read back from a table in the shared folder: lineage ends there, and its size is known to the planner.

    ``instead_of`` is a table cut before that is not needed any more.
    """
    spark = df.sparkSession
    path = f"{_scratch.get() or shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if instead_of is not None and hasattr(instead_of, "cut_path"):
        delete(spark, instead_of.cut_path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def by_merge(df: DataFrame) -> DataFrame:
    """``df`` for a join that sorts and merges, never broadcasts: the planner can't tell how many rows a Python function or an explode makes of a small file."""
    return df.hint("merge")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ARROW_ROWS rows unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def cut_with(df: DataFrame, aggregates: list[Column], instead_of: DataFrame | None = None) -> tuple[DataFrame, list]:
    """``cut`` and the aggregates of the table, taken while it is written: no scan and no job more."""
    seen = Observation()
    out = cut(df.observe(seen, *[a.alias(f"a{k}") for k, a in enumerate(aggregates)]), instead_of)
    return out, [seen.get[f"a{k}"] for k in range(len(aggregates))]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names starting with ``names`` that ``df`` does not have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_or_least(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("long"), F.lit(NULL_ID))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def map_rows(df: DataFrame, schema: str, rows: Callable[[Iterable[dict]], Iterator[tuple]], out_rows: int = 4096) -> DataFrame:
    """``mapInArrow`` over rows as dicts; ``rows`` yields tuples in the order of ``schema``, which leave in bounded batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def source() -> Iterator[dict]:
            for batch in batches:
                names = batch.schema.names
                for start in range(0, batch.num_rows, 256):
                    columns = [c.to_pylist() for c in batch.slice(start, 256).columns]
                    for values in zip(*columns, strict=True):
                        yield dict(zip(names, values, strict=True))

        held: list[tuple] = []
        for row in rows(source()):
            held.append(row)
            if len(held) >= out_rows:
                yield as_batch(held, arrow)
                held = []
        if held:
            yield as_batch(held, arrow)

    return df.mapInArrow(run, schema)


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
