"""Shapes made of a small file are never broadcast by a grid join."""

from pyspark.sql import functions as F

from voluma.functions import library as lib
from voluma.operators.joins import dwithin_join, intersects_join


def test_grid_joins(spark, tmp_path):
    spark.range(20).write.parquet(f"{tmp_path}/keys")
    words = F.concat(F.lit("POINT Z ("), F.col("id"), F.lit(" 0 0)"))
    shapes = spark.read.parquet(f"{tmp_path}/keys").select("id", lib.call("st_3dgeomfromtext", words).alias("g"))
    for joined in (dwithin_join(shapes, shapes, 1.0, distinct_pairs=True, cell=4.0), intersects_join(shapes, shapes, cell=4.0)):
        shown = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in shown and "Broadcast" not in shown
