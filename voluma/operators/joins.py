"""Spatial joins: a grid of cells, an equi-join, a native box test, then the exact function.

Both sides are laid into XY cells; rows meet in every cell both touch, and a pair is kept only in the cell
that holds the low corner of its boxes' overlap, so no pair is lost or repeated and no distinct is needed.
Only ids and boxes take part in that; the shapes are joined to the pairs that the box test leaves, so the
large columns move once and AQE can split a crowded cell. Joins sort and merge: the planner judges shapes that a
function makes by the small file that they come from, and would broadcast all of them by way of the driver. Rows without a box never match. Ids must be unique on each
side: pairs find their shapes by id, so an id given twice would meet with each of its shapes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voluma.functions import library

#: A box that touches more cells than this is laid into a coarser grid of its own.
MOST_CELLS = 64


def cell_size(df: DataFrame, value: str, reach: float) -> float:
    """About the usual extent of a box, by an aggregate, and the reach."""
    box = F.col(value)["bbox"]
    extent = df.agg(F.percentile_approx(F.greatest(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"]), 0.9, 1000)).first()[0]
    return max((extent or 0.0) + reach, 1e-9, reach)


def _cells(df: DataFrame, prefix: str, reach: float, cell: float) -> DataFrame:
    """A row for each cell that a box touches, at the level whose cells are at least its size."""
    low = {a: F.floor((F.col(f"{prefix}_box")[f"min_{a}"] - reach) / F.col("size")) for a in "xy"}
    high = {a: F.floor((F.col(f"{prefix}_box")[f"max_{a}"] + reach) / F.col("size")) for a in "xy"}
    sized = df.withColumn("size", F.lit(cell) * F.pow(F.lit(float(math.isqrt(MOST_CELLS))), F.col("level")))
    sized = sized.withColumn("cx", F.explode(F.sequence(low["x"], high["x"])))
    return sized.withColumn("cy", F.explode(F.sequence(low["y"], high["y"])))


def box_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_value: str, right_value: str, reach: float = 0.0, cell: float | None = None) -> DataFrame:
    """(l_id, r_id) of the pairs whose boxes are at most ``reach`` apart."""
    cell = cell or max(cell_size(left, left_value, reach), cell_size(right, right_value, reach))
    a = left.select(F.col(left_id).alias("l_id"), F.col(left_value)["bbox"].alias("l_box")).where("l_box is not null")
    b = right.select(F.col(right_id).alias("r_id"), F.col(right_value)["bbox"].alias("r_box")).where("r_box is not null")
    step = math.isqrt(MOST_CELLS)

    def level(prefix: str) -> Column:
        box = F.col(f"{prefix}_box")
        extent = F.greatest(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"], F.lit(cell))
        return F.greatest(F.lit(0), F.ceil(F.log(extent / F.lit(cell * (step - 1))) / math.log(step))).cast("int")

    a, b = a.withColumn("own", level("l")), b.withColumn("own", level("r"))
    highest = a.select("own").union(b.select("own")).agg(F.max("own")).first()[0] or 0  # a level for each power of the step, a handful
    a = _cells(a.withColumn("level", F.explode(F.sequence(F.col("own"), F.lit(highest)))), "l", reach, cell)
    b = _cells(b.withColumn("level", F.explode(F.sequence(F.col("own"), F.lit(highest)))), "r", 0.0, cell)
    met = a.withColumnRenamed("own", "l_own").join(b.drop("size").withColumnRenamed("own", "r_own").hint("merge"), ["level", "cx", "cy"])
    first = F.lit(True)
    for axis in "xy":
        corner = F.greatest(F.col("l_box")[f"min_{axis}"] - reach, F.col("r_box")[f"min_{axis}"])
        first &= F.floor(corner / F.col("size")) == F.col(f"c{axis}")
    gap = library.bbox_gap2(F.struct(F.col("l_box").alias("bbox")), F.struct(F.col("r_box").alias("bbox")))
    meeting = F.col("level") == F.greatest("l_own", "r_own")
    return met.where(meeting & first & (gap <= F.lit(float(reach) * float(reach)) * (1 + 1e-12))).select("l_id", "r_id")


def _refined(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_value: str, right_value: str, pairs: DataFrame, test: Column) -> DataFrame:
    a = left.select(F.col(left_id).alias("l_id"), F.col(left_value).alias("l_value"))
    b = right.select(F.col(right_id).alias("r_id"), F.col(right_value).alias("r_value"))
    return pairs.join(a.hint("merge"), "l_id").join(b.hint("merge"), "r_id").where(test).select("l_id", "r_id")


def dwithin_join(left: DataFrame, right: DataFrame, distance: float, left_id: str = "id", right_id: str = "id", left_value: str = "g", right_value: str = "g", distinct_pairs: bool = False, cell: float | None = None) -> DataFrame:
    """(l_id, r_id) of the values at most ``distance`` apart; ``distinct_pairs`` keeps l_id < r_id, for a join of a table with itself."""
    pairs = box_pairs(left, right, left_id, right_id, left_value, right_value, distance, cell)
    pairs = pairs.where("l_id < r_id") if distinct_pairs else pairs
    return _refined(left, right, left_id, right_id, left_value, right_value, pairs, library.call("st_3ddwithin", "l_value", "r_value", F.lit(float(distance))))


def intersects_join(left: DataFrame, right: DataFrame, left_id: str = "id", right_id: str = "id", left_value: str = "g", right_value: str = "g", distinct_pairs: bool = False, cell: float | None = None) -> DataFrame:
    """(l_id, r_id) of the values that share a point."""
    pairs = box_pairs(left, right, left_id, right_id, left_value, right_value, 0.0, cell)
    pairs = pairs.where("l_id < r_id") if distinct_pairs else pairs
    return _refined(left, right, left_id, right_id, left_value, right_value, pairs, library.call("st_3dintersects", "l_value", "r_value"))
