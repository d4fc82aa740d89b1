"""Streams of 3D values: every function is row by row and works on a stream as it is; extents are windowed aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voluma.functions import library


def windowed_extent(stream: DataFrame, value: str, time: str, window: str, late: str, *keys: str) -> DataFrame:
    """The extent of ``value`` by time window (and keys); rows later than ``late`` are left out."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, window), *keys)
    return grouped.agg(library.st_3dextent(F.col(value)).alias("extent"), F.count(value).alias("n"))
