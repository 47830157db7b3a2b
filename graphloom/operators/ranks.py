"""Row numbers without a task that sees all rows of a key.

Rows are range-sorted over all tasks and written; a row's number is its place in its task plus the counts of the
tasks before, of which there is one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written


def numbered(df: DataFrame, *order: Column, to: str = "rank") -> DataFrame:
    """``df`` with each row's number from 1 in the given order."""
    placed = df.orderBy(*order).withColumns({"__task": F.spark_partition_id(), "__row": F.monotonically_increasing_id()})
    fixed = written(placed)
    counts = fixed.groupBy("__task").agg(F.count("*").alias("n"))
    before = counts.select("__task", F.coalesce(F.sum("n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.col("__row") - F.shiftleft(F.col("__task").cast("bigint"), 33) + F.col("__before") + 1
    return fixed.join(F.broadcast(before), "__task").withColumn(to, place).drop("__task", "__row", "__before")  # a row per task


def numbered_within(df: DataFrame, key: str, *order: Column, to: str = "rank") -> DataFrame:
    """Row numbers from 1 within each key, however frequent a key is, and the key's size as ``n``."""
    whole = numbered(df, F.col(key), *order, to="__rank")
    keys = whole.groupBy(key).agg(F.min("__rank").alias("__first"), F.count("*").alias("n"))
    return whole.join(keys, key).withColumn(to, F.col("__rank") - F.col("__first") + 1).drop("__rank", "__first")
