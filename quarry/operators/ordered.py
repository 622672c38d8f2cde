"""Running totals over one sequence that no task holds whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.state import stored


def running_total(df: DataFrame, order: Sequence[str | Column], value: Column, name: str = "total") -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows up to this one in the order.

    Rows are dealt to tasks by ranges of the order and stored, so that each range keeps its number; the sums of the ranges,
    one row a task, give each its start. Rows that are equal in the order share no place, so order by enough columns.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = stored(df.select("*", value.alias("_value")).repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    before = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"))  # a row a task
    inside = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.withColumn("_in", F.sum("_value").over(inside)).join(F.broadcast(before), "_range").withColumn(name, F.col("_in") + F.col("_before")).drop("_range", "_value", "_in", "_before")


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "number") -> DataFrame:
    """``df`` with the place of each row in the order, from 1."""
    return running_total(df, order, F.lit(1).cast("long"), name)
