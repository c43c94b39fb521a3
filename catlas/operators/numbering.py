"""Consecutive numbers for the rows of a frame in a global order, without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catlas.storage import materialize


def numbered(rows: DataFrame, *order: str | Column, out: str = "place") -> DataFrame:
    """`rows` with `out`, 1 for the first in `order`.

    Rows are dealt to ranges of the order, each range is sorted where it lies,
    and the numbers of rows in the ranges before it are added. The order must be
    total but for rows that are alike. One row per range is summed in one task.
    """
    at, before = f"__range_{out}", f"__before_{out}"
    ranged = materialize(rows.repartitionByRange(*order).withColumn(at, F.spark_partition_id()), "ranges")  # so that ranges stay what they are
    counts = ranged.groupBy(at).agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.orderBy(at))
    starts = counts.select(at, (upto - F.col("__n")).alias(before))
    placed = ranged.join(F.broadcast(starts), at)  # one row per shuffle partition
    number = (F.col(before) + F.row_number().over(Window.partitionBy(at).orderBy(*order))).cast("long")
    return placed.withColumn(out, number).drop(at, before)
