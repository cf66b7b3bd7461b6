"""Positions in one global order, without moving all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaforge.session import cut


def with_position(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """``df`` with its 0-based position in the order of the columns given, which should be unique together.

    Rows are range-partitioned by the order; each partition numbers its own rows and adds the number of rows in the
    partitions before it, which a small table of counts gives.
    """
    spread = cut(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_pid", F.spark_partition_id()))
    counts = spread.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_pid").orderBy(*order)) - 1
    return spread.withColumn("_in", inside).join(before, "_pid").withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_pid", "_in", "_before")


def running_total(df: DataFrame, value: str, *order: str, name: str = "total_before") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before it in the global order; partitioned as ``with_position``."""
    spread = cut(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_pid", F.spark_partition_id()))
    sums = spread.groupBy("_pid").agg(F.sum(value).alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spread.withColumn("_in", inside).join(before, "_pid").withColumn(name, F.col("_before") + F.col("_in")).drop("_pid", "_in", "_before")
