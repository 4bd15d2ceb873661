"""Sorting, indexing, compaction and scans that don't put all rows through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.plans.func import Input


def indexed(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with its place (from 0) in the order of the given columns.

    Rows are dealt out by ranges of the order and numbered inside each range; the ranges' sizes, one short row each, give
    the offsets. Only those rows meet in one task.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    inside = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return inside.join(before, "_range").withColumn(name, (F.col("_before") + F.col("_row") - 1).cast("bigint")).drop("_range", "_row", "_n", "_before")


def dense(source: Input) -> DataFrame:
    """All sites of a series' box, its fill where the table has none."""
    (axis, (a, n)), (value, kind) = next(iter(source.box.items())), next(iter(source.values.items()))
    every = source.df.sparkSession.range(a, a + n).select(F.col("id").alias(axis))
    return every.join(source.df, axis, "left").withColumn(value, F.coalesce(value, F.lit(source.fill).cast(kind.spark())))


def blocked_scan(source: Input, block: int, name: str) -> DataFrame:
    """Running sums: inside blocks in parallel, then each block's start from the blocks' sums."""
    axis, value = next(iter(source.box)), next(iter(source.values))
    df = dense(source).withColumn("_block", F.floor(F.col(axis) / block))
    sums = df.groupBy("_block").agg(F.sum(value).alias("_sum"))
    # One short row for each block.
    starts = sums.select("_block", (F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")).alias("_start"))
    inside = F.sum(value).over(Window.partitionBy("_block").orderBy(axis).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_inside", inside).join(starts, "_block").select(axis, (F.col("_start") + F.col("_inside")).alias(name))


def compact(source: Input, keep: Column, place: str, name: str) -> DataFrame:
    """Coordinates of the sites that are kept, moved together in order."""
    axis = next(iter(source.box))
    return indexed(dense(source).where(keep).select(F.col(axis).alias(name)), place, name)


def equalized(df: DataFrame, value: str, bins: int, name: str) -> DataFrame:
    """Histogram equalization of a column of whole numbers below ``bins``: histogram, running sum, lookup.

    The lookup table has at most ``bins`` rows, so it is broadcast; the rows themselves are never shuffled.
    """
    counts = df.where(F.col(value).between(0, bins - 1)).groupBy(value).agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy())
    running = F.sum("_n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    table = counts.select(value, F.floor(running * (bins - 1) / total).cast("bigint").alias(name))
    return df.join(F.broadcast(table), value)
