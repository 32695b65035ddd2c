"""Ranks of rows in an order, dump by dump, without a task that orders a whole dump."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import written


def ranked(df: DataFrame, *order: Column | str, top: int | None = None) -> DataFrame:
    """df with rank, from 1 in each dump_id; with top, only so many of each.

    Rows are dealt to ranges of the order, sorted there and written with the range that they lie in; a row's rank is its place in
    its range and the number of rows in the dump's ranges before. The first few of each dump need no such table: Spark cuts
    every task's rows to them first."""
    if top is not None:
        place = F.row_number().over(Window.partitionBy("dump_id").orderBy(*order)).cast("long")
        return df.withColumn("rank", place).filter(F.col("rank") <= top)
    dealt = df.repartitionByRange("dump_id", *order).sortWithinPartitions("dump_id", *order)
    dealt = written(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    before = Window.partitionBy("dump_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("dump_id", "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    ranges = ranges.select("dump_id", "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = dealt.join(ranges, ["dump_id", "_range"])
    return out.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("rank"))
