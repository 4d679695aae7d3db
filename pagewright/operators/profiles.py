"""Projection histograms, interval merging and what is cut out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Longest histogram that coordinates may ask for.
MAX_EXTENT = 1_000_000


def projection(boxes: DataFrame, axis: str = "x") -> DataFrame:
    """(page, place, n, error): how many boxes cover each integer of an axis. The histogram ends at the largest coordinate, or at the magnitude of the smallest if one is negative; intervals count by absolute values, inverted ones not at all.

    A page whose extent is above MAX_EXTENT gives one row with an error. Only starts and ends are counted and summed up along the axis, so that a long box costs no more rows than a short one until the histogram is written out.
    """
    low, high = F.col(f"{axis}1").cast("bigint"), F.col(f"{axis}2").cast("bigint")
    extent = boxes.groupBy("page").agg(F.least(F.min(low), F.min(high)).alias("least"), F.greatest(F.max(low), F.max(high)).alias("most"))
    extent = extent.select("page", F.when(F.col("least") < 0, -F.col("least")).otherwise(F.col("most")).alias("extent")).where("extent > 0")
    refused = extent.where(F.col("extent") > MAX_EXTENT)
    extent = extent.where(F.col("extent") <= MAX_EXTENT)
    ends = F.array(F.struct(F.col("a").alias("place"), F.lit(1).alias("d")), F.struct(F.col("b").alias("place"), F.lit(-1).alias("d")))
    steps = boxes.select("page", F.abs(low).alias("a"), F.abs(high).alias("b")).where("a < b").select("page", F.explode(ends).alias("s")).select("page", "s.place", "s.d")
    steps = steps.unionByName(extent.select("page", F.lit(0).cast("bigint").alias("place"), F.lit(0).alias("d"))).groupBy("page", "place").agg(F.sum("d").alias("d"))
    order = Window.partitionBy("page").orderBy("place")
    steps = steps.withColumn("n", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.lead("place").over(order))
    runs = steps.join(extent, "page").where("place < extent").withColumn("end", F.least(F.coalesce("after", "extent"), "extent"))
    found = runs.select("page", F.explode(F.sequence("place", F.col("end") - 1)).alias("place"), F.col("n").cast("bigint").alias("n"), F.lit(None).cast("string").alias("error"))
    error = F.concat(F.lit("an extent of "), F.col("extent").cast("string"), F.lit(f" is above {MAX_EXTENT}"))
    return found.unionByName(refused.select("page", F.lit(None).cast("bigint").alias("place"), F.lit(None).cast("bigint").alias("n"), error.alias("error")))


def split_profile(histogram: DataFrame, min_value: int = 0, min_gap: int = 1) -> DataFrame:
    """(page, segment, start, end): runs of values above min_value; a gap splits only if it is wider than min_gap. A run ends at its last index, the last one an index further."""
    order = Window.partitionBy("page").orderBy("place")
    high = histogram.where(F.col("n") > min_value).select("page", "place", F.coalesce(F.col("place") - F.lag("place").over(order) > min_gap, F.lit(False)).cast("int").alias("new"))
    high = high.withColumn("segment", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = high.groupBy("page", "segment").agg(F.min("place").alias("start"), F.max("place").alias("last"))
    final = F.max("segment").over(Window.partitionBy("page")) == F.col("segment")
    return runs.select("page", F.col("segment").cast("bigint").alias("segment"), "start", F.when(final, F.col("last") + 1).otherwise(F.col("last")).alias("end"))


def merge_intervals(boxes: DataFrame, axis: str = "x") -> DataFrame:
    """(page, start, end, members): intervals that touch or overlap become one."""
    rows = boxes.select("page", "idx", F.col(f"{axis}1").alias("low"), F.col(f"{axis}2").alias("high"))
    order = Window.partitionBy("page").orderBy("low", "idx")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.coalesce(F.col("low") > reach, F.lit(True)).cast("int"))
    rows = rows.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("page", "island").agg(F.min("low").alias("start"), F.max("high").alias("end"), F.count("*").alias("members")).drop("island")


def local_minima(histogram: DataFrame) -> DataFrame:
    """(page, start, end): plateaus lower than what stands on either side, without the page's first; the start of the axis counts as higher."""
    order = Window.partitionBy("page").orderBy("place")
    rows = histogram.where("place IS NOT NULL").withColumn("new", F.coalesce(F.col("n") != F.lag("n").over(order), F.lit(True)).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("page", "run").agg(F.min("place").alias("start"), F.max("place").alias("end"), F.first("n").alias("n"))
    by_run = Window.partitionBy("page").orderBy("run")
    lower = runs.withColumn("before", F.lag("n").over(by_run)).withColumn("after", F.lead("n").over(by_run))
    lower = lower.where((F.col("before").isNull() | (F.col("before") > F.col("n"))) & (F.col("after") > F.col("n")))
    return lower.withColumn("k", F.row_number().over(by_run)).where("k > 1").select("page", "start", "end")
