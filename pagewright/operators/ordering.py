"""Orders and numberings that windows express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import geometry as g
from pagewright.functions import labels
from pagewright.functions.numbers import five_places


def plain_block_order(boxes: DataFrame, line_height: float = 10.0, line_width: float = 20.0, vertical: bool = False) -> DataFrame:
    """(page, pos, idx): by text-line cells (floor division), then by the squared centre distance from the origin; vertical pages go from right to left."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    row, column = F.floor(F.col("y1") / line_height), F.floor(F.col("x1") / line_width)
    keys = [F.floor(-F.col("x2") / line_width), row, cy * cy - cx * cx] if vertical else [row, column, cx * cx + cy * cy]
    return boxes.select("page", (F.row_number().over(Window.partitionBy("page").orderBy(*keys, "idx")) - 1).alias("pos"), "idx")


def batch_plan(crops: DataFrame, size: int = 6, height: int = 48, base_width: int = 320) -> DataFrame:
    """(page, idx, batch, slot, crop_width, batch_width): crops by aspect (stable), in batches; the batch width truncates, a crop's width is rounded up within it."""
    rank = F.row_number().over(Window.partitionBy("page").orderBy("aspect", "idx")) - 1
    rows = crops.select("page", "idx", (F.col("w") / F.col("h")).alias("aspect")).withColumn("rank", rank)
    rows = rows.withColumn("batch", F.floor(F.col("rank") / size).cast("int")).withColumn("slot", (F.col("rank") % size).cast("int"))
    widest = F.greatest(F.max("aspect").over(Window.partitionBy("page", "batch")), F.lit(base_width / height))
    rows = rows.withColumn("batch_width", (widest * height).cast("bigint"))
    return rows.select("page", "idx", "batch", "slot", F.least(F.ceil(F.col("aspect") * height), F.col("batch_width")).cast("bigint").alias("crop_width"), "batch_width")


def top_classes(scores: DataFrame, key: str, k: int = 5) -> DataFrame:
    """(key, rank, class, score): highest first; of equal scores the higher class; rounded to five places in single precision."""
    rows = scores.select(key, F.posexplode("scores").alias("class", "raw"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("raw"), F.desc("class")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "rank", "class", five_places(F.col("raw")).alias("score"))


def order_index(blocks: DataFrame) -> DataFrame:
    """order_index counts from 1 over numbered labels of a page; null for others."""
    shown = F.col("label").isin(*labels.NUMBERED)
    running = F.sum(shown.cast("int")).over(Window.partitionBy("page").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("order_index", F.when(shown, running))


def nth_table(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Each table block with the html of the page's n-th table; empty if there are fewer."""
    n = lambda: F.row_number().over(Window.partitionBy("page").orderBy("idx"))
    left = blocks.where("label = 'table'").select("page", "idx", n().alias("n"))
    return left.join(tables.select("page", "html", n().alias("n")), ["page", "n"], "left").select("page", "idx", "n", F.coalesce("html", F.lit("")).alias("html"))


def first_seen(rows: DataFrame, key: str, value: Column, position: str) -> DataFrame:
    """(key, pos, value): distinct values by where they come first; nulls left out."""
    firsts = rows.select(key, value.alias("value"), position).where("value IS NOT NULL").groupBy(key, "value").agg(F.min(position).alias("at"))
    return firsts.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1).alias("pos"), "value")


def restore_order(planned: DataFrame) -> DataFrame:
    """(page, pos, batch, slot) of a batch plan: where the result of each crop is, in the order in which the crops came."""
    return planned.select("page", (F.row_number().over(Window.partitionBy("page").orderBy("idx")) - 1).alias("pos"), "batch", "slot")


def line_places(lines: DataFrame, tall: float = 2.0, normal: float = 1.1, share: float = 0.4, column: float = 2.0) -> DataFrame:
    """(page, idx, widest, kept, place): the widest line up to each; whether a line stays when tall lines go; and its place by column, then top.

    Tall lines go if the tallest is more than twice the lowest and fewer than the share of the lines are about as low as
    the lowest (under 1.1 times).
    """
    whole, upto = Window.partitionBy("page"), Window.partitionBy("page").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    b = g.box()
    h = b.y2 - b.y1
    rows = lines.select("page", "idx", "x1", "y1", h.alias("h"), F.max(b.x2 - b.x1).over(upto).alias("widest"), F.max(h).over(whole).alias("most"), F.min(h).over(whole).alias("low"), F.count("*").over(whole).alias("n"))
    rows = rows.withColumn("usual", F.sum((F.col("h") < normal * F.col("low")).cast("int")).over(whole))
    goes = (F.col("most") > tall * F.col("low")) & (F.col("usual") < share * F.col("n")) & (F.col("h") > normal * F.col("low"))
    place = F.row_number().over(Window.partitionBy("page").orderBy(F.floor(F.col("x1") / column), "y1", "idx"))
    return rows.select("page", "idx", "widest", (~goes).alias("kept"), place.alias("place"))


def page_frames(boxes: DataFrame, line_height: float = 10.0, line_width: float = 20.0) -> DataFrame:
    """(page, x1, y1, x2, y2, most, lowest, horizontal, line_height, line_width): the hull of a page's boxes, the largest area, the lowest edge of a text, whether at least half lie flat, and the mean size of texts (the defaults without any)."""
    b, text = g.box(), F.col("label") == "text"
    w, h = b.x2 - b.x1, b.y2 - b.y1
    mean = lambda side, without: F.coalesce(F.avg(F.when(text, side)), F.lit(without))
    return boxes.groupBy("page").agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.max(g.area(b)).alias("most"), F.max(F.when(text, b.y2)).alias("lowest"),
        (F.sum((w >= h).cast("int")) * 2 >= F.count("*")).alias("horizontal"), mean(h, line_height).alias("line_height"), mean(w, line_width).alias("line_width"),
    )
