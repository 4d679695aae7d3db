"""Spatial joins. The page is always an equi-key, so that Spark hashes or sorts by page and box tests stay residual."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import geometry as g
from pagewright.functions import labels

BOX = ("x1", "y1", "x2", "y2")


def prefixed(boxes: DataFrame, prefix: str) -> DataFrame:
    """All columns but page with a prefix."""
    return boxes.select("page", *[F.col(c).alias(prefix + c) for c in boxes.columns if c != "page"])


def pairs(boxes: DataFrame) -> DataFrame:
    """Each two boxes of a page, a_idx < b_idx."""
    return prefixed(boxes, "a_").join(prefixed(boxes, "b_"), "page").where("a_idx < b_idx")


def spans_in_blocks(spans: DataFrame, blocks: DataFrame, pixels: float = 3.0) -> DataFrame:
    """(page, block_idx, span_idx): spans that overlap a block by more than so many pixels each way, but for labels that take none."""
    b = prefixed(blocks.where(~F.col("label").isin(*labels.NO_SPANS)), "block_")
    s = prefixed(spans, "span_")
    return b.join(s, "page").where(g.overlaps_by(g.box("span_"), g.box("block_"), pixels)).select("page", "block_idx", "span_idx").distinct()


def spans_by_objects(spans: DataFrame, objects: DataFrame, within: bool, pixels: float = 3.0) -> DataFrame:
    """Spans that overlap some object of their page (within), or none."""
    o = prefixed(objects, "object_")
    on = (spans["page"] == o["page"]) & g.overlaps_by(g.Box(*(spans[c] for c in BOX)), g.box("object_"), pixels)
    return spans.join(o, on, "left_semi" if within else "left_anti")


def crop_to_table(boxes: DataFrame, tables: DataFrame) -> DataFrame:
    """Boxes that lie wholly in a table, edges included, in the table's coordinates; others are dropped, never clipped."""
    t = prefixed(tables, "table_")
    inside = boxes.join(t, "page").where(g.within(g.box(), g.box("table_")))
    moved = [(F.col(c) - F.col(f"table_{c[0]}1")).alias(c) for c in BOX]
    return inside.select("page", "table_idx", "idx", *moved)


def match_cells(cells: DataFrame, texts: DataFrame, share: float = 0.7) -> DataFrame:
    """(page, row, position, idx): texts of which more than the share lies in a cell; position counts the cells of a row from 0."""
    place = Window.partitionBy("page", "row").orderBy("pos")
    c = cells.select("page", "row", (F.row_number().over(place) - 1).alias("position"), *[F.col(k).alias(f"cell_{k}") for k in BOX])
    return c.join(texts.select("page", "idx", *BOX), "page").where(g.over_second(g.box("cell_"), g.box()) > share).select("page", "row", "position", "idx")


def neighbours(blocks: DataFrame, horizontal: bool = True, share: float = 0.1) -> DataFrame:
    """(page, idx, side, rank, other): blocks whose projections overlap by more than the share of the smaller; side prev or post by where they start, nearest first."""
    a, b = prefixed(blocks, "a_"), prefixed(blocks, "b_")
    ratio = (g.projection_x if horizontal else g.projection_y)(g.box("a_"), g.box("b_"), True)
    start = "y1" if horizontal else "x1"
    near = a.join(b, "page").where((F.col("a_idx") != F.col("b_idx")) & (ratio > share))
    before = F.col(f"b_{start}") <= F.col(f"a_{start}")
    near = near.select("page", F.col("a_idx").alias("idx"), F.when(before, "prev").otherwise("post").alias("side"), F.col(f"b_{start}").alias("at"), F.col("b_idx").alias("other"))
    order = Window.partitionBy("page", "idx", "side").orderBy(F.when(F.col("side") == "prev", -F.col("at")).otherwise(F.col("at")), "other")
    return near.select("page", "idx", "side", F.row_number().over(order).alias("rank"), "other")


def align_rows(flags: DataFrame, starts: DataFrame) -> DataFrame:
    """(page, row, start, aligned): the largest flag not past each start; the start itself if there is none."""
    joined = starts.join(flags, (starts["page"] == flags["page"]) & (flags["flag"] <= starts["start"]), "left")
    return joined.groupBy(starts["page"], starts["row"], starts["start"]).agg(F.max("flag").alias("flag")).select("page", "row", "start", F.coalesce("flag", "start").alias("aligned"))


def absorbed(detections: DataFrame, ignored: DataFrame, share: float = 0.5) -> DataFrame:
    """Detections of which more than the share lies in some ignored region."""
    i = prefixed(ignored, "gt_")
    on = (detections["page"] == i["page"]) & (g.over_second(g.box("gt_"), g.Box(*(detections[c] for c in BOX))) > share)
    return detections.join(i, on, "left_semi")
