"""Order-dependent operators as folds over a page's sorted boxes.

A page's boxes are collected and sorted once (a page is a bounded group); what depends on what came before is the
accumulator of an aggregate() in the same row, so that no page is dealt out again. Accumulators are copied at each step, so
time goes with the square of a page's boxes: meant for pages of some thousands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import geometry as g

BOX_TYPE = "struct<idx:int,x1:double,y1:double,x2:double,y2:double,score:double,label:string>"


def page_boxes(boxes: DataFrame, *order: Column) -> DataFrame:
    """(page, boxes): a page's boxes as an array sorted by the given keys, then idx."""
    box = F.struct(F.col("idx").cast("int").alias("idx"), *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2", "score")), F.col("label").alias("label"))
    keys = [k.alias(f"k{i}") for i, k in enumerate(order)]
    rows = F.array_sort(F.collect_list(F.struct(*keys, F.col("idx").cast("int").alias("k"), box.alias("box"))))
    return boxes.groupBy("page").agg(F.transform(rows, lambda r: r["box"]).alias("boxes"))


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def suppress(boxes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(page, pos, idx): greedy suppression by score; of equal scores the highest index goes first; a box stays unless its IoU with a kept one is above the threshold."""
    paged = page_boxes(boxes, -F.col("score"), -F.col("idx"))
    kept = F.aggregate(
        "boxes", _empty(BOX_TYPE),
        lambda kept, b: F.when(F.exists(kept, lambda k: g.iou(g.box_of(k), g.box_of(b)) > threshold), kept).otherwise(F.array_append(kept, b)),
    )
    return paged.select("page", F.posexplode(kept).alias("pos", "b")).select("page", "pos", F.col("b.idx").alias("idx"))


def drop_overlaps(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(page, idx) of boxes that stay: of two whose overlap is above the threshold of the smaller area the smaller one goes (the first if equal), but an image goes before anything else. A box that went no longer counts; pairs are taken in index order."""
    paged = page_boxes(boxes)
    stays = lambda gone, b: ~F.array_contains(gone, b["idx"])
    drop = lambda a: lambda gone, b: F.when(stays(gone, a) & stays(gone, b) & (g.overlap_small(g.box_of(a), g.box_of(b)) > threshold), F.array_append(gone, _loser(a, b))).otherwise(gone)
    gone = F.aggregate(
        "boxes", _empty("int"),
        lambda gone, a: F.when(stays(gone, a), F.aggregate(F.filter("boxes", lambda b: b["idx"] > a["idx"]), gone, drop(a))).otherwise(gone),
    )
    paged = paged.select("page", "boxes", gone.alias("gone"))
    return paged.select("page", F.explode(F.filter("boxes", lambda b: ~F.array_contains("gone", b["idx"]))).alias("b")).select("page", F.col("b.idx").alias("idx"))


def _loser(a: Column, b: Column) -> Column:
    image_a, image_b = a["label"] == "image", b["label"] == "image"
    smaller = F.when(g.area(g.box_of(a)) <= g.area(g.box_of(b)), a["idx"]).otherwise(b["idx"])
    return F.when(image_a & ~image_b, a["idx"]).when(image_b & ~image_a, b["idx"]).otherwise(smaller)


def cell_rows(boxes: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """(page, row, pos, idx): cells by top edge, in rows of tops within the tolerance of the row's first; in a row by left edge. pos counts a page's cells in that order."""
    paged = page_boxes(boxes, F.col("y1"))
    state = F.struct(F.lit(-1).alias("row"), F.lit(0.0).cast("double").alias("top"), _empty("struct<row:int,x1:double,at:int,idx:int>").alias("cells"))
    rows = F.aggregate(
        "boxes", state,
        lambda acc, b: _with_row(acc, b, (acc["row"] < 0) | (F.abs(b["y1"] - acc["top"]) > tolerance)),
        lambda acc: F.array_sort(acc["cells"]),
    )
    return paged.select("page", F.posexplode(rows).alias("pos", "c")).select("page", F.col("c.row").alias("row"), "pos", F.col("c.idx").alias("idx"))


def _with_row(acc: Column, b: Column, new: Column) -> Column:
    row = F.when(new, acc["row"] + 1).otherwise(acc["row"])
    cell = F.struct(row.alias("row"), b["x1"].alias("x1"), F.size(acc["cells"]).alias("at"), b["idx"].alias("idx"))
    return F.struct(row.alias("row"), F.when(new, b["y1"]).otherwise(acc["top"]).alias("top"), F.array_append(acc["cells"], cell).alias("cells"))


def reading_order(boxes: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """(page, pos, idx): by first corner (y, x); then each box moves back past those of its line (within the tolerance) that stand further right, stopping at the first that doesn't."""
    paged = page_boxes(boxes, F.col("y1"), F.col("x1"))

    def insert(done: Column, b: Column) -> Column:
        stays = F.transform(done, lambda d, k: F.when((F.abs(b["y1"] - d["y1"]) < tolerance) & (b["x1"] < d["x1"]), F.lit(0)).otherwise(k + 1))
        at = F.coalesce(F.array_max(stays), F.lit(0))
        return F.concat(F.slice(done, 1, at), F.array(b), F.slice(done, at + 1, F.size(done)))

    return paged.select("page", F.posexplode(F.aggregate("boxes", _empty(BOX_TYPE), insert)).alias("pos", "b")).select("page", "pos", F.col("b.idx").alias("idx"))


def greedy_matches(truth: DataFrame, detections: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(page, gt_idx, det_idx): each truth in index order takes the first free detection, in index order, with an IoU above the threshold."""
    gt = truth.select("page", F.col("idx").alias("gt_idx"), *[F.col(c).alias(f"gt_{c}") for c in ("x1", "y1", "x2", "y2")])
    near = gt.join(detections.select("page", F.col("idx").alias("det_idx"), "x1", "y1", "x2", "y2"), "page").where(g.iou(g.box(), g.box("gt_")) > threshold)
    paged = near.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(F.col("gt_idx").cast("int").alias("g"), F.col("det_idx").cast("int").alias("d")))).alias("near"))
    taken = F.aggregate(
        "near", _empty("struct<g:int,d:int>"),
        lambda got, p: F.when(F.exists(got, lambda m: (m["g"] == p["g"]) | (m["d"] == p["d"])), got).otherwise(F.array_append(got, p)),
    )
    return paged.select("page", F.explode(taken).alias("m")).select("page", F.col("m.g").alias("gt_idx"), F.col("m.d").alias("det_idx"))


def grow_region(boxes: DataFrame, seeds: DataFrame, share: float = 0.6) -> DataFrame:
    """(page, idx) of boxes that a seed region claims: those with an overlap above the share join, the region becomes their hull, until the number stays the same, which takes no more rounds than the page has boxes."""
    paged = page_boxes(boxes).join(seeds.select("page", F.struct("x1", "y1", "x2", "y2").alias("region")), "page")
    hull_type = "struct<x1:double,y1:double,x2:double,y2:double>"

    def step(acc: Column, _: Column) -> Column:
        inside = F.filter("boxes", lambda b: g.overlap_small(g.box_of(b), g.box_of(acc["region"])) > share)
        hull = F.struct(*[(F.array_min if c[1] == "1" else F.array_max)(_edge(inside, c)).alias(c) for c in ("x1", "y1", "x2", "y2")])
        settled = F.size(inside) == F.size(acc["own"])
        done = acc["done"] | settled | (F.size(inside) == 0)
        return F.struct(
            F.when(acc["done"] | settled, acc["own"]).otherwise(F.transform(inside, lambda b: b["idx"])).alias("own"),
            F.when(done, acc["region"]).otherwise(hull).cast(hull_type).alias("region"),
            done.alias("done"),
        )

    start = F.struct(_empty("int").alias("own"), F.col("region").cast(hull_type).alias("region"), F.lit(False).alias("done"))
    own = F.aggregate(F.sequence(F.lit(1), F.size("boxes") + 1), start, step, lambda acc: acc["own"])
    return paged.select("page", F.explode(own).alias("idx"))


def _edge(boxes: Column, name: str) -> Column:
    return F.transform(boxes, lambda b: b[name])
