"""Page kernels over DataFrames.

Rows of a page are collected into one row in the JVM (partially before the shuffle), and kernels run over batches of
such rows: one Arrow hand-over for many pages instead of one for each. A page that a kernel refuses gives a row with an
error and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pagewright.functions import labels
from pagewright.kernels import lines, page_order, parsing, shapes, xycut

BOX = ("x1", "y1", "x2", "y2")


def paged(rows: DataFrame, keys: list[str], order: str, columns: tuple[str, ...], name: str) -> DataFrame:
    """(keys, name): a page's rows as an array of structs, sorted by the order column first."""
    item = F.struct(F.col(order).alias("o"), F.struct(*columns).alias("v"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["v"]).alias(name))


def run_pages(pages: DataFrame, keys: list[str], kernel: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Rows (keys, schema's columns, error) of kernel(*other columns), which returns tuples or raises ValueError."""
    out = T.StructType([pages.schema[k] for k in keys] + T._parse_datatype_string(schema).fields + [T.StructField("error", T.StringType())])
    kinds = [to_arrow_type(f.dataType) for f in out.fields]
    width = len(out.fields) - len(keys) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page in batch.to_pylist():
                own = tuple(page.pop(k) for k in keys)
                try:
                    rows += [(*own, *row, None) for row in kernel(*page.values())]
                except ValueError as e:
                    rows.append((*own, *[None] * width, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=out.names)

    return pages.mapInArrow(run, out)


def cut_order(boxes: DataFrame, by_columns: bool = True, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """(keys, pos, idx, error): order by recursive cuts; a box in no segment has no row."""

    def kernel(own: list[dict]) -> list[tuple]:
        order = xycut.recursive_cut(np.array([[int(b[c]) for c in BOX] for b in own]), by_columns)
        return [(pos, own[k]["idx"]) for pos, k in enumerate(order)]

    return run_pages(paged(boxes, list(keys), "idx", ("idx", *BOX), "boxes"), list(keys), kernel, "pos int, idx bigint")


def enhanced_order(blocks: DataFrame, pages: DataFrame, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """(keys, pos, idx, label, role, error); a block that the cuts leave out has a null pos. blocks: keys, idx, label, box, lines, line_height, line_width; pages: keys, w, h."""

    def kernel(own: list[dict], w: float, h: float) -> list[tuple]:
        made = [page_order.Block(b["label"], tuple(b[c] for c in BOX), b["lines"], b["line_height"], b["line_width"]) for b in own]
        page = page_order.Page(made, (0, 0, w, h))
        order = page.order()
        lost = sorted(set(range(len(own))).difference(order))
        return [(pos, own[k]["idx"], made[k].label, made[k].role) for pos, k in [*enumerate(order), *((None, k) for k in lost)]]

    rows = paged(blocks, list(keys), "idx", ("idx", "label", *BOX, "lines", "line_height", "line_width"), "blocks").join(pages.select(*keys, "w", "h"), list(keys))
    return run_pages(rows, list(keys), kernel, "pos int, idx bigint, label string, role string")


def block_texts(blocks: DataFrame, spans: DataFrame, bridge: DataFrame, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """(keys, idx, content, lines, horizontal, seg_start, seg_end, line_height, line_width, error) of each block. bridge: keys, block_idx, span_idx."""
    keys = list(keys)
    joined = bridge.join(spans.select(*keys, F.col("idx").alias("span_idx"), F.struct(*BOX, "text").alias("s")), [*keys, "span_idx"])
    own = joined.groupBy(*keys, F.col("block_idx").alias("idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("span_idx", "s"))), lambda i: i["s"]).alias("spans"))
    rows = blocks.select(*keys, "idx", "label", F.struct(*BOX).alias("box")).join(own, [*keys, "idx"], "left")

    def kernel(label: str, box: dict, found: list[dict] | None) -> list[tuple]:
        t = lines.block_text(label, [box[c] for c in BOX], [([s[c] for c in BOX], s["text"]) for s in found or []])
        return [(t.content, t.lines, t.horizontal, t.seg_start, t.seg_end, t.line_height, t.line_width)]

    return run_pages(rows, [*keys, "idx"], kernel, "content string, lines int, horizontal boolean, seg_start double, seg_end double, line_height double, line_width double")


def score_map_boxes(maps: DataFrame, key: str, box_score: float = shapes.BOX_SCORE, ratio: float = shapes.GROWTH) -> DataFrame:
    """(key, pos, corners, score, error). maps: key, w, h, scores array<float> by rows, target_w, target_h."""

    def kernel(w: int, h: int, scores: list[float], target_w: int, target_h: int) -> list[tuple]:
        found = shapes.map_boxes(np.array(scores, np.float32).reshape(h, w), (target_w, target_h), box_score, ratio)
        return [(pos, [{"x": x, "y": y} for x, y in corners], score) for pos, (corners, score) in enumerate(found)]

    return run_pages(maps.select(key, "w", "h", "scores", "target_w", "target_h"), [key], kernel, "pos int, corners array<struct<x:int,y:int>>, score double")


def map_areas(maps: DataFrame, key: str, threshold: float = shapes.BRIGHT) -> DataFrame:
    """(key, pos, x1, y1, x2, y2, n, error): 8-connected bright areas. maps: key, w, h, scores."""

    def kernel(w: int, h: int, scores: list[float]) -> list[tuple]:
        return [(pos, *a) for pos, a in enumerate(shapes.labelled_areas(shapes.binary(np.array(scores, np.float32).reshape(h, w), threshold)))]

    return run_pages(maps.select(key, "w", "h", "scores"), [key], kernel, "pos int, x1 int, y1 int, x2 int, y2 int, n int")


def map_borders(maps: DataFrame, key: str, threshold: float = shapes.BRIGHT) -> DataFrame:
    """(key, pos, points, centre_x, centre_y, w, h, angle, error): borders and the smallest rectangles around them."""

    def kernel(w: int, h: int, scores: list[float]) -> list[tuple]:
        out = []
        for pos, border in enumerate(shapes.borders(shapes.binary(np.array(scores, np.float32).reshape(h, w), threshold))):
            (cx, cy), (rw, rh), angle = shapes.smallest_rectangle(border)
            out.append((pos, [{"x": x, "y": y} for x, y in border], cx, cy, rw, rh, angle))
        return out

    return run_pages(maps.select(key, "w", "h", "scores"), [key], kernel, "pos int, points array<struct<x:int,y:int>>, centre_x double, centre_y double, rect_w double, rect_h double, angle double")


PARSED = "index int, label string, x1 bigint, y1 bigint, x2 bigint, y2 bigint, content string, order_index int, lines int, horizontal boolean, seg_start double, seg_end double, line_height double, line_width double, width double, image_path string"


def parse_pages(pages: DataFrame, layout: DataFrame, spans: DataFrame, tables: DataFrame | None = None, regions: DataFrame | None = None, recognize: parsing.Recognize | None = None, threshold: float = 0.0, keys: tuple[str, ...] = ("page",), hidden: tuple[str, ...] = labels.NOT_IN_MARKDOWN) -> DataFrame:
    """Ordered blocks of each page (PARSED, error): detections and spans are reconciled, then assembled; a block that the order leaves out has a null index.

    pages: keys, w, h; layout and regions: keys, idx, label, box, score; spans: keys, idx, box, text, score; tables:
    keys, idx, html. recognize reads a rectangle anew and must be picklable; without one nothing is read anew.
    """
    keys = list(keys)
    read = recognize or (lambda box: ("", -1.0))
    rows = pages.select(*keys, "w", "h")
    for name, frame, columns in (("found", layout, ("label", *BOX, "score")), ("regions", regions, ("label", *BOX, "score")), ("spans", spans, (*BOX, "text", "score")), ("html", tables, ("html",))):
        part = paged(frame, keys, "idx", columns, name) if frame is not None else None
        rows = rows.join(part, keys, "left") if part is not None else rows.withColumn(name, F.lit(None).cast("array<struct<html:string>>"))

    def kernel(w: float, h: float, found: list | None, areas: list | None, own: list | None, html: list | None) -> list[tuple]:
        box = lambda r: [float(r[c]) for c in BOX]
        detections = [parsing.Detection(r["label"], box(r), r["score"]) for r in found or []]
        around = [parsing.Detection(r["label"], box(r), r["score"]) for r in areas or []]
        page = parsing.reconcile((w, h), detections, around, [parsing.Span(box(r), r["text"], r["score"]) for r in own or []], read, threshold)
        lost: list[parsing.Ordered] = []
        blocks = parsing.assemble(page, [t["html"] for t in html or []], hidden, lost)
        return [(k, b.label, *b.box, b.content, b.order_index, b.lines, b.horizontal, b.seg_start, b.seg_end, b.line_height, b.line_width, b.width, b.image_path) for k, b in [*enumerate(blocks), *((None, b) for b in lost)]]

    return run_pages(rows, keys, kernel, PARSED)


def polygon_matches(truth: DataFrame, detections: DataFrame, threshold: float = 0.5, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """(keys, gt_care, det_care, matched, error) for polygons: like boxes, by exact polygon intersections. truth: keys, idx, points array<struct<x,y>>, ignored; detections: keys, idx, points."""
    keys = list(keys)
    rows = paged(truth, keys, "idx", ("points", "ignored"), "truth").join(paged(detections, keys, "idx", ("points",), "found"), keys, "full")

    def kernel(gt: list | None, det: list | None) -> list[tuple]:
        ring = lambda r: [(p["x"], p["y"]) for p in r["points"]]
        size = lambda ps: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ps, ps[1:] + ps[:1]))) / 2
        care, ignored = [ring(r) for r in gt or [] if not r["ignored"]], [ring(r) for r in gt or [] if r["ignored"]]
        found = [ring(r) for r in det or []]
        free = [d for d in found if not any(size(d) and shapes.clipped_area(i, d) / size(d) > 0.5 for i in ignored)]
        taken: set[int] = set()
        for t in care:
            hit = next((k for k, d in enumerate(free) if k not in taken and shapes.polygon_iou(d, t) > threshold), None)
            if hit is not None:
                taken.add(hit)
        return [(len(care), len(free), len(taken))]

    return run_pages(rows, keys, kernel, "gt_care int, det_care int, matched int")
