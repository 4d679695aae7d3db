"""Documents of many pages: ranges, render scales and the reference graph that is checked before a page is drawn."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.planning import render_pixels, render_scale
from pagewright.sources.images import ERROR, PAGES

MAX_PAGES, MAX_DEPTH, MAX_NODES = 4_096, 16, 4_096


def page_range(pages: int, first: int = 0, count: int | None = None) -> range:
    """Pages from first on; a count beyond the end stops there. A start past the end, or no page at all, is an error."""
    if pages <= 0:
        raise ValueError("the document has no pages")
    if pages > MAX_PAGES:
        raise ValueError(f"{pages} pages are above {MAX_PAGES}")
    if not 0 <= first < pages:
        raise ValueError(f"page {first} is past the last of {pages}")
    if count == 0:
        raise ValueError("no pages asked for")
    return range(first, pages if count is None else min(pages, first + count))


def planned(pages: DataFrame, asked: float = 2.0, least: float = 0.5, budget: int = 40_000_000) -> DataFrame:
    """pages (doc_id, page, width_pt, height_pt) with scale, pixels and error: the largest scale up to the one asked for whose pixels fit."""
    w, h = F.col("width_pt"), F.col("height_pt")
    scale = render_scale(w, h, asked, least, budget)
    rows = pages.withColumn("scale", scale)
    error = F.when(~((w > 0) & (h > 0)), F.struct(F.lit("malformed").alias("kind"), F.lit("page size").alias("field"), F.lit("").alias("detail"))).when(F.col("scale").isNull(), F.struct(F.lit("limit").alias("kind"), F.lit("page size").alias("field"), render_pixels(w, h, F.lit(least)).cast("string").alias("detail")))
    return rows.withColumns({"pixels": render_pixels(w, h, F.col("scale")).cast("bigint"), "error": error.cast(ERROR)})


def reference_faults(edges: DataFrame, roots: DataFrame, depth: int = MAX_DEPTH, nodes: int = MAX_NODES) -> DataFrame:
    """(doc_id, page, fault) of pages whose references run in a circle, deeper than allowed, or over too many objects.

    edges: doc_id, parent, child; roots: doc_id, page, node. A recursive query walks all paths with their own nodes: an
    object may be drawn twice, but not within itself. Paths end where a fault is found, so that depth bounds the query.
    """
    spark = edges.sparkSession
    edges.createOrReplaceTempView("reference_edges_")
    roots.createOrReplaceTempView("reference_roots_")
    return spark.sql(f"""
        WITH RECURSIVE walk(doc_id, page, node, path, depth, fault) MAX RECURSION LEVEL {depth + 2} AS (
          SELECT doc_id, page, node, array(node), 1, CAST(NULL AS STRING) FROM reference_roots_
          UNION ALL
          SELECT w.doc_id, w.page, e.child, array_append(w.path, e.child), w.depth + 1,
                 CASE WHEN array_contains(w.path, e.child) THEN 'cycle' WHEN w.depth + 1 > {depth} THEN 'depth' END
          FROM walk w JOIN reference_edges_ e ON e.doc_id = w.doc_id AND e.parent = w.node WHERE w.fault IS NULL
        )
        SELECT doc_id, page, coalesce(min(fault), CASE WHEN count(*) > {nodes} THEN 'nodes' END) AS fault
        FROM walk GROUP BY doc_id, page HAVING min(fault) IS NOT NULL OR count(*) > {nodes}""")


def render(pages: DataFrame, draw: Callable[[str, int, float], tuple[int, int, bytes]]) -> DataFrame:
    """PAGES of planned pages by a renderer (doc_id, page, scale to width, height, bytes) that the caller brings; it must be picklable and raises ValueError for a page that it can't draw. One bad page leaves the others alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.struct([("kind", pa.string()), ("field", pa.string()), ("detail", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                width = height = raw = None
                error = row["error"]
                if error is None:
                    try:
                        width, height, raw = draw(row["doc_id"], row["page"], row["scale"])
                    except ValueError as e:
                        error = {"kind": "malformed", "field": "page", "detail": str(e)}
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"]], pa.string()), pa.array([row["page"]], pa.int32()), pa.array([width], pa.int32()), pa.array([height], pa.int32()), pa.array([raw], pa.binary()), pa.array([error], kinds)], names=["doc_id", "page", "w", "h", "content", "error"])

    return pages.select("doc_id", "page", "scale", "error").mapInArrow(run, PAGES)
