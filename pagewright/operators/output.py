"""Versioned JSON, tab-separated and plain text of results, built as strings so that every byte is decided here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import json_string

LINES, LAYOUT, DETECTION, TABLE, PARSING = (f"pagewright/{k}-result/v1" for k in ("ocr", "layout", "detection", "table", "parsing"))


def _or_null(c: Column, said: Column) -> Column:
    return F.when(c.isNull(), F.lit("null")).otherwise(said)


def _object(**fields: Column) -> Column:
    parts = []
    for k, (name, value) in enumerate(fields.items()):
        parts += [F.lit(("," if k else "{") + f'"{name}":'), value]
    return F.concat(*parts, F.lit("}"))


def _array(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def fixed(c: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", c.cast("double"))


def whole(c: Column) -> Column:
    """Without decimals, ties to even."""
    return F.rint(c.cast("double")).cast("bigint").cast("string")


def quad(points: Column) -> Column:
    return _array(F.transform(points, lambda p: F.concat(F.lit("["), whole(p["x"]), F.lit(","), whole(p["y"]), F.lit("]"))))


def box(*sides: Column, places: int | None = None) -> Column:
    return _array(F.array(*[fixed(s, places) if places is not None else s.cast("bigint").cast("string") for s in sides]))


def documents(items: DataFrame, item: Column, pages: DataFrame, schema: str, key: str, model: Column | None = None, named: bool = True) -> DataFrame:
    """(doc_id, page, json): a document for each page of pages (doc_id, page, w, h) with its items in order of pos; pages without items have an empty list."""
    own = items.select("doc_id", "page", F.struct("pos", item.alias("json")).alias("i")).groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list("i")), lambda i: i["json"]).alias("items"))
    rows = pages.select("doc_id", "page", "w", "h").join(own, ["doc_id", "page"], "left")
    name = json_string(F.col("doc_id")) if named else F.lit("null")
    given = _object(id=name, page_index=F.col("page").cast("string"), width=F.col("w").cast("string"), height=F.col("h").cast("string"))
    body = {"schema_version": F.lit(f'"{schema}"'), "input": given, "model": F.lit("null") if model is None else model, key: _array(F.coalesce("items", F.array().cast("array<string>")))}
    return rows.select("doc_id", "page", _object(**body).alias("json"))


def line_documents(lines: DataFrame, pages: DataFrame, **how) -> DataFrame:
    """lines: doc_id, page, pos, quad, text, score."""
    return documents(lines, _object(quad=quad(F.col("quad")), text=json_string(F.col("text")), confidence=fixed(F.col("score"), 10)), pages, LINES, "lines", **how)


def detection_documents(regions: DataFrame, pages: DataFrame, **how) -> DataFrame:
    """regions: doc_id, page, pos, quad, det_score."""
    return documents(regions, _object(quad=quad(F.col("quad")), detector_score=fixed(F.col("det_score"), 10)), pages, DETECTION, "regions", **how)


def layout_documents(found: DataFrame, pages: DataFrame, **how) -> DataFrame:
    """found: doc_id, page, pos, label, box, score."""
    sides = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    return documents(found, _object(label=json_string(F.col("label")), score=fixed(F.col("score"), 10), box=box(*sides, places=10)), pages, LAYOUT, "regions", **how)


def parsing_documents(blocks: DataFrame, pages: DataFrame, **how) -> DataFrame:
    """blocks: doc_id, page, pos, order_index, label, box, content, image_path."""
    sides = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    order, path = F.col("order_index"), F.col("image_path")
    item = _object(index=F.col("pos").cast("string"), order_index=_or_null(order, order.cast("string")), label=json_string(F.col("label")), bbox=box(*sides), content=json_string(F.col("content")), image_path=_or_null(path, json_string(path)))
    return documents(blocks, item, pages, PARSING, "blocks", **how)


def table_documents(tables: DataFrame, pages: DataFrame, **how) -> DataFrame:
    """tables: doc_id, page, pos, route, html, tokens array<string>, cells array<array<double>>."""
    cells = _array(F.transform("cells", lambda c: _array(F.transform(c, lambda v: fixed(v, 10)))))
    item = _object(route=json_string(F.col("route")), html=json_string(F.col("html")), tokens=_array(F.transform("tokens", json_string)), cells=cells)
    return documents(tables, item, pages, TABLE, "tables", **how)


def text_lines(lines: DataFrame, named: bool) -> DataFrame:
    """(doc_id, page, pos, value): score and text, tab-separated, after the input's name if there are several."""
    cells = [F.format_string("%.6f", F.col("score")), F.col("text")]
    return lines.select("doc_id", "page", "pos", F.concat_ws("\t", *([F.col("doc_id")] if named else []), *cells).alias("value"))


def outcomes(pages: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, recognized, failed, status): pages without and with an error; status is 0 if no page has one, 1 if some have, 2 if all have or there is none."""
    n = pages.groupBy(*keys).agg(F.count_if(F.col("error").isNull()).alias("recognized"), F.count("error").alias("failed"))
    return n.withColumn("status", F.when(F.col("recognized") == 0, 2).when(F.col("failed") > 0, 1).otherwise(0))


def exit_status(pages: DataFrame) -> int:
    """The status of all pages together."""
    return outcomes(pages).first()["status"]
