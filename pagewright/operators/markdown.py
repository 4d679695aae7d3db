"""Markdown of ordered blocks, pages and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import labels
from pagewright.functions import text as t


def image(path: Column, pretty: bool, width: Column, page_width: Column) -> Column:
    """An image reference, scaled in HTML when pretty; empty without a path."""
    plain = F.concat(F.lit("![]("), t.collapse_soft_newlines(path), F.lit(")"))
    if pretty:
        scale = F.floor(width / page_width * 100).cast("bigint").cast("string")
        plain = t.centered(F.concat(F.lit('<img src="'), t.collapse_soft_newlines(path), F.lit('" alt="Image" width="'), scale, F.lit('%" />')))
    return F.when(path.isNull(), F.lit("")).otherwise(plain)


def format_block(label: Column, content: Column, path: Column, width: Column, page_width: Column, pretty: bool = False, tables: bool = True, ignore: tuple[str, ...] = labels.NOT_IN_MARKDOWN) -> Column:
    """A block's Markdown by its label; null for labels that are ignored or have no form."""
    shown = image(path, pretty, width, page_width)
    caption = t.centered(content) if pretty else content
    if not tables:
        table = shown
    elif pretty:
        table = F.concat(F.lit("\n"), F.replace(t.centered(content), F.lit("<table>"), F.lit('<table border="1">')))
    else:
        table = t.simplify_table(F.concat(F.lit("\n"), content))
    hard = F.replace(F.replace(content, F.lit("-\n"), F.lit("  \n")), F.lit("\n"), F.lit("  \n"))
    forms = (
        (("paragraph_title", "abstract_title", "reference_title", "content_title"), t.format_title(content)),
        (("doc_title",), t.collapse_soft_newlines(F.concat(F.lit("# "), content))),
        (("table_title", "figure_title", "chart_title"), caption),
        (("vision_footnote", "text", "ocr", "vertical_text", "reference_content"), t.normalize_newlines(content)),
        (("abstract",), t.format_first_line(content, ("摘要", "abstract"), "## ", "\n", " ")),
        (("content",), hard),
        (("image", "chart", "seal", "formula", "display_formula", "inline_formula"), shown),
        (("table",), table),
        (("reference",), t.format_first_line(content, ("参考文献", "references"), "## ", "", "\n")),
        (("algorithm",), F.regexp_replace(content, r"^\n+|\n+\z", "")),
        (("spotting", "number", "footnote", "header", "footer", "aside_text"), content),
        (("header_image", "footer_image"), image(path, False, width, page_width)),
    )
    out = F.when(label.isin(*ignore), F.lit(None)) if ignore else F.when(F.lit(False), F.lit(None).cast("string"))
    for names, form in forms:
        out = out.when(label.isin(*names), form)
    return out


def continuation(block: Column, before: Column) -> tuple[Column, Column]:
    """(starts, ends): whether a block begins a paragraph of its own, and whether it ends one. before may be null.

    Structs have start, end, seg_start, seg_end, lines, width; missing segments are +inf and -inf.
    """
    meets = (block["start"] < before["end"]) & (block["end"] > before["start"])
    left = F.when(before.isNotNull() & meets, F.least(before["start"], block["start"])).otherwise(block["start"])
    right = F.when(before.isNotNull() & meets, F.greatest(before["end"], block["end"])).otherwise(block["end"])
    apart = F.when(meets, F.lit(0.0)).otherwise(F.abs(block["start"] - before["end"]))
    full = F.abs(F.when(meets, right).otherwise(before["end"]) - before["seg_end"]) < 10
    flush = block["seg_start"] - left < 10
    goes_on = F.when(before.isNull(), flush).otherwise(full & flush & (before["lines"] > 1) & (apart < F.greatest(before["width"], block["width"])))
    return ~goes_on, right - block["seg_end"] >= 10


GEOMETRY = ("start", "end", "seg_start", "seg_end", "lines", "width")


def blocks_of_parsed(parsed: DataFrame, sizes: DataFrame, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """What page_markdown takes, from grouped.parse_pages and the pages' sizes (keys, w, h); keys become the struct page. Blocks along the page's direction: from left to right, or from top to bottom."""
    rows = parsed.where("error IS NULL AND index IS NOT NULL").join(sizes.select(*keys, F.col("w").alias("page_width")), list(keys))
    side = lambda across, along: F.when(F.col("horizontal"), F.col(across)).otherwise(F.col(along)).cast("double")
    page = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
    return rows.select(
        page.alias("page"), F.col("index").alias("idx"), "label", "content", "image_path", (F.col("x2") - F.col("x1")).alias("box_width"), "page_width",
        side("x1", "y1").alias("start"), side("x2", "y2").alias("end"), "seg_start", "seg_end", "lines", "width",
    )


def page_markdown(blocks: DataFrame, pretty: bool = False, tables: bool = True, ignore: tuple[str, ...] = labels.NOT_IN_MARKDOWN) -> DataFrame:
    """(page, markdown, starts, ends): the page's handled blocks in order.

    blocks: page, idx, label, content, image_path, box_width, page_width and the columns of GEOMETRY. "Before" a block
    stands the last handled one. Two text blocks are joined if the second goes on with the first's paragraph; other
    blocks have an empty line between. starts is the first block's flag, ends the last one's, handled or not.
    """
    said = format_block(F.col("label"), F.col("content"), F.col("image_path"), F.col("box_width"), F.col("page_width"), pretty, tables, ignore)
    by = Window.partitionBy("page").orderBy("idx")
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.withColumn("said", said).withColumn("g", F.struct(*GEOMETRY))
    rows = rows.withColumn("before", F.last(F.when(F.col("said").isNotNull(), F.struct(F.col("g").alias("g"), F.col("label").alias("label"))), ignorenulls=True).over(earlier))
    starts, ends = continuation(F.col("g"), F.col("before.g"))
    rows = rows.withColumn("starts", starts).withColumn("ends", ends)
    joined = (F.col("label") == "text") & F.coalesce(F.col("before.label") == "text", F.lit(False)) & ~F.col("starts")
    piece = F.when(F.col("said").isNotNull(), F.struct(joined.alias("joined"), F.col("said").alias("said")))
    paged = rows.groupBy("page").agg(
        F.array_sort(F.collect_list(F.struct("idx", piece.alias("p"), "starts", "ends"))).alias("rows"),
    )
    text = F.aggregate(
        F.filter("rows", lambda r: r["p"].isNotNull()), F.lit(""),
        lambda out, r: F.concat(out, F.when(r["p"]["joined"] | (out == ""), F.lit("")).otherwise(F.lit("\n\n")), r["p"]["said"]),
    )
    return paged.select("page", text.alias("markdown"), F.col("rows")[0]["starts"].alias("starts"), F.element_at("rows", -1)["ends"].alias("ends"))


def document_markdown(pages: DataFrame) -> DataFrame:
    """(doc, markdown): pages in order, an empty line before each, the first too, unless a page goes on with the paragraph before; then a space, unless CJK meets there. pages: doc, page, markdown, starts, ends."""
    rows = pages.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "markdown", "starts", "ends"))).alias("pages"))
    state = F.struct(F.lit("").alias("out"), F.lit(True).alias("ended"))
    step = lambda acc, p: F.struct(
        F.concat(acc["out"], F.when(~p["starts"] & ~acc["ended"], t.joining_space(acc["out"], p["markdown"])).otherwise(F.lit("\n\n")), p["markdown"]).alias("out"),
        p["ends"].alias("ended"),
    )
    return rows.select("doc", F.aggregate("pages", state, step, lambda acc: acc["out"]).alias("markdown"))


def merge_across_pages(blocks: DataFrame) -> DataFrame:
    """(doc, page, idx, group_id, label, content) of blocks that stay: a text block that starts no paragraph is taken up by the last block that stayed, if that is text. group_id counts all blocks of the document.

    blocks: doc, page, idx, label, content, starts. Which blocks stay depends on those before, so that a text that goes
    on with a text belongs to the run of the last block that doesn't.
    """
    by = Window.partitionBy("doc").orderBy("page", "idx")
    rows = blocks.withColumn("group_id", F.row_number().over(by) - 1)
    after_text = F.coalesce(F.lag("label").over(by) == "text", F.lit(False))  # what stayed last has the label of the block before, in either case
    rows = rows.withColumn("stays", ~((F.col("label") == "text") & after_text & ~F.col("starts")))
    rows = rows.withColumn("run", F.sum(F.col("stays").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("doc", "run").agg(F.array_sort(F.collect_list(F.struct("group_id", "page", "idx", "label", "content"))).alias("parts"))
    join = lambda out, p: F.concat(out, F.when((out == "") | (p["content"] == ""), F.lit("")).otherwise(t.joining_space(out, p["content"])), p["content"])
    content = F.aggregate(F.slice("parts", 2, F.size("parts")), F.col("parts")[0]["content"], join)
    head = F.col("parts")[0]
    return runs.select("doc", head["page"].alias("page"), head["idx"].alias("idx"), head["group_id"].alias("group_id"), head["label"].alias("label"), content.alias("content"))
