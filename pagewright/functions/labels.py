"""Layout labels and the roles that they play."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The classes of the layout model, in class order.
LAYOUT = (
    "paragraph_title", "image", "text", "number", "abstract", "content", "figure_title", "formula", "table", "reference",
    "doc_title", "footnote", "header", "algorithm", "footer", "seal", "chart", "formula_number", "aside_text", "reference_content",
)

#: Labels by role.
HEADER = ("header", "header_image")
DOC_TITLE = ("doc_title",)
PARAGRAPH_TITLE = ("paragraph_title", "abstract_title", "reference_title", "content_title")
VISION = ("image", "table", "chart", "flowchart", "figure")
VISION_TITLE = ("table_title", "chart_title", "figure_title", "figure_table_chart_title")
FOOTER = ("footer", "footer_image", "footnote")
UNORDERED = ("aside_text", "seal", "number", "formula_number")
MASK = (*UNORDERED, *HEADER, *FOOTER)
NUMBERED = (
    "text", "formula", "algorithm", "reference", "content", "abstract", "paragraph_title", "doc_title", "abstract_title",
    "refer_title", "content_title", "number", "footnote", "header", "header_image", "footer", "footer_image", "aside_text",
)
NOT_IN_MARKDOWN = ("number", "footnote", "header", "header_image", "footer", "footer_image", "aside_text")
WITH_IMAGE = ("seal", "table", "formula", "chart", "image", "figure")
GATHERED_IMAGES = ("image", "figure", "seal")
NO_SPANS = ("formula", "table", "seal")

ROLES = {"header": HEADER, "doc_title": DOC_TITLE, "paragraph_title": PARAGRAPH_TITLE, "vision": VISION, "vision_title": VISION_TITLE, "footer": FOOTER, "unordered": UNORDERED}


def role(label: Column) -> Column:
    """The role of a label; text, region and all others are normal_text."""
    out = F.when(F.lit(False), "")
    for name, members in ROLES.items():
        out = out.when(label.isin(*members), name)
    return out.otherwise("normal_text")


def layout_label(index: Column) -> Column:
    """The label of a class index."""
    return F.array(*map(F.lit, LAYOUT))[index.cast("int")]


def image_path(label: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Where a block's image goes, by its truncated box; null for labels without one."""
    return F.when(label.isin(*WITH_IMAGE), F.format_string("imgs/img_in_%s_box_%d_%d_%d_%d.jpg", label, *(c.cast("bigint") for c in (x1, y1, x2, y2))))
