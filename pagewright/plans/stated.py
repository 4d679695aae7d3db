"""Fixed values as the SQL of the catalogue states them: written out here on their own, so that a wrong one in the library shows."""

from __future__ import annotations

LAYOUT = (
    "paragraph_title", "image", "text", "number", "abstract", "content", "figure_title", "formula",
    "table", "reference", "doc_title", "footnote", "header", "algorithm", "footer", "seal",
    "chart", "formula_number", "aside_text", "reference_content",
)
MASK = (
    "aside_text", "seal", "number", "formula_number", "header", "header_image", "footer", "footer_image",
    "footnote",
)
VISION = (
    "image", "table", "chart", "flowchart", "figure",
)
NOT_IN_MARKDOWN = (
    "number", "footnote", "header", "header_image", "footer", "footer_image", "aside_text",
)
WITH_IMAGE = (
    "seal", "table", "formula", "chart", "image", "figure",
)
NUMBERED = (
    "text", "formula", "algorithm", "reference", "content", "abstract", "paragraph_title", "doc_title",
    "abstract_title", "refer_title", "content_title", "number", "footnote", "header", "header_image", "footer",
    "footer_image", "aside_text",
)
GATHERED_IMAGES = (
    "image", "figure", "seal",
)
NO_SPANS = ("formula", "table", "seal")
ROLES = {
    "header": ("header", "header_image",),
    "doc_title": ("doc_title",),
    "paragraph_title": ("paragraph_title", "abstract_title", "reference_title", "content_title",),
    "vision": ("image", "table", "chart", "flowchart", "figure",),
    "vision_title": ("table_title", "chart_title", "figure_title", "figure_table_chart_title",),
    "footer": ("footer", "footer_image", "footnote",),
    "unordered": ("aside_text", "seal", "number", "formula_number",),
}
#: (name, first, last) code point, in the order of equal counts.
SCRIPTS = (
    ("ASCII", 0, 127),
    ("Latin", 128, 591),
    ("Greek", 880, 1023),
    ("Cyrillic", 1024, 1279),
    ("Punctuation", 8192, 8303),
    ("CJK Symbols", 12288, 12351),
    ("Hiragana", 12352, 12447),
    ("Katakana", 12448, 12543),
    ("CJK Extension A", 13312, 19903),
    ("CJK Unified", 19968, 40959),
    ("Hangul Syllables", 44032, 55215),
    ("Halfwidth and Fullwidth", 65280, 65519),
    ("Symbols", 8592, 11263),
    ("Emoji", 127744, 129791),
)
NUMBERING = (
    r"[1-9][0-9]*(?:\.[1-9][0-9]*)*[.、]?|[(（](?:[1-9][0-9]*|[一二三四五六七八九十百千万亿零壹贰叁肆伍陆柒捌玖拾]+)[)）]"
    r"|[一二三四五六七八九十百千万亿零壹贰叁肆伍陆柒捌玖拾]+[、.]?|(?:I|II|III|IV|V|VI|VII|VIII|IX|X)(?:\.|\s)"
)
