"""String rules of titles, Markdown, JSON and recognition metrics as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numerals that may number a title.
CJK_NUMERALS = "一二三四五六七八九十百千万亿零壹贰叁肆伍陆柒捌玖拾"
ROMAN = "I|II|III|IV|V|VI|VII|VIII|IX|X"
#: Alternatives in order, leftmost first; a Roman numeral needs a point or white space behind it.
NUMBERING = (
    rf"[1-9][0-9]*(?:\.[1-9][0-9]*)*[.、]?|[(（](?:[1-9][0-9]*|[{CJK_NUMERALS}]+)[)）]|[{CJK_NUMERALS}]+[、.]?|(?:{ROMAN})(?:\.|\s)"
)
#: Unicode ranges (first, last) of a script census, in the order of equal counts.
SCRIPTS = (
    ("ASCII", 0x0000, 0x007F), ("Latin", 0x0080, 0x024F), ("Greek", 0x0370, 0x03FF), ("Cyrillic", 0x0400, 0x04FF),
    ("Punctuation", 0x2000, 0x206F), ("CJK Symbols", 0x3000, 0x303F), ("Hiragana", 0x3040, 0x309F), ("Katakana", 0x30A0, 0x30FF),
    ("CJK Extension A", 0x3400, 0x4DBF), ("CJK Unified", 0x4E00, 0x9FFF), ("Hangul Syllables", 0xAC00, 0xD7AF),
    ("Halfwidth and Fullwidth", 0xFF00, 0xFFEF), ("Symbols", 0x2190, 0x2BFF), ("Emoji", 0x1F300, 0x1FAFF),
)


def collapse_soft_newlines(text: Column) -> Column:
    """A hyphen before a line break goes with it; other breaks become spaces."""
    return F.replace(F.replace(text, F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))


def normalize_newlines(text: Column) -> Column:
    """Double breaks become single ones first, then all are doubled."""
    return F.replace(F.replace(text, F.lit("\n\n"), F.lit("\n")), F.lit("\n"), F.lit("\n\n"))


def numbering(text: Column) -> Column:
    """The numbering that a title (without leading white space) starts with; empty without one."""
    return F.regexp_extract(text, f"^(?:{NUMBERING})", 0)


def format_title(text: Column) -> Column:
    """A heading; its level is one more than the dots of the title without trailing ones."""
    lead = F.regexp_replace(text, r"^\s+", "")
    number = numbering(lead)
    rest = F.regexp_replace(F.substring(lead, F.length(number) + 1, F.length(lead)), r"^\s+", "")
    title = F.when(number != "", F.concat(F.regexp_replace(number, r"^\s+|\s+$", ""), F.lit(" "), rest)).otherwise(text)
    title = F.regexp_replace(title, r"\.+$", "")
    dots = F.length(title) - F.length(F.replace(title, F.lit("."), F.lit("")))
    return collapse_soft_newlines(F.concat(F.repeat(F.lit("#"), dots + 2), F.lit(" "), title))


def format_paragraph_title(text: Column, level: Column | None = None) -> Column:
    """An explicit level wins over the dots."""
    if level is None:
        return format_title(text)
    explicit = collapse_soft_newlines(F.concat(F.repeat(F.lit("#"), level + 1), F.lit(" "), text))
    return F.when(level.isNull(), format_title(text)).otherwise(explicit)


def format_first_line(text: Column, templates: tuple[str, ...], prefix: str, suffix: str, splitter: str) -> Column:
    """Marks the first non-blank field if it is one of the templates, whatever its case; no later field is looked at."""
    fields = F.split(text, splitter.replace("\n", r"\n"), -1)
    blank = F.transform(fields, lambda f: F.regexp_replace(f, r"\s", "") == "")
    at = F.array_position(blank, F.lit(False)).cast("int") - 1
    return F.array_join(
        F.transform(fields, lambda f, k: F.when((k == at) & F.lower(f).isin(*templates), F.concat(F.lit(prefix), f, F.lit(suffix))).otherwise(f)), splitter
    )


def simplify_table(html: Column) -> Column:
    """Without html and body tags, after a line break."""
    return F.concat(F.lit("\n"), reduce(lambda c, tag: F.replace(c, F.lit(tag), F.lit("")), ("<html>", "</html>", "<body>", "</body>"), html))


def merge_formula_and_number(formula: Column, number: Column) -> Column:
    inner = F.regexp_replace(F.replace(formula, F.lit("$$"), F.lit("")), r"^\s+|\s+$", "")
    return F.concat(F.lit("$$"), inner, F.lit(" \\tag*{"), number, F.lit("}$$"))


def centered(text: Column) -> Column:
    return F.concat(F.lit('<div style="text-align: center;">'), collapse_soft_newlines(text), F.lit("</div>\n"))


def is_cjk(char: Column) -> Column:
    """Whether a one-character string lies in U+4E00 to U+9FFF; false for null and empty strings."""
    code = F.ascii(F.coalesce(char, F.lit("")))
    return code.between(0x4E00, 0x9FFF)


def joining_space(before: Column, after: Column) -> Column:
    """A space unless the characters that meet are CJK on either side."""
    return F.when(is_cjk(F.right(before, F.lit(1))) | is_cjk(F.left(after, F.lit(1))), F.lit("")).otherwise(F.lit(" "))


def script_of(char: Column) -> Column:
    code = F.ascii(char)
    out = F.when(F.lit(False), "")
    for name, low, high in SCRIPTS:
        out = out.when(code.between(low, high), name)
    return out.otherwise("Other")


def script_rank(script: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s[0]) for s in SCRIPTS], F.lit("Other")), script)


def json_string(text: Column) -> Column:
    """A JSON string literal: the quote, the backslash and control characters are escaped, all else stays."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, said in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(said))
    # the rest of the control range is rare: a text without any is left alone
    rest = reduce(lambda c, k: F.replace(c, F.lit(chr(k)), F.lit(f"\\u{k:04x}")), (k for k in range(32) if chr(k) not in "\n\r\t"), out)
    return F.concat(F.lit('"'), F.when(out.rlike(r"[\x00-\x1f]"), rest).otherwise(out), F.lit('"'))


def metric_text(text: Column) -> Column:
    """ASCII letters and digits in lower case."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def edit_distance_ratio(a: Column, b: Column) -> Column:
    """Code-point edit distance over the longer length; 0 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def is_sha256(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


#: Marks that don't end a line.
NON_BREAKING = ",，、;；:：-'\"“"
