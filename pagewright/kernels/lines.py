"""Spans of a block become lines, lines become the block's text."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

from pagewright.functions.text import NON_BREAKING

SAME_LINE = 0.6


@dataclass
class Line:
    box: list[float]
    spans: list[tuple[list[float], str]]
    breaks: bool = False

    @property
    def height(self) -> float:
        return abs(self.box[3] - self.box[1]) if self.across else abs(self.box[2] - self.box[0])

    @property
    def width(self) -> float:
        return abs(self.box[2] - self.box[0]) if self.across else abs(self.box[3] - self.box[1])

    across: bool = field(default=True)


@dataclass
class BlockText:
    content: str = ""
    lines: int = 1
    horizontal: bool = True
    seg_start: float | None = None
    seg_end: float | None = None
    line_height: float = 1.0
    line_width: float = 1.0


def mean(values: Iterable[float]) -> float:
    """Summed from left to right without compensation, as plain doubles add up."""
    total, n = 0.0, 0
    for v in values:
        total, n = total + v, n + 1
    return total / n


def is_letter(c: str) -> bool:
    return len(c) == 1 and c.isascii() and c.isalpha()


def is_digit(c: str) -> bool:
    return len(c) == 1 and c.isnumeric()


def holds_on(c: str) -> bool:
    return c != "" and c in NON_BREAKING


def small_overlap(a: list[float], b: list[float], axis: int) -> float:
    both = min(a[axis + 2], b[axis + 2]) - max(a[axis], b[axis])
    least = min(a[axis + 2] - a[axis], b[axis + 2] - b[axis])
    return both / least if both > 0 and least > 0 else 0.0


def group(spans: list[tuple[list[float], str]]) -> tuple[list[Line], bool]:
    """Lines in reading order, and whether they go across the page."""
    across = 2 * sum(1.5 * (b[2] - b[0]) >= b[3] - b[1] for b, _ in spans) >= len(spans)
    axis = 1 if across else 0
    lines: list[Line] = []
    for box, text in sorted(spans, key=lambda s: s[0][1] if across else -s[0][0]):
        if lines and small_overlap(lines[-1].box, box, axis) >= SAME_LINE:
            own = lines[-1]
            own.spans.append((box, text))
            own.box = [min(own.box[0], box[0]), min(own.box[1], box[1]), max(own.box[2], box[2]), max(own.box[3], box[3])]
        else:
            lines.append(Line(list(box), [(box, text)], across=across))
    if not across and lines:
        heights = [x.height for x in lines]
        low, high = min(heights), max(heights)
        if high > 2 * low and sum(h < 1.1 * low for h in heights) < 0.4 * len(lines):
            lines = [x for x in lines if x.height <= 1.1 * low]
    return lines, across


def line_text(line: Line, width: float, start: float, stop: float) -> str:
    """The line's text with what its end asks for; marks the line if it ends early."""
    if line.across:
        line.spans.sort(key=lambda s: (math.floor(s[0][0] / 2), s[0][1]))
    else:
        line.spans.sort(key=lambda s: (math.floor(s[0][1] / 2), -s[0][3]))
    text = ""
    for _, said in line.spans:
        text += said
        if said and is_letter(text[-1:]):
            text += " "
    text = text.removesuffix(" ")
    if not text:
        return ""
    last = text[-1]
    gap = stop - line.spans[-1][0][2 if line.across else 3]
    limit = 1.5 * line.height
    plain = not (is_letter(last) or holds_on(last) or is_digit(last))
    if plain or gap > 0.3 * width:
        line.breaks |= gap > limit or (not line.across and line.spans[0][0][1] - start > limit)
    if last == "-":
        return text[:-1]
    if is_letter(last) or last == "$":
        text += " "
    if not (is_letter(last) or is_digit(last)) or not line.across:
        ends = gap > 0.3 * width and not holds_on(last)
    else:
        ends = gap > 0.5 * (stop - start)
    if ends:
        line.breaks = True
        text += "\n"
    return text


def block_text(label: str, box: list[float], spans: list[tuple[list[float], str]]) -> BlockText:
    """Content and line measures of a block. Without spans, measures are 1; if no line is left, they are 0."""
    if not spans:
        return BlockText()
    lines, across = group(spans)
    if not lines:
        return BlockText(horizontal=across, line_height=0.0, line_width=0.0)
    low, high = (0, 2) if across else (1, 3)
    start, stop = (min(b[low] for b, _ in spans), max(b[high] for b, _ in spans)) if label == "reference" else (box[low], box[high])
    widest, texts = -math.inf, []
    for line in lines:
        widest = max(widest, line.width)
        texts.append(line_text(line, widest, start, stop))
    out = BlockText(lines=len(lines), horizontal=across, line_height=mean(x.height for x in lines), line_width=mean(x.width for x in lines))
    out.seg_start = lines[0].spans[0][0][0]
    if len(lines) > 1:
        out.seg_end = lines[-1].spans[-1][0][2]
    if label in ("doc_title", "content"):
        out.content = (" " if label == "doc_title" else "\n").join(texts)
        return out
    early = sum(x.breaks for x in lines)
    content, short_before, last = "", False, ""
    for line, text in zip(lines, texts):
        if not text:
            continue
        if short_before:
            indent = line.box[low] - start
            inner = indent > 1.5 * line.height and not (is_letter(last) or is_digit(last))
            if (inner or indent > 0.4 * (stop - start)) and not content.endswith("\n"):
                text = "\n" + text
        content += text
        last = text[-2] if len(text) > 2 and text.endswith(" ") else text[-1]
        held = is_letter(last) or holds_on(last) or is_digit(last)
        if (not text.endswith("\n") and not held and early > 0.5 * len(texts)) or early > 0.6 * len(texts):
            content += "\n"
        short_before = stop - line.box[high] > 0.3 * (stop - start)
    out.content = content
    return out
