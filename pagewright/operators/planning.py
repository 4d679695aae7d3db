"""Sizes, scales and crops that are planned before any pixel is touched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.numbers import half_away, half_even, truncated


def detector_size(w: Column, h: Column, limit: int = 960, most: int = 4000, stride: int = 32) -> Column:
    """struct<w,h>: longest side at most the limit (truncated), then rounded to the stride, ties to even. Very small sources count as padded to the stride."""
    small = w + h < 64
    w, h = (F.when(small, F.greatest(c, F.lit(stride))).otherwise(c) for c in (w, h))
    first = F.when(F.greatest(w, h) > limit, F.lit(float(limit)) / F.greatest(w, h)).otherwise(F.lit(1.0))
    w, h = truncated(w * first), truncated(h * first)
    second = F.when(F.greatest(w, h) > most, F.lit(float(most)) / F.greatest(w, h)).otherwise(F.lit(1.0))
    w, h = truncated(w * second), truncated(h * second)
    snap = lambda c: F.greatest(half_even(c / stride) * stride, F.lit(float(stride))).cast("bigint")
    return F.struct(snap(w).alias("w"), snap(h).alias("h"))


def short_edge_size(w: Column, h: Column, edge: int = 256) -> Column:
    """struct<w,h>: the shorter side becomes the edge, ties away from zero."""
    scale = F.lit(float(edge)) / F.least(w, h)
    return F.struct(half_away(w * scale).cast("bigint").alias("w"), half_away(h * scale).cast("bigint").alias("h"))


def long_edge_size(w: Column, h: Column, edge: int = 512) -> Column:
    """struct<w,h>: the longer side becomes the edge, ties to even."""
    scale = F.lit(float(edge)) / F.greatest(w, h)
    return F.struct(half_even(w * scale).cast("bigint").alias("w"), half_even(h * scale).cast("bigint").alias("h"))


def render_pixels(w: Column, h: Column, scale: Column) -> Column:
    return F.ceil(w * scale) * F.ceil(h * scale)


def render_scale(w: Column, h: Column, asked: float = 2.0, least: float = 0.5, budget: int = 40_000_000, steps: int = 32) -> Column:
    """The scale asked for if the page's pixels fit the budget; else the lower end of so many bisection steps; null if not even the least scale fits or a size isn't positive."""
    fits = lambda s: render_pixels(w, h, s) <= budget
    start = F.struct(F.lit(float(least)).alias("low"), F.least(F.lit(float(asked)), F.sqrt(F.lit(float(budget)) / (w * h))).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        middle = (acc["low"] + acc["high"]) / 2
        return F.struct(F.when(fits(middle), middle).otherwise(acc["low"]).alias("low"), F.when(fits(middle), acc["high"]).otherwise(middle).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda acc: acc["low"])
    sound = (w > 0) & (h > 0)
    return F.when(~sound, F.lit(None)).when(fits(F.lit(float(asked))), F.lit(float(asked))).when(~fits(F.lit(float(least))), F.lit(None)).otherwise(found)


def crop_size(quad: Column) -> Column:
    """struct<w,h,rotates> of a quadrilateral array<struct<x,y>>: the longer of opposite edges, truncated; it is turned if at least one and a half times as tall as wide."""
    edge = lambda i, j: F.sqrt(F.pow(quad[i]["x"] - quad[j]["x"], 2) + F.pow(quad[i]["y"] - quad[j]["y"], 2))
    w, h = truncated(F.greatest(edge(0, 1), edge(2, 3))), truncated(F.greatest(edge(0, 3), edge(1, 2)))
    return F.struct(w.alias("w"), h.alias("h"), F.when(w > 0, h / w >= 1.5).alias("rotates"))


#: Sine and cosine of the four angles that a page may be turned by, as double arithmetic gives them.
TURNS = {0: (0.0, 1.0), 90: (1.0, 6.123233995736766e-17), 180: (1.2246467991473532e-16, -1.0), 270: (-1.0, -1.8369701987210297e-16)}


def rotation(w: Column, h: Column, degrees: int) -> Column:
    """struct<a,b,c,d,e,f,w,h>: x' = a x + b y + c, y' = d x + e y + f, counter-clockwise about the centre; the new size truncates."""
    sin, cos = TURNS[degrees]
    cx, cy = w / 2, h / 2
    nw, nh = truncated(h * abs(sin) + w * abs(cos)), truncated(h * abs(cos) + w * abs(sin))
    c = (1 - cos) * cx - sin * cy + (nw - w) / 2
    f = sin * cx + (1 - cos) * cy + (nh - h) / 2
    return F.struct(F.lit(cos).alias("a"), F.lit(sin).alias("b"), c.alias("c"), F.lit(-sin).alias("d"), F.lit(cos).alias("e"), f.alias("f"), nw.alias("w"), nh.alias("h"))


def turn(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m["a"] * x + m["b"] * y + m["c"], m["d"] * x + m["e"] * y + m["f"]


def turn_back(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    det = m["a"] * m["e"] - m["b"] * m["d"]
    x, y = x - m["c"], y - m["f"]
    return (m["e"] * x - m["b"] * y) / det, (m["a"] * y - m["d"] * x) / det
