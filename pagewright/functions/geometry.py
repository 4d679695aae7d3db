"""Box and point arithmetic as Catalyst expressions.

A box is four double columns. Comparisons keep their strictness: touching boxes never intersect, and a zero reference
area gives the ratio 0.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "") -> Box:
    """The box in columns <prefix>x1 to <prefix>y2."""
    return Box(*(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))


def box_of(value: Column) -> Box:
    """The box in a struct's fields."""
    return Box(*(value[c] for c in ("x1", "y1", "x2", "y2")))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def area(b: Box) -> Column:
    """Absolute, so that inverted boxes have one too."""
    return F.abs((b.x2 - b.x1) * (b.y2 - b.y1))


def overlap_sides(a: Box, b: Box) -> tuple[Column, Column]:
    return F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)


def overlap_area(a: Box, b: Box) -> Column:
    w, h = overlap_sides(a, b)
    zero = F.lit(0.0)
    return F.greatest(w, zero) * F.greatest(h, zero)


def overlap_small(a: Box, b: Box) -> Column:
    """Intersection over the smaller area."""
    return ratio(overlap_area(a, b), F.least(area(a), area(b)))


def overlap_union(a: Box, b: Box) -> Column:
    both = overlap_area(a, b)
    return ratio(both, area(a) + area(b) - both)


def overlaps_by(a: Box, b: Box, pixels: float = 3.0) -> Column:
    """Both sides of the intersection are strictly longer."""
    w, h = overlap_sides(a, b)
    return (w > pixels) & (h > pixels)


def iou(a: Box, b: Box) -> Column:
    """Signed areas; boxes that only touch score 0."""
    w, h = overlap_sides(a, b)
    both = w * h
    signed = lambda x: (x.x2 - x.x1) * (x.y2 - x.y1)
    return F.when((w <= 0) | (h <= 0), F.lit(0.0)).otherwise(both / (signed(a) + signed(b) - both))


def over_second(a: Box, b: Box) -> Column:
    """Intersection over the second box's area; 0 for a flat second box."""
    second = (b.x2 - b.x1) * (b.y2 - b.y1)
    return F.when(second == 0, F.lit(0.0)).otherwise(overlap_area(a, b) / second)


def box_distance(a: Box, b: Box) -> Column:
    """Distance of centres plus the smaller city-block distance of equal corners."""
    dx, dy = (b.x1 + b.x2 - a.x1 - a.x2) / 2, (b.y1 + b.y2 - a.y1 - a.y2) / 2
    near, far = F.abs(b.x1 - a.x1) + F.abs(b.y1 - a.y1), F.abs(b.x2 - a.x2) + F.abs(b.y2 - a.y2)
    return F.sqrt(dx * dx + dy * dy) + F.least(near, far)


def projection(a_low: Column, a_high: Column, b_low: Column, b_high: Column, small: bool) -> Column:
    """Overlap of two intervals over the smaller one (small) or over their hull."""
    both = F.least(a_high, b_high) - F.greatest(a_low, b_low)
    whole = F.least(a_high - a_low, b_high - b_low) if small else F.greatest(a_high, b_high) - F.least(a_low, b_low)
    return F.when((both > 0) & (whole > 0), both / whole).otherwise(F.lit(0.0))


def projection_x(a: Box, b: Box, small: bool = False) -> Column:
    return projection(a.x1, a.x2, b.x1, b.x2, small)


def projection_y(a: Box, b: Box, small: bool = False) -> Column:
    return projection(a.y1, a.y2, b.y1, b.y2, small)


#: Directional weights (left, right, up, down) by label.
TITLE_WEIGHTS = {False: (1.0, 0.1, 0.1, 1.0), True: (0.2, 0.1, 1.0, 1.0)}
DOWN_WEIGHTS, UP_WEIGHTS = (1.0, 1.0, 0.1, 1.0), (1.0, 1.0, 1.0, 0.1)
DOWN_LABELS = ("paragraph_title", "table_title", "abstract", "image", "seal", "chart", "figure")


def label_weights(label: Column, vertical: bool = False) -> Column:
    """array<double>: left, right, up, down."""
    lit = lambda w: F.array(*map(F.lit, w))
    return F.when(label == "doc_title", lit(TITLE_WEIGHTS[vertical])).when(label.isin(*DOWN_LABELS), lit(DOWN_WEIGHTS)).otherwise(lit(UP_WEIGHTS))


def edge_distance(a: Box, b: Box, weights: Column) -> Column:
    """Weighted gaps to the nearest edges on axes whose projections are apart; 0 if both overlap."""
    h, v = projection_x(a, b), projection_y(a, b)
    gap_x = F.least(F.abs(a.x1 - b.x2), F.abs(a.x2 - b.x1)) * F.when(a.x2 < b.x1, weights[0]).otherwise(weights[1])
    gap_y = F.least(F.abs(a.y1 - b.y2), F.abs(a.y2 - b.y1)) * F.when(a.y2 < b.y1, weights[2]).otherwise(weights[3])
    zero = F.lit(0.0)
    return F.when(h == 0, gap_x).otherwise(zero) + F.when(v == 0, gap_y).otherwise(zero)


def city_distance(ax: Column, ay: Column, bx: Column, by: Column, wx: float = 1.0, wy: float = 1.0) -> Column:
    return wx * F.abs(ax - bx) + wy * F.abs(ay - by)


def corner_distance(b: Box, right: Column | None = None) -> Column:
    """Of the nearer corner to the origin, or to (right, 0)."""
    x, y = (b.x1, b.y1) if right is None else (right - b.x2, b.y1)
    return F.sqrt(x * x + y * y)


def within(inner: Box, outer: Box) -> Column:
    """All four edges, inclusive."""
    return (inner.x1 >= outer.x1) & (inner.y1 >= outer.y1) & (inner.x2 <= outer.x2) & (inner.y2 <= outer.y2)


def ring_area(points: Column) -> Column:
    """Signed area of a closed polygon, array<struct<x,y>>, by the shoelace rule."""
    n = F.size(points)
    nxt = lambda k: points[(k + 1) % n]
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, k: s + points[k]["x"] * nxt(k)["y"] - nxt(k)["x"] * points[k]["y"]) / 2


def ring_length(points: Column) -> Column:
    n = F.size(points)
    step = lambda k: F.sqrt(F.pow(points[(k + 1) % n]["x"] - points[k]["x"], 2) + F.pow(points[(k + 1) % n]["y"] - points[k]["y"], 2))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, k: s + step(k))


def unclip_distance(points: Column, factor: float = 1.5) -> Column:
    return ratio(F.abs(ring_area(points)) * factor, ring_length(points))


def order_corners(points: Column) -> Column:
    """Top-left, top-right, bottom-right, bottom-left by coordinate sums and differences; the first extreme on ties."""
    first = lambda key, low: F.array_position(F.transform(points, key), (F.array_min if low else F.array_max)(F.transform(points, key))).cast("int") - 1
    total, rise = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.array(points[first(total, True)], points[first(rise, True)], points[first(total, False)], points[first(rise, False)])


def clip_corner(value: Column, limit: Column) -> Column:
    """Truncated into 0 .. limit-1."""
    return F.least(F.greatest(value, F.lit(0.0)), limit - 1).cast("bigint")


def sound_quad(points: Column) -> Column:
    """Four finite corners, all different, that turn strictly one way."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    place = [tuple(F.get(points, F.lit(k))[c].cast("double") for c in "xy") for k in range(4)]

    def turn(k: int) -> Column:
        (ax, ay), (bx, by), (cx, cy) = (place[(k + j) % 4] for j in range(3))
        return (bx - ax) * (cy - by) - (by - ay) * (cx - bx)

    least, most = F.least(*map(turn, range(4))), F.greatest(*map(turn, range(4)))
    whole = points.isNotNull() & (F.size(points) == 4) & F.forall(points, lambda p: p.isNotNull() & finite(p["x"].cast("double")) & finite(p["y"].cast("double")))
    whole = F.coalesce(whole, F.lit(False))
    return F.when(whole, (F.size(F.array_distinct(points)) == 4) & ((least > 2.0**-52) | (most < -(2.0**-52)))).otherwise(False)


def kept_quad(points: Column, width: Column, height: Column) -> Column:
    """Corners in order and clipped to the image; null if the upper or left edge truncates to 3 or less, or the corners aren't sound any more."""
    total, rise = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    at = lambda key, ps, pick: (F.array_position(F.transform(ps, key), pick(F.transform(ps, key))) - 1).cast("int")
    low, high = at(total, points, F.array_min), at(total, points, F.array_max)
    rest = F.filter(points, lambda p, k: (k != low) & (k != high))
    corners = F.array(F.get(points, low), F.get(rest, at(rise, rest, F.array_min)), F.get(points, high), F.get(rest, at(rise, rest, F.array_max)))
    clipped = F.transform(corners, lambda p: F.struct(clip_corner(p["x"], width).alias("x"), clip_corner(p["y"], height).alias("y")))
    edge = lambda k: F.floor(F.hypot(F.get(clipped, F.lit(0))["x"] - F.get(clipped, F.lit(k))["x"], F.get(clipped, F.lit(0))["y"] - F.get(clipped, F.lit(k))["y"]))
    return F.when((low != high) & (edge(1) > 3) & (edge(3) > 3) & sound_quad(clipped), clipped)
