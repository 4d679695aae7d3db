"""From a score map to boxes: borders of bright areas, rectangles around them, scores in them, and their outlines grown."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np

Point = tuple[float, float]

BRIGHT, SHORT_BEFORE, SHORT_AFTER, BOX_SCORE, GROWTH, CANDIDATES = 0.3, 3.0, 5.0, 0.6, 1.5, 1000
#: Neighbours counter-clockwise from the right, y downwards: (dx, dy).
AROUND = ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))
SEEN, SEEN_RIGHT = 2, -126


def binary(scores: np.ndarray, threshold: float = BRIGHT) -> np.ndarray:
    """1 where the single-precision score is strictly above the threshold."""
    return (np.asarray(scores, np.float32) > np.float32(threshold)).astype(np.int16)


def borders(bitmap: np.ndarray) -> list[list[tuple[int, int]]]:
    """Borders of 8-connected areas and their holes, the last found first; vertices only where the direction changes."""
    height, width = bitmap.shape
    frame = np.zeros((height + 2, width + 2), np.int16)
    frame[1:-1, 1:-1] = bitmap != 0
    found = []
    for y in range(1, height + 1):
        if not frame[y].any():
            continue
        left = 0
        for x in range(1, width + 1):
            here = int(frame[y, x])
            if here != left:
                if left == 0 and here == 1:
                    found.append(_follow(frame, x, y, 4))
                    here = int(frame[y, x])
                elif here == 0 and left > 0:
                    found.append(_follow(frame, x - 1, y, 0))
            left = here
    return found[::-1]


def _follow(frame: np.ndarray, x0: int, y0: int, behind: int) -> list[tuple[int, int]]:
    """One border, from a pixel whose outside lies in direction behind. Pixels passed on their right side get a mark that starts no hole border."""
    step = lambda x, y, d: (x + AROUND[d & 7][0], y + AROUND[d & 7][1])
    lit = lambda p: frame[p[1], p[0]] != 0
    arrive = next((d & 7 for d in range(behind + 7, behind - 1, -1) if lit(step(x0, y0, d))), None)
    if arrive is None:
        frame[y0, x0] = SEEN_RIGHT
        return [(x0 - 1, y0 - 1)]
    last = step(x0, y0, arrive)
    points, heading, at, back = [], arrive ^ 4, (x0, y0), arrive
    while True:
        turn = next((d for d in range(back + 1, 16) if lit(step(*at, d))), 15)
        ahead = step(*at, turn)
        direction = turn & 7
        if 0 < direction <= back:  # the sweep went past the right-hand neighbour
            frame[at[1], at[0]] = SEEN_RIGHT
        elif frame[at[1], at[0]] == 1:
            frame[at[1], at[0]] = SEEN
        if direction != heading:
            points.append((at[0] - 1, at[1] - 1))
            heading = direction
        if ahead == (x0, y0) and at == last:
            return points
        at, back = ahead, direction ^ 4


def hull(points: list[Point]) -> list[Point]:
    """Convex hull without collinear points, from the least point on."""
    points = sorted(set(map(tuple, points)))
    if len(points) <= 2:
        return points

    def chain(ps: list[Point]) -> list[Point]:
        out: list[Point] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(points) + chain(points[::-1])


def smallest_rectangle(points: list[Point], first: bool = False) -> tuple[Point, Point, float]:
    """(centre, size, angle in degrees) of the least rectangle along a hull edge; of equal areas the last, or the first if asked for."""
    corners = hull(points)
    if len(corners) == 1:
        return corners[0], (0.0, 0.0), 0.0
    if len(corners) == 2:
        (ax, ay), (bx, by) = corners
        return ((ax + bx) * 0.5, (ay + by) * 0.5), (math.hypot(bx - ax, by - ay), 0.0), math.degrees(math.atan2(by - ay, bx - ax))
    best, least = None, math.inf
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        length = math.hypot(bx - ax, by - ay)
        ux, uy = (bx - ax) / length, (by - ay) / length
        u = [x * ux + y * uy for x, y in corners]
        v = [y * ux - x * uy for x, y in corners]
        w, h = max(u) - min(u), max(v) - min(v)
        if w * h < least if first else w * h <= least + 1e-12:
            least = min(least, w * h)
            cu, cv = (min(u) + max(u)) * 0.5, (min(v) + max(v)) * 0.5
            best = (cu * ux - cv * uy, cu * uy + cv * ux), (w, h), math.degrees(math.atan2(uy, ux))
    return best


def rectangle_corners(rect: tuple[Point, Point, float]) -> list[Point]:
    """The corners: the left two by height, the right two by height, clockwise from the top left."""
    (cx, cy), (w, h), angle = rect
    c, s = math.cos(math.radians(angle)) * 0.5, math.sin(math.radians(angle)) * 0.5
    one, two = (cx - s * h - c * w, cy + c * h - s * w), (cx + s * h - c * w, cy - c * h - s * w)
    corners = sorted([one, two, (2 * cx - one[0], 2 * cy - one[1]), (2 * cx - two[0], 2 * cy - two[1])], key=lambda p: p[0])
    left, right = corners[:2], corners[2:]
    top_left, bottom_left = left if left[1][1] > left[0][1] else left[::-1]
    top_right, bottom_right = right if right[1][1] > right[0][1] else right[::-1]
    return [top_left, top_right, bottom_right, bottom_left]


def _edge_pixels(a: tuple[int, int], b: tuple[int, int]) -> list[tuple[int, int]]:
    """Pixels of a line, one for each step of its longer axis; halves go toward zero along x, down along y."""
    (dx, dy) = (b[0] - a[0], b[1] - a[1])
    n = max(abs(dx), abs(dy))
    if n == 0:
        return [a]
    if abs(dx) >= abs(dy):
        a, b = (a, b) if dx >= 0 else (b, a)
        rise = b[1] - a[1]
        return [(a[0] + k, a[1] + int(math.copysign((2 * abs(rise) * k + n - 1) // (2 * n), rise))) for k in range(n + 1)]
    a, b = (a, b) if dy >= 0 else (b, a)
    run = b[0] - a[0]
    return [(a[0] + (2 * run * k + n - 1) // (2 * n), a[1] + k) for k in range(n + 1)]


def box_score(scores: np.ndarray, corners: list[Point]) -> float:
    """Mean of the scores between the outermost edge pixels of each row of the box's clipped frame; 0 without any."""
    height, width = scores.shape
    clip = lambda v, most: min(max(int(v), 0), most - 1)
    xs, ys = [p[0] for p in corners], [p[1] for p in corners]
    x0, x1 = clip(math.floor(min(xs)), width), clip(math.ceil(max(xs)), width)
    y0, y1 = clip(math.floor(min(ys)), height), clip(math.ceil(max(ys)), height)
    outline = [(int(x - x0), int(y - y0)) for x, y in corners]
    spans: dict[int, tuple[int, int]] = {}
    for a, b in zip(outline, outline[1:] + outline[:1]):
        for x, y in _edge_pixels(a, b):
            if 0 <= y <= y1 - y0 and 0 <= x <= x1 - x0:
                low, high = spans.get(y, (x, x))
                spans[y] = (min(low, x), max(high, x))
    total, n = 0.0, 0
    for y in sorted(spans):
        low, high = spans[y]
        for v in scores[y0 + y, x0 + low : x0 + high + 1].astype(np.float64).tolist():
            total, n = total + v, n + 1
    return total / n if n else 0.0


def growth_distance(corners: list[Point], ratio: float = GROWTH) -> float:
    """Area times the ratio over the perimeter."""
    ring = list(zip(corners, corners[1:] + corners[:1]))
    twice = perimeter = 0.0
    for (ax, ay), (bx, by) in ring:
        twice += ax * by - bx * ay
        perimeter += math.hypot(bx - ax, by - ay)
    return abs(twice) * 0.5 * ratio / perimeter


def _nearest(v: float) -> int:
    """Halves away from zero."""
    return int(v + 0.5) if v >= 0 else int(v - 0.5)


def grown(corners: list[Point], distance: float, tolerance: float = 0.25) -> list[tuple[int, int]]:
    """The outline of truncated corners moved outwards, with round joints as fine as the tolerance asks for."""
    path: list[tuple[int, int]] = []
    for p in ((int(x), int(y)) for x, y in corners):
        if not path or path[-1] != p:
            path.append(p)
    if len(path) > 1 and path[0] == path[-1]:
        path.pop()
    if len(path) < 3:
        raise ValueError("an outline needs three corners")
    size = abs(distance)
    steps = min(math.pi / math.acos(1 - min(tolerance, size * 0.25) / size), size * math.pi)
    turn = math.copysign(2 * math.pi / steps, distance)
    turn_sin, turn_cos = math.sin(turn), math.cos(turn)

    def normal(a: tuple[int, int], b: tuple[int, int]) -> Point:
        dx, dy = b[0] - a[0], b[1] - a[1]
        length = 1.0 / math.sqrt(dx * dx + dy * dy)
        return dy * length, -dx * length

    sides = [normal(a, b) for a, b in zip(path, path[1:] + path[:1])]
    out = []
    for k, (px, py) in enumerate(path):
        moved = lambda n: (_nearest(px + n[0] * distance), _nearest(py + n[1] * distance))
        before, after = sides[k - 1], sides[k]
        sine, cosine = before[0] * after[1] - after[0] * before[1], before[0] * after[0] + before[1] * after[1]
        if abs(sine * distance) < 1 and cosine > 0:
            out.append(moved(before))
            continue
        sine = max(-1.0, min(1.0, sine))
        if sine * distance < 0:
            out += [moved(before), (px, py), moved(after)]
            continue
        x, y = before
        for _ in range(max(_nearest(steps / (2 * math.pi) * abs(math.atan2(sine, cosine))), 1)):
            out.append(moved((x, y)))
            x, y = x * turn_cos - turn_sin * y, x * turn_sin + y * turn_cos
        out.append(moved(after))
    return out


def rescaled(corners: list[Point], source: tuple[int, int], target: tuple[int, int]) -> list[tuple[int, int]]:
    """Corners moved from one size (w, h) to another in single precision, ties to even, clamped to the size."""
    f = np.float32
    one = lambda v, s, t: int(min(max(np.rint(f(v) / f(s) * f(t)), f(0)), f(t)))
    return [(one(x, source[0], target[0]), one(y, source[1], target[1])) for x, y in corners]


def map_boxes(scores: np.ndarray, target: tuple[int, int], box_score_least: float = BOX_SCORE, ratio: float = GROWTH) -> list[tuple[list[tuple[int, int]], float]]:
    """(corners, score) of each box on a score map, in the order of borders. Scores are those of the box before it grows."""
    scores = np.asarray(scores, np.float32)
    if not np.isfinite(scores).all():
        raise ValueError("a score map must be finite")
    out = []
    for border in borders(binary(scores))[:CANDIDATES]:
        rect = smallest_rectangle(border)
        if min(rect[1]) < SHORT_BEFORE:
            continue
        corners = rectangle_corners(rect)
        score = box_score(scores, corners)
        if score < box_score_least:
            continue
        rect = smallest_rectangle(grown(corners, growth_distance(corners, ratio)))
        if min(rect[1]) < SHORT_AFTER:
            continue
        out.append((rescaled(rectangle_corners(rect), scores.shape[::-1], target), score))
    return out


def clipped_area(subject: list[Point], clipper: list[Point]) -> float:
    """Area of a polygon within a convex one."""
    turn = lambda ps: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ps, ps[1:] + ps[:1])) / 2
    if turn(clipper) < 0:
        clipper = clipper[::-1]
    out = list(subject)
    for a, b in zip(clipper, clipper[1:] + clipper[:1]):
        inside = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        left, out = out, []
        for p, q in zip(left[-1:] + left[:-1], left):
            dp, dq = inside(p), inside(q)
            if (dp >= 0) != (dq >= 0):
                t = dp / (dp - dq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            if dq >= 0:
                out.append(q)
        if not out:
            return 0.0
    return abs(turn(out))


def polygon_iou(a: list[Point], b: list[Point]) -> float:
    ring = lambda ps: abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ps, ps[1:] + ps[:1]))) / 2
    both = clipped_area(a, b)
    whole = ring(a) + ring(b) - both
    return both / whole if whole > 0 else 0.0


def labelled_areas(bitmap: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(min x, min y, max x, max y, pixels) of 8-connected areas, by their first pixel in rows from the top."""
    height, width = bitmap.shape
    up: dict[tuple[int, int], tuple[int, int]] = {}

    def root(p: tuple[int, int]) -> tuple[int, int]:
        while up[p] != p:
            up[p] = up[up[p]]
            p = up[p]
        return p

    lit = [(int(y), int(x)) for y, x in np.argwhere(bitmap != 0)]
    for y, x in lit:
        up[y, x] = (y, x)
        for q in ((y, x - 1), (y - 1, x - 1), (y - 1, x), (y - 1, x + 1)):
            if q in up:
                a, b = sorted((root(q), root((y, x))))
                up[b] = a
    out: dict[tuple[int, int], list[int]] = {}
    for y, x in lit:
        s = out.setdefault(root((y, x)), [x, y, x, y, 0])
        s[:] = [min(s[0], x), min(s[1], y), max(s[2], x), max(s[3], y), s[4] + 1]
    return [tuple(out[k]) for k in sorted(out)]


def polygon_pixels(outline: list[tuple[int, int]], width: int, height: int) -> np.ndarray:
    """Pixels of an integer polygon: its edges, and what an odd number of edges lies left of, in each row; crossings go to the nearest pixel, halves down."""
    mask = np.zeros((height, width), bool)
    ring = list(zip(outline, outline[1:] + outline[:1]))
    for a, b in ring:
        for x, y in _edge_pixels(a, b):
            if 0 <= x < width and 0 <= y < height:
                mask[y, x] = True
    for y in range(height):
        crossings = []
        for (ax, ay), (bx, by) in ring:
            if min(ay, by) <= y < max(ay, by):
                crossings.append(Fraction(ax * (by - ay) + (y - ay) * (bx - ax), by - ay))
        ends = [math.ceil(c - Fraction(1, 2)) for c in sorted(crossings)]
        for left, right in zip(ends[::2], ends[1::2]):
            mask[y, max(left, 0) : max(min(right, width - 1) + 1, 0)] = True
    return mask


def polygon_score(scores: np.ndarray, outline: list[Point]) -> float:
    """Mean of the scores in an outline that need not be convex, edges included; 0 without any pixel."""
    height, width = scores.shape
    clip = lambda v, most: min(max(int(v), 0), most - 1)
    xs, ys = [p[0] for p in outline], [p[1] for p in outline]
    x0, x1 = clip(math.floor(min(xs)), width), clip(math.ceil(max(xs)), width)
    y0, y1 = clip(math.floor(min(ys)), height), clip(math.ceil(max(ys)), height)
    mask = polygon_pixels([(int(x - x0), int(y - y0)) for x, y in outline], x1 - x0 + 1, y1 - y0 + 1)
    held = scores[y0 : y1 + 1, x0 : x1 + 1].astype(np.float64)[mask]
    return float(held.sum() / len(held)) if len(held) else 0.0
