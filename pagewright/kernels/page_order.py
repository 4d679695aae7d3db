"""Reading order of a page of labelled blocks, or of a page of regions that are such pages themselves.

Blocks first take up their children (subtitles, captions, notes). What remains is parted by cuts across the page, each
part is ordered by recursive cuts, blocks that lie across columns are inserted where they are nearest, and children
come out next to their parents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np

from pagewright.functions import geometry, labels
from pagewright.kernels.lines import mean
from pagewright.kernels.xycut import ExtentError, profile, recursive_cut

#: Roles that keep a block out of the cuts.
ASIDE = {"header", "unordered", "footer", "vision_footnote", "sub_paragraph_title", "doc_title_text", "vision_title", "sub_region"}
#: Shares, factors and weights of the ordering.
NEAR, INSIDE, ACROSS, WIDE_LINE = 0.1, 0.9, 0.1, 10.0
EDGE, UP, LEFT, EDGE_TOLERANCE = 1e4, 1.0, 1e-4, 2.0

Box = list[int]


def role_group(label: str) -> str:
    return next((name for name, members in labels.ROLES.items() if label in members), "normal_text")


@dataclass
class Block:
    """Measures are those of the box that the block was made with, whatever it takes up later."""

    label: str
    frame: tuple[float, float, float, float]
    lines: int = 1
    line_height: float = 1.0
    line_width: float = 1.0
    seg_start: float | None = None
    seg_end: float | None = None
    distance: float = 0.0
    across: bool | None = None
    box: Box = field(init=False)
    role: str | None = field(default=None, init=False)
    children: list[int] = field(default_factory=list, init=False)
    first_box: Box | None = field(default=None, init=False)

    def __post_init__(self) -> None:
        self.box = [int(v) for v in self.frame]
        self.width, self.height = self.frame[2] - self.frame[0], self.frame[3] - self.frame[1]
        self.area = self.width * self.height
        if self.across is None:
            self.across = self.width >= self.height
        self.seg_start = self.frame[0] if self.seg_start is None else self.seg_start
        self.seg_end = self.frame[2] if self.seg_end is None else self.seg_end

    @property
    def long(self) -> float:
        return self.width if self.across else self.height

    @property
    def short(self) -> float:
        return self.height if self.across else self.width

    @property
    def centre(self) -> tuple[float, float]:
        return (self.box[0] + self.box[2]) / 2, (self.box[1] + self.box[3]) / 2

    @property
    def along(self) -> tuple[int, int]:
        """Start and end on the block's own axis."""
        return (self.box[0], self.box[2]) if self.across else (self.box[1], self.box[3])

    @property
    def aside(self) -> bool:
        return self.role in ASIDE


def overlap(a: Box, b: Box, small: bool) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    sizes = [max(x[2] - x[0], 0) * max(x[3] - x[1], 0) for x in (a, b)]
    whole = min(sizes) if small else sum(sizes) - both
    return both / whole if whole > 0 else 0.0


def shadow(a: Box, b: Box, axis: int, small: bool = False) -> float:
    """Overlap of projections on an axis, over the hull or the smaller."""
    both = min(a[axis + 2], b[axis + 2]) - max(a[axis], b[axis])
    whole = min(a[axis + 2] - a[axis], b[axis + 2] - b[axis]) if small else max(a[axis + 2], b[axis + 2]) - min(a[axis], b[axis])
    return both / whole if both > 0 and whole > 0 else 0.0


def gap(a: Box, b: Box, weights: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0)) -> float:
    """Weighted distance of nearest edges on the axes where projections are apart."""
    apart = [shadow(a, b, axis) == 0 for axis in (0, 1)]
    out = 0.0
    for axis in (0, 1):
        if apart[axis]:
            near = min(abs(a[axis] - b[axis + 2]), abs(a[axis + 2] - b[axis]))
            out += near * weights[2 * axis + (0 if a[axis + 2] < b[axis] else 1)]
    return out


def weights_of(name: str, vertical: bool) -> tuple[float, ...]:
    if name == "doc_title":
        return geometry.TITLE_WEIGHTS[vertical]
    return geometry.DOWN_WEIGHTS if name in geometry.DOWN_LABELS else geometry.UP_WEIGHTS


def merged(boxes: Iterable[Box], axis: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Intervals that touch or overlap as one, and how many each took."""
    out: list[tuple[int, int]] = []
    counts: list[int] = []
    for low, high in sorted(((b[axis], b[axis + 2]) for b in boxes), key=lambda v: v[0]):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
            counts[-1] += 1
        else:
            out.append((low, high))
            counts.append(1)
    return out, counts


def valleys(values: np.ndarray) -> list[tuple[int, int]]:
    """Plateaus lower than both neighbours, without the first; the start counts as higher."""
    values = np.asarray(values)
    edge = np.flatnonzero(np.diff(values)) + 1
    starts, ends = [0, *edge.tolist()], [*(edge - 1).tolist(), len(values) - 1]
    low = [(s, e) for s, e in zip(starts[:-1], ends[:-1]) if (s == 0 or values[s - 1] > values[s]) and values[e + 1] > values[s]] if len(values) else []
    return low[1:]


def continues(block: Block, before: Block) -> bool:
    """Whether a block goes on with the paragraph of the one before."""
    (start, end), (b_start, b_end) = block.along, before.along
    meets = start < b_end and end > b_start
    left, right = (min(start, b_start), max(end, b_end)) if meets else (start, b_end)
    apart = 0.0 if meets else abs(start - b_end)
    return abs(right - before.seg_end) < 10 and block.seg_start - left < 10 and before.lines > 1 and apart < max(before.width, block.width)


class Page:
    """Blocks of a page by index. axis is 0 where the page reads from left to right, 1 where it reads from top to bottom."""

    def __init__(self, blocks: list[Block], frame: tuple[float, float, float, float]):
        self.blocks, self.frame = blocks, frame
        self.buckets: dict[str, list[int]] = {}
        for k, b in enumerate(blocks):
            self.buckets.setdefault(role_group(b.label), []).append(k)
        texts = [blocks[k] for k in self.bucket("normal_text")]
        self.across = 2 * sum(b.across for b in texts) >= len(texts)
        self.line_height = mean(b.line_height for b in texts) if texts else 10.0
        self.line_width = mean(b.line_width for b in texts) if texts else 20.0

    @property
    def axis(self) -> int:
        return 0 if self.across else 1

    def bucket(self, name: str) -> list[int]:
        return self.buckets.setdefault(name, [])

    def plain_order(self, ids: list[int]) -> list[int]:
        def key(k: int) -> tuple:
            b = self.blocks[k]
            (cx, cy), row, column = b.centre, math.floor(b.box[1] / self.line_height), math.floor(b.box[0] / self.line_width)
            return (row, column, cx * cx + cy * cy) if self.across else (math.floor(-b.box[2] / self.line_width), row, cy * cy - cx * cx)

        return sorted(ids, key=key)

    def around(self, k: int, others: list[int], across: bool) -> tuple[list[int], list[int]]:
        """Others beside the block: those that start before it, nearest first, and those that start behind it."""
        own, axis = self.blocks[k].box, 0 if across else 1
        beside = [o for o in others if o != k and shadow(own, self.blocks[o].box, axis, small=True) > NEAR]
        at = lambda o: self.blocks[o].box[1 - axis]
        return sorted((o for o in beside if at(o) <= own[1 - axis]), key=lambda o: -at(o)), sorted((o for o in beside if at(o) > own[1 - axis]), key=at)

    # -- children

    def attach(self, parent: int, child: int, role: str) -> None:
        """The child, and what it has taken up, belongs to the parent, whose box grows."""
        p, c = self.blocks[parent], self.blocks[child]
        c.role = role
        if not p.children:
            p.first_box = list(p.box)
        p.box = [min(p.box[0], c.box[0]), min(p.box[1], c.box[1]), max(p.box[2], c.box[2]), max(p.box[3], c.box[3])]
        p.children += [child, *c.children]
        c.children = []
        for ids in self.buckets.values():
            if child in ids:
                ids.remove(child)

    def take_title_texts(self, k: int) -> None:
        title, texts = self.blocks[k], list(self.bucket("normal_text"))
        for side in self.around(k, texts, title.across):
            for c in side[:1]:
                b = self.blocks[c]
                long_fits = b.long < title.long or b.long > 1.5 * title.long
                if b.across == title.across and b.label == "text" and b.short < 0.8 * title.short and long_fits and b.lines < 3 and gap(title.box, b.box) < 2 * b.line_height:
                    self.attach(k, c, "doc_title_text")
        for c in texts:
            b = self.blocks[c]
            if b.role != "doc_title_text" and b.across == title.across and overlap(title.box, b.box, True) > INSIDE:
                self.attach(k, c, "doc_title_text")

    def take_subtitles(self, k: int) -> None:
        title = self.blocks[k]
        if title.role == "sub_paragraph_title":
            return
        for side in self.around(k, [*self.bucket("paragraph_title"), *self.bucket("normal_text")], title.across):
            for c in side:
                b = self.blocks[c]
                if b.label not in labels.PARAGRAPH_TITLE:
                    break
                line = min(title.line_height, b.line_height)
                if b.across == title.across and abs(b.along[0] - title.along[0]) < int(2 * line) and gap(title.box, b.box) <= 1.5 * line:
                    self.attach(k, c, "sub_paragraph_title")

    def take_captions(self, k: int) -> None:
        picture = self.blocks[k]
        others = [*self.bucket("normal_text"), *self.bucket("vision_title")]
        noted = titled = False
        for across in (picture.across, not picture.across):
            for behind, side in enumerate(self.around(k, others, across)):
                for c in side:
                    b = self.blocks[c]
                    text, title = b.label == "text", b.label in labels.VISION_TITLE
                    if not (behind or text or title) or (behind and noted and text):
                        break
                    near = gap(picture.box, b.box) <= 2 * b.line_height
                    middle = picture.centre[0] - b.centre[0]
                    if title and near:
                        titled = True
                        self.attach(k, c, "vision_title")
                    if text:
                        if not noted and b.across == picture.across and b.long < picture.long and near and self._is_note(picture, b, middle):
                            noted = True
                            if behind:
                                b.label = "vision_footnote"
                            self.attach(k, c, "vision_footnote")
                        break
            if titled:
                break
        for c in others:
            if c in self.bucket("normal_text") and overlap(picture.box, self.blocks[c].box, True) > INSIDE:
                self.blocks[c].label = "vision_footnote"
                self.attach(k, c, "vision_footnote")

    @staticmethod
    def _is_note(picture: Block, b: Block, middle: float) -> bool:
        centred = b.short < picture.short and b.long < 0.5 * picture.long and abs(middle) < 10
        flush = b.lines == 1 and (picture.box[0] - b.box[0] < 10 or picture.box[2] - b.box[2] < 10)  # signed on purpose
        return centred or flush

    def take_regions(self, k: int) -> None:
        for c, b in enumerate(self.blocks):
            if c != k and b.role != "sub_region" and self.blocks[k].area > b.area and overlap(self.blocks[k].box, b.box, False) > 0:
                self.attach(k, c, "sub_region")

    def settle_role(self, k: int) -> None:
        b = self.blocks[k]
        role = "region" if b.label == "region" else role_group(b.label)
        if role == "vision_title" or (role == "paragraph_title" and b.role is not None):
            role = "normal_text"
        if role == "vision":
            b.lines, b.across = 1, self.across
        b.role = role
        take = {"doc_title": self.take_title_texts, "paragraph_title": self.take_subtitles, "vision": self.take_captions, "region": self.take_regions}.get(role)
        if take:
            take(k)

    # -- cuts

    def parts(self) -> list[list[int]]:
        """Groups of blocks between cuts across the page, in reading order, without those that stand aside."""
        axis, other = self.axis, 1 - self.axis
        middle = (self.frame[axis] + self.frame[axis + 2]) / 2
        central = []
        for k, b in enumerate(self.blocks):
            if not b.aside:
                self.settle_role(k)
            tolerance = int(b.long) // 5 if b.across else int(b.short) // 10
            if abs((b.box[axis] + b.box[axis + 2]) / 2 - middle) <= tolerance:
                central.append(k)
        free = [b for b in self.blocks if not b.aside]
        if not free:
            return []
        cuts: list[int] = []
        bands: list[tuple[int, int]] = []
        if central:
            bands, counts = merged((b.box for b in free), other)
            for k in central:
                b = self.blocks[k]
                pair = (b.box[other], b.box[other + 2]) if b.across == self.across else None
                if not b.aside and pair in bands and counts[bands.index(pair)] == 1:
                    cuts += pair
        regions = self.blocks[0].label == "region"
        rest = [b.box for b in free if b.role != "vision"]
        if rest and (regions or len(merged(rest, axis)[0]) == 1):
            cuts += self._gap_cuts(bands or merged((b.box for b in free), other)[0], cuts, regions)
        ordered = sorted(range(len(self.blocks)), key=lambda k: self.blocks[k].box[other + 2])
        groups: list[list[int]] = [[] for _ in range(len(set(cuts)) + 1)]
        limits = sorted(set(cuts))
        for k in ordered:
            if not self.blocks[k].aside:
                groups[sum(self.blocks[k].box[other + 2] > c for c in limits)].append(k)
        groups = [g for g in groups if g]
        return groups if self.across else groups[::-1]

    def _gap_cuts(self, bands: list[tuple[int, int]], known: list[int], regions: bool) -> list[int]:
        """Cuts at wide gaps between bands, and at narrower ones where the columns on either side differ."""
        other = 1 - self.axis
        cuts: list[int] = []
        last = max(max((c for c in known if c < bands[0][1]), default=0), bands[0][0])
        for now, after in zip(bands, bands[1:]):
            space = after[0] - now[1]
            if regions or space >= 3 * self.line_height:
                cuts.append(now[1])
            elif space > 1.2 * self.line_height:
                above, below = self._column_gaps(last, now[1], other), self._column_gaps(now[1], after[1], other)
                most = max(len(above), len(below))
                if most and len(merged([[s, s, e, e] for s, e in above + below], self.axis)[0]) != most:
                    last = now[1]
                    cuts.append(now[1])
        return cuts

    def _column_gaps(self, start: int, end: int, axis: int) -> list[tuple[int, int]]:
        inside = np.array([b.box for b in self.blocks if b.box[axis] >= start and b.box[axis + 2] <= end], np.int64).reshape(-1, 4)
        if not len(inside):
            return []
        try:
            return valleys(profile(inside[:, 1 - axis], inside[:, 3 - axis]))
        except ExtentError:
            return []

    # -- blocks across columns

    def mark_crossing(self, group: list[int]) -> list[int]:
        """The group by left edge and width; blocks that others lie under or beside on both sides get a role of their own."""
        group = sorted(group, key=lambda k: (self.blocks[k].box[0], self.blocks[k].width))
        out = lambda b: b.role in ("doc_title", "cross_layout", "cross_reference")
        for k in group:
            b = self.blocks[k]
            if out(b):
                continue
            for r in group:
                ref = self.blocks[r]
                if r == k or out(ref):
                    continue
                covered = overlap(b.box, ref.box, False)
                if covered > 0 and ref.role == "vision":
                    ref.role = "cross_layout"
                    break
                if covered > ACROSS and b.area < ref.area:
                    b.role = "cross_layout"
                    break
                if shadow(b.box, ref.box, self.axis) > 0:
                    self._third(group, k, r, out)
        return group

    def _third(self, group: list[int], k: int, r: int, out: Callable[[Block], bool]) -> None:
        b, ref, axis = self.blocks[k], self.blocks[r], self.axis
        for s in group:
            third = self.blocks[s]
            if s in (k, r) or out(third):
                continue
            if overlap(b.box, third.box, False) > ACROSS:
                if third.role == "vision":
                    third.role = "cross_layout"
                    return
                if b.role == "vision" or b.area < third.area:
                    b.role = "cross_layout"
                    return
            if shadow(b.box, third.box, axis) > 0 and shadow(ref.box, third.box, axis) == 0 and shadow(ref.box, third.box, 1 - axis) > 0:
                wide = all(x.role == "normal_text" and x.long > WIDE_LINE * x.line_height for x in (ref, third))
                if b.role in ("vision", "region") or wide:
                    b.role = "cross_reference" if b.label == "reference" else "cross_layout"

    # -- insertion

    def insert_all(self, done: list[int], rest: list[int]) -> None:
        ways = {"cross_reference": self.put_reference, "region": self.put_by_distance}
        ways |= dict.fromkeys(("cross_layout", "paragraph_title", "doc_title", "vision_title", "vision"), self.put_weighted)
        for n, k in enumerate(self.plain_order(rest)):
            role = "region" if self.blocks[k].label == "region" else self.blocks[k].role
            if n == 0 and role == "doc_title":
                done.insert(0, k)
            else:
                done.insert(ways.get(role, self.put_near)(k, done), k)

    def put_reference(self, k: int, done: list[int]) -> int:
        """Behind the lowest, rightmost block above; a block that isn't above repeats the distance before it."""
        top, best, at, last = self.blocks[k].box[1], math.inf, 0, math.inf
        for n, c in enumerate(done):
            box = self.blocks[c].box
            if box[3] <= top:
                last = -(10 * box[2] + box[3])
            if last < best:
                best, at = last, n
        return min(at + 1, len(done))

    def put_by_distance(self, k: int, done: list[int]) -> int:
        return next((n for n, c in enumerate(done) if self.blocks[c].distance > self.blocks[k].distance), len(done))

    def put_near(self, k: int, done: list[int]) -> int:
        """Behind the nearest first corner."""
        x, y = self.blocks[k].box[:2]
        at = min(range(len(done)), key=lambda n: abs(self.blocks[done[n]].box[0] - x) + abs(self.blocks[done[n]].box[1] - y), default=0)
        return min(at + 1, len(done))

    def put_weighted(self, k: int, done: list[int]) -> int:
        """Beside the block of the least weighted distance: edges count most, then how far up, then how far left it stands."""
        b = self.blocks[k]
        weights = weights_of(b.role or "", not b.across)
        leads = b.role != "unordered" or b.label in (*labels.DOC_TITLE, *labels.PARAGRAPH_TITLE, *labels.VISION)
        visual = b.label in (*labels.VISION, *labels.VISION_TITLE)
        tolerance, best, highest, at = EDGE_TOLERANCE, math.inf, math.inf, 0
        for n, c in enumerate(done):
            o = self.blocks[c]
            edge = gap(b.box, o.box, weights)
            if b.label in labels.DOC_TITLE:
                tolerance = max(tolerance, self.line_width, 1.0)
            if b.label == "abstract":
                tolerance *= 2
                edge = 10 * max(edge, 0.1)
            up, left = (o.box[1], o.box[0]) if self.across else (-o.box[2], o.box[1])
            if leads and (o.box[3] < b.box[1] if self.across else o.box[0] > b.box[2]):
                up, left = -up, -left
            if abs(highest - up) <= tolerance:
                up = highest
            cost = edge * EDGE + up * UP + left * LEFT
            highest = min(highest, up)
            if cost < best:
                best, at = cost, n
                if self._behind(b, o):
                    at = n + 1
                    if visual and n + 1 < len(done) and continues(self.blocks[done[n + 1]], o):
                        at += 1
                elif visual and n > 0 and continues(o, self.blocks[done[n - 1]]):
                    at = n - 1
        return min(at, len(done))

    def _behind(self, b: Block, o: Block) -> bool:
        x1, y1, x2, _ = b.box
        half = lambda v: int(v / 2)
        if half(y1) != half(o.box[1]):
            return y1 > o.box[1]
        if self.across and half(x1) != half(x2):  # the block's own edges, on purpose
            return x1 > o.box[0]
        if not self.across and x1 != x2:
            return -x2 > -o.box[2]
        return sum(v * v for v in b.centre) > sum(v * v for v in o.centre)

    # -- the whole

    def cut_order(self, ids: list[int]) -> list[int]:
        """Order of one part by recursive cuts of its boxes, mirrored where the page reads from right to left."""
        axis, other = self.axis, 1 - self.axis
        single = len(merged((self.blocks[k].box for k in ids), axis)[0]) == 1 or max(self.blocks[k].lines for k in ids) == 1
        boxes = {k: list(self.blocks[k].box) for k in ids}
        if not self.across:
            boxes = {k: [-b[0], b[1], -b[2], b[3]] for k, b in boxes.items()}
        first, unit = (other, self.line_height) if single else (axis, self.line_width)
        step = max(int(unit) // 2, 1)
        ids = sorted(ids, key=lambda k: (boxes[k][first] // step, boxes[k][1 - first]))
        shrink([boxes[k] for k in ids], other)
        try:
            return [ids[n] for n in recursive_cut(np.array([boxes[k] for k in ids]), by_columns=(other if single else axis) == 0)]
        except ExtentError:
            return ids

    def expand(self, done: list[int]) -> list[int]:
        """Children next to their parents, in the order of their boxes; those of regions by distance."""
        out, todo = [], list(done)
        while todo:
            k = todo.pop(0)
            b = self.blocks[k]
            if not b.children:
                out.append(k)
                continue
            family, b.children = [*b.children, k], []
            if b.first_box is not None:
                b.box = b.first_box
            head = self.blocks[family[0]]
            if head.label == "region":
                todo = sorted(family, key=lambda m: self.blocks[m].distance) + todo
                continue

            def key(m: int) -> tuple:
                o = self.blocks[m]
                cx, cy = o.centre
                return (o.box[1], o.box[0], cx * cx + cy * cy) if head.across else (-o.box[2], o.box[1], cy * cy - cx * cx)

            family.sort(key=key)
            out.append(family[0])
            todo = family[1:] + todo
        return out

    def order(self) -> list[int]:
        if not self.blocks:
            return []
        parts = self.parts()
        aside = {name: self.plain_order(self.bucket(name)) for name in ("header", "footer", "unordered")}
        done: list[int] = []
        later: list[int] = []
        for group in parts:
            regions = self.blocks[group[0]].label == "region"
            if not regions or len(merged((self.blocks[k].box for k in group), self.axis)[0]) == 1:
                group = self.mark_crossing(group)
            special = lambda k: self.blocks[k].role in ("cross_layout", "cross_reference", "doc_title", "unordered")
            plain = [k for k in group if not special(k)]
            titles = [k for k in group if special(k) and self.blocks[k].label == "doc_title"]
            later += [k for k in group if special(k) and self.blocks[k].label != "doc_title"]
            part = self.cut_order(plain) if plain else []
            self.insert_all(part, titles)
            if later and self.blocks[later[0]].label == "region":
                self.insert_all(part, later)
                later = []
            done += part
        self.insert_all(done, later)
        return self.expand([*aside["header"], *done, *aside["footer"], *aside["unordered"]])


def shrink(boxes: list[Box], axis: int) -> None:
    """Parts neighbours in the list that overlap a little along the axis, or meet there, in place: a pixel goes on either side of the middle."""
    for a, b in zip(boxes, boxes[1:]):
        slim = 0 < shadow(a, b, axis) < NEAR and shadow(a, b, 1 - axis) > 0
        if slim or abs(a[axis + 2] - b[axis]) <= 3:
            split = int((max(a[axis], b[axis]) + min(a[axis + 2], b[axis + 2])) / 2)
            ends = (axis + 2, axis) if a[axis] < b[axis] else (axis, axis + 2)
            a[ends[0]], b[ends[1]] = split - 1, split + 1


def region_block(page: Page) -> Block:
    """A page as a block of a page of regions."""
    corner = (lambda b: math.hypot(b.box[0], b.box[1])) if page.across else (lambda b: math.hypot(page.frame[2] - b.box[2], b.box[1]))
    out = Block("region", page.frame, lines=10, line_height=page.line_height, line_width=page.line_width, across=page.across)
    out.distance = min(map(corner, page.blocks), default=0.0)
    return out
