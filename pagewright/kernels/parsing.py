"""A page's detections and recognized spans become ordered blocks with text.

reconcile() makes detections and spans agree, recognizing parts anew where a span belongs to several blocks or a block
has no text; assemble() gives blocks their text and puts regions, and the blocks in them, in reading order.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pagewright.functions import labels
from pagewright.kernels.lines import block_text
from pagewright.kernels.page_order import Block, Page, region_block

#: Overlap shares, pixels and areas.
PIXELS, DUPLICATE, BLANKED, CLAIMED, SPLIT, TITLE_AREA = 3.0, 0.5, 0.8, 0.6, 0.4, 0.3
REGION = "SupplementaryRegion"

Rect = list[float]
#: Recognizes a rectangle of the page: (text, score).
Recognize = Callable[[list[int]], tuple[str, float]]


@dataclass
class Detection:
    label: str
    box: Rect
    score: float = 1.0


@dataclass
class Span:
    box: Rect
    text: str
    score: float = 1.0
    label: str = "text"


@dataclass
class Reconciled:
    blocks: list[Detection]
    spans: list[Span]
    block_spans: dict[int, list[int]]
    regions: list[Detection] = field(default_factory=list)
    region_blocks: dict[int, list[int]] = field(default_factory=dict)


def area(b: Rect) -> float:
    return abs((b[2] - b[0]) * (b[3] - b[1]))


def sides(a: Rect, b: Rect) -> tuple[float, float]:
    return min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])


def share(a: Rect, b: Rect, small: bool = True) -> float:
    w, h = sides(a, b)
    both = max(w, 0.0) * max(h, 0.0)
    whole = min(area(a), area(b)) if small else area(a) + area(b) - both
    return both / whole if whole > 0 else 0.0


def hull(boxes: list[Rect]) -> Rect:
    return [min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)]


def common(a: Rect, b: Rect) -> Rect | None:
    out = [max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])]
    return out if out[0] < out[2] and out[1] < out[3] else None


def floored_hull(boxes: list[Rect]) -> Rect:
    """The integer hull that a running union from (65535, 65535, 0, 0) ends in."""
    out = hull([[65535, 65535, 0, 0], *boxes])
    return [float(math.floor(v)) for v in out]


def touches(spans: list[Span], box: Rect) -> list[int]:
    return [k for k, s in enumerate(spans) if all(side > PIXELS for side in sides(s.box, box))]


def without_duplicates(found: list[Detection], threshold: float = DUPLICATE) -> list[Detection]:
    gone: set[int] = set()
    for i, a in enumerate(found):
        for j in range(i + 1, len(found)):
            b = found[j]
            if i in gone or j in gone or share(a.box, b.box) <= threshold:
                continue
            if (a.label == "image") != (b.label == "image"):
                gone.add(i if a.label == "image" else j)
            else:
                gone.add(i if area(a.box) <= area(b.box) else j)
    return [d for k, d in enumerate(found) if k not in gone]


def relabel(blocks: list[Detection]) -> None:
    """A footnote above the lowest text is text; a lone large paragraph title on a page without a document title is one."""
    low = [b.label.lower() for b in blocks]
    lowest = max((b.box[3] for b, name in zip(blocks, low) if name == "text"), default=0.0)
    titles = [b for b, name in zip(blocks, low) if name == "paragraph_title"]
    most = max((area(b.box) for b in blocks), default=0.0)
    for b, name in zip(blocks, low):
        if name == "footnote" and b.box[3] < max(lowest, 0.0):
            b.label = "text"
    if len(titles) == 1 and "doc_title" not in low and area(titles[0].box) > most * TITLE_AREA:
        titles[0].label = "doc_title"


def reconcile(size: tuple[float, float], found: list[Detection], regions: list[Detection], spans: list[Span], recognize: Recognize, threshold: float = 0.0) -> Reconciled:
    blocks, spans = [Detection(d.label, list(d.box), d.score) for d in without_duplicates(found)], [Span(list(s.box), s.text, s.score, s.label) for s in spans]
    out = Reconciled(blocks, spans, {k: touches(spans, b.box) for k, b in enumerate(blocks) if b.label.lower() not in labels.NO_SPANS})
    frame = [b.box for b in blocks]
    relabel(blocks)
    owners: dict[int, list[int]] = {}
    for k, own in out.block_spans.items():
        for s in own:
            owners.setdefault(s, []).append(k)
    for s, ks in owners.items():
        if len(ks) > 1:
            _share_out(out, s, ks, recognize, threshold)
    for k, own in out.block_spans.items():
        if blocks[k].label not in labels.VISION and not any(spans[s].text for s in own) and all(blocks[k].box[c] < blocks[k].box[c + 2] for c in (0, 1)):
            text, score = recognize([int(v) for v in blocks[k].box])
            if score >= threshold:
                spans.append(Span(list(blocks[k].box), text, score))
                own.append(len(spans) - 1)
    if not blocks and spans:
        blocks += [Detection("text", list(s.box), s.score) for s in spans]
        out.block_spans |= {k: [k] for k in range(len(spans))}
        frame = [b.box for b in blocks]
    _match_regions(out, size, regions, floored_hull(frame))
    return out


def _share_out(out: Reconciled, s: int, owners: list[int], recognize: Recognize, threshold: float) -> None:
    """A span of several blocks is read anew in each: the first that succeeds replaces it, later ones are appended. Spans that the part covers are blanked before the result is known."""
    whole, first = out.spans[s].box, True
    for k in owners:
        part = common(whole, out.blocks[k].box)
        if part is None:
            continue
        for other in out.block_spans.get(k, []):
            if share(out.spans[other].box, part) > BLANKED:
                out.spans[other].text = ""
        text, score = recognize([int(v) for v in part])
        if score < threshold:
            continue
        if first:
            out.spans[s].box, out.spans[s].text, out.spans[s].score, first = part, text, score, False
        else:
            out.spans.append(Span(part, text, score))
            own = out.block_spans[k]
            if s in own:
                own.remove(s)
            own.append(len(out.spans) - 1)


def _match_regions(out: Reconciled, size: tuple[float, float], regions: list[Detection], frame: Rect) -> None:
    blocks = out.blocks
    if not regions:
        out.regions, out.region_blocks = [Detection(REGION, frame)], {0: list(range(len(blocks)))}
        return
    out.regions = [Detection(r.label, list(r.box), r.score) for r in sorted(regions, key=lambda r: area(r.box))]
    free = list(range(len(blocks)))
    plain = lambda k: blocks[k].label not in labels.MASK
    claim = lambda box: [k for k in free if plain(k) and share(box, blocks[k].box) > CLAIMED]
    for r, region in enumerate(out.regions):
        own = claim(region.box)
        out.region_blocks[r] = []
        while own:
            grown = hull([blocks[k].box for k in own])
            again = claim(grown)
            if len(again) == len(own):
                out.region_blocks[r], region.box = again, grown
                free = [k for k in free if k not in again]
                break
            own = again
    while free:
        box, own = hull([blocks[k].box for k in free]), []
        for r, region in enumerate(out.regions):
            if out.region_blocks.get(r) and share(box, region.box, small=False) > 0:
                box, own = shrink_region(box, region.box, size, free, blocks)
        own = [k for k in own if plain(k)] or [k for k in free if plain(k)]
        if not own:
            break
        out.region_blocks[len(out.regions)] = own
        out.regions.append(Detection(REGION, hull([blocks[k].box for k in own])))
        free = [k for k in free if k not in own]
    for k, b in enumerate(blocks):
        if not plain(k):
            out.region_blocks[len(out.regions)] = [k]
            out.regions.append(Detection(REGION, list(b.box)))


def shrink_region(box: Rect, fixed: Rect, size: tuple[float, float], ids: list[int], blocks: list[Detection]) -> tuple[Rect, list[int]]:
    """The box drawn back from a fixed region on the side where the two edges are nearest, until blocks lie in it; three sides are tried. Blocks that the cut goes through push it further."""
    if not ids:
        return box, []

    def margins(outer: Rect, inner: Rect) -> list[float]:
        return [(inner[0] - outer[0]) / size[0], (inner[1] - outer[1]) / size[1], (outer[2] - inner[2]) / size[0], (outer[3] - inner[3]) / size[1]]

    opposite = (2, 3, 0, 1)
    all_margins = margins(box, fixed)
    inside: list[int] = []
    for value in sorted(all_margins)[:3]:
        side = all_margins.index(value)  # equal margins find the first side again, on purpose
        cut = list(box)
        cut[side] = fixed[opposite[side]]
        ratios = {k: share(cut, blocks[k].box) for k in ids}
        inside = [k for k in ids if ratios[k] > CLAIMED]
        if inside:
            for k in ids:
                if SPLIT < ratios[k] <= CLAIMED:
                    gaps = margins(cut, blocks[k].box)
                    far = gaps.index(max(gaps))
                    cut[opposite[far]] = blocks[k].box[far]
                    cut, _ = shrink_region(cut, fixed, size, inside, blocks)
            return hull([blocks[k].box for k in inside]), inside
    return box, inside


@dataclass
class Ordered:
    """A block of the ordered page; order_index counts numbered labels from 1."""

    label: str
    box: list[int]
    content: str
    order_index: int | None
    lines: int
    horizontal: bool
    seg_start: float
    seg_end: float
    line_height: float
    line_width: float
    width: float
    image_path: str | None


def assemble(page: Reconciled, tables: list[str], hidden: tuple[str, ...] = labels.NOT_IN_MARKDOWN, left_out: list[Ordered] | None = None) -> list[Ordered]:
    """Blocks of all regions in order. tables: html of the page's table blocks in turn; without any, tables get their spans' text.

    Cuts may leave a block out of the order; such blocks are added to left_out, so that no text goes without a trace.
    """
    made, contents, paths, n_table = [], [], [], 0
    for k, d in enumerate(page.blocks):
        b = Block(d.label, tuple(d.box), seg_start=math.inf, seg_end=-math.inf)
        if d.label == "table" and tables:
            contents.append(tables[n_table] if n_table < len(tables) else "")
            n_table += 1
        else:
            own = touches(page.spans, d.box) if d.label == "formula" else page.block_spans.get(k, [])
            spans = [(page.spans[s].box, page.spans[s].text) for s in own]
            text = block_text(d.label, [float(v) for v in b.box], spans)
            b.lines, b.line_height, b.line_width = text.lines, text.line_height, text.line_width
            b.seg_start = b.seg_start if text.seg_start is None else text.seg_start
            b.seg_end = b.seg_end if text.seg_end is None else text.seg_end
            if spans:
                b.across = text.horizontal
            contents.append(text.content)
        paths.append(f"imgs/img_in_{d.label}_box_{'_'.join(str(int(v)) for v in d.box)}.jpg" if d.label in labels.WITH_IMAGE else None)
        made.append(b)
    inner: list[tuple[Page, list[int]]] = []
    for r, region in enumerate(page.regions):
        if ids := page.region_blocks.get(r):
            inner.append((Page([copy_of(made[k]) for k in ids], tuple(float(int(v)) for v in region.box)), ids))
    if not inner:
        return []
    outer = Page([region_block(p) for p, _ in inner], tuple(floored_hull([list(p.frame) for p, _ in inner])))
    out: list[Ordered] = []
    numbered = [x for x in labels.NUMBERED if x not in hidden]
    placed: set[tuple[int, int]] = set()

    def block(r: int, k: int, index: int | None) -> Ordered:
        b, own = inner[r][0].blocks[k], inner[r][1][k]
        return Ordered(b.label, b.box, contents[own], index, b.lines, b.across, b.seg_start, b.seg_end, b.line_height, b.line_width, b.width, paths[own])

    count = 0
    for r in outer.order():
        for k in inner[r][0].order():
            shown = inner[r][0].blocks[k].label in numbered
            count += shown
            out.append(block(r, k, count if shown else None))
            placed.add((r, k))
    if left_out is not None:
        left_out += [block(r, k, None) for r, (part, _) in enumerate(inner) for k in range(len(part.blocks)) if (r, k) not in placed]
    return out


def copy_of(b: Block) -> Block:
    return Block(b.label, b.frame, b.lines, b.line_height, b.line_width, b.seg_start, b.seg_end, b.distance, b.across)
