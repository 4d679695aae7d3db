"""Page kernels on small pages with known results, and under repartitioning."""

import math
import random

import numpy as np
import pytest

from pagewright.kernels import lines, page_order, parsing, shapes, xycut
from pagewright.plans import catalogue


@pytest.mark.parametrize(
    "boxes, xy, yx",
    [
        ([[10, 10, 190, 40], [10, 50, 190, 80], [10, 90, 190, 120]], [0, 1, 2], [0, 1, 2]),
        ([[10, 10, 90, 100], [110, 10, 190, 100], [10, 120, 90, 200]], [0, 2, 1], [0, 1, 2]),
        ([[0, 0, 200, 20], [0, 30, 90, 200], [110, 30, 200, 200]], [0, 1, 2], [0, 1, 2]),
        ([[5, 5, 9, 9]], [0], [0]),
        ([], [], []),
    ],
)
def test_cuts(boxes, xy, yx):
    assert xycut.recursive_cut(boxes, True) == xy and xycut.recursive_cut(boxes, False) == yx


def test_cuts_never_repeat():
    rng = random.Random(1)
    for _ in range(200):
        boxes = [[x, y, x + rng.randrange(1, 60), y + rng.randrange(1, 40)] for x, y in ((rng.randrange(200), rng.randrange(200)) for _ in range(rng.randrange(1, 12)))]
        for way in (True, False):
            got = xycut.recursive_cut(boxes, way)
            assert len(set(got)) == len(got) and set(got) <= set(range(len(boxes)))
    with pytest.raises(ValueError):
        xycut.recursive_cut([[0, 0, 2_000_000, 5]], True)


def test_profile():
    assert xycut.profile(np.array([0, 5]), np.array([10, 12])).tolist() == [1] * 5 + [2] * 5 + [1] * 2
    assert xycut.segments(np.array([0, 1, 1, 0, 0, 1, 0]), 0, 1) == [(1, 2), (5, 6)]
    assert xycut.segments(np.array([0, 1, 0, 1]), 0, 2) == [(1, 4)] and xycut.segments(np.zeros(3)) == []


def page(blocks, frame=(0, 0, 400, 600)):
    return page_order.Page([page_order.Block(b[0], tuple(map(float, b[1])), *b[2:]) for b in blocks], frame)


def test_page_order_columns_and_titles():
    columns = [("text", [x, y, x + 170, y + 100], 8, 10, 160) for x, y in ((210, 210), (20, 100), (210, 100), (20, 210))]
    p = page([*columns, ("doc_title", [20, 20, 380, 60], 1, 30, 300), ("header", [20, 2, 100, 12], 1, 8, 60), ("footer", [20, 580, 100, 590], 1, 8, 60)])
    assert p.across and p.order() == [5, 4, 1, 3, 2, 0, 6]
    tall = page([("text", [20, 100, 190, 500], 20, 10, 160), ("text", [210, 100, 380, 500], 20, 10, 160)])
    assert not tall.across and tall.order() == [1, 0]  # tall blocks make a page that reads from right to left


def test_page_order_caption_stays_with_its_picture():
    p = page([("image", [20, 100, 380, 300], 1, 10, 100), ("figure_title", [60, 305, 340, 318], 1, 12, 280), ("text", [20, 20, 380, 90], 5, 10, 360), ("text", [20, 400, 380, 500], 8, 10, 360)])
    assert p.order() == [2, 0, 1, 3] and p.blocks[1].role == "vision_title"


def test_page_order_is_a_permutation_of_a_subset():
    rng = random.Random(5)
    names = list(page_order.labels.LAYOUT)
    for _ in range(300):
        blocks = [(rng.choice(names), [x, y, x + rng.randrange(1, 300), y + rng.randrange(1, 200)], rng.randrange(1, 4), 10.0, 100.0) for x, y in ((rng.randrange(300), rng.randrange(500)) for _ in range(rng.randrange(0, 12)))]
        got = page(blocks).order()
        assert len(set(got)) == len(got) and set(got) <= set(range(len(blocks))) and got == page(blocks).order()


def test_nested_regions():
    left = page([("text", [20, 20, 190, 100], 5, 10, 170), ("text", [20, 110, 190, 260], 5, 10, 170)], (0, 0, 200, 280))
    right = page([("text", [210, 20, 380, 260], 12, 10, 150)], (200, 0, 400, 280))
    outer = page_order.Page([page_order.region_block(right), page_order.region_block(left)], (0, 0, 400, 600))
    assert outer.order() == [1, 0] and left.order() == [0, 1]


def test_block_text():
    spans = [([12, 12, 300, 26], "Lines that end in a hy-"), ([12, 32, 305, 46], "phen join; others get a"), ([12, 52, 150, 66], "space.")]
    t = lines.block_text("text", [10, 10, 310, 70], spans)
    assert t.content == "Lines that end in a hyphen join; others get a space.\n" and (t.lines, t.horizontal, t.seg_start, t.seg_end) == (3, True, 12, 150)
    assert lines.block_text("doc_title", [0, 0, 100, 50], [([0, 0, 90, 20], "A"), ([0, 25, 90, 45], "B")]).content == "A  B "
    assert lines.block_text("text", [0, 0, 9, 9], []) == lines.BlockText()
    one = lines.block_text("text", [0, 0, 100, 20], [([0, 0, 90, 20], "x")])
    assert one.seg_end is None and one.lines == 1


def test_reconcile_reads_shared_spans_anew():
    seen = []

    def read(box):
        seen.append(box)
        return f"{box[2] - box[0]} wide", 0.9

    found = [parsing.Detection("text", [20, 20, 190, 400]), parsing.Detection("text", [210, 20, 380, 400])]
    page_ = parsing.reconcile((400, 600), found, [], [parsing.Span([100, 80, 300, 100], "crosses both")], read, 0.5)
    assert seen == [[100, 80, 190, 100], [210, 80, 300, 100]] and [s.text for s in page_.spans] == ["90 wide", "90 wide"] and page_.block_spans == {0: [0], 1: [1]}
    assert page_.regions[0].label == parsing.REGION and page_.region_blocks == {0: [0, 1]}
    blocks = parsing.assemble(page_, [])
    assert [b.content for b in blocks] == ["90 wide ", "90 wide \n"] and [b.order_index for b in blocks] == [1, 2]


def test_reconcile_labels_and_fallback():
    none = lambda box: ("", -1.0)
    found = [parsing.Detection("footnote", [0, 0, 50, 10]), parsing.Detection("text", [0, 20, 50, 100]), parsing.Detection("paragraph_title", [0, 110, 50, 190])]
    assert [b.label for b in parsing.reconcile((100, 200), found, [], [], none).blocks] == ["text", "text", "doc_title"]
    only = parsing.reconcile((100, 200), [], [], [parsing.Span([1, 2, 30, 12], "a")], none)
    assert [b.label for b in only.blocks] == ["text"] and only.block_spans == {0: [0]} and only.regions[0].box == [1, 2, 30, 12]
    assert parsing.assemble(parsing.reconcile((9, 9), [], [], [], none), []) == []
    duplicates = [parsing.Detection("image", [0, 0, 100, 100]), parsing.Detection("text", [10, 10, 60, 60]), parsing.Detection("text", [10, 10, 50, 50])]
    assert [d.box for d in parsing.without_duplicates(duplicates)] == [[10, 10, 60, 60]]


def brute_areas(bitmap):
    left = {tuple(p) for p in np.argwhere(bitmap != 0)}
    out = []
    while left:
        todo, own = [min(left)], set()
        while todo:
            p = todo.pop()
            if p in left:
                left.remove(p)
                own.add(p)
                todo += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        ys, xs = [p[0] for p in own], [p[1] for p in own]
        out.append((min(xs), min(ys), max(xs), max(ys), len(own)))
    return out


def test_areas_and_borders():
    rng = np.random.default_rng(2)
    for _ in range(60):
        bitmap = (rng.random((9, 11)) < 0.45).astype(int)
        areas = shapes.labelled_areas(bitmap)
        assert areas == brute_areas(bitmap)
        found = shapes.borders(bitmap)
        frames = {(min(p[0] for p in b), min(p[1] for p in b), max(p[0] for p in b), max(p[1] for p in b)) for b in found}
        assert {a[:4] for a in areas} <= frames and len(found) >= len(areas)  # each area has an outer border with its frame
    square = np.zeros((5, 6), int)
    square[1:4, 1:5] = 1
    assert shapes.borders(square) == [[(1, 1), (1, 3), (4, 3), (4, 1)]]
    assert shapes.borders(np.eye(1, dtype=int)) == [[(0, 0)]] and shapes.borders(np.zeros((3, 3), int)) == []


def test_rectangles():
    rect = shapes.smallest_rectangle([(2, 3), (2, 7), (20, 7), (20, 3)])
    assert shapes.rectangle_corners(rect) == [pytest.approx(p) for p in ((2, 3), (20, 3), (20, 7), (2, 7))] and min(rect[1]) == pytest.approx(4)
    rng = random.Random(3)
    for _ in range(100):
        points = [(rng.randrange(30), rng.randrange(30)) for _ in range(rng.randrange(1, 12))]
        centre, size, angle = shapes.smallest_rectangle([tuple(map(float, p)) for p in points])
        c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        for x, y in points:  # every point lies in the rectangle
            dx, dy = x - centre[0], y - centre[1]
            assert abs(dx * c + dy * s) <= size[0] / 2 + 1e-6 and abs(dy * c - dx * s) <= size[1] / 2 + 1e-6


def test_growth_and_score():
    corners = [(2.0, 4.0), (14.0, 4.0), (14.0, 7.0), (2.0, 7.0)]
    assert shapes.growth_distance(corners) == pytest.approx(1.8)
    assert set(shapes.grown(corners, 1.8)) == {(0, 4), (2, 2), (14, 2), (16, 4), (16, 7), (14, 9), (2, 9), (0, 7)}
    scores = np.arange(240, dtype=np.float32).reshape(12, 20) / 240
    assert shapes.box_score(scores, corners) == pytest.approx(scores[4:8, 2:15].mean(), rel=1e-6)
    bright = np.zeros((40, 60), np.float32)
    bright[10:20, 5:50] = 0.9
    (found, score), = shapes.map_boxes(bright, (120, 80))
    assert score == pytest.approx(0.9) and found[0][0] < 10 and found[2][0] > 98
    with pytest.raises(ValueError):
        shapes.map_boxes(np.full((2, 2), np.nan), (2, 2))


def test_polygon_score():
    square = [(3, 3), (12, 3), (12, 9), (3, 9)]
    assert shapes.polygon_pixels(square, 20, 15).sum() == 70
    notch = [(0, 0), (8, 0), (8, 8), (4, 4), (0, 8)]
    mask = shapes.polygon_pixels(notch, 9, 9)
    assert mask[2].all() and mask[7].tolist() == [True, True, *[False] * 5, True, True]
    scores = np.arange(300, dtype=np.float32).reshape(15, 20)
    assert shapes.polygon_score(scores, square) == pytest.approx(scores[3:10, 3:13].mean())
    assert shapes.polygon_score(scores, [(50, 50), (60, 50), (60, 60)]) in (0.0, 299.0)


def test_first_of_equal_rectangles():
    points = [(4.0, 3.0), (8.0, 3.0), (12.0, 3.0), (12.0, 9.0), (8.0, 6.0), (4.0, 9.0)]
    rect = shapes.smallest_rectangle(points, first=True)
    assert min(rect[1]) == pytest.approx(6) and shapes.rectangle_corners(rect) == [pytest.approx(p) for p in ((4, 3), (12, 3), (12, 9), (4, 9))]


def test_polygons():
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    assert shapes.clipped_area(square, [(5, 5), (15, 5), (15, 15), (5, 15)]) == pytest.approx(25)
    assert shapes.polygon_iou(square, square[::-1]) == pytest.approx(1) and shapes.polygon_iou(square, [(20, 20), (30, 20), (30, 30)]) == 0
    assert shapes.clipped_area([(5, -5), (15, 5), (5, 15), (-5, 5)], square) == pytest.approx(100)


@pytest.mark.parametrize("name", ["xycut_full", "enhanced_order", "parsed_pages", "reading_order_quads", "dedup_overlap", "page_markdown", "block_texts"])
def test_same_under_any_partitioning(spark, small, name):
    seen = set()
    for n in ("1", "4", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(tuple(sorted(map(repr, catalogue.QUERIES[name](spark, small).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(seen) == 1 and len(next(iter(seen))) > 0


def test_bad_page_gives_one_error_row(spark):
    from pagewright.operators import grouped

    rows = spark.createDataFrame([(1, 0, 0.0, 0.0, 5.0, 5.0), (2, 0, 0.0, 0.0, 3e6, 5.0), (2, 1, 0.0, 0.0, 5.0, 5.0)], "page long, idx long, x1 double, y1 double, x2 double, y2 double")
    got = {r["page"]: r for r in grouped.cut_order(rows).collect()}
    assert got[1]["error"] is None and got[1]["idx"] == 0 and got[2]["idx"] is None and "extent" in got[2]["error"]
