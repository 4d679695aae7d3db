"""The engine's operators as queries over whole tables, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import geometry as g
from pagewright.functions import labels, numbers
from pagewright.functions import text as t
from pagewright.operators import filters, folds, grouped, markdown, metrics, ordering, output, planning, profiles, recognition, spatial
from pagewright.plans import stated
from pagewright.plans.relations import BOXES_SQL, MAPS_SQL, STEPS_SQL, TRUTH_SQL, boxes, maps, pages_of_turns, score_steps, truth
from pagewright.session import load
from pagewright.sources import images, manifest
from pagewright.streaming import events as stream_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its function's name, with its SQL."""

    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


def six(c: Column) -> Column:
    return F.round(c, 6)


def quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


# -- detection metrics -------------------------------------------------------------------------------------------------

IOU_SQL = """CASE WHEN least(a.x2, b.x2) <= greatest(a.x1, b.x1) OR least(a.y2, b.y2) <= greatest(a.y1, b.y1) THEN 0 ELSE
  (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))
  / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))) END"""
INTER_SQL = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
AREA_A, AREA_B = "((a.x2 - a.x1) * (a.y2 - a.y1))", "((b.x2 - b.x1) * (b.y2 - b.y1))"

MATCH_SQL = f"""
WITH RECURSIVE {BOXES_SQL}, {TRUTH_SQL},
care AS (
  SELECT * FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM truth a WHERE a.page = b.page AND a.ignored AND {INTER_SQL} / {AREA_B} > 0.5)
), near AS (
  SELECT a.page, a.idx AS gi, b.idx AS di, row_number() OVER (PARTITION BY a.page ORDER BY a.idx, b.idx) AS n
  FROM truth a JOIN care b ON a.page = b.page WHERE NOT a.ignored AND {IOU_SQL} > 0.5
), walk(page, n, gs, ds) AS (
  SELECT DISTINCT page, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM near
  UNION ALL
  SELECT w.page, w.n + 1, CASE WHEN list_contains(gs, gi) OR list_contains(ds, di) THEN gs ELSE list_append(gs, gi) END,
         CASE WHEN list_contains(gs, gi) OR list_contains(ds, di) THEN ds ELSE list_append(ds, di) END
  FROM walk w JOIN near e ON e.page = w.page AND e.n = w.n + 1
), matched AS (SELECT page, max(len(gs)) AS matched FROM walk GROUP BY page),
counts AS (
  SELECT p.page, coalesce(gt, 0) AS gt_care, coalesce(dc, 0) AS det_care, coalesce(matched, 0) AS matched
  FROM (SELECT page, count(*) FILTER (WHERE NOT ignored) AS gt FROM truth GROUP BY page) p
  LEFT JOIN (SELECT page, count(*) AS dc FROM care GROUP BY page) d ON d.page = p.page LEFT JOIN matched m ON m.page = p.page
)"""


@query(f"{MATCH_SQL} SELECT * FROM counts")
def detection_counts(spark, sf_dir):
    return metrics.page_counts(truth(spark, sf_dir), boxes(spark, sf_dir))


@query(f"""{MATCH_SQL}, s AS (SELECT CAST(sum(gt_care) AS BIGINT) AS gt_care, CAST(sum(det_care) AS BIGINT) AS det_care, CAST(sum(matched) AS BIGINT) AS matched FROM counts),
r AS (SELECT *, matched / det_care AS precision, matched / gt_care AS recall FROM s)
SELECT gt_care, det_care, matched, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS hmean FROM r""")
def detection_prf(spark, sf_dir):
    rows = metrics.detection_scores(detection_counts(spark, sf_dir))
    return rows.select("gt_care", "det_care", "matched", *[six(F.col(c)).alias(c) for c in ("precision", "recall", "hmean")])


@query(f"""{MATCH_SQL}, m AS (SELECT page, n, gs, ds FROM walk QUALIFY n = max(n) OVER (PARTITION BY page))
SELECT page, CAST(unnest(gs) AS INTEGER) AS gt_idx, CAST(unnest(ds) AS INTEGER) AS det_idx FROM m""")
def greedy_matches(spark, sf_dir):
    """The matched pairs themselves, over detections that aren't absorbed by ignored truth."""
    own, found = truth(spark, sf_dir), boxes(spark, sf_dir)
    out = spatial.absorbed(found, own.where("ignored")).select("page", "idx")
    return folds.greedy_matches(own.where("NOT ignored"), found.join(out, ["page", "idx"], "left_anti"))


# -- spatial joins -----------------------------------------------------------------------------------------------------


@query(f"""WITH {BOXES_SQL} SELECT a.page, a.idx AS a_idx, b.idx AS b_idx, round({IOU_SQL}, 6) AS iou, round({INTER_SQL} / {AREA_B}, 6) AS over_second,
  round({INTER_SQL} / least({AREA_A}, {AREA_B}), 6) AS small, round({INTER_SQL} / ({AREA_A} + {AREA_B} - {INTER_SQL}), 6) AS hull,
  round(sqrt(pow((b.x1 + b.x2 - a.x1 - a.x2) / 2, 2) + pow((b.y1 + b.y2 - a.y1 - a.y2) / 2, 2)) + least(abs(b.x1 - a.x1) + abs(b.y1 - a.y1), abs(b.x2 - a.x2) + abs(b.y2 - a.y2)), 6) AS distance
FROM boxes a JOIN boxes b ON a.page = b.page AND a.idx < b.idx""")
def box_pairs(spark, sf_dir):
    a, b = g.box("a_"), g.box("b_")
    rows = spatial.pairs(boxes(spark, sf_dir))
    measured = {"iou": g.iou(a, b), "over_second": g.over_second(a, b), "small": g.overlap_small(a, b), "hull": g.overlap_union(a, b), "distance": g.box_distance(a, b)}
    return rows.select("page", "a_idx", "b_idx", *[six(c).alias(n) for n, c in measured.items()])


@query(f"""WITH {BOXES_SQL} SELECT a.page, a.idx AS block_idx, b.idx AS span_idx FROM boxes a JOIN boxes b ON a.page = b.page
WHERE a.label NOT IN ({quoted(stated.NO_SPANS)}) AND a.idx % 2 = 0 AND b.idx % 2 = 1 AND least(a.x2, b.x2) - greatest(a.x1, b.x1) > 3 AND least(a.y2, b.y2) - greatest(a.y1, b.y1) > 3""")
def span_block_overlap(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    return spatial.spans_in_blocks(rows.where("idx % 2 = 1"), rows.where("idx % 2 = 0"))


OUTSIDE_SQL = f"""WITH {BOXES_SQL} SELECT page, idx FROM boxes a WHERE {{}} EXISTS (SELECT 1 FROM boxes b WHERE a.page = b.page AND b.label = 'table'
AND least(a.x2, b.x2) - greatest(a.x1, b.x1) > 3 AND least(a.y2, b.y2) - greatest(a.y1, b.y1) > 3)"""


@query(OUTSIDE_SQL.format("NOT"))
def spans_outside_tables(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    return spatial.spans_by_objects(rows, rows.where("label = 'table'"), within=False).select("page", "idx")


@query(OUTSIDE_SQL.format(""))
def spans_inside_tables(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    return spatial.spans_by_objects(rows, rows.where("label = 'table'"), within=True).select("page", "idx")


TABLES_SQL = "tables AS (SELECT page, idx, x1 - 40 AS x1, y1 - 30 AS y1, x2 + 40 AS x2, y2 + 30 AS y2 FROM boxes WHERE idx % 3 = 0)"


def wide_tables(spark, sf_dir):
    return boxes(spark, sf_dir).where("idx % 3 = 0").select("page", "idx", (F.col("x1") - 40).alias("x1"), (F.col("y1") - 30).alias("y1"), (F.col("x2") + 40).alias("x2"), (F.col("y2") + 30).alias("y2"))


@query(f"""WITH {BOXES_SQL}, {TABLES_SQL} SELECT b.page, a.idx AS table_idx, b.idx, b.x1 - a.x1 AS x1, b.y1 - a.y1 AS y1, b.x2 - a.x1 AS x2, b.y2 - a.y1 AS y2
FROM boxes b JOIN tables a ON a.page = b.page AND b.x1 >= a.x1 AND b.y1 >= a.y1 AND b.x2 <= a.x2 AND b.y2 <= a.y2""")
def table_crop(spark, sf_dir):
    return spatial.crop_to_table(boxes(spark, sf_dir), wide_tables(spark, sf_dir))


@query(f"""WITH {BOXES_SQL}, near AS (
  SELECT a.page, a.idx, b.idx AS other, CASE WHEN b.y1 <= a.y1 THEN 'prev' ELSE 'post' END AS side, CASE WHEN b.y1 <= a.y1 THEN -b.y1 ELSE b.y1 END AS k
  FROM boxes a JOIN boxes b ON a.page = b.page AND a.idx <> b.idx
  WHERE least(a.x2, b.x2) > greatest(a.x1, b.x1) AND (least(a.x2, b.x2) - greatest(a.x1, b.x1)) / least(a.x2 - a.x1, b.x2 - b.x1) > 0.1)
SELECT page, idx, side, row_number() OVER (PARTITION BY page, idx, side ORDER BY k, other) AS rank, other FROM near""")
def nearest_blocks(spark, sf_dir):
    return spatial.neighbours(boxes(spark, sf_dir))


WEIGHT_SQL = f"CASE WHEN a.label = 'doc_title' THEN [1.0, 0.1, 0.1, 1.0] WHEN a.label IN ({quoted(g.DOWN_LABELS)}) THEN [1.0, 1.0, 0.1, 1.0] ELSE [1.0, 1.0, 1.0, 0.1] END"


@query(f"""WITH {BOXES_SQL}, e AS (
  SELECT a.page, a.idx AS a_idx, b.idx AS b_idx, {WEIGHT_SQL} AS w, least(a.x2, b.x2) > greatest(a.x1, b.x1) AS hx, least(a.y2, b.y2) > greatest(a.y1, b.y1) AS hy,
         least(abs(a.x1 - b.x2), abs(a.x2 - b.x1)) AS dx, least(abs(a.y1 - b.y2), abs(a.y2 - b.y1)) AS dy, a.x2 < b.x1 AS lx, a.y2 < b.y1 AS ly,
         sqrt(a.x1 * a.x1 + a.y1 * a.y1) AS corner, sqrt((300 - a.x2) * (300 - a.x2) + a.y1 * a.y1) AS corner_right
  FROM boxes a JOIN boxes b ON a.page = b.page AND a.idx < b.idx)
SELECT page, a_idx, b_idx, round(CAST(CASE WHEN hx THEN 0 WHEN lx THEN dx * w[1] ELSE dx * w[2] END + CASE WHEN hy THEN 0 WHEN ly THEN dy * w[3] ELSE dy * w[4] END AS DOUBLE), 6) AS edge,
  round(corner, 6) AS corner, round(corner_right, 6) AS corner_right FROM e""")
def edge_distances(spark, sf_dir):
    a, b = g.box("a_"), g.box("b_")
    return spatial.pairs(boxes(spark, sf_dir)).select("page", "a_idx", "b_idx", six(g.edge_distance(a, b, g.label_weights(F.col("a_label")))).alias("edge"), six(g.corner_distance(a)).alias("corner"), six(g.corner_distance(a, F.lit(300.0))).alias("corner_right"))


# -- folds over a page -------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {BOXES_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, idx DESC) AS n FROM boxes),
walk(page, n, kept) AS (
  SELECT DISTINCT page, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM boxes
  UNION ALL
  SELECT w.page, w.n + 1, CASE WHEN EXISTS (SELECT 1 FROM boxes a WHERE a.page = w.page AND list_contains(w.kept, a.idx) AND {IOU_SQL} > 0.3) THEN kept ELSE list_append(kept, b.idx) END
  FROM walk w JOIN ranked b ON b.page = w.page AND b.n = w.n + 1
), last AS (SELECT page, arg_max(kept, n) AS kept FROM walk GROUP BY page)
SELECT page, CAST(unnest(range(len(kept))) AS INTEGER) AS pos, CAST(unnest(kept) AS INTEGER) AS idx FROM last""")
def nms_cells(spark, sf_dir):
    return folds.suppress(boxes(spark, sf_dir))


@query(f"""WITH RECURSIVE {BOXES_SQL}, over AS (
  SELECT a.page, a.idx AS i, b.idx AS j, row_number() OVER (PARTITION BY a.page ORDER BY a.idx, b.idx) AS n,
         CASE WHEN a.label = 'image' AND b.label <> 'image' THEN a.idx WHEN b.label = 'image' AND a.label <> 'image' THEN b.idx WHEN {AREA_A} <= {AREA_B} THEN a.idx ELSE b.idx END AS loser
  FROM boxes a JOIN boxes b ON a.page = b.page AND a.idx < b.idx WHERE {INTER_SQL} / least({AREA_A}, {AREA_B}) > 0.5
), walk(page, n, gone) AS (
  SELECT DISTINCT page, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM boxes
  UNION ALL
  SELECT w.page, w.n + 1, CASE WHEN list_contains(gone, i) OR list_contains(gone, j) THEN gone ELSE list_append(gone, loser) END FROM walk w JOIN over o ON o.page = w.page AND o.n = w.n + 1
), last AS (SELECT page, arg_max(gone, n) AS gone FROM walk GROUP BY page)
SELECT b.page, CAST(b.idx AS INTEGER) AS idx FROM boxes b JOIN last l ON l.page = b.page WHERE NOT list_contains(gone, b.idx)""")
def dedup_overlap(spark, sf_dir):
    return folds.drop_overlaps(boxes(spark, sf_dir))


ROWS_SQL = f"""WITH RECURSIVE {BOXES_SQL}, tops AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y1, idx) AS n FROM boxes),
walk(page, n, rw, top) AS (
  SELECT page, n, 0, y1 FROM tops WHERE n = 1
  UNION ALL
  SELECT t.page, t.n, CASE WHEN abs(t.y1 - w.top) > 10 THEN w.rw + 1 ELSE w.rw END, CASE WHEN abs(t.y1 - w.top) > 10 THEN t.y1 ELSE w.top END
  FROM walk w JOIN tops t ON t.page = w.page AND t.n = w.n + 1
), placed AS (
  SELECT t.page, w.rw AS row, CAST(row_number() OVER (PARTITION BY t.page ORDER BY w.rw, t.x1, t.n) - 1 AS INTEGER) AS pos, CAST(t.idx AS INTEGER) AS idx
  FROM walk w JOIN tops t ON t.page = w.page AND t.n = w.n
)"""


@query(f"{ROWS_SQL} SELECT * FROM placed")
def cell_rows(spark, sf_dir):
    return folds.cell_rows(boxes(spark, sf_dir))


@query(f"""{ROWS_SQL}, cells AS (SELECT p.*, row_number() OVER (PARTITION BY p.page, p.row ORDER BY p.pos) - 1 AS position, x1, y1, x2, y2 FROM placed p JOIN boxes b ON b.page = p.page AND b.idx = p.idx)
SELECT a.page, a.row, CAST(a.position AS INTEGER) AS position, b.idx FROM cells a JOIN boxes b ON a.page = b.page WHERE {INTER_SQL} / {AREA_B} > 0.7""")
def cell_text_match(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    cells = cell_rows(spark, sf_dir).join(rows.select("page", F.col("idx").cast("int").alias("idx"), "x1", "y1", "x2", "y2"), ["page", "idx"])
    return spatial.match_cells(cells, rows)


@query(f"""{ROWS_SQL}, flags AS (SELECT page, row, count(*) AS n FROM placed GROUP BY page, row), sums AS (SELECT page, row, CAST(sum(n) OVER (PARTITION BY page ORDER BY row) - n AS BIGINT) AS flag FROM flags),
starts AS (SELECT page, idx AS row, idx * 2 AS start FROM boxes)
SELECT s.page, s.row, s.start, coalesce(max(flag), s.start) AS aligned FROM starts s LEFT JOIN sums f ON f.page = s.page AND f.flag <= s.start GROUP BY s.page, s.row, s.start""")
def row_flag_asof(spark, sf_dir):
    counts = cell_rows(spark, sf_dir).groupBy("page", "row").agg(F.count("*").alias("n"))
    flags = counts.select("page", (F.sum("n").over(Window.partitionBy("page").orderBy("row")) - F.col("n")).alias("flag"))
    starts = boxes(spark, sf_dir).select("page", F.col("idx").alias("row"), (F.col("idx") * 2).alias("start"))
    return spatial.align_rows(flags, starts)


@query(f"""WITH RECURSIVE {BOXES_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y1, x1, idx) AS n FROM boxes),
walk(page, n, done) AS (
  SELECT DISTINCT page, CAST(0 AS BIGINT), CAST([] AS STRUCT(i BIGINT, x DOUBLE, y DOUBLE)[]) FROM boxes
  UNION ALL
  SELECT w.page, w.n + 1, list_concat(done[1:cut], [{{'i': b.idx, 'x': b.x1, 'y': b.y1}}], done[cut + 1:])
  FROM (SELECT w.*, b.idx, b.x1, b.y1, coalesce((SELECT max(k) FROM (SELECT unnest(range(1, len(w.done) + 1)) AS k) q WHERE NOT (abs(b.y1 - w.done[k].y) < 10 AND b.x1 < w.done[k].x)), 0) AS cut
        FROM walk w JOIN ranked b ON b.page = w.page AND b.n = w.n + 1) w, (SELECT 1) z, LATERAL (SELECT w.idx, w.x1, w.y1) b
), last AS (SELECT page, arg_max(done, n) AS done FROM walk GROUP BY page)
SELECT page, CAST(unnest(range(len(done))) AS INTEGER) AS pos, CAST(unnest(done).i AS INTEGER) AS idx FROM last""")
def reading_order_quads(spark, sf_dir):
    return folds.reading_order(boxes(spark, sf_dir))


@query(f"""WITH RECURSIVE {BOXES_SQL}, walk(page, n, x1, y1, x2, y2, own, settled) AS (
  SELECT page, 0, x1, y1, x2, y2, CAST([] AS BIGINT[]), FALSE FROM boxes WHERE idx = 0
  UNION ALL
  SELECT page, n, nx1, ny1, nx2, ny2, ids, len(ids) = len(own) OR len(ids) = 0 FROM (
    SELECT w.page, w.n + 1 AS n, any_value(w.own) AS own, min(b.x1) AS nx1, min(b.y1) AS ny1, max(b.x2) AS nx2, max(b.y2) AS ny2, list(b.idx ORDER BY b.idx) AS ids
    FROM walk w JOIN boxes b ON b.page = w.page
    WHERE NOT w.settled AND greatest(least(w.x2, b.x2) - greatest(w.x1, b.x1), 0) * greatest(least(w.y2, b.y2) - greatest(w.y1, b.y1), 0) / least((w.x2 - w.x1) * (w.y2 - w.y1), {AREA_B}) > 0.6
    GROUP BY w.page, w.n)
), last AS (SELECT page, arg_max(own, n) AS own FROM walk GROUP BY page)
SELECT page, CAST(unnest(own) AS INTEGER) AS idx FROM last""")
def region_growth(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    return folds.grow_region(rows, rows.where("idx = 0"))


# -- profiles ----------------------------------------------------------------------------------------------------------

HIST_SQL = """hist AS (
  SELECT p.page, g.place, (SELECT count(*) FROM boxes b WHERE b.page = p.page AND b.x1 <= g.place AND b.x2 > g.place) AS n
  FROM (SELECT page, CAST(max(x2) AS BIGINT) AS extent FROM boxes GROUP BY page) p, LATERAL (SELECT unnest(range(p.extent)) AS place) g
)"""


@query(f"WITH {BOXES_SQL}, {HIST_SQL} SELECT page, place, n FROM hist")
def projection_histogram(spark, sf_dir):
    return profiles.projection(boxes(spark, sf_dir)).where("error IS NULL").drop("error")


@query(f"""WITH {BOXES_SQL}, {HIST_SQL}, s AS (SELECT page, place, CASE WHEN place - lag(place) OVER (PARTITION BY page ORDER BY place) > 1 THEN 1 ELSE 0 END AS brk FROM hist WHERE n > 1),
r AS (SELECT page, place, sum(brk) OVER (PARTITION BY page ORDER BY place) AS segment FROM s), m AS (SELECT page, segment, min(place) AS start, max(place) AS last FROM r GROUP BY page, segment)
SELECT page, CAST(segment AS BIGINT) AS segment, start, CASE WHEN segment = max(segment) OVER (PARTITION BY page) THEN last + 1 ELSE last END AS "end" FROM m""")
def profile_split(spark, sf_dir):
    return profiles.split_profile(profiles.projection(boxes(spark, sf_dir)), min_value=1)


@query(f"""WITH {BOXES_SQL}, w AS (SELECT *, coalesce(x1 > max(x2) OVER (PARTITION BY page ORDER BY x1, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS brk FROM boxes),
i AS (SELECT *, sum(CAST(brk AS INTEGER)) OVER (PARTITION BY page ORDER BY x1, idx) AS island FROM w)
SELECT page, min(x1) AS start, max(x2) AS "end", count(*) AS members FROM i GROUP BY page, island""")
def interval_merge(spark, sf_dir):
    return profiles.merge_intervals(boxes(spark, sf_dir))


@query(f"""WITH {BOXES_SQL}, {HIST_SQL}, w AS (SELECT *, coalesce(n <> lag(n) OVER (PARTITION BY page ORDER BY place), TRUE) AS brk FROM hist),
i AS (SELECT *, sum(CAST(brk AS INTEGER)) OVER (PARTITION BY page ORDER BY place) AS run FROM w), r AS (SELECT page, run, min(place) AS start, max(place) AS last, min(n) AS n FROM i GROUP BY page, run),
f AS (SELECT *, lag(n) OVER (PARTITION BY page ORDER BY run) AS b, lead(n) OVER (PARTITION BY page ORDER BY run) AS a FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY run) AS k FROM f WHERE (b IS NULL OR b > n) AND a > n)
SELECT page, start, last AS "end" FROM k WHERE k > 1""")
def local_minima(spark, sf_dir):
    return profiles.local_minima(profiles.projection(boxes(spark, sf_dir)))


# -- orders and numberings ---------------------------------------------------------------------------------------------


@query(f"""WITH {BOXES_SQL} SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY floor(y1 / 10), floor(x1 / 20), pow((x1 + x2) / 2, 2) + pow((y1 + y2) / 2, 2), idx) - 1 AS INTEGER) AS pos, idx FROM boxes""")
def plain_block_sort(spark, sf_dir):
    return ordering.plain_block_order(boxes(spark, sf_dir))


@query(f"""WITH {BOXES_SQL} SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY floor(-x2 / 20), floor(y1 / 10), pow((y1 + y2) / 2, 2) - pow((x1 + x2) / 2, 2), idx) - 1 AS INTEGER) AS pos, idx FROM boxes""")
def plain_block_sort_vertical(spark, sf_dir):
    return ordering.plain_block_order(boxes(spark, sf_dir), vertical=True)


PLAN_SQL = f"""WITH {BOXES_SQL}, r AS (SELECT page, idx, (x2 - x1) / (y2 - y1) AS aspect, row_number() OVER (PARTITION BY page ORDER BY (x2 - x1) / (y2 - y1), idx) - 1 AS k FROM boxes),
b AS (SELECT *, CAST(k // 6 AS INTEGER) AS batch, CAST(k % 6 AS INTEGER) AS slot FROM r),
m AS (SELECT *, CAST(trunc(greatest(max(aspect) OVER (PARTITION BY page, batch), CAST(320 AS DOUBLE) / 48) * 48) AS BIGINT) AS batch_width FROM b)"""


def crops(spark, sf_dir):
    return boxes(spark, sf_dir).select("page", "idx", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))


@query(f"{PLAN_SQL} SELECT page, idx, batch, slot, least(CAST(ceil(aspect * 48) AS BIGINT), batch_width) AS crop_width, batch_width FROM m")
def batch_plan(spark, sf_dir):
    return ordering.batch_plan(crops(spark, sf_dir))


@query(f"{PLAN_SQL} SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY idx) - 1 AS INTEGER) AS pos, batch, slot FROM m")
def restore_order(spark, sf_dir):
    return ordering.restore_order(ordering.batch_plan(crops(spark, sf_dir)))


@query(f"""WITH {BOXES_SQL} SELECT page, idx, label, CASE WHEN label IN ({quoted(stated.NUMBERED)}) THEN CAST(count(*) FILTER (WHERE label IN ({quoted(stated.NUMBERED)})) OVER (PARTITION BY page ORDER BY idx) AS BIGINT) END AS order_index FROM boxes""")
def order_index(spark, sf_dir):
    return ordering.order_index(boxes(spark, sf_dir)).select("page", "idx", "label", F.col("order_index").cast("bigint").alias("order_index"))


@query(f"""WITH {BOXES_SQL}, l AS (SELECT page, idx, row_number() OVER (PARTITION BY page ORDER BY idx) AS n FROM boxes WHERE label = 'table'),
r AS (SELECT page, '<table>' || idx || '</table>' AS html, row_number() OVER (PARTITION BY page ORDER BY idx) AS n FROM boxes WHERE label = 'chart')
SELECT l.page, l.idx, CAST(l.n AS INTEGER) AS n, coalesce(html, '') AS html FROM l LEFT JOIN r ON r.page = l.page AND r.n = l.n""")
def table_running_index(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    html = rows.where("label = 'chart'").select("page", "idx", F.concat(F.lit("<table>"), F.col("idx").cast("string"), F.lit("</table>")).alias("html"))
    return ordering.nth_table(rows, html)


@query(f"""WITH {BOXES_SQL}, p AS (SELECT page, label AS value, min(idx) AS first FROM boxes WHERE label IN ({quoted(stated.GATHERED_IMAGES)}) GROUP BY page, label)
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY first) - 1 AS INTEGER) AS pos, value FROM p""")
def first_seen_images(spark, sf_dir):
    return ordering.first_seen(boxes(spark, sf_dir), "page", F.when(F.col("label").isin(*labels.GATHERED_IMAGES), F.col("label")), "idx")


@query(f"""WITH {BOXES_SQL}, a AS (SELECT page, idx, max(x2 - x1) OVER (PARTITION BY page ORDER BY idx) AS widest, max(y2 - y1) OVER (PARTITION BY page) AS tall, min(y2 - y1) OVER (PARTITION BY page) AS low, y2 - y1 AS h, count(*) OVER (PARTITION BY page) AS n,
  x1, x2, y1 FROM boxes), b AS (SELECT *, count(*) FILTER (WHERE h < 1.1 * low) OVER (PARTITION BY page) AS normal FROM a)
SELECT page, idx, widest, NOT (tall > 2 * low AND normal < 0.4 * n AND h > 1.1 * low) AS kept, CAST(row_number() OVER (PARTITION BY page ORDER BY floor(x1 / 2), y1, idx) AS INTEGER) AS place FROM b""")
def line_widths_and_tall_lines(spark, sf_dir):
    return ordering.line_places(boxes(spark, sf_dir))


@query(f"""WITH {BOXES_SQL} SELECT page, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, max((x2 - x1) * (y2 - y1)) AS most, max(y2) FILTER (WHERE label = 'text') AS lowest,
  count(*) FILTER (WHERE x2 - x1 >= y2 - y1) * 2 >= count(*) AS horizontal, round(coalesce(avg(y2 - y1) FILTER (WHERE label = 'text'), 10), 6) AS line_height, round(coalesce(avg(x2 - x1) FILTER (WHERE label = 'text'), 20), 6) AS line_width FROM boxes GROUP BY page""")
def page_frames(spark, sf_dir):
    return ordering.page_frames(boxes(spark, sf_dir)).withColumns({c: six(F.col(c)) for c in ("line_height", "line_width")})


ROLE_SQL = "CASE " + " ".join(f"WHEN label IN ({quoted(m)}) THEN '{r}'" for r, m in stated.ROLES.items()) + " ELSE 'normal_text' END"


@query(f"""WITH {BOXES_SQL} SELECT page, idx, {ROLE_SQL} AS role, label IN ({quoted(stated.MASK)}) AS masked, label IN ({quoted(stated.VISION)}) AS vision, label IN ({quoted(stated.NOT_IN_MARKDOWN)}) AS hidden,
  CASE WHEN label IN ({quoted(stated.WITH_IMAGE)}) THEN 'imgs/img_in_' || label || '_box_' || CAST(x1 AS BIGINT) || '_' || CAST(y1 AS BIGINT) || '_' || CAST(x2 AS BIGINT) || '_' || CAST(y2 AS BIGINT) || '.jpg' END AS image_path FROM boxes""")
def label_roles(spark, sf_dir):
    label = F.col("label")
    return boxes(spark, sf_dir).select("page", "idx", labels.role(label).alias("role"), label.isin(*labels.MASK).alias("masked"), label.isin(*labels.VISION).alias("vision"), label.isin(*labels.NOT_IN_MARKDOWN).alias("hidden"), labels.image_path(label, *g.box()).alias("image_path"))


@query(f"""WITH {BOXES_SQL}, s AS (SELECT *, least(x2 - x1, y2 - y1) - 20 AS side, score * 10 AS v FROM boxes)
SELECT page, idx, CAST(v AS FLOAT) > CAST(0.3 AS FLOAT) AS segment, NOT (side < 3) AS side_before, NOT (v < 0.6::DOUBLE) AS box_score, NOT (side < 5) AS side_after, v >= 0.5::DOUBLE AS recognized, idx * 300 < 1000 AS candidate,
  v > x2 / 400 AND v > 0.9::DOUBLE AS turned, CAST(trunc(least(greatest(x1, 0), 199)) AS BIGINT) AS clipped FROM s""")
def threshold_filters(spark, sf_dir):
    """Every threshold with its own strictness, as the engine has it."""
    score, side = F.col("score") * 10, F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) - 20
    return boxes(spark, sf_dir).select(
        "page", "idx", filters.bright(score).alias("segment"), filters.long_enough(side, 3).alias("side_before"), filters.scored(score).alias("box_score"), filters.long_enough(side, 5).alias("side_after"),
        filters.recognized(score).alias("recognized"), filters.candidate(F.col("idx") * 300).alias("candidate"), filters.upside_down(F.col("x2") / 400, score).alias("turned"), g.clip_corner(F.col("x1"), F.lit(200.0)).alias("clipped"),
    )


# New ones beside them: corners, distances, headings and signatures.


@query(f"""WITH {BOXES_SQL}, p AS (SELECT page, idx, unnest([0, 1, 2, 3]) AS k, x1, y1, x2, y2 FROM boxes),
c AS (SELECT page, idx, k, CASE k WHEN 0 THEN x2 WHEN 1 THEN x1 + 3 WHEN 2 THEN x2 - 7 ELSE x1 END AS x, CASE k WHEN 0 THEN y2 WHEN 1 THEN y1 WHEN 2 THEN y1 + 2 ELSE y2 + 5 END AS y FROM p),
a AS (SELECT page, idx, arg_min({{'x': x, 'y': y}}, x + y) AS a, arg_min({{'x': x, 'y': y}}, y - x) AS b, arg_max({{'x': x, 'y': y}}, x + y) AS c, arg_max({{'x': x, 'y': y}}, y - x) AS d,
  count(DISTINCT x + y) = 4 AND count(DISTINCT y - x) = 4 AS clear FROM c GROUP BY page, idx)
SELECT page, idx, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS "by", c.x AS cx, c.y AS cy, d.x AS dx, d.y AS dy FROM a WHERE clear""")
def clockwise_corners(spark, sf_dir):
    """Corners in order, of quadrilaterals whose coordinate sums and differences are all different."""
    b = g.box()
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    quad = F.array(point(b.x2, b.y2), point(b.x1 + 3, b.y1), point(b.x2 - 7, b.y1 + 2), point(b.x1, b.y2 + 5))
    rows = boxes(spark, sf_dir).select("page", "idx", quad.alias("q"))
    different = lambda key: F.size(F.array_distinct(F.transform("q", key))) == 4
    rows = rows.where(different(lambda p: p["x"] + p["y"]) & different(lambda p: p["y"] - p["x"])).select("page", "idx", g.order_corners(F.col("q")).alias("q"))
    return rows.select("page", "idx", *[F.col("q")[k][c].alias(f"{n}{c}") for k, n in enumerate("abcd") for c in "xy"])


@query(f"""WITH {BOXES_SQL}, n AS (SELECT *, lead({{'x': x1, 'y': y1}}) OVER (PARTITION BY page ORDER BY idx) AS b FROM boxes)
SELECT page, idx, abs(x1 - b.x) * 1 + abs(y1 - b.y) * 1 AS plain, abs(x1 - b.x) * 0.25::DOUBLE + abs(y1 - b.y) * 2 AS weighted, sqrt(x1 * x1 + y1 * y1) AS corner FROM n WHERE b IS NOT NULL""")
def city_distances(spark, sf_dir):
    """How far each box's corner is from the next one's, axis by axis, and from the origin."""
    after = F.lead(F.struct("x1", "y1")).over(Window.partitionBy("page").orderBy("idx"))
    rows = boxes(spark, sf_dir).withColumn("b", after).where("b IS NOT NULL")
    far = lambda *w: g.city_distance(F.col("x1"), F.col("y1"), F.col("b.x1"), F.col("b.y1"), *w)
    return rows.select("page", "idx", far().alias("plain"), far(0.25, 2.0).alias("weighted"), g.corner_distance(g.box()).alias("corner"))


@query(f"""WITH leads AS (SELECT item_id, text, length(text) % 4 AS level, regexp_replace(text, '^\\s+', '') AS lead, regexp_extract(regexp_replace(text, '^\\s+', ''), '^(?:{stated.NUMBERING})') AS num FROM benchmark),
titles AS (SELECT *, regexp_replace(CASE WHEN num <> '' THEN trim(num) || ' ' || regexp_replace(substr(lead, length(num) + 1), '^\\s+', '') ELSE text END, '\\.+$', '') AS title FROM leads)
SELECT item_id, replace(replace(CASE WHEN level > 0 THEN repeat('#', level + 1) || ' ' || text ELSE repeat('#', length(title) - length(replace(title, '.', '')) + 2) || ' ' || title END, '-' || chr(10), ''), chr(10), ' ') AS heading FROM titles""".replace("\\\\", "\\"))
def paragraph_headings(spark, sf_dir):
    """Headings whose level is given, and those whose level the dots give."""
    level = F.length("text") % 4
    return load(spark, sf_dir, "benchmark").select("item_id", t.format_paragraph_title(F.col("text"), F.when(level > 0, level)).alias("heading"))


@query("""WITH s AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '89504E470D0A1A0A' WHEN 1 THEN 'FFD8FF' WHEN 2 THEN '89504E470D0A1A' WHEN 3 THEN 'FFD8' ELSE '' END || hex(encode(text)) AS content FROM documents)
SELECT doc_id, CASE WHEN starts_with(content, 'FFD8FF') THEN 'jpeg' WHEN starts_with(content, '89504E470D0A1A0A') THEN 'png' END AS kind FROM s""")
def format_sniff(spark, sf_dir):
    """Texts behind whole and broken signatures."""
    heads = F.array(*[F.unhex(F.lit(h)) for h in ("89504E470D0A1A0A", "FFD8FF", "89504E470D0A1A", "FFD8", "")])
    rows = load(spark, sf_dir, "documents").select("doc_id", F.concat(heads[(F.col("doc_id") % 5).cast("int")], F.encode("text", "UTF-8")).alias("content"))
    return rows.select("doc_id", images.image_format(F.col("content")).alias("kind"))


# -- plans of sizes ----------------------------------------------------------------------------------------------------


@query(f"""WITH {BOXES_SQL}, d AS (SELECT page, idx, x2 * 20 AS w, y2 * 9 AS h FROM boxes), a AS (SELECT *, CASE WHEN greatest(w, h) > 960 THEN CAST(960 AS DOUBLE) / greatest(w, h) ELSE 1 END AS f FROM d),
b AS (SELECT *, trunc(w * f) AS w1, trunc(h * f) AS h1 FROM a)
SELECT page, idx, CAST(greatest(round_even(CAST(w1 / 32 AS DOUBLE), 0) * 32, 32) AS BIGINT) AS det_w, CAST(greatest(round_even(CAST(h1 / 32 AS DOUBLE), 0) * 32, 32) AS BIGINT) AS det_h,
  CAST(floor(w * (CAST(256 AS DOUBLE) / least(w, h)) + 0.5) AS BIGINT) AS short_w, CAST(floor(h * (CAST(256 AS DOUBLE) / least(w, h)) + 0.5) AS BIGINT) AS short_h,
  CAST(round_even(w * (CAST(512 AS DOUBLE) / greatest(w, h)), 0) AS BIGINT) AS long_w, CAST(round_even(h * (CAST(512 AS DOUBLE) / greatest(w, h)), 0) AS BIGINT) AS long_h FROM b""")
def resize_plans(spark, sf_dir):
    rows = boxes(spark, sf_dir).select("page", "idx", (F.col("x2") * 20).alias("w"), (F.col("y2") * 9).alias("h"))
    w, h = F.col("w"), F.col("h")
    planned = rows.select("page", "idx", planning.detector_size(w, h).alias("det"), planning.short_edge_size(w, h).alias("short"), planning.long_edge_size(w, h).alias("long"))
    return planned.select("page", "idx", *[F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in ("det", "short", "long") for c in ("w", "h")])


@query(f"""WITH RECURSIVE {BOXES_SQL}, d AS (SELECT page, idx, x2 * 60 AS w, y2 * 60 AS h FROM boxes),
walk(page, idx, w, h, n, low, high) AS (
  SELECT page, idx, w, h, 0, CAST(0.5 AS DOUBLE), least(CAST(2 AS DOUBLE), sqrt(40000000 / (w * h))) FROM d WHERE ceil(w * 2) * ceil(h * 2) > 40000000 AND ceil(w * 0.5::DOUBLE) * ceil(h * 0.5::DOUBLE) <= 40000000
  UNION ALL
  SELECT page, idx, w, h, n + 1, CASE WHEN ceil(w * ((low + high) / 2)) * ceil(h * ((low + high) / 2)) <= 40000000 THEN (low + high) / 2 ELSE low END,
         CASE WHEN ceil(w * ((low + high) / 2)) * ceil(h * ((low + high) / 2)) <= 40000000 THEN high ELSE (low + high) / 2 END FROM walk WHERE n < 32
)
SELECT d.page, d.idx, CAST(ceil(d.w * 2) * ceil(d.h * 2) AS BIGINT) AS pixels, round(CASE WHEN ceil(d.w * 2) * ceil(d.h * 2) <= 40000000 THEN 2 ELSE k.low END, 6) AS scale FROM d LEFT JOIN walk k ON k.page = d.page AND k.idx = d.idx AND k.n = 32""")
def render_scale(spark, sf_dir):
    w, h = F.col("x2") * 60, F.col("y2") * 60
    return boxes(spark, sf_dir).select("page", "idx", planning.render_pixels(w, h, F.lit(2.0)).cast("bigint").alias("pixels"), six(planning.render_scale(w, h)).alias("scale"))


@query(f"""WITH {BOXES_SQL}, d AS (SELECT page, idx, x1, y1, 300 AS w, 201 AS h FROM boxes)
SELECT page, idx, 201 AS new_w, 300 AS new_h, round(y1 + (-100.5 + 150) + 0 * x1 + (201 - 300) / 2.0::DOUBLE, 6) + 0 AS x, round(-x1 + 150 + 100.5 + (300 - 201) / 2.0::DOUBLE, 6) + 0 AS y, round(x1, 6) AS back_x, round(y1, 6) AS back_y FROM d""")
def rotation_roundtrip(spark, sf_dir):
    m = planning.rotation(F.lit(300), F.lit(201), 90)
    rows = boxes(spark, sf_dir).select("page", "idx", "x1", "y1", m.alias("m"))
    x, y = planning.turn(F.col("m"), F.col("x1"), F.col("y1"))
    rows = rows.select("page", "idx", "m", x.alias("x"), y.alias("y"))
    bx, by = planning.turn_back(F.col("m"), F.col("x"), F.col("y"))
    return rows.select("page", "idx", F.col("m.w").cast("int").alias("new_w"), F.col("m.h").cast("int").alias("new_h"), (six(F.col("x")) + 0).alias("x"), (six(F.col("y")) + 0).alias("y"), six(bx).alias("back_x"), six(by).alias("back_y"))


@query(f"""WITH {BOXES_SQL} SELECT page, idx, CAST(least(greatest(round_even(CAST(CAST(CAST(x2 AS FLOAT) / CAST(320 AS FLOAT) AS FLOAT) * CAST(737 AS FLOAT) AS DOUBLE), 0), 0), 737) AS INTEGER) AS x,
  CAST(round_even(x1 / 8, 0) AS BIGINT) AS even, CAST(floor(y1 / 8 + 0.5) AS BIGINT) AS away, CAST(trunc(-x1 / 7) AS BIGINT) AS cut, CAST(floor(-x1 / 7) AS BIGINT) AS low FROM boxes""")
def rounding_rules(spark, sf_dir):
    return boxes(spark, sf_dir).select(
        "page", "idx", numbers.rescaled(F.col("x2"), F.lit(320), F.lit(737)).alias("x"), numbers.half_even(F.col("x1") / 8).cast("bigint").alias("even"), numbers.half_away(F.col("y1") / 8).cast("bigint").alias("away"),
        numbers.truncated(-F.col("x1") / 7).alias("cut"), numbers.floored_quotient(-F.col("x1"), F.lit(7.0)).cast("bigint").alias("low"),
    )


@query(f"""WITH {BOXES_SQL}, q AS (SELECT page, idx, greatest(sqrt(pow(x2 - x1, 2) + 9), sqrt(pow(x2 - x1 - 4, 2) + 4)) AS w, greatest(sqrt(25 + pow(y2 - y1, 2)), sqrt(1 + pow(y2 - y1 - 1, 2))) AS h,
  (x1 * (y1 + 3) - x2 * y1 + x2 * (y2 + 2) - (x2 + 1) * (y1 + 3) + (x2 + 1) * y2 - (x1 + 5) * (y2 + 2) + (x1 + 5) * y1 - x1 * y2) / 2 AS area,
  sqrt(pow(x2 - x1, 2) + 9) + sqrt(1 + pow(y2 - y1 - 1, 2)) + sqrt(pow(x2 - x1 - 4, 2) + 4) + sqrt(25 + pow(y2 - y1, 2)) AS length FROM boxes)
SELECT page, idx, CAST(trunc(w) AS BIGINT) AS w, CAST(trunc(h) AS BIGINT) AS h, trunc(h) / trunc(w) >= 1.5 AS rotates, round(area, 6) AS area, round(length, 6) AS length, round(abs(area) * 1.5::DOUBLE / length, 6) AS distance FROM q""")
def quad_measures(spark, sf_dir):
    """Crop size, area, perimeter and unclip distance of a quadrilateral."""
    b = g.box()
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    quad = F.array(point(b.x1, b.y1), point(b.x2, b.y1 + 3), point(b.x2 + 1, b.y2 + 2), point(b.x1 + 5, b.y2))
    rows = boxes(spark, sf_dir).select("page", "idx", quad.alias("quad"))
    rows = rows.select("page", "idx", planning.crop_size(F.col("quad")).alias("c"), g.ring_area(F.col("quad")).alias("area"), g.ring_length(F.col("quad")).alias("length"), g.unclip_distance(F.col("quad")).alias("distance"))
    return rows.select("page", "idx", "c.*", *[six(F.col(c)).alias(c) for c in ("area", "length", "distance")])


# -- scores ------------------------------------------------------------------------------------------------------------

CTC_SQL = f"""WITH {STEPS_SQL}, b AS (SELECT vec_id, t, list_position(scores, list_max(scores)) - 1 AS c, list_max(scores) AS top FROM steps),
k AS (SELECT *, lag(c) OVER (PARTITION BY vec_id ORDER BY t) AS before FROM b), f AS (SELECT * FROM k WHERE c <> 0 AND (before IS NULL OR before <> c))
SELECT v.vec_id, coalesce(string_agg(['a', 'b', ' '][c], '' ORDER BY t), '') AS text, round(CAST(coalesce(list_reduce(list(top ORDER BY t) FILTER (WHERE c IS NOT NULL), lambda a, b: a + b) / CAST(count(c) AS FLOAT), CAST(0 AS FLOAT)) AS DOUBLE), 6) AS score, CAST(count(c) AS INTEGER) AS n FROM (SELECT DISTINCT vec_id FROM steps) v LEFT JOIN f ON f.vec_id = v.vec_id GROUP BY v.vec_id"""


@query(CTC_SQL)
def ctc_decode(spark, sf_dir):
    entries = recognition.dictionary_rows(spark.createDataFrame([("a\r\nb\n",)], "value string"), appends_space=True)
    decoded = recognition.ctc_decode(score_steps(spark, sf_dir), entries, "vec_id")
    return decoded.select("vec_id", "text", six(F.col("score").cast("double")).alias("score"), "n")


@query(f"""WITH {STEPS_SQL}, r AS (SELECT vec_id * 16 + t AS row, unnest(range(4)) AS class, unnest(scores) AS raw FROM steps), k AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY raw DESC, class DESC) AS rank FROM r)
SELECT row, CAST(rank AS INTEGER) AS rank, CAST(class AS INTEGER) AS class, CAST(CAST(round_even(CAST(CAST(raw AS FLOAT) * CAST(100000 AS FLOAT) AS DOUBLE), 0) AS FLOAT) / CAST(100000 AS FLOAT) AS FLOAT) AS score FROM k WHERE rank <= 5""")
def topk_rank(spark, sf_dir):
    rows = score_steps(spark, sf_dir).select((F.col("vec_id") * 16 + F.col("t")).alias("row"), "scores")
    return ordering.top_classes(rows, "row")


@query(f"""WITH s AS (SELECT vec_id, t, list_slice(embedding, t * 8 + 1, t * 8 + 8) AS scores FROM embeddings, (SELECT unnest(range(8)) AS t)),
b AS (SELECT vec_id, t, list_position(scores, list_max(scores)) - 1 AS c, list_max(scores) AS top, scores FROM s), e AS (SELECT *, min(CASE WHEN t > 0 AND c = 7 THEN t END) OVER (PARTITION BY vec_id) AS stop FROM b),
k AS (SELECT * FROM e WHERE (stop IS NULL OR t < stop) AND c NOT IN (0, 7))
SELECT v.vec_id, '<html><body><table>' || coalesce(string_agg(['<tr>', '</tr>', '</td>', '<td', '>', '<td></td>'][c], '' ORDER BY t), '') || '</table></body></html>' AS tokens,
  round(CAST(CAST(coalesce(avg(CAST(top AS DOUBLE)), 0) AS FLOAT) AS DOUBLE), 6) AS score, CAST(count(*) FILTER (WHERE c IN (4, 6)) AS INTEGER) AS cells FROM (SELECT DISTINCT vec_id FROM s) v LEFT JOIN k ON k.vec_id = v.vec_id GROUP BY v.vec_id""")
def structure_decode(spark, sf_dir):
    vocab = ["sos", "<tr>", "</tr>", "</td>", "<td", ">", "<td></td>", "eos"]
    steps = score_steps(spark, sf_dir, 8).withColumn("box", F.transform("scores", lambda v: v.cast("double") * 100))
    rows = recognition.structure_decode(steps, vocab, "vec_id")
    return rows.select("vec_id", F.array_join("tokens", "").alias("tokens"), six(F.col("score").cast("double")).alias("score"), F.size("cells").alias("cells"))


@query(f"WITH {MAPS_SQL} SELECT vec_id, y, x, CAST(v AS DOUBLE) > CAST(CAST(0.1 AS FLOAT) AS DOUBLE) AS bit FROM maps")
def db_segmentation(spark, sf_dir):
    return maps(spark, sf_dir).select("vec_id", "y", "x", filters.bright(F.col("v"), 0.1).alias("bit"))


# -- text --------------------------------------------------------------------------------------------------------------

SCRIPT_SQL = "CASE " + " ".join(f"WHEN unicode(c) BETWEEN {low} AND {high} THEN '{name}'" for name, low, high in stated.SCRIPTS) + " ELSE 'Other' END"


@query(f"""WITH n AS (SELECT {SCRIPT_SQL} AS script, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY 1)
SELECT script, n, CAST(row_number() OVER (ORDER BY n DESC, coalesce(list_position([{quoted(s[0] for s in stated.SCRIPTS)}], script), 99)) AS INTEGER) AS rank FROM n""")
def script_census(spark, sf_dir):
    return metrics.script_census(load(spark, sf_dir, "documents"), "text")


TITLE_SQL = rf"""WITH a AS (SELECT doc_id, text, regexp_replace(text, '^\s+', '') AS lead FROM documents), n AS (SELECT *, regexp_extract(lead, '^(?:{stated.NUMBERING})') AS num FROM a),
b AS (SELECT doc_id, regexp_replace(CASE WHEN num <> '' THEN trim(num) || ' ' || regexp_replace(substr(lead, length(num) + 1), '^\s+', '') ELSE text END, '\.+$', '') AS title FROM n)
SELECT doc_id, sha256(replace(replace(repeat('#', length(title) - length(replace(title, '.', '')) + 2) || ' ' || title, '-' || chr(10), ''), chr(10), ' ')) AS heading FROM b"""


@query(TITLE_SQL)
def title_levels(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(t.format_title(F.col("text")), 256).alias("heading"))


@query("""SELECT doc_id, sha256(replace(replace(text, chr(10) || chr(10), chr(10)), chr(10), chr(10) || chr(10))) AS doubled, sha256(replace(replace(text, '-' || chr(10), ''), chr(10), ' ')) AS joined,
  sha256(replace(replace(text, '-' || chr(10), '  ' || chr(10)), chr(10), '  ' || chr(10))) AS hard, sha256('$$' || trim(replace(text, '$$', ''), ' ' || chr(10) || chr(9)) || ' \\tag*{' || source || '}$$') AS formula FROM documents""".replace("\\\\", "\\"))
def newline_rules(spark, sf_dir):
    text = F.col("text")
    hard = markdown.format_block(F.lit("content"), text, F.lit(None).cast("string"), F.lit(1), F.lit(1))
    forms = {"doubled": t.normalize_newlines(text), "joined": t.collapse_soft_newlines(text), "hard": hard, "formula": t.merge_formula_and_number(text, F.col("source"))}
    return load(spark, sf_dir, "documents").select("doc_id", *[F.sha2(c, 256).alias(n) for n, c in forms.items()])


@query("""WITH s AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS f, generate_subscripts(string_split(text, ' '), 1) AS k FROM conversations),
m AS (SELECT conv_id, turn, min(k) FILTER (WHERE trim(replace(f, chr(10), '')) <> '') AS k0 FROM s GROUP BY conv_id, turn)
SELECT s.conv_id, s.turn, sha256(string_agg(CASE WHEN k = k0 AND lower(f) IN ('the', 'la', 'die', 'le', 'of') THEN '## ' || f || chr(10) ELSE f END, ' ' ORDER BY k)) AS said FROM s JOIN m ON m.conv_id = s.conv_id AND m.turn = s.turn GROUP BY s.conv_id, s.turn""")
def first_line_template(spark, sf_dir):
    said = t.format_first_line(F.col("text"), ("the", "la", "die", "le", "of"), "## ", "\n", " ")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(said, 256).alias("said"))


@query("SELECT page_id, sha256(chr(10) || replace(replace(replace(replace(html, '<html>', ''), '</html>', ''), '<body>', ''), '</body>', '')) AS html FROM pages")
def simplify_table_html(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.sha2(t.simplify_table(F.col("html")), 256).alias("html"))


JSON_SQL = "'\"' || replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '\"'"


@query(f"""SELECT page_id, sha256('{{"id":' || page_id || ',"url":' || {JSON_SQL.format('url')} || ',"html":' || {JSON_SQL.format('html')} || '}}') AS json FROM pages""")
def json_lines(spark, sf_dir):
    line = F.concat(F.lit('{"id":'), F.col("page_id").cast("string"), F.lit(',"url":'), t.json_string(F.col("url")), F.lit(',"html":'), t.json_string(F.col("html")), F.lit("}"))
    return load(spark, sf_dir, "pages").select("page_id", F.sha2(line, 256).alias("json"))


@query("""WITH p AS (SELECT conv_id, regexp_replace(replace(text, ' ', ''), '[^A-Za-z0-9]', '', 'g') AS p, lead(regexp_replace(replace(text, ' ', ''), '[^A-Za-z0-9]', '', 'g')) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations),
d AS (SELECT lower(p) AS p, lower(q) AS q FROM p WHERE q IS NOT NULL)
SELECT count(*) AS n, round(coalesce(sum(CASE WHEN p = q THEN 1 ELSE 0 END), 0) / (count(*) + 1e-5::DOUBLE), 6) AS accuracy, round(1 - coalesce(sum(CASE WHEN greatest(length(p), length(q)) = 0 THEN 0 ELSE levenshtein(p, q) / greatest(length(p), length(q)) END), 0) / (count(*) + 1e-5::DOUBLE), 6) AS ned FROM d""")
def recognition_metrics(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").select(F.col("text").alias("prediction"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("target")).where("target IS NOT NULL")
    scores = metrics.recognition_scores(rows, is_filter=True)
    return scores.select("n", six(F.col("accuracy")).alias("accuracy"), six(F.col("ned")).alias("ned"))


@query("""WITH p AS (SELECT string_split(text, ' ') AS p, string_split(replace(text, 'the ', 'the'), ' ') AS q FROM benchmark)
SELECT count(*) AS n, round(sum(CASE WHEN array_to_string(p, '') = array_to_string(q, '') THEN 1 ELSE 0 END) / (count(*) + 1e-6::DOUBLE), 6) AS accuracy FROM p""")
def structure_accuracy(spark, sf_dir):
    pairs = load(spark, sf_dir, "benchmark").select(F.split("text", " ").alias("prediction"), F.split(F.replace(F.col("text"), F.lit("the "), F.lit("the")), " ").alias("target"))
    return metrics.structure_accuracy(pairs).select("n", six(F.col("accuracy")).alias("accuracy"))


@query("""WITH p AS (SELECT conv_id AS doc, turn, text, length(text) % 3 <> 0 AS starts, length(text) % 2 = 0 AS ends FROM conversations),
l AS (SELECT *, coalesce(lag(ends) OVER (PARTITION BY doc ORDER BY turn), TRUE) AS before, lag(text) OVER (PARTITION BY doc ORDER BY turn) AS prev FROM p)
SELECT doc, sha256(string_agg(CASE WHEN starts OR before THEN chr(10) || chr(10) WHEN unicode(right(prev, 1)) BETWEEN 19968 AND 40959 OR unicode(left(text, 1)) BETWEEN 19968 AND 40959 THEN '' ELSE ' ' END || text, '' ORDER BY turn)) AS markdown FROM l GROUP BY doc""")
def document_markdown(spark, sf_dir):
    return markdown.document_markdown(pages_of_turns(spark, sf_dir)).select("doc", F.sha2("markdown", 256).alias("markdown"))


@query("""WITH p AS (SELECT conv_id AS doc, turn AS page, CASE WHEN role = 'system' THEN 'doc_title' ELSE 'text' END AS label, text, length(text) % 3 <> 0 AS starts FROM conversations),
l AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page) - 1 AS group_id, NOT (label = 'text' AND coalesce(lag(label) OVER (PARTITION BY doc ORDER BY page) = 'text', FALSE) AND NOT starts) AS stays FROM p),
r AS (SELECT *, sum(CAST(stays AS INTEGER)) OVER (PARTITION BY doc ORDER BY page) AS run FROM l)
SELECT doc, min(page) AS page, CAST(min(group_id) AS INTEGER) AS group_id, arg_min(label, group_id) AS label, sha256(string_agg(text, ' ' ORDER BY page)) AS content FROM r GROUP BY doc, run""")
def paragraph_merge(spark, sf_dir):
    return markdown.merge_across_pages(pages_of_turns(spark, sf_dir)).select("doc", "page", "group_id", "label", F.sha2("content", 256).alias("content"))


def text_blocks(spark, sf_dir):
    """Boxes with texts of a benchmark item and the geometry of their lines."""
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.col("text").alias("content"))
    rows = boxes(spark, sf_dir).join(items.agg((F.max("key") + 1).alias("n")), F.lit(True)).withColumn("key", (F.col("page") + F.col("idx")) % F.col("n")).join(items, "key", "left")
    w = F.col("x2") - F.col("x1")
    return rows.select(
        "page", "idx", "label", F.coalesce("content", F.lit("")).alias("content"), labels.image_path(F.col("label"), *g.box()).alias("image_path"), w.alias("box_width"), F.lit(300.0).alias("page_width"),
        F.col("x1").alias("start"), F.col("x2").alias("end"), (F.col("x1") + F.col("idx") % 3 * 8).alias("seg_start"), (F.col("x2") - F.col("idx") % 2 * 12).alias("seg_end"), (F.col("idx") % 3 + 1).alias("lines"), w.alias("width"),
    )


BLOCKS_SQL = rf"""{BOXES_SQL}, leads AS (
  SELECT item_id, text, regexp_replace(text, '^\s+', '') AS lead, regexp_extract(regexp_replace(text, '^\s+', ''), '^(?:{stated.NUMBERING})') AS num FROM benchmark
), titles AS (
  SELECT item_id, text, regexp_replace(CASE WHEN num <> '' THEN trim(num) || ' ' || regexp_replace(substr(lead, length(num) + 1), '^\s+', '') ELSE text END, '\.+$', '') AS title FROM leads
), blocks AS (
  SELECT b.page, b.idx, label, coalesce(text, '') AS content, replace(replace(repeat('#', coalesce(length(title) - length(replace(title, '.', '')), 0) + 2) || ' ' || coalesce(title, ''), '-' || chr(10), ''), chr(10), ' ') AS heading, CASE WHEN label IN ({quoted(stated.WITH_IMAGE)}) THEN 'imgs/img_in_' || label || '_box_' || CAST(x1 AS BIGINT) || '_' || CAST(y1 AS BIGINT) || '_' || CAST(x2 AS BIGINT) || '_' || CAST(y2 AS BIGINT) || '.jpg' END AS path,
         x1 AS s, x2 AS e, x1 + idx % 3 * 8 AS ss, x2 - idx % 2 * 12 AS se, idx % 3 + 1 AS lines, x2 - x1 AS width
  FROM boxes b LEFT JOIN titles i ON i.item_id = (b.page + b.idx) % (SELECT max(item_id) + 1 FROM benchmark)
)"""
FLAG_SQL = """NOT CASE WHEN p IS NULL THEN ss - s < 10 WHEN s < p.e AND e > p.s THEN abs(greatest(e, p.e) - p.se) < 10 AND ss - least(s, p.s) < 10 AND p.lines > 1 AND 0 < greatest(p.width, width)
  ELSE abs(p.e - p.se) < 10 AND ss - s < 10 AND p.lines > 1 AND abs(s - p.e) < greatest(p.width, width) END AS starts,
  CASE WHEN p IS NOT NULL AND s < p.e AND e > p.s THEN greatest(e, p.e) ELSE e END - se >= 10 AS ends"""


@query(f"""WITH {BLOCKS_SQL}, l AS (SELECT *, lag({{'s': s, 'e': e, 'se': se, 'lines': lines, 'width': width}}) OVER (PARTITION BY page ORDER BY idx) AS p FROM blocks) SELECT page, idx, {FLAG_SQL} FROM l""")
def paragraph_flags(spark, sf_dir):
    rows = text_blocks(spark, sf_dir).select("page", "idx", F.struct(*markdown.GEOMETRY).alias("g"))
    rows = rows.withColumn("before", F.lag("g").over(Window.partitionBy("page").orderBy("idx")))
    starts, ends = markdown.continuation(F.col("g"), F.col("before"))
    return rows.select("page", "idx", starts.alias("starts"), ends.alias("ends"))


@query(rf"""WITH {BLOCKS_SQL}, h AS (SELECT *, CASE WHEN label IN ({quoted(stated.NOT_IN_MARKDOWN)}) THEN NULL
  WHEN label = 'paragraph_title' THEN heading WHEN label = 'doc_title' THEN '# ' || replace(replace(content, '-' || chr(10), ''), chr(10), ' ')
  WHEN label = 'figure_title' THEN content WHEN label IN ('text', 'reference_content') THEN replace(replace(content, chr(10) || chr(10), chr(10)), chr(10), chr(10) || chr(10))
  WHEN label = 'abstract' THEN content WHEN label = 'content' THEN replace(replace(content, '-' || chr(10), '  ' || chr(10)), chr(10), '  ' || chr(10)) WHEN label IN ('image', 'chart', 'seal', 'formula') THEN '![](' || path || ')'
  WHEN label = 'table' THEN chr(10) || chr(10) || content WHEN label = 'reference' THEN content WHEN label = 'algorithm' THEN trim(content, chr(10)) END AS said FROM blocks),
k AS (SELECT *, last_value(CASE WHEN said IS NOT NULL THEN {{'s': s, 'e': e, 'se': se, 'lines': lines, 'width': width, 'label': label}} END IGNORE NULLS) OVER (PARTITION BY page ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM h),
f AS (SELECT *, {FLAG_SQL} FROM k), j AS (SELECT *, row_number() OVER (PARTITION BY page, said IS NULL ORDER BY idx) = 1 AS opening FROM f)
SELECT page, md5(coalesce(string_agg(CASE WHEN opening OR (label = 'text' AND p.label = 'text' AND NOT starts) THEN '' ELSE chr(10) || chr(10) END || said, '' ORDER BY idx) FILTER (WHERE said IS NOT NULL), '')) AS markdown, arg_min(starts, idx) AS starts, arg_max(ends, idx) AS ends FROM j GROUP BY page""")
def page_markdown(spark, sf_dir):
    return markdown.page_markdown(text_blocks(spark, sf_dir)).select("page", F.md5("markdown").alias("markdown"), "starts", "ends")


# -- sources, sinks and control ----------------------------------------------------------------------------------------


@query("""SELECT doc_id, sha256(text) AS digest, regexp_matches(sha256(text), '^[0-9a-f]{64}$') AS sound, strlen(text) AS n_bytes FROM documents""")
def sha256_identity(spark, sf_dir):
    digest = F.sha2("text", 256)
    return load(spark, sf_dir, "documents").select("doc_id", digest.alias("digest"), t.is_sha256(digest).alias("sound"), F.octet_length("text").cast("bigint").alias("n_bytes"))


STAGES = ("view", "click", "signup", "purchase", "error")


@query("""WITH s AS (SELECT event_type AS stage, count(*) AS calls, sum(CAST(floor(value * 1000) AS BIGINT)) AS micros, sum(user_id % 5) AS items, count(*) FILTER (WHERE user_id % 11 = 0) AS failures FROM events GROUP BY event_type)
SELECT CAST(list_position(['view', 'click', 'signup', 'purchase', 'error'], stage) AS BIGINT) AS pos, 'stage=' || stage || ' calls=' || calls || ' micros=' || CAST(micros AS BIGINT) || ' items=' || CAST(items AS BIGINT) || ' failures=' || failures AS line FROM s""")
def stage_report(spark, sf_dir):
    events = load(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.floor(F.col("value") * 1000).alias("micros"), (F.col("user_id") % 5).alias("items"), (F.col("user_id") % 11 == 0).alias("failed"))
    return metrics.stage_report(events, STAGES)


# -- page kernels: no SQL, tested against their definitions ------------------------------------------------------------


def pages_of(spark, sf_dir):
    return boxes(spark, sf_dir).select("page").distinct().select("page", F.lit(300.0).alias("w"), F.lit(200.0).alias("h"))


@query()
def xycut_full(spark, sf_dir):
    return grouped.cut_order(boxes(spark, sf_dir))


@query()
def yxcut_full(spark, sf_dir):
    return grouped.cut_order(boxes(spark, sf_dir), by_columns=False)


@query()
def enhanced_order(spark, sf_dir):
    blocks = boxes(spark, sf_dir).withColumns({"lines": (F.col("idx") % 3 + 1).cast("int"), "line_height": F.lit(10.0), "line_width": F.col("x2") - F.col("x1")})
    return grouped.enhanced_order(blocks, pages_of(spark, sf_dir))


def spans_of(spark, sf_dir):
    """Every second box as a span with the words of its page."""
    rows = boxes(spark, sf_dir).where("idx % 2 = 1")
    return rows.select("page", "idx", "x1", "y1", "x2", (F.col("y1") + 9).alias("y2"), F.concat(F.lit("line "), F.col("idx").cast("string"), F.when(F.col("idx") % 3 == 0, ".").otherwise("")).alias("text"), "score")


@query()
def block_texts(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    return grouped.block_texts(rows.where("idx % 2 = 0"), spans_of(spark, sf_dir), span_block_overlap(spark, sf_dir))


@query()
def parsed_pages(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    html = rows.where("label = 'chart'").select("page", "idx", F.lit("<table></table>").alias("html"))
    return grouped.parse_pages(pages_of(spark, sf_dir), rows.where("idx % 2 = 0"), spans_of(spark, sf_dir), html)


@query()
def parsed_markdown(spark, sf_dir):
    """Pages parsed and written as Markdown."""
    return markdown.page_markdown(markdown.blocks_of_parsed(parsed_pages(spark, sf_dir), pages_of(spark, sf_dir)))


def score_maps(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", F.lit(8).alias("w"), F.lit(8).alias("h"), F.transform("embedding", lambda v: (v * 4).cast("float")).alias("scores"), F.lit(800).alias("target_w"), F.lit(600).alias("target_h"))


@query()
def score_map_boxes(spark, sf_dir):
    return grouped.score_map_boxes(score_maps(spark, sf_dir), "vec_id", box_score=0.1)


@query()
def map_borders(spark, sf_dir):
    return grouped.map_borders(score_maps(spark, sf_dir), "vec_id")


@query(f"""WITH RECURSIVE {MAPS_SQL}, lit AS (SELECT vec_id, y, x, y * 8 + x AS k FROM maps WHERE CAST(CAST(v * 4 AS FLOAT) AS DOUBLE) > CAST(CAST(0.3 AS FLOAT) AS DOUBLE)),
reach(vec_id, k, root) AS (
  SELECT vec_id, k, k FROM lit
  UNION
  SELECT r.vec_id, l.k, r.root FROM reach r JOIN lit f ON f.vec_id = r.vec_id AND f.k = r.k JOIN lit l ON l.vec_id = r.vec_id AND abs(l.y - f.y) <= 1 AND abs(l.x - f.x) <= 1
), roots AS (SELECT vec_id, k, min(root) AS root FROM reach GROUP BY vec_id, k)
SELECT r.vec_id, CAST(row_number() OVER (PARTITION BY r.vec_id ORDER BY root) - 1 AS INTEGER) AS pos, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, CAST(count(*) AS INTEGER) AS n
FROM roots r JOIN lit l ON l.vec_id = r.vec_id AND l.k = r.k GROUP BY r.vec_id, root""")
def map_areas(spark, sf_dir):
    return grouped.map_areas(score_maps(spark, sf_dir), "vec_id").drop("error")


@query()
def polygon_metrics(spark, sf_dir):
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(corner(F.col("x1"), F.col("y1")), corner(F.col("x2"), F.col("y1") + 3), corner(F.col("x2") + 1, F.col("y2") + 2), corner(F.col("x1") + 5, F.col("y2")))
    return grouped.polygon_matches(truth(spark, sf_dir).withColumn("points", ring), boxes(spark, sf_dir).withColumn("points", ring))


# -- sources and sinks as queries --------------------------------------------------------------------------------------


def structure_tables(spark, sf_dir):
    """Structure tokens of each embedding, as a table."""
    vocab = ["sos", "<tr>", "</tr>", "</td>", "<td", ">", "<td></td>", "eos"]
    steps = score_steps(spark, sf_dir, 8).withColumn("box", F.transform("scores", lambda v: v.cast("double") * 100))
    return recognition.structure_decode(steps, vocab, "vec_id")


TOKENS_SQL = """s AS (SELECT vec_id, t, list_slice(embedding, t * 8 + 1, t * 8 + 8) AS scores FROM embeddings, (SELECT unnest(range(8)) AS t)),
b AS (SELECT vec_id, t, list_position(scores, list_max(scores)) - 1 AS c FROM s), e AS (SELECT *, min(CASE WHEN t > 0 AND c = 7 THEN t END) OVER (PARTITION BY vec_id) AS stop FROM b),
k AS (SELECT vec_id, t, ['<tr>', '</tr>', '</td>', '<td', '>', '<td></td>'][c] AS token FROM e WHERE (stop IS NULL OR t < stop) AND c NOT IN (0, 7))"""


@query(f"""WITH {TOKENS_SQL}, f AS (SELECT *, sum(CAST(token = '<tr>' AS INTEGER)) OVER w AS tr, sum(CAST(token = '</tr>' AS INTEGER)) OVER w AS ended, sum(CAST(token IN ('</td>', '<td></td>') AS INTEGER)) OVER w - 1 AS cell FROM k WINDOW w AS (PARTITION BY vec_id ORDER BY t)),
r AS (SELECT vec_id, tr, min(cell) AS start FROM f WHERE token IN ('</td>', '<td></td>') AND tr > ended GROUP BY vec_id, tr)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY tr) - 1 AS INTEGER) AS row, CAST(start AS INTEGER) AS start FROM r""")
def row_start_indices(spark, sf_dir):
    return recognition.row_starts(structure_tables(spark, sf_dir), "vec_id")


@query(f"""WITH {TOKENS_SQL}, f AS (SELECT *, contains(token, '</td>') AS closes, sum(CAST(contains(token, '</td>') AS INTEGER)) OVER (PARTITION BY vec_id ORDER BY t) - 1 AS cell FROM k)
SELECT v.vec_id, '<html><body><table>' || coalesce(string_agg(CASE WHEN NOT closes THEN token WHEN cell < 2 THEN CASE WHEN token = '<td></td>' THEN '<td>cell ' || cell || '</td>' ELSE 'cell ' || cell || token END ELSE token END, '' ORDER BY t), '') || '</table></body></html>' AS html
FROM (SELECT DISTINCT vec_id FROM s) v LEFT JOIN f ON f.vec_id = v.vec_id GROUP BY v.vec_id""")
def table_html(spark, sf_dir):
    """Tables with texts for the first two cells; all cells are one row."""
    tables = structure_tables(spark, sf_dir).select("vec_id", "tokens")
    cells = tables.select("vec_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("position"))
    matches = cells.select("vec_id", F.lit(0).alias("row"), "position", F.lit(0).alias("n"), F.concat(F.lit("cell "), F.col("position").cast("string")).alias("text"))
    starts = tables.select("vec_id", F.lit(0).alias("row"), F.lit(0).alias("start"))
    return recognition.table_html(tables, matches, starts, "vec_id")


@query("""WITH e AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN repeat('0', 64) ELSE sha256(text) END AS want, CASE WHEN doc_id % 7 = 0 THEN 1 WHEN doc_id % 3 = 0 THEN NULL ELSE strlen(text) END AS size FROM documents)
SELECT CAST(e.doc_id AS VARCHAR) AS name, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN size IS NOT NULL AND size <> strlen(text) THEN 'size' WHEN sha256(text) <> want THEN 'digest' END AS fault
FROM e LEFT JOIN (SELECT * FROM documents WHERE doc_id % 11 <> 0) d ON d.doc_id = e.doc_id
WHERE d.doc_id IS NULL OR (size IS NOT NULL AND size <> strlen(text)) OR sha256(text) <> want""")
def manifest_resolve(spark, sf_dir):
    """Documents as model files: every eleventh is missing, others are stated with a wrong size or digest."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    name, k = F.col("doc_id").cast("string").alias("name"), F.col("doc_id")
    length = F.length("content").cast("bigint")
    expected = docs.select(name, F.when(k % 5 == 0, F.repeat(F.lit("0"), F.lit(64))).otherwise(F.sha2("content", 256)).alias("sha256"), F.when(k % 7 == 0, 1).when(k % 3 == 0, F.lit(None)).otherwise(length).alias("bytes"))
    return manifest.resolve(expected, docs.where(k % 11 != 0).select(name, length.alias("length"), "content"))


@query("""SELECT doc_id, CAST(generate_subscripts(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1) AS INTEGER) AS class_id, sha256(regexp_replace(unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))), '\\r$', '')) AS entry FROM documents""")
def dictionary_scan(spark, sf_dir):
    """Every document read as a dictionary: an entry a line."""
    rows = recognition.dictionary_rows(load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("value")), False, ("doc_id",))
    return rows.select("doc_id", "class_id", F.sha2("text", 256).alias("entry"))


@query(f"""WITH {BOXES_SQL} SELECT CAST(page AS VARCHAR) AS doc_id, 0 AS page, '{{"schema_version":"pagewright/layout-result/v1","input":{{"id":"' || page || '","page_index":0,"width":300,"height":200}},"model":null,"regions":[' ||
  string_agg('{{"label":"' || label || '","score":' || printf('%.10f', score) || ',"box":[' || printf('%.10f', x1) || ',' || printf('%.10f', y1) || ',' || printf('%.10f', x2) || ',' || printf('%.10f', y2) || ']}}', ',' ORDER BY idx) || ']}}' AS json FROM boxes GROUP BY page""")
def layout_json(spark, sf_dir):
    found = boxes(spark, sf_dir).withColumns({"doc_id": F.col("page").cast("string"), "page": F.lit(0), "pos": F.col("idx")})
    sizes = found.select("doc_id", "page").distinct().withColumns({"w": F.lit(300), "h": F.lit(200)})
    return output.layout_documents(found, sizes)


def result_sql(kind: str, key: str, item: str) -> str:
    """A page's result as JSON, with the items in order."""
    head = f"""'{{"schema_version":"pagewright/{kind}-result/v1","input":{{"id":"' || page || '","page_index":0,"width":300,"height":200}},"model":null,"{key}":['"""
    return f"WITH {BOXES_SQL}, t AS (SELECT *, label || ' \"' || idx || chr(10) AS said FROM boxes) SELECT CAST(page AS VARCHAR) AS doc_id, 0 AS page, {head} || string_agg({item}, ',' ORDER BY idx) || ']}}' AS json FROM t GROUP BY page"


def results_of(spark, sf_dir):
    """Boxes as a page's results, texts with a quote and a line break, and the sizes of the pages."""
    b = g.box()
    corner = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    quad = F.array(corner(b.x1, b.y1), corner(b.x2, b.y1), corner(b.x2, b.y2), corner(b.x1, b.y2))
    said = F.concat(F.col("label"), F.lit(' "'), F.col("idx").cast("string"), F.lit("\n"))
    found = boxes(spark, sf_dir).withColumns({"quad": quad, "text": said, "doc_id": F.col("page").cast("string"), "pos": F.col("idx")}).withColumn("page", F.lit(0))
    return found, found.select("doc_id", "page").distinct().withColumns({"w": F.lit(300), "h": F.lit(200)})


SAID_SQL = JSON_SQL.format("said")
QUAD_SQL = "'[[' || CAST(x1 AS BIGINT) || ',' || CAST(y1 AS BIGINT) || '],[' || CAST(x2 AS BIGINT) || ',' || CAST(y1 AS BIGINT) || '],[' || CAST(x2 AS BIGINT) || ',' || CAST(y2 AS BIGINT) || '],[' || CAST(x1 AS BIGINT) || ',' || CAST(y2 AS BIGINT) || ']]'"


@query(result_sql("ocr", "lines", f"""'{{"quad":' || {QUAD_SQL} || ',"text":' || {SAID_SQL} || ',"confidence":' || printf('%.10f', score) || '}}'"""))
def line_json(spark, sf_dir):
    return output.line_documents(*results_of(spark, sf_dir))


@query(result_sql("detection", "regions", f"""'{{"quad":' || {QUAD_SQL} || ',"detector_score":' || printf('%.10f', score) || '}}'"""))
def detection_json(spark, sf_dir):
    found, sizes = results_of(spark, sf_dir)
    return output.detection_documents(found.withColumn("det_score", F.col("score")), sizes)


@query(result_sql("parsing", "blocks", f"""'{{"index":' || idx || ',"order_index":' || CASE WHEN idx % 3 = 0 THEN 'null' ELSE CAST(idx * 2 AS VARCHAR) END || ',"label":"' || label || '","bbox":[' || CAST(x1 AS BIGINT) || ',' || CAST(y1 AS BIGINT) || ',' || CAST(x2 AS BIGINT) || ',' || CAST(y2 AS BIGINT) || '],"content":' || {SAID_SQL} || ',"image_path":' || CASE WHEN label = 'seal' THEN '"a/' || idx || '.jpg"' ELSE 'null' END || '}}'"""))
def parsing_json(spark, sf_dir):
    found, sizes = results_of(spark, sf_dir)
    path = F.when(F.col("label") == "seal", F.concat(F.lit("a/"), F.col("idx").cast("string"), F.lit(".jpg")))
    return output.parsing_documents(found.withColumns({"order_index": F.when(F.col("idx") % 3 != 0, F.col("idx") * 2), "content": F.col("text"), "image_path": path}), sizes)


@query(result_sql("table", "tables", f"""'{{"route":"' || label || '","html":' || {SAID_SQL} || ',"tokens":["<td>",' || {SAID_SQL} || '],"cells":[[' || printf('%.10f', x1) || ',' || printf('%.10f', y1) || '],[' || printf('%.10f', score) || ']]}}'"""))
def table_json(spark, sf_dir):
    found, sizes = results_of(spark, sf_dir)
    return output.table_documents(found.withColumns({"route": F.col("label"), "html": F.col("text"), "tokens": F.array(F.lit("<td>"), F.col("text")), "cells": F.array(F.array("x1", "y1"), F.array("score"))}), sizes)


@query(f"""WITH {BOXES_SQL} SELECT page, count(*) FILTER (WHERE score >= 0.04) AS recognized, count(*) FILTER (WHERE score < 0.04) AS failed,
  CASE WHEN count(*) FILTER (WHERE score >= 0.04) = 0 THEN 2 WHEN count(*) FILTER (WHERE score < 0.04) > 0 THEN 1 ELSE 0 END AS status FROM boxes GROUP BY page""")
def page_outcomes(spark, sf_dir):
    return output.outcomes(boxes(spark, sf_dir).withColumn("error", F.when(F.col("score") < 0.04, "low")), ("page",))


@query(f"""WITH {BOXES_SQL}, c AS (SELECT page, idx, CAST(trunc(least(greatest(x1 - 5, 0), 99)) AS BIGINT) AS a, CAST(trunc(least(greatest(y1 - 5, 0), 89)) AS BIGINT) AS b, CAST(trunc(least(greatest(x2 - 5, 0), 99)) AS BIGINT) AS c, CAST(trunc(least(greatest(y2 - 5, 0), 89)) AS BIGINT) AS d FROM boxes)
SELECT page, idx, c - a > 3 AND d - b > 3 AS kept, CASE WHEN c - a > 3 AND d - b > 3 THEN a || ',' || b || ' ' || c || ',' || b || ' ' || c || ',' || d || ' ' || a || ',' || d END AS corners FROM c""")
def kept_quads(spark, sf_dir):
    """Quadrilaterals in any corner order, put in order and clipped to a page of 100 by 90; the thin ones go."""
    b = g.box()
    point = lambda x, y: F.struct((x - 5).alias("x"), (y - 5).alias("y"))
    quad = F.array(point(b.x2, b.y2), point(b.x1, b.y1), point(b.x1, b.y2), point(b.x2, b.y1))
    rows = boxes(spark, sf_dir).select("page", "idx", g.kept_quad(quad, F.lit(100.0), F.lit(90.0)).alias("q"))
    said = F.array_join(F.transform("q", lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " ")
    return rows.select("page", "idx", F.col("q").isNotNull().alias("kept"), F.when(F.col("q").isNotNull(), said).alias("corners"))


@query(f"""WITH {BOXES_SQL} SELECT CAST(page AS VARCHAR) AS doc_id, CAST(idx AS BIGINT) AS pos, page || chr(9) || printf('%.6f', score) || chr(9) || label AS value FROM boxes""")
def tsv_lines(spark, sf_dir):
    lines = boxes(spark, sf_dir).select(F.col("page").cast("string").alias("doc_id"), F.lit(0).alias("page"), F.col("idx").alias("pos"), "score", F.col("label").alias("text"))
    return output.text_lines(lines, named=True).drop("page")


@query("""SELECT date_trunc('hour', ts) AS start, event_type AS stage, count(*) AS calls, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS micros FROM events GROUP BY ALL""")
def extension_event_windows(spark, sf_dir):
    """An extension: hourly windows of events, by the same function that streams use."""
    events = load(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"), F.floor(F.col("value") * 1000).alias("micros"))
    totals = stream_events.windowed_totals(events, size="1 hour")
    return totals.select(F.col("start").cast("timestamp_ntz").alias("start"), "stage", "calls", "micros")
