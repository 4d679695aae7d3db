"""Detection, recognition and table metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import geometry as g
from pagewright.functions import text as t

#: What keeps the two accuracies from dividing by zero; they differ.
RECOGNITION_EPSILON, TABLE_EPSILON = 1e-5, 1e-6


def page_counts(truth: DataFrame, detections: DataFrame, threshold: float = 0.5, share: float = 0.5) -> DataFrame:
    """(page, gt_care, det_care, matched): truth has a boolean column ignored; detections of which more than the share lies in an ignored truth don't count. Each other truth, in index order, takes the first free detection with an IoU above the threshold.

    Both sides of a page become arrays, each by one aggregation, and meet in one join; the rest happens in the row.
    """
    corners = ("x1", "y1", "x2", "y2")
    side = lambda rows, name, *more: rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), *corners, *more))).alias(name))
    rows = side(truth, "gt", "ignored").join(side(detections, "det"), "page", "full")
    none = lambda c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType))
    rows = rows.select("page", none("gt").alias("gt"), none("det").alias("det"))
    rows = rows.select("page", F.filter("gt", lambda t: ~t["ignored"]).alias("care"), F.filter("det", lambda d: ~F.exists("gt", lambda t: t["ignored"] & (g.over_second(g.box_of(t), g.box_of(d)) > share))).alias("det"))

    def take(used: Column, t_: Column) -> Column:
        fits = F.filter("det", lambda d: ~F.array_contains(used, d["idx"]) & (g.iou(g.box_of(d), g.box_of(t_)) > threshold))
        return F.when(F.size(fits) > 0, F.array_append(used, F.get(fits, F.lit(0))["idx"])).otherwise(used)

    matched = F.size(F.aggregate("care", F.array().cast("array<int>"), take))
    return rows.select("page", *[c.cast("bigint").alias(n) for n, c in (("gt_care", F.size("care")), ("det_care", F.size("det")), ("matched", matched))])


def detection_scores(counts: DataFrame) -> DataFrame:
    """(gt_care, det_care, matched, precision, recall, hmean): counts are summed first, then divided."""
    sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gt_care", "det_care", "matched")])
    share = lambda whole: F.when(F.col(whole) == 0, F.lit(0.0)).otherwise(F.col("matched") / F.col(whole))
    sums = sums.select("*", share("det_care").alias("precision"), share("gt_care").alias("recall"))
    both = F.col("precision") + F.col("recall")
    return sums.select("*", F.when(both == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / both).alias("hmean"))


def recognition_scores(pairs: DataFrame, ignore_space: bool = True, is_filter: bool = False) -> DataFrame:
    """(n, accuracy, ned) over (prediction, target)."""

    def norm(c: Column) -> Column:
        c = F.replace(c, F.lit(" "), F.lit("")) if ignore_space else c
        return t.metric_text(c) if is_filter else c

    rows = pairs.select(norm(F.col("prediction")).alias("p"), norm(F.col("target")).alias("t"))
    rows = rows.select((F.col("p") == F.col("t")).cast("int").alias("same"), t.edit_distance_ratio(F.col("p"), F.col("t")).alias("ned"))
    n = F.count("*")
    eps = F.lit(RECOGNITION_EPSILON)
    zero = F.lit(0.0)
    return rows.agg(n.alias("n"), (F.coalesce(F.sum("same").cast("double"), zero) / (n + eps)).alias("accuracy"), (1 - F.coalesce(F.sum("ned"), zero) / (n + eps)).alias("ned"))


def structure_accuracy(pairs: DataFrame, drop_sections: bool = False) -> DataFrame:
    """(n, accuracy) over (prediction, target), arrays of tokens that are compared joined, so that a token split otherwise compares equal."""

    def joined(c: str) -> Column:
        out = F.array_join(c, "")
        for tag in ("<thead>", "</thead>", "<tbody>", "</tbody>") if drop_sections else ():
            out = F.replace(out, F.lit(tag), F.lit(""))
        return out

    same = pairs.select((joined("prediction") == joined("target")).cast("int").alias("same"))
    return same.agg(F.count("*").alias("n"), (F.coalesce(F.sum("same").cast("double"), F.lit(0.0)) / (F.count("*") + F.lit(TABLE_EPSILON))).alias("accuracy"))


def script_census(texts: DataFrame, column: str) -> DataFrame:
    """(script, n, rank): code points by Unicode block, most first, equal counts in the order of the blocks; what is in no block is Other.

    Each block is counted in the row, so that one row of sums leaves a partition, however long its texts are.
    """
    blocks = [(name, F.regexp_count(column, F.lit(f"[\\x{{{low:X}}}-\\x{{{high:X}}}]"))) for name, low, high in t.SCRIPTS]
    sums = texts.agg(*[F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias(f"n{k}") for k, (_, c) in enumerate(blocks)], F.coalesce(F.sum(F.length(column).cast("bigint")), F.lit(0)).alias("all"))
    known = [F.col(f"n{k}") for k in range(len(blocks))]
    counts = [*zip((name for name, _ in blocks), known), ("Other", F.col("all") - sum(known, F.lit(0)))]
    rows = F.array_sort(F.array(*[F.struct((-n).alias("less"), F.lit(k).alias("place"), F.lit(name).alias("script"), n.alias("n")) for k, (name, n) in enumerate(counts)]))
    return sums.select(F.posexplode(F.filter(rows, lambda r: r["n"] > 0)).alias("pos", "r")).select("r.script", "r.n", (F.col("pos") + 1).alias("rank"))


def stage_report(events: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """(pos, line) for the stages that occur, in their fixed order. events: stage, micros, items, failed."""
    order = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    sums = events.groupBy("stage").agg(F.count("*").alias("calls"), F.sum("micros").alias("micros"), F.sum("items").alias("items"), F.sum(F.col("failed").cast("bigint")).alias("failures"))
    line = F.format_string("stage=%s calls=%d micros=%d items=%d failures=%d", "stage", "calls", "micros", "items", "failures")
    return sums.where(order > 0).select(order.alias("pos"), line.alias("line"))
