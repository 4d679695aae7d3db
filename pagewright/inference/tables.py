"""Tables: route, structure and cells by models, and their assembly to HTML by DataFrame operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.inference.backend import Backend, Checked, Contract
from pagewright.inference.engine import _pages, detect_layout
from pagewright.kernels import pixels
from pagewright.operators import folds, recognition, spatial

#: Routes by class, and the score and overlap that cells need.
ROUTES = ("wired_table", "wireless_table")
CELL_SCORE, CELL_OVERLAP = 0.3, 0.3
ROUTED = "doc_id string, page int, route string, score float, error string"
STEPS = "doc_id string, page int, t int, scores array<float>, box array<double>, error string"


def classify(pages: DataFrame, backend: Callable[[], Backend], routes: tuple[str, ...] = ROUTES) -> DataFrame:
    """ROUTED: the highest class of each table image; of equal scores the higher one; rounded to five places in single precision."""
    made: list[Backend] = []

    def work(image: np.ndarray) -> list[tuple]:
        if not made:
            made.append(backend())
        run = Checked(made[0], (Contract("x", (1, 3, 224, 224)),), (Contract("scores", (1, len(routes))),))
        scores = run(pixels.table_class_tensor(image))[0][0]
        best = max(range(len(scores)), key=lambda k: (scores[k], k))
        return [(routes[best], float(np.rint(scores[best] * np.float32(100_000)) / np.float32(100_000)))]

    return _pages(pages, ROUTED, work)


def structure_steps(pages: DataFrame, backend: Callable[[], Backend], classes: int, side: int = 512, padded: bool = True) -> DataFrame:
    """STEPS of each table image for recognition.structure_decode: scores by class, and the cell's eight corner values scaled to the image: as the padded square scales, or, for models whose boxes are shares of the image, by its width and height."""
    made: list[Backend] = []

    def work(image: np.ndarray) -> list[tuple]:
        if not made:
            made.append(backend())
        run = Checked(made[0], (Contract("x", (1, 3, side, side)),), (Contract("boxes", (1, (1, 4096), 8)), Contract("scores", (1, (1, 4096), classes))))
        boxes, scores = run(pixels.table_structure_tensor(image, side))
        h, w = image.shape[:2]
        scale = side / min(side / w, side / h) if padded else np.array([w, h] * 4, float)
        return [(t, s.tolist(), (b.astype(float) * scale).tolist()) for t, (s, b) in enumerate(zip(scores[0], boxes[0]))]

    return _pages(pages, STEPS, work)


def detect_cells(pages: DataFrame, backend: Callable[[], Backend], side: int = 640) -> DataFrame:
    """(doc_id, page, idx, x1, y1, x2, y2, score) of cells that stay after suppression; pages with an error are left out."""
    found = detect_layout(pages, backend, side, CELL_SCORE, ("cell",)).where("error IS NULL")
    rows = found.select(F.struct("doc_id", "page").alias("page"), F.col("idx").cast("bigint").alias("idx"), "x1", "y1", "x2", "y2", "score", "label")
    kept = folds.suppress(rows, CELL_OVERLAP)
    rows = rows.join(kept.select("page", F.col("idx").cast("bigint").alias("idx")), ["page", "idx"])
    return rows.select("page.*", "idx", "x1", "y1", "x2", "y2", "score")


def to_html(structures: DataFrame, cells: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, page, html). structures: doc_id, page, tokens; cells: doc_id, page, idx, box, score; texts: doc_id, page, idx, box, text, all in the table's coordinates.

    Cells go in rows by their tops; a structure row starts at the last cell row that starts no later. Texts belong to
    the cell that holds more than seven tenths of them.
    """
    keyed = lambda d: d.select(F.struct("doc_id", "page").alias("page"), *[c for c in d.columns if c not in ("doc_id", "page")])
    structures, cells, texts = keyed(structures), keyed(cells), keyed(texts)
    placed = folds.cell_rows(cells.withColumn("label", F.lit("cell"))).join(cells.select("page", F.col("idx").cast("int").alias("idx"), "x1", "y1", "x2", "y2"), ["page", "idx"])
    sizes = placed.groupBy("page", "row").agg(F.count("*").alias("n"))
    flags = sizes.select("page", (F.sum("n").over(Window.partitionBy("page").orderBy("row")) - F.col("n")).alias("flag"))
    starts = recognition.row_starts(structures, "page")
    aligned = spatial.align_rows(flags, starts).select("page", F.col("row").cast("int").alias("row"), F.col("aligned").cast("int").alias("aligned"))
    total = placed.groupBy("page").agg(F.count("*").alias("total"))
    upto = F.lead("aligned").over(Window.partitionBy("page").orderBy("row"))
    windows = aligned.withColumn("upto", upto).join(total, "page").select("page", "row", "aligned", F.coalesce("upto", "total").alias("upto"))
    in_rows = placed.drop("row").join(windows, "page").where((F.col("pos") >= F.col("aligned")) & (F.col("pos") < F.col("upto")))
    found = spatial.match_cells(in_rows, texts).join(texts.select("page", "idx", "text"), ["page", "idx"])
    matches = found.select("page", "row", "position", F.col("idx").alias("n"), "text")
    return recognition.table_html(structures, matches, starts.select("page", "row", "start"), "page").select("page.*", "html")
