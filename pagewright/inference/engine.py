"""Pages to text lines: detection, crops, orientation, recognition and decoding, a page at a time in Arrow batches.

A page gives its lines, or one row with an error, never both. Models are backends (a stub in tests), made once in each
worker; batches are formed within a page, because padding depends on them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pagewright.functions import labels
from pagewright.inference.backend import Backend, Budget, Checked, Contract
from pagewright.kernels import pixels, shapes
from pagewright.operators import grouped, markdown
from pagewright.operators.filters import finite
from pagewright.sources.images import PAGES

QUAD = "array<struct<x:int,y:int>>"
LINES = f"doc_id string, page int, pos int, quad {QUAD}, text string, score double, error string"
REGIONS = f"doc_id string, page int, pos int, quad {QUAD}, det_score double, error string"
DETECTIONS = "doc_id string, page int, idx int, label string, x1 double, y1 double, x2 double, y2 double, score double, error string"
HEIGHT, BASE_WIDTH, BATCH, MAX_CROPS = 48, 320, 6, 1_000
ORIENTATION_BATCH = 8


class Stopped(ValueError):
    """A page whose time was up, or whose run was cancelled; the flag is looked at first."""


@dataclass(frozen=True)
class Control:
    """How long a page may take, looked at between stages, and a picklable function that says whether to stop."""

    seconds: float | None = None
    cancelled: Callable[[], bool] | None = None

    def checks(self) -> Callable[[str], None]:
        began = time.monotonic()

        def check(stage: str) -> None:
            if self.cancelled is not None and self.cancelled():
                raise Stopped(f"cancelled before {stage}")
            if self.seconds is not None and time.monotonic() - began >= self.seconds:
                raise Stopped(f"out of time before {stage}")

        return check


@dataclass(frozen=True)
class Options:
    box_score: float = 0.6
    growth: float = 1.5
    least_score: float = 0.5
    turn_score: float = 0.9
    control: Control = field(default_factory=Control)

    def __post_init__(self):
        for threshold in (self.box_score, self.growth, self.least_score, self.turn_score):
            finite(threshold)


def detector_size(width: int, height: int, limit: int = 960, most: int = 4000, stride: int = 32) -> tuple[int, int]:
    """As planning.detector_size plans it."""
    if width + height < 64:
        width, height = max(width, stride), max(height, stride)
    for top in (limit, most):
        if max(width, height) > top:
            share = top / max(width, height)
            width, height = int(width * share), int(height * share)
    snap = lambda v: max(int(np.rint(v / stride)) * stride, stride)
    return snap(width), snap(height)


@dataclass
class Models:
    """detector: (1, 3, h, w) to (1, 1, h, w); recognizer: (n, 3, 48, w) to (n, t, classes); turner: (n, 3, 80, 160) to (n, 2), whose second class is upside down."""

    detector: Backend
    recognizer: Backend | None = None
    dictionary: tuple[str, ...] = ()
    turner: Backend | None = None
    budget: Budget = field(default_factory=Budget)

    def score_map(self, image: np.ndarray) -> np.ndarray:
        w, h = detector_size(image.shape[1], image.shape[0])
        run = Checked(self.detector, (Contract("x", (1, 3, h, w)),), (Contract("map", (1, 1, h, w)),), self.budget)
        return run(pixels.detector_tensor([pixels.linear_resize(image, w, h)]))[0][0, 0]

    def texts(self, crops: list[np.ndarray]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("", 0.0)] * len(crops)
        order = sorted(range(len(crops)), key=lambda k: crops[k].shape[1] / crops[k].shape[0])
        classes = len(self.dictionary) + 1
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            aspects = [crops[k].shape[1] / crops[k].shape[0] for k in part]
            width = int(max(BASE_WIDTH / HEIGHT, *aspects) * HEIGHT)
            sized = [pixels.linear_resize(crops[k], min(int(np.ceil(a * HEIGHT)), width), HEIGHT) for k, a in zip(part, aspects)]
            run = Checked(self.recognizer, (Contract("x", (len(part), 3, HEIGHT, width)),), (Contract("scores", (len(part), (1, 1 << 20), classes)),), self.budget)
            for k, scores in zip(part, run(pixels.recognizer_tensor(sized, width))[0]):
                out[k] = greedy_text(scores, self.dictionary)
        return out

    def turned(self, crops: list[np.ndarray], least: float) -> list[np.ndarray]:
        out = []
        for at in range(0, len(crops), ORIENTATION_BATCH):
            part = crops[at : at + ORIENTATION_BATCH]
            run = Checked(self.turner, (Contract("x", (len(part), 3, 80, 160)),), (Contract("scores", (len(part), 2)),), self.budget)
            scores = run(pixels.detector_tensor([pixels.linear_resize(c, 160, 80) for c in part]))[0]
            out += [c[::-1, ::-1] if s.argmax() == 1 and s[1] > least else c for c, s in zip(part, scores)]
        return out


def greedy_text(scores: np.ndarray, dictionary: tuple[str, ...]) -> tuple[str, float]:
    """Kept classes differ from blank and from the step before; the score is their single-precision mean."""
    best = scores.argmax(1)
    kept = np.flatnonzero((best != 0) & (best != np.concatenate([[-1], best[:-1]])))
    total = np.float32(0)
    for k in kept:
        total = np.float32(total + scores[k, best[k]])
    return "".join(dictionary[best[k] - 1] for k in kept), float(total / np.float32(len(kept))) if len(kept) else 0.0


def in_reading_order(found: list[tuple[list[tuple[int, int]], float]], tolerance: float = 10) -> list[tuple[list[tuple[int, int]], float]]:
    out: list = []
    for item in sorted(found, key=lambda f: (f[0][0][1], f[0][0][0])):
        at = len(out)
        while at and abs(item[0][0][1] - out[at - 1][0][0][1]) < tolerance and item[0][0][0] < out[at - 1][0][0][0]:
            at -= 1
        out.insert(at, item)
    return out


def page_regions(image: np.ndarray, models: Models, options: Options, check: Callable[[str], None]) -> list[tuple[list[tuple[int, int]], float]]:
    check("detector")
    found = shapes.map_boxes(models.score_map(image), image.shape[1::-1], options.box_score, options.growth)
    return in_reading_order(found)


def page_lines(image: np.ndarray, models: Models, options: Options) -> list[tuple]:
    check = options.control.checks()
    found = page_regions(image, models, options, check)
    if not found:
        return []
    if len(found) > MAX_CROPS:
        raise ValueError(f"{len(found)} crops are above {MAX_CROPS}")
    check("crop")
    crops = [pixels.crop_quadrilateral(image, [(float(x), float(y)) for x, y in quad]) for quad, _ in found]
    if models.turner is not None:
        check("orientation")
        crops = models.turned(crops, options.turn_score)
    check("recognizer")
    read = models.texts(crops)
    kept = [(quad, text, score) for (quad, _), (text, score) in zip(found, read) if score >= options.least_score]
    return [(pos, [{"x": x, "y": y} for x, y in quad], text, score) for pos, (quad, text, score) in enumerate(kept)]


def _pages(pages: DataFrame, schema: str, work: Callable[[np.ndarray], list[tuple]]) -> DataFrame:
    out = T._parse_datatype_string(schema)
    kinds = [to_arrow_type(f.dataType) for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.to_pylist():
                key = (page["doc_id"], page["page"])
                if page["error"] is not None:
                    rows = [(*key, *[None] * (len(kinds) - 3), f"{page['error']['kind']}: {page['error']['field']}")]
                else:
                    try:
                        image = np.frombuffer(page["content"], np.uint8).reshape(page["h"], page["w"], 3)
                        rows = [(*key, *row, None) for row in work(image)]
                    except ValueError as e:
                        rows = [(*key, *[None] * (len(kinds) - 3), str(e))]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=out.names)

    return pages.select("doc_id", "page", "w", "h", "content", "error").mapInArrow(run, out)


def read_lines(pages: DataFrame, models: Callable[[], Models], options: Options = Options()) -> DataFrame:
    """LINES of pages (sources.images.PAGES). models is called once in each worker and must be picklable."""
    made: list[Models] = []

    def work(image: np.ndarray) -> list[tuple]:
        if not made:
            made.append(models())
        return page_lines(image, made[0], options)

    return _pages(pages, LINES, work)


def detect_regions(pages: DataFrame, models: Callable[[], Models], options: Options = Options()) -> DataFrame:
    """REGIONS of pages, in reading order, without recognition."""
    made: list[Models] = []

    def work(image: np.ndarray) -> list[tuple]:
        if not made:
            made.append(models())
        found = page_regions(image, made[0], options, options.control.checks())
        return [(pos, [{"x": x, "y": y} for x, y in quad], score) for pos, (quad, score) in enumerate(found)]

    return _pages(pages, REGIONS, work)


def decode_detections(rows: np.ndarray, names: tuple[str, ...], threshold: float) -> list[tuple[str, float, list[float]]]:
    """(label, score, box) of rows (class, score, x1, y1, x2, y2): negative classes and low scores are left out; others must be known and finite."""
    out = []
    for row in np.asarray(rows, np.float32).reshape(-1, 6):
        if not np.isfinite(row).all():
            raise ValueError("a detection isn't finite")
        if row[0] < 0 or row[1] < threshold:
            continue
        if int(row[0]) >= len(names):
            raise ValueError(f"class {int(row[0])} is unknown")
        out.append((names[int(row[0])], float(row[1]), [float(v) for v in row[2:]]))
    return out


def detect_layout(pages: DataFrame, backend: Callable[[], Backend], side: int = 800, threshold: float = 0.5, names: tuple[str, ...] = labels.LAYOUT) -> DataFrame:
    """DETECTIONS of a layout or cell model: inputs image, its size and its scale factors, red first."""
    made: list[Backend] = []

    def work(image: np.ndarray) -> list[tuple]:
        if not made:
            made.append(backend())
        given = (Contract("im_shape", (1, 2)), Contract("image", (1, 3, side, side)), Contract("scale_factor", (1, 2)))
        run = Checked(made[0], given, (Contract("boxes", ((0, 1 << 16), 6)),))
        size = np.array([[side, side]], np.float32)
        rows = run(size, pixels.square_tensor(image[..., ::-1], side), pixels.scale_factors(image, side))[0]
        return [(k, label, *box, score) for k, (label, score, box) in enumerate(decode_detections(rows, names, threshold))]

    return _pages(pages, DETECTIONS, work)


def parse_images(pages: DataFrame, models: Callable[[], Models], layout: Callable[[], Backend], options: Options = Options(), regions: Callable[[], Backend] | None = None, tables: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Ordered blocks (doc_id, page, then grouped.PARSED, error) of pages, from their images: lines, layout, reconciliation and order.

    tables: doc_id, page, idx, html of table blocks. A page that fails in any step gives one row with that error, the
    first step's, and no block. What the models say is persisted, so that they run once; it is small beside the pages.
    """
    keys = ["doc_id", "page"]
    lines, found = read_lines(pages, models, options).persist(), detect_layout(pages, layout, threshold=threshold).persist()
    around = detect_layout(pages, regions, threshold=threshold, names=("region",)).persist() if regions is not None else None
    steps = [lines, found, *([around] if around is not None else [])]
    bad = reduce(DataFrame.unionByName, [s.where("error IS NOT NULL").select(*keys, F.struct(F.lit(k).alias("step"), "error").alias("e")) for k, s in enumerate(steps)])
    bad = bad.groupBy(*keys).agg(F.min("e").alias("e")).select(*keys, F.col("e.error").alias("error"))
    corner = lambda pick, c: pick(F.transform("quad", lambda p: p[c])).cast("double")
    spans = lines.where("error IS NULL").select(*keys, F.col("pos").alias("idx"), corner(F.array_min, "x").alias("x1"), corner(F.array_min, "y").alias("y1"), corner(F.array_max, "x").alias("x2"), corner(F.array_max, "y").alias("y2"), "text", "score")
    sound = pages.where("error IS NULL").select(*keys, F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h")).join(bad, keys, "left_anti")
    good = lambda rows: rows.where("error IS NULL").drop("error") if rows is not None else None
    parsed = grouped.parse_pages(sound, good(found), spans, tables, good(around), keys=tuple(keys))
    return parsed.unionByName(bad, allowMissingColumns=True)


def image_markdown(pages: DataFrame, parsed: DataFrame, pretty: bool = False) -> DataFrame:
    """(doc, markdown) of each image or document, from parse_images: its pages in order."""
    keys = ("doc_id", "page")
    made = markdown.page_markdown(markdown.blocks_of_parsed(parsed, pages, keys), pretty)
    return markdown.document_markdown(made.select(F.col("page.doc_id").alias("doc"), F.col("page.page").alias("page"), "markdown", "starts", "ends"))


ANGLES = (0, 90, 180, 270)


def _new_pages(pages: DataFrame, schema: str, work: Callable[[np.ndarray], tuple[np.ndarray, tuple]]) -> DataFrame:
    """Pages with other images, and columns besides; pages with an error pass through."""
    out = T._parse_datatype_string(schema)
    kinds = [to_arrow_type(f.dataType) for f in out.fields]
    more = len(kinds) - 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.to_pylist():
                key, error = (page["doc_id"], page["page"]), page["error"]
                if error is None:
                    try:
                        image, values = work(np.frombuffer(page["content"], np.uint8).reshape(page["h"], page["w"], 3))
                        row = (*key, image.shape[1], image.shape[0], image.tobytes(), None, *values)
                    except ValueError as e:
                        error = {"kind": getattr(e, "kind", "model"), "field": str(e)}
                if error is not None:
                    row = (*key, None, None, None, error, *[None] * more)
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds)], names=out.names)

    return pages.select("doc_id", "page", "w", "h", "content", "error").mapInArrow(run, out)


def turn_pages(pages: DataFrame, backend: Callable[[], Backend]) -> DataFrame:
    """PAGES turned by the angle of the class with the highest score, the first on ties and without a threshold; angle says which."""
    made: list[Backend] = []

    def work(image: np.ndarray) -> tuple[np.ndarray, tuple]:
        if not made:
            made.append(backend())
        run = Checked(made[0], (Contract("x", (1, 3, 224, 224)),), (Contract("scores", (1, len(ANGLES))),))
        angle = ANGLES[int(run(pixels.page_class_tensor(image))[0][0].argmax())]
        return (pixels.rotate_page(image, angle) if angle else image), (angle,)

    return _new_pages(pages, f"{PAGES}, angle int", work)


def unwarp_pages(pages: DataFrame, backend: Callable[[], Backend]) -> DataFrame:
    """PAGES as a model flattens them; nothing maps their places back to the page."""
    made: list[Backend] = []

    def work(image: np.ndarray) -> tuple[np.ndarray, tuple]:
        if not made:
            made.append(backend())
        side = (1, 1 << 14)
        run = Checked(made[0], (Contract("image", (1, 3, *image.shape[:2])),), (Contract("flat", (1, 3, side, side)),))
        return pixels.unwarped(run(pixels.unwarp_tensor(image))[0]), ()

    return _new_pages(pages, PAGES, work)
