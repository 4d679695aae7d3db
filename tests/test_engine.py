"""Pixels, sources, inference with stubs, outputs and streams."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright import __main__ as cli
from pagewright.inference import engine
from pagewright.inference.backend import Budget, Checked, Contract, ContractError, Stub, verify
from pagewright.kernels import pixels
from pagewright.operators import folds, metrics, output, planning, profiles, recognition
from pagewright.sources import documents, images, manifest
from pagewright.streaming import events


def picture(w=9, h=7, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), np.uint8)


def raw_png(width, height, depth, colour, lines, palette=b"", interlace=0):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlace)
    return pixels.PNG + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_png():
    p = picture()
    assert (pixels.decode(pixels.encode_png(p)) == p).all()
    grey = pixels.decode(raw_png(8, 1, 1, 0, b"\x00\xa5"))
    assert grey[0, :, 0].tolist() == [255, 0, 255, 0, 0, 255, 0, 255]
    assert pixels.decode(raw_png(2, 1, 16, 0, b"\x00\x12\x34\xff\x00"))[0, :, 2].tolist() == [0x12, 0xFF]
    assert pixels.decode(raw_png(2, 1, 8, 3, b"\x00\x01\x00", palette=b"\x01\x02\x03\x04\x05\x06"))[0].tolist() == [[6, 5, 4], [3, 2, 1]]
    assert pixels.decode(raw_png(1, 1, 8, 6, b"\x00\x01\x02\x03\x00"))[0, 0].tolist() == [3, 2, 1]
    for kind in range(1, 5):  # a constant gradient under each filter decodes the same in every row
        lines = bytes([kind]) + bytes([5, 5, 5] + [0, 0, 0] * 2) + bytes([kind]) + bytes(9)
        assert pixels.decode(raw_png(3, 2, 8, 2, lines)).shape == (2, 3, 3)
    passes = b"".join(b"\x00" + bytes([k]) * 1 for k in range(1, 2))
    assert pixels.decode(raw_png(1, 1, 8, 0, passes, interlace=1))[0, 0, 0] == 1


@pytest.mark.parametrize("content, kind", [(b"", "empty"), (b"GIF89a", "unsupported"), (pixels.PNG + b"\0" * 8, "malformed"), (raw_png(16385, 1, 8, 0, b""), "limit"), (raw_png(2, 2, 8, 0, b"\0\0"), "malformed"), (raw_png(1, 1, 8, 0, b"\x09\0"), "malformed"), (pixels.JPEG + b"\xe0", "unsupported"), (pixels.encode_png(np.zeros((2, 2, 3), np.uint8))[:-20], "malformed")])
def test_bad_images(content, kind):
    with pytest.raises(pixels.ImageError) as e:
        pixels.decode(content)
    assert e.value.kind == kind


def test_exif():
    tiff = lambda v, o=">": (b"MM" if o == ">" else b"II") + struct.pack(o + "HIHHHIHH", 42, 8, 1, 0x0112, 3, 1, v, 0)
    file = lambda body: b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(body) + 8) + b"Exif\0\0" + body + b"\xff\xda"
    for v in range(1, 9):
        assert pixels.exif_orientation(file(tiff(v))) == pixels.exif_orientation(file(tiff(v, "<"))) == v
    assert pixels.exif_orientation(file(tiff(9))) == pixels.exif_orientation(b"\xff\xd8\xff\xda") == pixels.exif_orientation(file(b"MM\0")) == 1
    p = picture(2, 3)
    assert (pixels.upright(p, 6) == np.rot90(p, -1)).all() and (pixels.upright(p, 8) == np.rot90(p)).all() and (pixels.upright(p, 3) == p[::-1, ::-1]).all()
    assert (pixels.upright(p, 5) == p.swapaxes(0, 1)).all() and (pixels.upright(p, 2) == p[:, ::-1]).all()
    assert (pixels.decode(file(tiff(6)), jpeg=lambda c: p) == np.rot90(p, -1)).all()


def test_resizing_and_crops():
    flat = np.full((10, 14, 3), 77, np.uint8)
    for made in (pixels.linear_resize(flat, 5, 23), pixels.cubic_resize(flat, 5, 23)):
        assert made.shape == (23, 5, 3) and (made == 77).all()
    p = picture(20, 16)
    assert (pixels.linear_resize(p, 20, 16) == p).all() and (pixels.cubic_resize(p, 20, 16) == p).all()
    crop = pixels.crop_quadrilateral(p, [(2, 3), (12, 3), (12, 9), (2, 9)])
    assert crop.shape == (6, 10, 3) and (crop == p[3:9, 2:12]).all()
    tall = pixels.crop_quadrilateral(p, [(2, 1), (6, 1), (6, 13), (2, 13)])
    assert (tall == np.rot90(p[1:13, 2:6])).all()
    with pytest.raises(pixels.ImageError):
        pixels.crop_quadrilateral(p, [(0, 0), (0, 0), (0, 5), (0, 5)])
    assert pixels.rotate_page(p, 90).shape == (20, 16, 3) and (pixels.rotate_page(p, 0) == p).all()
    assert (pixels.rotate_page(p, 180)[1:, 1:] == p[::-1, ::-1][:-1, :-1]).all()
    assert pixels.crop_box(p, (30, 0, 40, 5)) is None and pixels.crop_box(p, (-3, 2.9, 4, 5)).shape == (3, 4, 3)
    assert pixels.cubic_weights(np.float32(0)).tolist() == [0, 1, 0, 0] and pixels.cubic_weights(np.float32(0.3)).sum() == pytest.approx(1)


def test_tensors():
    p = picture(8, 4)
    t = pixels.detector_tensor([p])
    assert t.shape == (1, 3, 4, 8) and t[0, 0, 1, 2] == pytest.approx((p[1, 2, 0] / 255 - 0.485) / 0.229, abs=1e-5)
    r = pixels.recognizer_tensor([p, p[:, :5]], 10)
    assert r.shape == (2, 3, 4, 10) and (r[0, :, :, 8:] == 0).all() and (r[1, :, :, 5:] == 0).all() and r[0, 0, 0, 0] == pytest.approx(p[0, 0, 0] / 127.5 - 1, abs=1e-6)
    assert pixels.table_class_tensor(picture(300, 260)).shape == (1, 3, 224, 224) and pixels.table_structure_tensor(picture(30, 60)).shape == (1, 3, 512, 512)
    assert (pixels.unwarped(pixels.unwarp_tensor(p)) == p).all() and pixels.scale_factors(p, 8).tolist() == [[2.0, 1.0]]
    with pytest.raises(pixels.ImageError):
        pixels.recognizer_tensor([p], 7)


def test_backend_contracts(tmp_path):
    double = Stub(lambda x: x * 2)
    run = Checked(double, (Contract("x", (1, (1, 4))),), (Contract("y", (1, (1, 4))),), Budget(elements=4))
    assert run(np.ones((1, 3), np.float32))[0].tolist() == [[2, 2, 2]]
    for bad in (np.ones((2, 3), np.float32), np.ones((1, 5), np.float32), np.full((1, 2), np.nan, np.float32), np.ones(3, np.float32)):
        with pytest.raises(ContractError):
            run(bad)
    with pytest.raises(ContractError):
        Checked(Stub(lambda x: x.astype(np.int64)), (Contract("x", (1,)),), (Contract("y", (1,)),))(np.ones(1, np.float32))
    file = tmp_path / "m"
    file.write_bytes(b"model")
    assert verify(str(file), hashlib.sha256(b"model").hexdigest()) == str(file)
    for path, digest in ((str(file), "0" * 64), (str(tmp_path / "none"), "0" * 64)):
        with pytest.raises(ContractError):
            verify(path, digest)


DICTIONARY = ("a", "b", " ")


def bright_boxes(x):
    """A score map that is bright where the page is."""
    return (x[:, :1] > 1).astype(np.float32)


def width_as_text(x):
    """One step for each 16 columns that aren't padding: a, then b, by turns, with a blank between."""
    out = np.full((x.shape[0], 40, 4), 0.01, np.float32)
    for k in range(len(x)):
        n = int(np.ceil((np.abs(x[k]).sum((0, 1)) > 0).sum() / 16))
        for t in range(40):
            out[k, t, (1 + t // 2 % 2) if t % 2 == 0 and t // 2 < n else 0] = 0.9
    return out


def models():
    return engine.Models(Stub(bright_boxes), Stub(width_as_text), DICTIONARY)


def test_lines_with_stubs(spark, tmp_path):
    page = np.zeros((96, 160, 3), np.uint8)
    page[20:40, 10:150] = 255
    page[60:76, 10:60] = 255
    (tmp_path / "a.png").write_bytes(pixels.encode_png(page))
    (tmp_path / "b.png").write_bytes(b"not an image")
    (tmp_path / "c.png").write_bytes(b"")
    (tmp_path / "d.png").write_bytes(pixels.encode_png(np.zeros((64, 64, 3), np.uint8)))
    pages = images.decode(images.read_files(spark, str(tmp_path))).cache()
    assert {r["doc_id"][-5:]: (r["error"] or {"kind": None})["kind"] for r in pages.collect()} == {"a.png": None, "b.png": "unsupported", "d.png": None}
    assert {r["error"]["kind"] for r in images.read_files(spark, str(tmp_path), limit=5).collect()} == {"limit"}
    lines = engine.read_lines(pages, models).cache()
    rows = {name: [r for r in lines.orderBy("pos").collect() if r["doc_id"].endswith(name)] for name in ("a.png", "b.png", "d.png")}
    assert len(rows["a.png"]) == 2 and rows["d.png"] == [] and len(rows["b.png"]) == 1 and rows["b.png"][0]["text"] is None and rows["b.png"][0]["error"]
    assert rows["a.png"][0]["quad"][0]["y"] < rows["a.png"][1]["quad"][0]["y"] and set(rows["a.png"][0]["text"]) == {"a", "b"} and rows["a.png"][0]["score"] == pytest.approx(0.9, abs=1e-6)
    regions = engine.detect_regions(pages, models).where("error IS NULL")
    assert regions.count() == 2 and regions.agg(F.min("det_score")).first()[0] > 0.9
    stopped = engine.read_lines(pages.where("doc_id LIKE '%a.png'"), models, engine.Options(control=engine.Control(seconds=0)))
    assert [r["error"] for r in stopped.collect()] == ["out of time before detector"]
    cancelled = engine.read_lines(pages.where("doc_id LIKE '%a.png'"), models, engine.Options(control=engine.Control(seconds=0, cancelled=lambda: True)))
    assert [r["error"] for r in cancelled.collect()] == ["cancelled before detector"]
    size = pages.where("error IS NULL").select("doc_id", "page", "w", "h")
    said = {r["doc_id"][-5:]: r["json"] for r in output.line_documents(lines.where("error IS NULL"), size).collect()}
    assert said["d.png"].endswith('"lines":[]}') and '"confidence":0.8999999762' in said["a.png"] and said["a.png"].startswith('{"schema_version":"pagewright/ocr-result/v1","input":{"id":"file:')
    assert output.exit_status(pages) == 1 and output.exit_status(pages.where("error IS NULL")) == 0 and output.exit_status(pages.where("error IS NOT NULL")) == 2


def test_turned_crops():
    flip = engine.Models(Stub(bright_boxes), turner=Stub(lambda x: np.tile(np.array([[0.05, 0.95]], np.float32), (len(x), 1))))
    p = picture(20, 10)
    assert (flip.turned([p] * 9, 0.9)[8] == p[::-1, ::-1]).all() and (flip.turned([p], 0.96)[0] == p).all()


def test_layout_detection(spark):
    rows = np.array([[2, 0.9, 1, 2, 3, 4], [-1, 0.9, 0, 0, 1, 1], [8, 0.4, 0, 0, 1, 1]], np.float32)
    p = picture(32, 32)
    pages = spark.createDataFrame([("d", 0, 32, 32, p.tobytes(), None)], images.PAGES)
    found = engine.detect_layout(pages, lambda: Stub(lambda im_shape, image, scale_factor: rows), side=64).collect()
    assert [(r["label"], r["x1"], r["error"]) for r in found] == [("text", 1.0, None)]
    with pytest.raises(ValueError):
        engine.decode_detections(np.array([[99, 0.9, 0, 0, 1, 1]]), ("a",), 0.5)


def page_of(*bars, w=160, h=96):
    page = np.zeros((h, w, 3), np.uint8)
    for x1, y1, x2, y2 in bars:
        page[y1:y2, x1:x2] = 255
    return page


def test_image_to_markdown(spark):
    """From images to blocks and Markdown in one call: lines are put into layout blocks, in order; a page that fails gives its error alone."""
    p = page_of((10, 8, 150, 24), (10, 60, 60, 76))
    pages = spark.createDataFrame([("d", 0, 160, 96, p.tobytes(), None), ("d", 1, 160, 96, p.tobytes(), None), ("e", 0, 160, 96, p.tobytes(), None), ("f", 0, None, None, None, ("malformed", "file", ""))], images.PAGES)
    rows = np.array([[2, 0.9, 0, 50, 160, 90], [10, 0.8, 0, 0, 160, 40]], np.float32)  # a text below a document's title
    parsed = engine.parse_images(pages, models, lambda: Stub(lambda im_shape, image, scale_factor: rows)).cache()
    own = {(d, k): [(r["label"], r["content"]) for r in parsed.where((F.col("doc_id") == d) & (F.col("page") == k) & F.col("error").isNull()).orderBy("index").collect()] for d, k in (("d", 0), ("d", 1), ("e", 0), ("f", 0))}
    assert [x[0] for x in own["d", 0]] == ["doc_title", "text"] and own["d", 0] == own["d", 1] == own["e", 0] and own["f", 0] == []
    assert all(set(text.strip()) <= {"a", "b"} and text for _, text in own["d", 0])
    assert [(r["doc_id"], r["error"]) for r in parsed.where("error IS NOT NULL").collect()] == [("f", "malformed: file")]
    said = {r["doc"]: r["markdown"] for r in engine.image_markdown(pages, parsed).collect()}
    title, text = (x[1].strip() for x in own["d", 0])
    assert set(said) == {"d", "e"} and [line.strip() for line in said["e"].split("\n") if line] == [f"# {title}", text] and said["d"].count(f"# {title}") == 2
    late = engine.parse_images(pages, models, lambda: Stub(lambda im_shape, image, scale_factor: rows), engine.Options(control=engine.Control(seconds=0)))
    assert {r["error"] for r in late.collect()} == {"out of time before detector", "malformed: file"}
    with pytest.raises(ValueError):
        engine.Options(least_score=float("nan"))


def test_premultiplied():
    rgba = np.array([[[10, 20, 30, 255], [10, 20, 30, 0], [100, 50, 1, 128], [200, 0, 3, 100]]], np.uint8)
    assert pixels.opaque(rgba)[0].tolist() == [[30, 20, 10], [0, 0, 0], [2, 100, 199], [8, 0, 255]]


def test_pages_beyond_the_usual(spark):
    """A chain that grows box by box, an axis that is too long, a class that no dictionary has, and overlaps among many boxes."""
    chain = spark.createDataFrame([(1, k, 10.0 * k, 0.0, 10.0 * k + 28.0, 10.0, 0.5, "text") for k in range(200)], "page long, idx long, x1 double, y1 double, x2 double, y2 double, score double, label string")
    assert folds.grow_region(chain, chain.where("idx = 0")).count() == 200
    far = chain.unionByName(chain.where("idx = 0").withColumns({"page": F.lit(2).cast("long"), "x2": F.lit(2e6)}))
    rows = profiles.projection(far)
    assert [(r["page"], r["n"], r["error"]) for r in rows.where("error IS NOT NULL").collect()] == [(2, None, "an extent of 2000000 is above 1000000")]
    assert rows.where("page = 1 AND error IS NULL").count() == 2018 and profiles.local_minima(rows).where("page = 2").count() == 0
    steps = spark.createDataFrame([("k", 0, [0.1, 0.9, 0.0]), ("k", 1, [0.0, 0.1, 0.9]), ("l", 0, [0.1, 0.9, 0.0])], "id string, t int, scores array<float>")
    got = {r["id"]: (r["text"], r["error"]) for r in recognition.ctc_decode(steps, spark.createDataFrame([(1, "a")], "class_id int, text string"), "id").collect()}
    assert got == {"k": (None, "class 2 is unknown"), "l": ("a", None)}
    rng = np.random.default_rng(3)
    corner = rng.integers(0, 400, (150, 2))
    size = rng.integers(5, 90, (150, 2))
    boxes = [(k, *map(float, (*corner[k], *(corner[k] + size[k]))), "image" if k % 7 == 0 else "text") for k in range(150)]
    gone = set()
    for i, a in enumerate(boxes):
        for b in boxes[i + 1 :]:
            w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
            area = lambda x: (x[3] - x[1]) * (x[4] - x[2])
            if a[0] not in gone and b[0] not in gone and w > 0 and h > 0 and w * h / min(area(a), area(b)) > 0.5:
                image = (a[5] == "image", b[5] == "image")
                gone.add(a[0] if image == (True, False) or (image != (False, True) and area(a) <= area(b)) else b[0])
    frame = spark.createDataFrame([(1, *b[:5], 0.5, b[5]) for b in boxes], chain.schema)
    assert {r["idx"] for r in folds.drop_overlaps(frame).collect()} == set(range(150)) - gone and len(gone) > 20
    texts = spark.createDataFrame([("aé日!",), ("ßß",), (None,), ("",), ("\U0001f600 \u2003",)], "value string")
    assert [tuple(r) for r in metrics.script_census(texts, "value").collect()] == [("ASCII", 3, 1), ("Latin", 3, 2), ("Punctuation", 1, 3), ("CJK Unified", 1, 4), ("Emoji", 1, 5)]


def test_documents(spark):
    assert list(documents.page_range(5, 2)) == [2, 3, 4] and list(documents.page_range(5, 3, 9)) == [3, 4] and list(documents.page_range(5, 1, 2)) == [1, 2]
    for bad in ((0,), (5, 5), (5, 0, 0), (5000,)):
        with pytest.raises(ValueError):
            documents.page_range(*bad)
    pages = spark.createDataFrame([("d", 0, 612.0, 792.0), ("d", 1, 9000.0, 9000.0), ("d", 2, 40000.0, 40000.0), ("d", 3, 0.0, 5.0)], "doc_id string, page int, width_pt double, height_pt double")
    got = {r["page"]: r for r in documents.planned(pages).collect()}
    assert got[0]["scale"] == 2.0 and 0.5 <= got[1]["scale"] < 2 and got[1]["pixels"] <= 40_000_000 and got[2]["error"]["kind"] == "limit" and got[3]["error"]["kind"] == "malformed"
    drawn = documents.render(documents.planned(pages), lambda doc, page, scale: (1, 1, bytes(3))).collect()
    assert [r["error"] is None for r in sorted(drawn, key=lambda r: r["page"])] == [True, True, False, False]
    edges = spark.createDataFrame([("d", "a", "b"), ("d", "b", "c"), ("d", "a", "c"), ("d", "x", "y"), ("d", "y", "x"), *[("d", f"n{k}", f"n{k + 1}") for k in range(20)]], "doc_id string, parent string, child string")
    roots = spark.createDataFrame([("d", 0, "a"), ("d", 1, "x"), ("d", 2, "n0"), ("d", 3, "n10")], "doc_id string, page int, node string")
    assert {r["page"]: r["fault"] for r in documents.reference_faults(edges, roots).collect()} == {1: "cycle", 2: "depth"}


GOOD = {k: "x" for k in manifest.KEYS} | {"schema_version": manifest.SCHEMA, "detector.sha256": "a" * 64, "recognizer.sha256": "b" * 64, "dictionary.sha256": "c" * 64, "detector.bytes": "3", "recognizer.bytes": "4", "dictionary.entries": "10", "dictionary.appends_space": "true"}
say = lambda fields: "# comment\n\n" + "\n".join(f"{k} = {v}" for k, v in fields.items())


@pytest.mark.parametrize("change", [{"detector.sha256": "A" * 64}, {"detector.bytes": "0"}, {"task": None}, {"extra": "1"}, {"schema_version": "other"}, {"dictionary.appends_space": "yes"}])
def test_bad_manifests(change):
    with pytest.raises(manifest.ManifestError):
        manifest.parse(say({k: v for k, v in (GOOD | change).items() if v is not None}))


def test_manifest(spark, tmp_path, capsys):
    assert manifest.parse(say(GOOD)).classes == 12
    for text in (say(GOOD) + "\ntask = twice", "no equals sign", "#\n" * 3000, "x" * 70_000):
        with pytest.raises(manifest.ManifestError):
            manifest.parse(text)
    assert manifest.check_directory("a/b") == "a/b"
    for path in ("", "a/../b"):
        with pytest.raises(manifest.ManifestError):
            manifest.check_directory(path)
    files = [("good", b"abc"), ("short", b"a"), ("other", b"xyz")]
    expected = [("good", hashlib.sha256(b"abc").hexdigest(), 3), ("short", "0" * 64, 3), ("other", "0" * 64, None), ("gone", "0" * 64, 1)]
    found = manifest.resolve(spark.createDataFrame(expected, "name string, sha256 string, bytes long"), spark.createDataFrame([(n, len(c), c) for n, c in files], "name string, length long, content binary"))
    assert {r["name"]: r["fault"] for r in found.collect()} == {"short": "size", "other": "digest", "gone": "missing"}
    (tmp_path / "m").write_text(say(GOOD))
    assert cli.main(["manifest", str(tmp_path / "m")]) == 0 and capsys.readouterr().out == "12\n"
    assert cli.main(["manifest", str(tmp_path / "none")]) == 2


def test_table_html(spark):
    tokens = ["<html>", "<body>", "<table>", "<tr>", "<td></td>", "<td></td>", "</tr>", "<tr>", "<td", ' colspan="2"', ">", "</td>", "</tr>", "</table>", "</body>", "</html>"]
    tables = spark.createDataFrame([(1, tokens), (2, ["<html>", "</html>"])], "t long, tokens array<string>")
    starts = recognition.row_starts(tables, "t")
    assert sorted((r["row"], r["start"]) for r in starts.where("t = 1").collect()) == [(0, 0), (1, 2)]
    matches = spark.createDataFrame([(1, 0, 0, 0, "a"), (1, 0, 1, 0, "<b>b</b>"), (1, 0, 1, 1, " c"), (1, 1, 0, 0, "d")], "t long, row int, position int, n int, text string")
    got = {r["t"]: r["html"] for r in recognition.table_html(tables, matches, starts, "t").collect()}
    assert got == {1: '<html><body><table><tr><td>a</td><td><b>b c</b></td></tr><tr><td colspan="2">d</td></tr></table></body></html>', 2: None}


def test_vocabulary(spark):
    row = spark.range(1).select(recognition.vocabulary(F.array(*map(F.lit, ["<tr>", "<td>", "</td>"]))).alias("v")).first()
    assert row["v"] == ["sos", "<tr>", "</td>", "<td></td>", "eos"]


def test_outputs(spark):
    pages = spark.createDataFrame([("d\"", 0, 10, 20)], "doc_id string, page int, w int, h int")
    blocks = spark.createDataFrame([('d"', 0, 0, 1, "text", 1, 2, 3, 4, "a\n\u0001é", None), ('d"', 0, 1, None, "image", 1, 2, 3, 4, "", "p.jpg")], "doc_id string, page int, pos int, order_index int, label string, x1 long, y1 long, x2 long, y2 long, content string, image_path string")
    text = output.parsing_documents(blocks, pages).first()["json"]
    import json

    assert json.loads(text)["blocks"] == [{"index": 0, "order_index": 1, "label": "text", "bbox": [1, 2, 3, 4], "content": "a\n\u0001é", "image_path": None}, {"index": 1, "order_index": None, "label": "image", "bbox": [1, 2, 3, 4], "content": "", "image_path": "p.jpg"}]
    assert '\\u0001é' in text
    tables = spark.createDataFrame([('d"', 0, 0, "wired", "<t>", ["<td>"], [[1.0, 2.5]])], "doc_id string, page int, pos int, route string, html string, tokens array<string>, cells array<array<double>>")
    assert json.loads(output.table_documents(tables, pages, named=False).first()["json"])["tables"][0]["cells"] == [[1.0, 2.5]]
    found = spark.createDataFrame([('d"', 0, 0, "text", 0.0, 0.0, 1.0, 1.0, 0.5)], "doc_id string, page int, pos int, label string, x1 double, y1 double, x2 double, y2 double, score double")
    assert json.loads(output.layout_documents(found, pages).first()["json"])["regions"][0]["score"] == 0.5
    lines = spark.createDataFrame([("d", 0, 0, "x", 0.25)], "doc_id string, page int, pos int, text string, score double")
    assert output.text_lines(lines, True).first()["value"] == "d\t0.250000\tx" and output.text_lines(lines, False).first()["value"] == "0.250000\tx"


def test_plans_agree(spark):
    sizes = [(w, h) for w in (5, 31, 33, 640, 961, 5000) for h in (7, 48, 1000, 4001)]
    rows = spark.createDataFrame(sizes, "w int, h int").select("w", "h", planning.detector_size(F.col("w"), F.col("h")).alias("s")).collect()
    assert all((r["s"]["w"], r["s"]["h"]) == engine.detector_size(r["w"], r["h"]) for r in rows)


def test_streams(spark, small, tmp_path):
    rows = spark.read.parquet(f"{small}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"), F.floor(F.col("value") * 1000).alias("micros"), "user_id")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"), "ts timestamp, stage string, micros long, user_id long", files_each=1)

    def totals(frame, how, mode):
        query = how(frame).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{mode}{how.__name__}")).trigger(availableNow=True).start()
        query.awaitTermination()
        return {tuple(r) for r in spark.table("out").collect()}

    wide = lambda f: events.windowed_totals(f, late="3650 days", size="1 hour")
    assert totals(stream, wide, "complete") == {tuple(r) for r in wide(spark.read.parquet(str(tmp_path / "in"))).collect()}
    once = events.first_seen(stream, "user_id", late="3650 days").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "once")).trigger(availableNow=True).start()
    once.awaitTermination()
    assert spark.table("once").count() == rows.select("user_id").distinct().count()
    batch = events.sessions(spark.read.parquet(str(tmp_path / "in")), "user_id", gap="1 hour")
    assert batch.agg(F.sum("calls")).first()[0] == rows.count()


def test_tables_with_stubs(spark):
    from pagewright.inference import tables

    p = picture(400, 200)
    pages = spark.createDataFrame([("d", 0, 400, 200, p.tobytes(), None), ("d", 1, None, None, None, {"kind": "malformed", "field": "image", "detail": ""})], images.PAGES)
    routed = {r["page"]: r for r in tables.classify(pages, lambda: Stub(lambda x: np.array([[0.5, 0.5]], np.float32))).collect()}
    assert routed[0]["route"] == "wireless_table" and routed[0]["score"] == 0.5 and routed[1]["error"] == "malformed: image"
    vocab = ["sos", "<tr>", "</tr>", "<td></td>", "eos"]
    said = [1, 3, 3, 2, 1, 3, 3, 2, 4, 3]
    scores = np.eye(5, dtype=np.float32)[said][None]
    steps = tables.structure_steps(pages, lambda: Stub(lambda x: [np.full((1, 10, 8), 0.5, np.float32), scores]), 5).where("error IS NULL")
    decoded = recognition.structure_decode(steps.select(F.struct("doc_id", "page").alias("page"), "t", "scores", "box"), vocab, "page").select("page.*", "tokens", "cells")
    row = decoded.first()
    assert "".join(row["tokens"]) == "<html><body><table><tr><td></td><td></td></tr><tr><td></td><td></td></tr></table></body></html>" and row["cells"] == [[200] * 8] * 4
    found = np.array([[0, 0.9, 0, 0, 190, 90], [0, 0.8, 5, 5, 195, 95], [0, 0.9, 200, 2, 390, 90], [0, 0.9, 0, 100, 190, 190], [0, 0.9, 200, 100, 390, 190], [0, 0.2, 0, 0, 5, 5]], np.float32)
    cells = tables.detect_cells(pages, lambda: Stub(lambda im_shape, image, scale_factor: found), side=64)
    assert sorted(r["idx"] for r in cells.collect()) == [0, 2, 3, 4]
    texts = spark.createDataFrame([("d", 0, k, x, y, x + 40.0, y + 10.0, t) for k, (x, y, t) in enumerate([(10.0, 10.0, "a"), (210.0, 10.0, "b"), (10.0, 110.0, "c"), (60.0, 110.0, "c2"), (500.0, 500.0, "out")])], "doc_id string, page int, idx long, x1 double, y1 double, x2 double, y2 double, text string")
    html = tables.to_html(decoded.select("doc_id", "page", "tokens"), cells, texts).first()
    assert html["html"] == "<html><body><table><tr><td>a</td><td>b</td></tr><tr><td>c c2</td><td></td></tr></table></body></html>"


def test_pages_set_right(spark):
    """A page model turns pages, another flattens them; what they return is read like any pages, and errors pass through."""
    p = picture(300, 260)
    rows = [("a", 0, 300, 260, p.tobytes(), None), ("b", 0, 20, 10, picture(20, 10).tobytes(), None), ("c", 0, None, None, None, {"kind": "malformed", "field": "x"})]
    frame = spark.createDataFrame(rows, images.PAGES)
    turn = lambda: Stub(lambda x: np.array([[0, 0.1, 0.1, 0]], np.float32) if x.shape == (1, 3, 224, 224) else None)
    a, b, c = engine.turn_pages(frame, turn).orderBy("doc_id").collect()
    assert (a["w"], a["h"], a["angle"], a["error"]) == (260, 300, 90, None) and a["content"] == pixels.rotate_page(p, 90).tobytes()
    assert c["error"]["kind"] == "malformed" and c["content"] is None and (b["w"], b["h"]) == (10, 20)
    flat = lambda: Stub(lambda image: image[:, :, ::2])
    a, b, c = engine.unwarp_pages(frame, flat).orderBy("doc_id").collect()
    assert (a["w"], a["h"]) == (300, 130) and a["content"] == p[::2].tobytes() and b["h"] == 5 and c["error"]["kind"] == "malformed"
    broken = lambda: Stub(lambda image: image[:, :1])
    assert all(r["error"] is not None and r["content"] is None for r in engine.unwarp_pages(frame, broken).collect())


def test_outputs_by_shape():
    boxes, scores = np.zeros((1, 5, 8), np.float32), np.ones((1, 5, 3), np.float32)
    made = (Contract("boxes", (1, (1, 9), 8)), Contract("scores", (1, (1, 9), 3)))
    for order in ([boxes, scores], [scores, boxes]):
        got = Checked(Stub(lambda x, o=order: o), (Contract("x", (1,)),), made)(np.zeros(1, np.float32))
        assert got[0] is boxes and got[1] is scores


def test_kept_quad(spark):
    from pagewright.functions import geometry

    quads = [
        [(30.0, 20.0), (10.0, 5.0), (30.0, 5.0), (10.0, 20.0)],
        [(10.0, 5.0), (13.9, 5.0), (13.9, 20.0), (10.0, 20.0)],
        [(-9.0, -5.0), (20.0, -5.0), (20.0, 8.7), (-9.0, 8.7)],
        [(0.0, 0.0), (20.0, 0.0), (5.0, 5.0), (0.0, 20.0)],
        [(10.0, 5.0), (10.0, 5.0), (10.0, 5.0), (10.0, 5.0)],
    ]
    frame = spark.createDataFrame([(k, q) for k, q in enumerate(quads)], "k int, q array<struct<x:double,y:double>>")
    got = [r["q"] and [tuple(p) for p in r["q"]] for r in frame.select("k", geometry.kept_quad(F.col("q"), F.lit(100), F.lit(50)).alias("q")).orderBy("k").collect()]
    assert got == [[(10, 5), (30, 5), (30, 20), (10, 20)], None, [(0, 0), (20, 0), (20, 8), (0, 8)], None, None]
    sound = frame.select(geometry.sound_quad(F.col("q")).alias("s"), "k").orderBy("k").collect()
    assert [r["s"] for r in sound] == [False, True, True, False, False]
