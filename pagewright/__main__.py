"""Command line: python -m pagewright {lines,regions,structure,census,manifest} ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from pagewright.inference.backend import Onnx
from pagewright.inference.engine import Control, Models, Options, detect_regions, image_markdown, parse_images, read_lines
from pagewright.operators import metrics, output
from pagewright.operators.recognition import dictionary_rows
from pagewright.session import session
from pagewright.sources import images, manifest


def entries_of(path: str, appends_space: bool) -> tuple[str, ...]:
    spark = session()
    rows = dictionary_rows(spark.read.text(path, wholetext=True), appends_space).orderBy("class_id")
    return tuple(r["text"] for r in rows.collect())


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pagewright")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("lines", "regions", "structure"):
        p = commands.add_parser(name, help="read page images with the models of a manifest")
        p.add_argument("path")
        p.add_argument("--manifest", required=True)
        p.add_argument("--models", required=True, help="folder of detector.onnx, recognizer.onnx and dictionary.txt")
        p.add_argument("--format", choices=("json", "markdown") if name == "structure" else ("json", "tsv", "text"), default="json")
        p.add_argument("--box-score", type=float, default=0.6)
        p.add_argument("--drop-score", type=float, default=0.5)
        p.add_argument("--seconds", type=float, help="time for a page")
        if name == "structure":
            p.add_argument("--layout", required=True, help="the layout model's file")
            p.add_argument("--layout-sha256", required=True, help="its digest")
    commands.add_parser("census", help="count a text file's characters by script").add_argument("path")
    commands.add_parser("manifest", help="check a manifest").add_argument("path")
    asked = parser.parse_args(args)
    try:
        if asked.command == "manifest":
            with open(asked.path) as file:
                print(manifest.parse(file.read()).classes)
            return 0
        spark = session()
        if asked.command == "census":
            for r in metrics.script_census(spark.read.text(asked.path, wholetext=True), "value").collect():
                print(f"{r['script']}\t{r['n']}")
            return 0
        with open(asked.manifest) as file:
            known = manifest.parse(file.read())
        folder, fields = manifest.check_directory(asked.models), known.fields
        entries = entries_of(f"{folder}/dictionary.txt", fields["dictionary.appends_space"] == "true")

        def models() -> Models:
            return Models(Onnx(f"{folder}/detector.onnx", fields["detector.sha256"]), Onnx(f"{folder}/recognizer.onnx", fields["recognizer.sha256"]), entries)

        pages = images.decode(images.read_files(spark, asked.path)).cache()
        options = Options(box_score=asked.box_score, least_score=asked.drop_score, control=Control(asked.seconds))
        if asked.command == "structure":
            found = parse_images(pages, models, lambda: Onnx(asked.layout, asked.layout_sha256), options).cache()
        else:
            found = (read_lines if asked.command == "lines" else detect_regions)(pages, models, options).cache()
        sound, size = found.where("error IS NULL"), pages.where("error IS NULL").select("doc_id", "page", "w", "h")
        named = pages.count() > 1
        if asked.command == "structure" and asked.format == "markdown":
            rows = image_markdown(pages, found).orderBy("doc").select(F.col("markdown").alias("value"))
        elif asked.command == "structure":
            rows = output.parsing_documents(sound.where("index IS NOT NULL").withColumnRenamed("index", "pos"), size, named=named).orderBy("doc_id", "page").select(F.col("json").alias("value"))
        elif asked.command == "regions":
            rows = output.detection_documents(sound, size, named=named).orderBy("doc_id", "page").select(F.col("json").alias("value"))
        elif asked.format == "json":
            rows = output.line_documents(sound, size, named=named).orderBy("doc_id", "page").select(F.col("json").alias("value"))
        else:
            lines = output.text_lines(sound, named) if asked.format == "tsv" else sound.select("doc_id", "page", "pos", F.col("text").alias("value"))
            rows = lines.orderBy("doc_id", "page", "pos").select("value")
        for row in rows.toLocalIterator():
            print(row["value"])
        bad = found.where("error IS NOT NULL").select("doc_id", "page", "error")
        for row in bad.toLocalIterator():
            print(f"{row['doc_id']} page {row['page']}: {row['error']}", file=sys.stderr)
        return output.exit_status(pages.select("doc_id", "page").join(bad, ["doc_id", "page"], "left"))
    except (OSError, ValueError) as e:
        print(f"pagewright: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
