"""Page images from files: bounded, sniffed, decoded in Arrow batches; what can't be read gives an error row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.kernels import pixels

ERROR = "struct<kind:string,field:string,detail:string>"
PAGES = f"doc_id string, page int, w int, h int, content binary, error {ERROR}"


def read_files(spark: SparkSession, path: str, limit: int = pixels.MAX_ENCODED) -> DataFrame:
    """(doc_id, length, content, error): regular files under a path; one above the limit gives an error and no content, and its bytes are never read. Spark lists no empty files, so they have no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    made = F.struct(F.lit("limit").alias("kind"), F.lit("file").alias("field"), F.col("length").cast("string").alias("detail"))
    sound = files.where(F.col("length") <= limit).select(F.col("path").alias("doc_id"), "length", "content", F.lit(None).cast(ERROR).alias("error"))
    bad = files.where(F.col("length") > limit).select(F.col("path").alias("doc_id"), "length", F.lit(None).cast("binary").alias("content"), made.cast(ERROR).alias("error"))
    return sound.unionByName(bad)


def image_format(content) -> Column:
    """png or jpeg by signature alone, null for others."""
    return F.when(F.substring(content, 1, 3) == F.lit(pixels.JPEG), "jpeg").when(F.substring(content, 1, 8) == F.lit(pixels.PNG), "png")


def header_size(content):
    """struct<w,h> that a PNG declares, from its header bytes alone."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("bigint")
    return F.when(image_format(content) == "png", F.struct(number(17).alias("w"), number(21).alias("h")))


def decode(files: DataFrame, jpeg: Callable[[bytes], np.ndarray] | None = None) -> DataFrame:
    """PAGES: a page 0 for each file, content as rows of blue, green and red bytes; a file that can't be decoded, or came with an error, gives an error and no size. JPEG needs a decoder, which must be picklable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.struct([("kind", pa.string()), ("field", pa.string()), ("detail", pa.string())])
        for batch in batches:
            for name, content, error in zip(*(batch.column(k).to_pylist() for k in range(3))):  # a page at a time: decoded pages are large
                width = height = raw = None
                if error is None:
                    try:
                        seen = pixels.decode(content, jpeg)
                        height, width, raw = *seen.shape[:2], seen.tobytes()
                    except pixels.ImageError as e:
                        error = {"kind": e.kind, "field": "image", "detail": str(e)}
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([0], pa.int32()), pa.array([width], pa.int32()), pa.array([height], pa.int32()), pa.array([raw], pa.binary()), pa.array([error], kinds)], names=["doc_id", "page", "w", "h", "content", "error"])

    return files.select("doc_id", "content", "error").mapInArrow(run, PAGES)
