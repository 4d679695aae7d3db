"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps bytes for word splitting: A-Z to lower case, other ASCII outside [0-9a-z] to a space. Bytes of multi-byte characters stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and the executors share: what the cluster names in spark.checkpoint.dir, and only in local mode, if that is unset, one of our own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="pagewright-"))
    return sc.getCheckpointDir()


_left: list = []


@atexit.register
def _clean() -> None:
    for fs, path in _left:
        try:
            fs.delete(path, True)
        except Exception:  # noqa: BLE001  the JVM may have gone already
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a table in the shared folder: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    _left.append((jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath))
    return spark.read.schema(df.schema).parquet(path)


def free_name(taken: list[str], name: str) -> str:
    """A column name that clashes with none of those taken (Spark compares without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts make up about max_bytes at most, or a single row."""
    for batch in batches:
        each = max(1, batch.num_rows and batch.num_rows * max_bytes // max(1, batch.column(batch.schema.get_field_index(column)).nbytes))
        for at in range(0, batch.num_rows, each):
            yield batch.slice(at, each)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys (which hold no nulls), from rows sorted by them."""
    held, last = [], None
    for batch in batches:
        if not (n := batch.num_rows):
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        new = np.zeros(n, bool)
        new[0] = bool(held) and last != tuple(c[0].as_py() for c in columns)
        for c in columns:
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(new[1:]) + 1).tolist(), n]
        for a, b in zip(edges, edges[1:]):
            if held and new[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[n - 1].as_py() for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def forget(df: DataFrame) -> None:
    """Removes the table behind a frame of written() that nothing reads any more."""
    for path in df.inputFiles()[:1]:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        if any(str(folder.getName()) == str(p.getName()) for _, p in _left):
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def sha256_hex(column) -> Column:
    return F.lower(F.sha2(column, 256))
