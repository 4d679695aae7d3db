"""Sessions and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "pagewright", **conf: str) -> SparkSession:
    """A session with adaptive execution; further settings by keyword, dots as double underscores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
