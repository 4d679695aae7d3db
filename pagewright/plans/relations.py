"""Document relations derived from plain tables, in Spark and as SQL common table expressions.

Integer arithmetic only, so that every engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import labels
from pagewright.plans import stated
from pagewright.session import load

BOXES_SQL = f"""
numbered AS (
  SELECT l_orderkey AS page, l_partkey AS p, l_suppkey AS s, l_linenumber AS n, CAST(floor(l_quantity) AS BIGINT) AS q, l_discount AS score,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount) - 1 AS idx
  FROM lineitem
), boxes AS (
  SELECT page, idx, CAST((p * 37 + n * 11) % 160 AS DOUBLE) AS x1, CAST((s * 53 + n * 17) % 120 AS DOUBLE) AS y1,
         CAST((p * 37 + n * 11) % 160 + 40 + q * 7 % 60 AS DOUBLE) AS x2, CAST((s * 53 + n * 17) % 120 + 20 + p % 40 AS DOUBLE) AS y2,
         CAST(score AS DOUBLE) AS score, ([{", ".join(f"'{x}'" for x in stated.LAYOUT)}])[CAST((p + idx) % 20 AS INTEGER) + 1] AS label
  FROM numbered
)"""

TRUTH_SQL = """
truth AS (SELECT page, idx, x1 + (idx % 5) * 4 AS x1, y1 + (idx % 5) * 4 AS y1, x2 + (idx % 5) * 4 AS x2, y2 + (idx % 5) * 4 AS y2, idx % 7 = 6 AS ignored FROM boxes)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, idx, x1, y1, x2, y2, score, label) from lineitem: an order is a page, a line a box."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount")
    rows = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"),
        F.floor("l_quantity").alias("q"), F.col("l_discount").alias("score"), (F.row_number().over(order) - 1).cast("bigint").alias("idx"),
    )
    x1, y1 = (F.col("p") * 37 + F.col("n") * 11) % 160, (F.col("s") * 53 + F.col("n") * 17) % 120
    return rows.select(
        "page", "idx", x1.cast("double").alias("x1"), y1.cast("double").alias("y1"),
        (x1 + 40 + F.col("q") * 7 % 60).cast("double").alias("x2"), (y1 + 20 + F.col("p") % 40).cast("double").alias("y2"),
        F.col("score").cast("double").alias("score"), labels.layout_label((F.col("p") + F.col("idx")) % 20).alias("label"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same boxes moved by up to 16 pixels, every seventh to be ignored."""
    move = (F.col("idx") % 5) * 4
    return boxes(spark, sf_dir).select("page", "idx", *[(F.col(c) + move).alias(c) for c in ("x1", "y1", "x2", "y2")], (F.col("idx") % 7 == 6).alias("ignored"))


def score_steps(spark: SparkSession, sf_dir: str, classes: int = 4) -> DataFrame:
    """(vec_id, t, scores): an embedding as a matrix of time steps by classes."""
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = vectors.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), (F.size("embedding") / classes).cast("int") - 1)).alias("t"))
    return rows.select("vec_id", "t", F.slice("embedding", F.col("t") * classes + 1, classes).alias("scores"))


STEPS_SQL = """
steps AS (
  SELECT vec_id, t, list_slice(embedding, t * 4 + 1, t * 4 + 4) AS scores
  FROM embeddings, (SELECT unnest(range(16)) AS t)
)"""


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, y, x, v): an embedding of 64 as a map of 8 by 8."""
    cells = load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    return cells.select("vec_id", F.floor(F.col("k") / 8).cast("int").alias("y"), (F.col("k") % 8).alias("x"), "v")


MAPS_SQL = """
maps AS (
  SELECT vec_id, CAST(floor(k / 8) AS INTEGER) AS y, CAST(k % 8 AS INTEGER) AS x, embedding[k + 1] AS v
  FROM embeddings, (SELECT unnest(range(64)) AS k)
)"""


def pages_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page, idx, label, content, starts, ends, markdown): a conversation is a document, a turn a page of one block."""
    rows = load(spark, sf_dir, "conversations")
    return rows.select(
        F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.lit(0).alias("idx"), F.when(F.col("role") == "system", "doc_title").otherwise("text").alias("label"),
        F.col("text").alias("content"), (F.length("text") % 3 != 0).alias("starts"), (F.length("text") % 2 == 0).alias("ends"), F.col("text").alias("markdown"),
    )
