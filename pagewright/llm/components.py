"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import forget, written

ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of an edge (columns a, b), the smallest node that links reach. Loops and repeated edges do no harm; edges with a null are left out.

    Each round hangs the neighbours of a node on its smallest one, first those above the node, then the others. Minima
    are aggregated before the shuffle, and the joins that follow have one row for each node on one side, so that Spark
    can split the rows of a node with very many edges. The number of edges never grows; rounds go with the logarithm
    of the diameter. Edges are written to the shared folder after each round.
    """
    pair = lambda u, v: F.struct(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    stars = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(pair("a", "b").alias("e")).select("e.*").distinct()
    stars = written(stars, "edges")
    seen = None
    for _ in range(ROUNDS):
        now = tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if now == seen or not now[0]:
            break
        seen = now
        both = stars.select("u", "v").unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        before, stars = stars, written(small, "edges")
        forget(before)
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
