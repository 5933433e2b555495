"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a grouped minimum and one join, so a hub is pre-aggregated before the shuffle and its
join can be split; nothing is gathered in one task or on the driver. Every step is written to the
shared folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import free, materialize, shuffles_freed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(edges: DataFrame):
    with shuffles_freed(edges.sparkSession):
        return edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for each node of links (u, v); root is the smallest node of the component.

    Links may repeat, in either direction; a link of a node to itself is ignored.
    """
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    was = _mark(edges)
    for _ in range(most):
        old, edges = edges, materialize(_small_star(_large_star(edges)), "stars")
        now = _mark(edges)
        free(old)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
