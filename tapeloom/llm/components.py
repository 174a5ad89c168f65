"""Connected components of a graph given as an edge table, in rounds of joins and groupings.

Alternating large-star and small-star rounds; each round's edges are written to the shared folder, so the lineage stays
short and a lost executor costs one round at most; tables of a round are deleted once the next one is written. The driver sees two numbers a round. Minima are taken by
partial aggregation before the shuffle, and written out before they are joined to the edges: the join then is a plain one of two
tables, which Spark broadcasts if the minima are few and else splits where a node has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, materialise, scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "components-least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = materialise(down.groupBy("u").agg(F.min("v").alias("m")), "components-least")
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of every node that has an edge, root being the component's smallest node.

    ``edges`` has columns u and v of one ordered type; loops, repeats and nulls are allowed and carry no weight.
    """
    edges = edges.select("u", "v").where("u is not null and v is not null and u <> v")
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    spark, state, before = edges.sparkSession, None, None
    while True:
        with scratch(spark) as keep_last:
            edges = materialise(_small_star(materialise(_large_star(edges), label)).where("u <> v").distinct(), label)
            path = keep_last()
        if before:
            delete(spark, before)
        before = path
        found = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if found == state:
            break
        state = found
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
