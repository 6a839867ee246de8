"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, save


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the smaller and own) neighbours of every node on its smallest neighbour. Nodes join by key, so that no
    neighbour list is ever gathered."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """From links (a, b) the table (node, component), with component the smallest node reachable, of the nodes where it is another
    one; and the scratch folder that holds it. Null ends and loops are no links."""
    spark = edges.sparkSession
    stars, path = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    # stars already: each node hangs on one smaller node that hangs on none
    while not stars.join(stars.select(F.col("b").alias("a")), "a", "left_semi").isEmpty() or not stars.groupBy("a").count().where("count > 1").isEmpty():
        following, at = save(_star(_star(stars, True), False))
        drop(spark, path)
        stars, path = following, at
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")), path
