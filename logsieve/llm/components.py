"""Connected components of an edge table by alternating large and small stars.

Every step is an aggregation with map-side combine and a join on the vertex, so a
hub with very many edges is never gathered in one task; edges and labels stay
in tables. Each step's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether only stars are left: each leaf has one centre, and no centre is a leaf."""
    ends = edges.select(F.col("u").alias("x"), "v").unionByName(edges.select(F.col("v").alias("x"), F.lit(None).alias("v")))
    leaf = ends.groupBy("x").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_if(F.col("v").isNull()).alias("centre"))
    return leaf.where("lo <> hi or (lo is not null and centre > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) -> (u, v): every vertex but a component's least, and that least vertex."""
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    while True:
        with scratch(edges.sparkSession) as tables:
            now = materialize(_small(_large(now)), "components")
            tables.keep(now)
        if _settled(now):
            return now
