"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al. 2014).

Every step is one min-aggregation and one join, so a vertex with very many edges is pre-aggregated before the shuffle
and its join partition can be split; nothing is gathered in one task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _hang(edges: DataFrame, both: bool) -> DataFrame:
    """Hangs neighbours on the smallest vertex around each u: the larger neighbours (both) or the smaller ones and u."""
    if both:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    near = edges.join(least, "u")
    if both:
        return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, root): for each vertex that isn't the smallest of its component, that smallest one. No edges: no rows.

    Nulls and loops in the edges count as no edge; repeated edges count once.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    now = written(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    while True:
        spread = now.groupBy("u").agg(F.min("v").alias("least"), F.max("v").alias("most"))
        loose = spread.where("least < most").select("u").unionByName(now.join(spread.select(F.col("u").alias("v")), "v", "left_semi").select("u"))
        if loose.isEmpty():  # every vertex hangs on one root, and no root hangs on another vertex
            return now.select(F.col("u").alias("v"), F.col("v").alias("root"))
        now = written(_hang(_hang(now, both=True), both=False), "edges")
