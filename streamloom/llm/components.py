"""Connected components by alternating large-star and small-star.

Each operation is a minimum per node and a join back, so that no task holds a
node's neighbours: a node with a third of all edges is met by partial
aggregation and by splits of its join partition. Every round is written to the
shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """(u, v) with u > v -> the star operation's edges, in the same form."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for every node of an edge the smallest node that it reaches, itself included.

    ``edges`` has integer columns a and b; loops, repeats, either direction and
    rows with a null are allowed. A node without an edge to another is not listed.
    """
    e = edges.dropna().where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stored(e, "edges")
    before = None
    while True:
        mark = e.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))).alias("s")).first()
        if mark == before or not mark.n:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        before = mark
        e = stored(_star(_star(e, True), False), "edges")
