"""Connected components of a graph of links, by alternating large-star and small-star steps.

Each step is one pre-aggregated minimum and one join over the links. Both results are written to the shared
folder, so that the join has plain exchanges on both sides and may split a node with very many links. The
number of steps grows with the logarithm of the longest path. Links and labels stay in tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import drop_table, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Large: larger neighbours of a node link to its smallest; small: smaller ones and itself do."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "links-least")
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "links-least")
        joined = edges.join(least, "u")
        moved = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links (a, b) reach from it; ids without links to others are left out."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "links")
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        seen, old = mark, edges
        edges = materialize(_star(materialize(_star(edges, large=True), "links"), large=False), "links")
        drop_table(old)
