"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from axiomflow.llm.common import materialised


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the least of the node and all its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the least of them; edges come with u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    met = edges.join(least, F.col("u") == F.col("w"))
    return met.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v) other than the roots: root is the least node it can reach.

    Loops, repeated edges and both directions may occur; rows with a null end are left out. No edges give no rows.
    Every node's neighbours are met in grouped minima and joins, never in a list.
    """
    now = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    mark = None
    while True:
        seen = Observation()
        now = materialised(now.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")), "edges")
        if seen.get == mark or not seen.get["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen.get
        now = _small_star(_large_star(now))
