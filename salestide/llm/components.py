"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salestide.llm.tables import cut


def smallest_reachable(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node it reaches) from links (a, b).

    Two steps alternate until nothing changes: every node hands the smallest of its
    neighbours to its larger neighbours, then to its smaller ones. Each step moves
    links only, reduces them to one minimum for each node before they meet, and never
    gathers a node's neighbours. Nodes without links don't appear.
    """
    edges = cut(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .distinct()
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Larger neighbours of u get the smallest node next to u, u included.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            edges.join(least, "u").where("v > m").select("v", F.col("m").alias("u")).distinct()
        )
        # Smaller neighbours of v (v's u) and v itself get the smallest of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(least, "v")
            .select(F.explode(F.array("u", "v")).alias("v"), F.col("m").alias("u"))
            .where("v <> u")
            .distinct()
        )
        edges = cut(small)
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
        before = state
    found = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return found.unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct()
