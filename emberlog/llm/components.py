"""Connected components of a link table by joins only; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberlog.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Label every vertex of `edges` (a, b) with the smallest vertex it reaches.

    Every vertex has a parent, at first its smallest neighbour or itself. In a round, a vertex
    learns the smallest grandparent among its neighbours, takes it as its parent, and hands it
    to the parent it had, so whole trees are hooked on at once; parents also become grandparents. The rounds
    grow with the logarithm of the longest path, in whatever order its vertices are numbered (11 for
    a path of 1,024). Parents only fall and are table rows, never driver state. Joins on a hub vertex are
    sort-merge joins that adaptive execution may split. Self-links and repeated links are
    allowed; an empty table gives an empty result. Returns (v, c).
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = scratch.put(both.where("a <> b").distinct(), "links")
    parents = scratch.put(
        links.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p")), "parents"
    )
    while True:
        grand = scratch.put(
            parents.join(parents.select(F.col("v").alias("p"), F.col("p").alias("g")), "p").select("v", "p", "g"), "grand"
        )
        near = links.join(grand.select(F.col("v").alias("b"), F.col("g").alias("n")), "b")
        step = scratch.put(grand.join(near.groupBy(F.col("a").alias("v")).agg(F.min("n").alias("n")), "v"), "step")
        scratch.drop(parents, grand)
        if not step.where("n < g or g < p").limit(1).count():
            scratch.drop(links)
            return step.select("v", F.col("g").alias("c"))
        told = F.array(F.struct("v", F.least("g", "n").alias("p")), F.struct(F.col("p").alias("v"), F.col("n").alias("p")))
        parents = scratch.put(
            step.select(F.explode(told).alias("t")).select("t.*").groupBy("v").agg(F.min("p").alias("p")), "parents"
        )
        scratch.drop(step)


def merge_components(comps: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The components (v, c) after more edges (a, b): only the components that they touch are labelled anew."""
    if not edges.limit(1).count():
        return comps
    for end in ("a", "b"):
        other = "b" if end == "a" else "a"
        edges = edges.join(comps.select(F.col("v").alias(end), "c"), end, "left").select(F.coalesce("c", end).alias(end), other)
    up = connected_components(edges, scratch).toDF("c", "d")
    risen = comps.join(up, "c", "left").select("v", F.coalesce("d", "c").alias("c"))
    fresh = up.toDF("v", "c").join(comps.select("v"), "v", "left_anti")
    return scratch.put(risen.unionByName(fresh), "merged")
