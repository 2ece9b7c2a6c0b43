"""Connected components of links, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from embedlens.llm.shared import Scratch


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(links: DataFrame, scratch: Scratch, max_rounds: int = 100) -> DataFrame:
    """(node, component) of all nodes in ``links(a, b)``; component is the smallest node reachable.

    A hub's neighbours are never gathered: minima are aggregated before the shuffle and joined back, where a skewed key can be
    split. Links to oneself keep a node as its own component; null ends are left out; no links give no rows. The result is a written
    table.
    """
    edges = scratch.stash(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u is not null and v is not null").distinct(), "edges")
    nodes = edges.select("u").union(edges.select("v")).distinct()
    edges_now, before = edges, None
    for _ in range(max_rounds):
        both = edges_now.where("u <> v").union(edges_now.where("u <> v").select(F.col("v"), F.col("u"))).toDF("u", "v")
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: towards smaller neighbours only
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        least = _least(down)
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        seen = Observation()
        after = scratch.stash(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "star")
        state = (seen.get["n"], seen.get["h"])
        if edges_now is not edges:
            scratch.drop(edges_now)
        edges_now = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("connected_components: no fixed point")
    found = nodes.join(edges_now.groupBy("u").agg(F.min("v").alias("v")), "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))
    found = scratch.stash(found, "components")
    scratch.drop(edges, *([edges_now] if edges_now is not edges else []))
    return found
