"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .scratch import checkpoint_root


def _marked(pairs: DataFrame) -> tuple[DataFrame, tuple]:
    """Distinct pairs, checkpointed, with their number and the sum of their hashes, which tell whether a
    round has changed anything."""
    seen = Observation()
    out = pairs.distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).checkpoint()
    return out, (seen.get["n"], seen.get["h"])


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)``: the smallest node reachable, for every node that has
    an edge to another node. Nulls, loops, repeats and either direction are allowed. No node's
    neighbours are ever gathered in one row: both rounds are a minimum and a join with one row per
    node, so the edges of a hub can be split by adaptive skew joins; both halves of a round are checkpointed.
    """
    checkpoint_root(edges.sparkSession)
    pairs, mark = _marked(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    before = (0, None)
    while mark not in (before, (0, None)):
        before = mark
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # checkpointed, as the small star reads it three times: in one plan, the driver would hold all of that at once
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("u > m")).checkpoint()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs, mark = _marked(small.union(least))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def extended(known: DataFrame | None, edges: DataFrame) -> DataFrame:
    """``(node, component)`` of known components and new edges between nodes. Edges are contracted to
    the known components first, so that only what still moves is iterated over."""
    if known is None:
        return components(edges.select("a", "b"))
    label = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    between = edges.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")).where("a <> b")
    moved = components(between).select(F.col("node").alias("label"), F.col("component").alias("root"))
    kept = known.join(moved, F.col("component") == F.col("label"), "left").select("node", F.coalesce("root", "component").alias("component"))
    fresh = moved.join(known.select("node"), F.col("label") == F.col("node"), "left_anti").select(F.col("label").alias("node"), F.col("root").alias("component"))
    return kept.unionByName(fresh)
