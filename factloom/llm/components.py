"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Large: neighbours above a node hang on its least neighbour; small: neighbours below do, and the node itself."""
    both = links.union(links.select("b", "a")) if large else links.select(F.greatest("a", "b"), F.least("a", "b"))
    both = both.toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
    out = both.join(least, "node")
    if large:
        return out.filter(F.col("other") > F.col("node")).select(F.col("other").alias("a"), F.col("m").alias("b"))
    hung = out.filter(F.col("other") != F.col("m")).select(F.col("other").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).filter("a != b")


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of ``links`` (a, b)."""
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    total = None
    while True:
        step = written(_stars(_stars(now, True).distinct(), False).distinct(), "links")
        # Unchanged when every node hangs on one least node and the links are the same: compared by count and sum of hashes.
        sign = step.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        now = step
        if sign == total:
            break
        total = sign
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (node, component) with more ``links`` (a, b): only the components they join are worked on. Nodes that are new come with them."""
    of = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    ends = links.hint("merge").join(of("a"), "a", "left").hint("merge").join(of("b"), "b", "left")
    ends = ends.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).filter("ca <> cb")
    ends = written(ends, "joining")
    step = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).toDF("old", "new")
    fresh = ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct().hint("merge").join(found, "node", "left_anti")
    known = found.union(fresh.select("node", F.col("node").alias("component")))
    out = known.hint("merge").join(step, known["component"] == step["old"], "left").select("node", F.coalesce("new", "component").alias("component"))
    return written(out, "components")
