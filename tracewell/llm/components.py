"""Connected components of an edge table, by alternating large and small stars (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of the component, for each node of an edge (a, b).

    Every round points the larger neighbours of a node at its least one, then the smaller ones; only minima are formed,
    so a node with very many edges is no single row, and the number of rounds grows with the logarithm of the size."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v")
        now = written(small.distinct(), "edges")


def merged(component: DataFrame, more: DataFrame) -> DataFrame:
    """component (node, component) with more links: only the components that these join are worked on."""
    ends = more.select("a").union(more.select("b")).distinct().withColumnRenamed("a", "node")
    new = ends.join(component, "node", "left_anti").select("node", F.col("node").alias("component"))
    component = component.union(new)
    one, two = (component.select(F.col("node").alias(x), F.col("component").alias(f"{x}_in")) for x in "ab")
    joined = components(more.select("a", "b").join(one, "a").join(two, "b").select(F.col("a_in").alias("a"), F.col("b_in").alias("b")))
    joined = joined.select(F.col("node").alias("component"), F.col("component").alias("_into"))
    return written(component.join(joined, "component", "left").select("node", F.coalesce("_into", "component").alias("component")), "components")
