"""Anchors and the sparse graph: postings, relational division, edges and one-hop expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the relations, and the sizes of anchor groups that make edges.
SAME_EXCHANGE, TEMPORAL, SHARED = 1.0, 0.62, 0.92
FEWEST, MOST = 2, 24
EXPANSION, FUSION_K = 0.38, 32


def anchor_postings(rows: DataFrame, key: str, anchors: Column) -> DataFrame:
    return rows.select(key, F.explode(anchors).alias("anchor")).distinct()


def division(postings: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(query_id, key): the rows that have all anchors of a query's (query_id, anchor).

    Candidates come from a query's rarest anchor only, so a common one costs nothing beside a rare one; the others are
    checked in the row's own list."""
    asked = wanted.distinct()
    size = postings.join(asked.select("anchor").distinct(), "anchor", "left_semi").groupBy("anchor").agg(F.count(F.lit(1)).alias("df"))
    first = asked.join(size, "anchor", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "anchor")).alias("rarest"), F.collect_set("anchor").alias("own"))
    first = first.filter("rarest.df > 0").select("query_id", F.col("rarest.anchor").alias("anchor"), "own")
    candidates = postings.join(first, "anchor").select("query_id", key, "own").distinct()
    held = postings.groupBy(key).agg(F.collect_set("anchor").alias("held"))
    return candidates.join(held, key).filter(F.size(F.array_except("own", "held")) == 0).select("query_id", key)


def both_ways(pairs: DataFrame, relation: str, weight: float) -> DataFrame:
    """(source, target, relation, weight) in both directions from (source, target)."""
    both = pairs.select("source", "target").unionByName(pairs.select(F.col("target").alias("source"), F.col("source").alias("target")))
    return both.distinct().withColumns({"relation": F.lit(relation), "weight": F.lit(weight)})


def shared_anchor_edges(postings: DataFrame, key: str) -> DataFrame:
    """A star around the least row of each anchor group of FEWEST to MOST rows."""
    group = postings.groupBy("anchor").agg(F.min(key).alias("source"), F.count(F.lit(1)).alias("n")).filter(F.col("n").between(FEWEST, MOST))
    return both_ways(postings.join(group, "anchor").filter(F.col(key) != F.col("source")).select("source", F.col(key).alias("target")), "shared-anchor", SHARED)


def following_edges(rows: DataFrame, group: list[str], order: list[str], key: str, relation: str, weight: float) -> DataFrame:
    """Edges between consecutive rows of a group."""
    t = rows.select(F.col(key).alias("source"), F.lead(key).over(Window.partitionBy(*group).orderBy(*order)).alias("target"))
    return both_ways(t.filter("target is not null"), relation, weight)


def expanded(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, target, relation, contribution): one hop from (query_id, node, rank)."""
    t = seeds.join(edges, F.col("node") == F.col("source"))
    return t.select("query_id", "target", "relation", (F.lit(EXPANSION) * F.col("weight") / (FUSION_K + F.col("rank"))).alias("contribution"))
