"""Fusion of routes, adjustments, deduplication, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
FUSION_K = 32
TEMPORAL_BONUS, TEMPORAL_LEAST, TEMPORAL_SHARE = 0.055, 0.2, 0.65
SNIPPET = 360


def fused(routes: DataFrame, key: str = "node_id") -> DataFrame:
    """(query_id, key, score, similarity, routes): sums of contributions, the best similarity, the different routes."""
    return routes.groupBy("query_id", key).agg(F.sum("contribution").alias("score"), F.max("similarity").alias("similarity"), F.array_sort(F.collect_set("route")).alias("routes"))


def reciprocal(rank: Column, weight: float) -> Column:
    return F.lit(weight) / (FUSION_K + rank)


def temporal_bonus(rows: DataFrame, group: str, order: list, count_by: str | None = None) -> DataFrame:
    """rows with bonus: the first in order gets the whole, the last one nth of it."""
    w = Window.partitionBy(group)
    return rows.withColumn("time_rank", F.row_number().over(w.orderBy(*order))).withColumn("bonus", F.lit(TEMPORAL_BONUS) * (F.count(F.lit(1)).over(w) - F.col("time_rank") + 1) / F.count(F.lit(1)).over(w))


def first_of_each(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def snippet(text: Column) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > SNIPPET, F.concat(F.left(t, F.lit(SNIPPET - 3)), F.lit("..."))).otherwise(t)


def confidence(exact: Column, coverage: Column, routes: Column, similarity: Column, ordinal: Column) -> Column:
    medium = ((coverage >= 0.30) & (routes >= 2)) | ((coverage >= 0.12) & (similarity >= 0.28) & (routes >= 3)) | ((ordinal >= 0.10) & (routes >= 2))
    return F.when(exact | ((coverage >= 0.65) & (routes >= 2)), "high").when(medium, "medium").otherwise("low")
