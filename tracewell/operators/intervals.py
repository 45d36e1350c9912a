"""Joins and merges of line or time ranges. Range conditions always stand beside an equality; a hot group is dealt over
bins of the range, so no pair is lost and none is made twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlapping(left: DataFrame, right: DataFrame, group: str, width: int = 128) -> DataFrame:
    """Rows (of left: group, a_start, a_end, ...; of right: group, b_start, b_end, ...) whose ranges meet. Both sides
    are dealt over bins of `width`; a pair is kept in the first bin that both touch."""
    l = left.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("a_start") / width), F.floor(F.col("a_end") / width))))  # noqa: E741
    r = right.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("b_start") / width), F.floor(F.col("b_end") / width))))
    met = l.join(r, [group, "_bin"]).filter((F.col("a_end") >= F.col("b_start")) & (F.col("a_start") <= F.col("b_end")))
    return met.filter(F.col("_bin") == F.floor(F.greatest("a_start", "b_start") / width)).drop("_bin")


def merged(ranges: DataFrame, group: str, gap: int = 1) -> DataFrame:
    """(group, start, end, ranges): islands of ranges that overlap or lie at most `gap` apart."""
    order = Window.partitionBy(group).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    t = ranges.withColumn("_new", F.when(F.col("start") <= reach + gap, 0).otherwise(1))
    t = t.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return t.groupBy(group, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("ranges")).drop("_island")


def latest_before(rows: DataFrame, marks: DataFrame, group: str, at: str, mark_at: str, mark: str) -> DataFrame:
    """rows with `mark`: the value of the latest mark of the same group that is not later. One sorted pass over both."""
    both = rows.withColumns({"_at": F.col(at), "_kind": F.lit(1)}).unionByName(marks.select(group, F.col(mark_at).alias("_at"), F.col(mark).alias("_mark"), F.lit(0).alias("_kind")), allowMissingColumns=True)
    order = Window.partitionBy(group).orderBy("_at", "_kind", F.col("_mark")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(mark, F.last("_mark", ignorenulls=True).over(order)).filter("_kind = 1").drop("_at", "_kind", "_mark")
