"""Retrieval evaluation: ranks of expected targets, recall, reciprocal ranks, false positives, latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_relevant(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """(case_id, rank): the best rank of a hit (case_id, rank, session_id, line_start, line_end, text) that meets any of a
    case's targets (case_id, session_id, line_start, line_end, phrase; null: anything, but not all null)."""
    t = hits.alias("h").join(targets.alias("t"), "case_id")
    any_of = F.col("t.session_id").isNotNull() | F.col("t.line_start").isNotNull() | F.col("t.phrase").isNotNull()
    session = F.col("t.session_id").isNull() | (F.col("t.session_id") == F.col("h.session_id"))
    lines = F.col("t.line_start").isNull() | ((F.col("h.line_end") >= F.col("t.line_start")) & (F.col("h.line_start") <= F.coalesce("t.line_end", "t.line_start")))
    phrase = F.col("t.phrase").isNull() | F.contains("h.text", "t.phrase")
    return t.filter(any_of & session & lines & phrase).groupBy("case_id").agg(F.min("h.rank").alias("rank"))


def report(cases: DataFrame) -> DataFrame:
    """One row of metrics over (answerable, rank, max_rank, safe, duplicate_free, latency_ms)."""
    yes, no = F.col("answerable"), ~F.col("answerable")
    share = lambda of, c: F.coalesce(F.avg(F.when(of, F.when(c, 1.0).otherwise(0.0))), F.lit(0.0))
    passed = F.when(yes, F.coalesce(F.col("rank") <= F.col("max_rank"), F.lit(False)) & F.col("safe")).otherwise(~F.col("safe"))
    return cases.agg(
        F.count(F.lit(1)).alias("cases"), F.count(F.when(yes, 1)).alias("positive_cases"), F.count(F.when(no, 1)).alias("negative_cases"),
        *[share(yes, F.coalesce(F.col("rank") <= k, F.lit(False))).alias(f"recall_at_{k}") for k in (1, 3, 5)],
        F.coalesce(F.avg(F.when(yes, F.coalesce(1 / F.col("rank"), F.lit(0.0)))), F.lit(0.0)).alias("mrr"), share(F.lit(True), F.col("duplicate_free")).alias("duplicate_free_rate"),
        share(yes, F.col("safe")).alias("positive_answerability_rate"), share(no, F.col("safe")).alias("negative_false_positive_rate"), share(F.lit(True), passed).alias("release_gate_pass_rate"),
        F.percentile("latency_ms", 0.5).alias("latency_p50_ms"), F.percentile("latency_ms", 0.95).alias("latency_p95_ms"),
    )
