"""Archives over time: canonical copies, source probes, retention, context budgets, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
GRACE_MS = 7 * 24 * 3600 * 1000
CHARS_PER_TOKEN = 2.4
PROFILE_CHARS = {"minimal": 4_000, "compact": 10_000, "standard": 24_000, "diagnostic": 60_000}
PROFILE_RANGES = {"minimal": 1, "compact": 2, "standard": 4, "diagnostic": 4}
MINIMAL_BELOW, COMPACT_BELOW = 0.12, 0.30


def canonical(files: DataFrame) -> DataFrame:
    """Of a session's files the largest, then the newest."""
    order = Window.partitionBy("session_id").orderBy(F.desc("size"), F.desc("mtime"), "path")
    return files.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def canonical_path(session_id: Column) -> Column:
    return F.concat(F.lit("by-session/"), F.left(session_id, F.lit(2)), F.lit("/"), session_id, F.lit(".jsonl"))


def by_precedence(*sources: DataFrame) -> DataFrame:
    """The union of sources by session_id; earlier sources win."""
    every = None
    for k, s in enumerate(sources):
        s = s.withColumn("_source", F.lit(k))
        every = s if every is None else every.unionByName(s)
    order = Window.partitionBy("session_id").orderBy("_source")
    return every.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_source")


def probed(lines: DataFrame, min_tokens: int = 4_000, window: int = 0, ratio: float = 0.5) -> DataFrame:
    """(session_id, visible_chars, tokens, compactions, long): long after any compaction, or beyond a token bound."""
    visible = F.sum(F.when(F.col("role").isin("user", "assistant"), F.length("text")).otherwise(0))
    t = lines.groupBy("session_id").agg(visible.cast("long").alias("visible_chars"), F.sum(F.when(F.col("role") == "system", 1).otherwise(0)).alias("compactions"))
    t = t.withColumn("tokens", F.ceil(F.col("visible_chars") / CHARS_PER_TOKEN))
    return t.withColumn("long", (F.col("compactions") > 0) | (F.col("tokens") >= max(min_tokens, -int(-window * ratio // 1))))


def status(files: DataFrame, cached: DataFrame) -> DataFrame:
    """files (session_id, size, mtime, probe) with long: once long always long; an unchanged file is as it was, else as
    the probe says."""
    was = cached.select("session_id", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("long").alias("_long"))
    t = files.join(was, "session_id", "left")
    same = (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime"))
    return t.withColumn("long", F.when(F.coalesce("_long", F.lit(False)), True).when(same, False).otherwise(F.col("probe"))).drop("_size", "_mtime", "_long")


def retention(archives: DataFrame, threads: DataFrame | None, sources: DataFrame, missing: DataFrame, now_ms: int, grace_ms: int = GRACE_MS) -> DataFrame:
    """(session_id, decision, reason, missing_since) for every archive.

    threads: (session_id, archived), or None where thread states can't be read, which is not the same as empty; sources:
    (session_id, long); missing: (session_id, missing_since); archives: (session_id, crossed), whether the archive itself
    holds a compaction. Archived threads and short sources go now; a source that is gone starts a timer; after the grace
    period the archive goes; a source that is back stops it."""
    t = archives.join(sources.select("session_id", F.col("long").alias("_long")), "session_id", "left")
    known = t.sparkSession.createDataFrame([], "session_id string, archived boolean") if threads is None else threads
    t = t.join(known.select("session_id", F.col("archived").alias("_archived")), "session_id", "left").join(missing.select("session_id", F.col("missing_since").alias("_since")), "session_id", "left")
    since = F.coalesce("_since", F.lit(now_ms))
    alive = F.col("_long").isNotNull() | ((~F.col("_archived")) if threads is not None else F.lit(False))
    reason = (
        F.when(F.coalesce("_archived", F.lit(False)), "thread-archived").when(~F.col("_long"), "below-compaction-boundary")
        .when(F.coalesce(alive, F.lit(False)), "source-present").when(~F.col("crossed"), "legacy-short-archive")
        .when(F.lit(now_ms) - since >= grace_ms, "grace-period-over").otherwise("source-missing")
    )
    t = t.withColumn("reason", reason)
    gone = F.col("reason").isin("thread-archived", "below-compaction-boundary", "legacy-short-archive", "grace-period-over")
    decision = F.when(gone, "delete").when(F.col("reason") == "source-present", "keep").otherwise("wait")
    return t.select("session_id", decision.alias("decision"), "reason", F.when(F.col("reason") == "source-missing", since).alias("missing_since"))


def budgets(rows: DataFrame, window: str, used: str) -> DataFrame:
    """rows with remaining, remaining_ratio, profile, max_chars and ranges: how much an answer may say."""
    remaining = F.when(F.col(window) > 0, F.greatest(F.lit(0), F.col(window) - F.col(used)))
    t = rows.withColumn("remaining", remaining).withColumn("remaining_ratio", F.col("remaining") / F.nullif(F.col(window), F.lit(0)))
    r = F.col("remaining_ratio")
    t = t.withColumn("profile", F.when(r <= MINIMAL_BELOW, "minimal").when(r <= COMPACT_BELOW, "compact").otherwise("standard"))
    return sized(t)


def sized(rows: DataFrame, clamped: bool = True) -> DataFrame:
    """rows (profile, remaining) with max_chars and ranges; clamped to a share of what remains, if anything does."""
    pick = lambda of: F.coalesce(*[F.when(F.col("profile") == name, F.lit(value)) for name, value in of.items()])
    chars = pick(PROFILE_CHARS)
    if clamped:
        share = F.greatest(F.lit(1000), F.floor(F.col("remaining") * 0.08 * 3.0)).cast("int")
        chars = F.when(F.col("remaining") > 0, F.least(chars, share)).otherwise(chars)
    return rows.withColumns({"max_chars": chars, "ranges": pick(PROFILE_RANGES)})


def versions(revisions: DataFrame, key: str, order: list) -> DataFrame:
    """revisions with version (from 1) and current: the last revision of each key."""
    w = Window.partitionBy(key)
    return revisions.withColumn("version", F.row_number().over(w.orderBy(*order))).withColumn("current", F.col("version") == F.count(F.lit(1)).over(w))


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The newest row of each key; rows of `new` replace those of `old`."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new.dropDuplicates(key))
