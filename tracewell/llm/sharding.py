"""Sharding by proportional stratified interleaving (DataFrame functions only).

Rows are shuffled by a seeded hash within each source and ranked there; a row's fractional rank (rank - 1 + phase) / n,
with a hash of the source between 0 and 1 as phase, is its place between 0 and 1. Sorting all rows by that place interleaves the sources in proportion at every point, so that
equal cuts of the order give shards that each match the mixture, with row counts at most one apart.

Ranks come from sums over slices of the key, and over buckets of the place: no source and no table is gathered in one
task. Defined results: a null source is a source, last in order; a null id is the empty id; repeated ids are ordered by
checksum and size, and rows equal in those too are interchangeable; empty tables give empty tables;
very long texts weigh as one row; other columns stay, and any of the names shard or slot gives way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_ROWS, carrying, hash_key, restored, running_before, slice_digits

SHARDS = 40
SEED = "shard-1"
PHASE_BITS = 24


def interleaved(rows: DataFrame, n_rows: int, shards: int = SHARDS, id_col: str = "doc_id", source: str = "source", ties: tuple[str, ...] = ("text_crc32", "size"), seed: str = SEED) -> DataFrame:
    """rows with shard (0 to shards - 1) and slot (gapless from 0 in each shard)."""
    marks = [f"tie{i}" for i in range(len(ties))]
    keyed = carrying(rows, source=F.col(source), key=hash_key(F.col(id_col), seed), **{m: F.col(t) for m, t in zip(marks, ties, strict=True)})
    counts = keyed.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("source", "of")
    ranked = running_before(keyed, ["source"], "key", marks, F.lit(1), "rank", slice_digits(n_rows))
    ranked = ranked.join(counts, F.col("source").eqNullSafe(F.col("of")), "left")
    # Each source starts at a place of its own in the first of its n parts, else many small sources fall on one place.
    phase = (F.xxhash64(F.lit(seed), "source").bitwiseAND(F.lit((1 << PHASE_BITS) - 1)) + 0.5) / float(1 << PHASE_BITS)
    ranked = ranked.withColumn("at", (F.col("rank") + phase) / F.col("n"))
    buckets = max(256, -(-n_rows // SLICE_ROWS))
    ranked = ranked.withColumn("bucket", F.least(F.floor(F.col("at") * buckets), F.lit(buckets - 1)).cast("long"))
    # One row for SLICE_ROWS rows of the input, added up in a single task.
    held = ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))
    held = held.select(F.col("bucket").alias("b"), F.coalesce(F.sum("c").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("bucket").orderBy("at", F.col("source").asc_nulls_last(), "key", *marks)
    ranked = ranked.withColumn("inside", F.row_number().over(inside) - 1).join(held, F.col("bucket") == F.col("b"))
    n = max(n_rows, 1)
    # Shard s starts at place ceil(s * n / shards).
    ranked = ranked.withColumn("place", (F.col("base") + F.col("inside")).cast("long")).withColumn("shard", F.expr(f"cast((place * {shards}L) div {n}L as int)"))
    ranked = ranked.withColumn("slot", F.expr(f"place - (cast(shard as bigint) * {n}L + {shards - 1}L) div {shards}L"))
    return restored(ranked, rows.columns, "shard", "slot")
