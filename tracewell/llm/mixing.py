"""Mixing sources to target weights (DataFrame functions only).

Every row gets a hash-random key. Within each source the rows are ordered by that key, word counts are summed up from
the front (sums of key slices first, so that no source is gathered in one task), and each source is cut at its exact
budget. A budget above the source's size repeats it: whole epochs first, then the cut of the next epoch.

Defined results: a null text or id counts as empty; a null source is a source of its own, last in order; sources
without words get nothing; rows with the same id keep their own place, ordered by size; empty tables give empty
tables; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, carrying, hash_key, restored, running_before, slice_digits

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix's size as a share of all words.
SHARE = 1.5
#: A source is read this many times at most.
MOST_EPOCHS = 2
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def budgets(sizes: DataFrame, source: str, size: str, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """One row a source: size, target and the epochs and words that follow from it.

    Targets by weight stop at `most` times the size; the excess goes to the others by weight. That fill has one level:
    sources sorted by cap over weight are full as long as the level over those that are left stays above theirs. The
    input has one row for each source, so its single window is small."""
    order = Window.orderBy(F.col(source).asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy()
    t = sizes.withColumn("_w", weight).withColumn("_cap", F.lit(float(most)) * F.col(size))
    t = t.withColumn("_r", F.col("_cap") / F.col("_w"))
    before = Window.orderBy("_r", F.col(source).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum(size).over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    t = t.withColumn("_level", left / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    t = t.withColumn("_full", F.col("_r") <= F.col("_level"))
    t = t.withColumn("_top", F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything))
    t = t.withColumn("_target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * F.col("_top")))
    budget = F.floor(F.col("_target") + 0.5).cast("long")
    epochs = F.when(F.col(size) > 0, F.floor(budget / F.col(size))).otherwise(0).cast("long")
    return t.select(F.col(source).alias("_source"), F.col(size).alias("_source_size"), "_target", epochs.alias("_epochs"), (budget - epochs * F.col(size)).alias("_rest"))


def mix(rows: DataFrame, n_rows: int, id_col: str = "doc_id", source: str = "source", size: str = "size", seed: str = SEED, **fill) -> DataFrame:
    """rows with source_size, target and taken: the words of each row that the mix takes, repeats counted."""
    slim = carrying(rows, source=F.col(source), size=F.col(size).cast("long"), key=hash_key(F.col(id_col), seed))
    table = budgets(slim.groupBy("source").agg(F.sum("size").cast("long").alias("_n")), "source", "_n", **fill)
    placed = running_before(slim, ["source"], "key", ["size"], F.col("size"), "before", slice_digits(n_rows))
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("before")))
    both = placed.join(table, F.col("source").eqNullSafe(F.col("_source")), "left")
    both = both.select("_row", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_epochs") * F.col("size") + cut).cast("long").alias("taken"))
    return restored(both, rows.columns, "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """The mix itself: every document once for each time it is taken whole, and the one at a source's cut once more
    with its first words only (up to the end of the last word that is taken); n_chars, where there is such a column, follows. Columns stay."""
    # The row travels whole in one column, so that no name of its columns can clash.
    sized = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"))
    got = mix(sized, docs.count(), **how)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    got = got.withColumns({"_whole": whole, "_part": part})
    # The copies of a row: 0 for each whole one, else the words of the cut one.
    copies = F.concat(F.array_repeat(F.lit(0), F.col("_whole")), F.when(F.col("_part") > 0, F.array(F.col("_part"))).otherwise(F.array().cast("array<int>")))
    got = got.withColumn("_copy", F.explode(copies))
    old = F.col("_row")[text]
    head = F.array_join(F.slice(F.regexp_extract_all(old, F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), F.lit(1)), 1, F.greatest(F.col("_copy"), F.lit(1))), "")
    got = got.withColumn("_text", F.when(F.col("_copy") > 0, head).otherwise(old))
    row = F.col("_row").withField(text, F.col("_text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("_copy") > 0, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row")["n_chars"]))
    return got.select(row.alias("_row")).select("_row.*")
