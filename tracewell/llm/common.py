"""What the training-data operators share: written tables, hash keys, ranks without a single task."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.sources.tables import noted, settled_alone
from tracewell.sources.tables import settled as written
from tracewell.sources.tables import shared_folder as shared_dir

__all__ = ["WORD", "bucketed", "carrying", "hash_key", "restored", "running_before", "settled_alone", "shared_dir", "slice_digits", "written"]

#: A word of the contracts: a run without ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one slice of a hash-ordered group should hold at most.
SLICE_ROWS = 20_000
#: Hex digits of a slice's name at least, so that a hot group is always spread.
SLICE_DIGITS = 2


def bucketed(df: DataFrame, by: str) -> DataFrame:
    """df, which is hash-dealt by a column, as a table in the shared folder that is read that way again."""
    spark = df.sparkSession
    name = f"tracewell_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = noted(f"{shared_dir(spark)}/{name}", name)
    df.write.bucketBy(n, by).sortBy(by).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def hash_key(id_col: Column, seed: str) -> Column:
    """A uniform, repeatable sort key: md5 of the seed and the id (null: empty), as hex."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))


def slice_digits(rows: int) -> int:
    """Hex digits of the hash key that name a slice, so that a slice of any group has about SLICE_ROWS rows at most."""
    return max(SLICE_DIGITS, math.ceil(math.log(max(rows, 1) / SLICE_ROWS, 16)) if rows > SLICE_ROWS else 0)


def running_before(df: DataFrame, group: list[str], key: str, ties: list[str], value: Column, out: str, digits: int) -> DataFrame:
    """Adds out: the sum of value over the rows of the same group that come earlier by key (then ties).

    A group is never gathered in one task: the key is a hex hash, its first digits name a slice, sums of slices are
    added up over the small table of slices, and only the rows of one slice are sorted together. Null is a group."""
    cut = F.substring(key, 1, digits)
    rows = df.withColumn("_slice", cut).withColumn("_value", value)
    sums = rows.groupBy(*group, "_slice").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_slice").alias("_s"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).cast("long").alias("_base"))
    same = F.col("_slice") == F.col("_s")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    within = Window.partitionBy(*group, "_slice").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_value").over(within), F.lit(0)).cast("long"))
    return rows.join(sums, same, "left").withColumn(out, F.col("_base") + F.col("_in")).drop("_slice", "_value", "_in", "_s", "_base", *[f"_g{i}" for i in range(len(group))])


def carrying(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows of df whole, in one column _row, with other columns beside: no name in df can clash with theirs."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[v.alias(k) for k, v in columns.items()])


def restored(df: DataFrame, names: list[str], *new: str) -> DataFrame:
    """What carrying() took, with the columns `new` of df behind; these replace columns of the same name."""
    taken = {n.lower() for n in new}
    return df.select(*[F.col("_row").getField(n).alias(n) for n in names if n.lower() not in taken], *new)
