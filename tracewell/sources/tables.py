"""Tables between steps: written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: (path, name in the catalogue) of the tables that are written for one result (`settled_alone`).
_steps: ContextVar[list[tuple[str, str | None]] | None] = ContextVar("steps", default=None)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where none is set, a temporary folder in local mode, as in tests; on a cluster that is an
    error, as executors could not see it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def settled(df: DataFrame, what: str) -> DataFrame:
    """df as a written table, read again: cuts the lineage, so later steps survive whatever happens to executors."""
    path = noted(f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def noted(path: str, name: str | None = None) -> str:
    """The path, which is about to be written; the result that the table is for, if any, will remove it."""
    if (steps := _steps.get()) is not None:
        steps.append((path, name))
    return path


def settled_alone(spark: SparkSession, make: Callable[[], DataFrame], what: str) -> DataFrame:
    """make() as a written table; the tables that were written for it go once it is there."""
    token = _steps.set([])
    try:
        df = make()
        steps = _steps.get()
    finally:
        _steps.reset(token)
    out = settled(df, what)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path, name in steps:
        if name is not None:
            spark.sql(f"drop table if exists {name}")
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return out
