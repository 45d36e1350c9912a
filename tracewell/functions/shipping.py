"""Python functions on executors: the package travels with the application, as with --py-files."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
#: Bytes of a batch that become Python objects at a time; features of texts take hundreds of times as many.
PORTION = 1 << 15


def ship(spark: SparkSession) -> None:
    """Makes this package importable by Python workers; once for each application."""
    context = spark.sparkContext
    if getattr(context, "_tracewell_shipped", False):
        return
    where = Path(tempfile.mkdtemp(prefix="tracewell-code-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(PACKAGE.rglob("*.py")):
            out.write(file, file.relative_to(PACKAGE.parent))
    context.addPyFile(str(where))
    context._tracewell_shipped = True


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """df.mapInArrow with the package shipped."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def portions(batches: Iterator[pa.RecordBatch], most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The batches in slices of `most` bytes or so, by the mean size of a batch's rows, of one row at least."""
    for batch in batches:
        size = max(1, len(batch) * most // max(1, batch.nbytes))
        for at in range(0, len(batch), size):
            yield batch.slice(at, size)
