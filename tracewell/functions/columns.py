"""Column expressions on the JVM where there are any; Arrow functions for what has none."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from . import text

# Types as objects: the module is imported by workers, which have no session to parse names with.
STRINGS = ArrayType(StringType())

#: Words of three letters or more: the terms that SQL can express as well.
ASCII_TERM = r"[a-z][a-z0-9_]{2,63}"
#: Identifiers that need no look-around.
ANCHOR = r"\b(?:0x[0-9a-f]{4,64}|[0-9a-f]{7,64}|v?[0-9]+(?:\.[0-9]+){1,4}|(?:step|epoch|task|run|job)[_:#-]?[0-9]{3,})\b"


def plain(c: Column) -> Column:
    """Blanks collapsed, lower case: the normal form of texts whose characters have one form."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def ascii_terms(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(ASCII_TERM), F.lit(0)))


def ascii_anchors(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(ANCHOR), F.lit(0)))


def dot(a: str | Column, b: str | Column) -> Column:
    """The scalar product in double precision, in order of the dimensions."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def pool_signature(vector: str | Column, bits: int = 64) -> Column:
    """A bit for each dimension of a vector of `bits` dimensions with the fixed signs; set where not negative."""
    sign = text.signs(bits)
    out = F.lit(0).cast("long")
    for d in range(bits):
        value = F.element_at(vector, d + 1).cast("double") * float(sign[d])
        out = out.bitwiseOR(F.when(value >= 0, F.shiftleft(F.lit(1).cast("long"), d)).otherwise(F.lit(0).cast("long")))
    return out


def band_keys(signature: Column) -> Column:
    """The eight band keys of a signature; an unsigned shift, as signatures may be negative."""
    return F.array(*[F.concat(F.lit(f"{b}:"), F.lpad(F.lower(F.hex(F.shiftrightunsigned(signature, 8 * b).bitwiseAND(F.lit(255)))), 2, "0")) for b in range(8)])


def coverage(available: Column, wanted: Column) -> Column:
    """The share of wanted terms that are available; 0 for no terms."""
    n = F.size(wanted)
    return F.when(n > 0, F.size(F.array_intersect(available, F.array_distinct(wanted))) / n).otherwise(F.lit(0.0))


@pandas_udf(StringType())
def normalize(s: pd.Series) -> pd.Series:
    return s.map(text.normalize)


@pandas_udf(STRINGS)
def terms(s: pd.Series) -> pd.Series:
    return s.map(text.routing_terms)


@pandas_udf(StructType([StructField(n, STRINGS) for n in ("every", "decisive", "stable")]))
def anchors(s: pd.Series) -> pd.DataFrame:
    found = [text.anchors(x or "") for x in s]
    return pd.DataFrame({"every": [f[0] for f in found], "decisive": [f[1] for f in found], "stable": [[a for a in f[1] if text.indexable(a)][:128] for f in found]})


@pandas_udf(ArrayType(FloatType()))
def embed(s: pd.Series) -> pd.Series:
    return pd.Series(list(text.embedded([x or "" for x in s]).astype("float32")), s.index, dtype=object)


@pandas_udf(StringType())
def opaque_masked(s: pd.Series) -> pd.Series:
    return s.map(text.opaque_masked)


@pandas_udf(STRINGS)
def stable_anchors(s: pd.Series) -> pd.Series:
    """Of the found values those that are stable identifiers, in normal form."""
    return s.map(lambda found: [a for a in dict.fromkeys(text.normalize(x) for x in found) if text.indexable(a)])
