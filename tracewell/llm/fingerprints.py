"""Document fingerprints from prefix polynomial hashes.

A text is its code points. Its prefix array holds, modulo 2^31 - 1 and for two bases, the sums of code times power of
the base up to each place; the difference of two entries, divided by the power at its start, is the hash of that span
wherever it stands. So any two spans are compared in constant time, and the longest common extension of two places is
found by binary search.

A fingerprint is text: length, hash of the whole, and a sketch of all spans of SPAN code points: the smallest span hash
of each of 64 classes. The likeness of two fingerprints is the share of classes that agree, an estimate of the share of
spans that the texts have in common.

Defined results: a null text is empty; a very long text is hashed in blocks and has whole prefix arrays; a text shorter than SPAN is one span; equal texts have equal fingerprints and a
likeness of 1; rows with the same id are neighbours, in order of text; null ids come first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.shipping import map_arrow

P = (1 << 31) - 1
MASK, SHIFT_31 = np.uint64(P), np.uint64(31)
BASES = (1_103_515_245, 1_664_525_013)
SPAN = 12
CLASSES = 64
SHIFT = np.uint64(58)  # the top bits of a hash name one of 64 classes
EDGES = np.arange(CLASSES, dtype=np.uint64) << SHIFT
REST = np.uint64((1 << 58) - 1)
NONE = np.uint64((1 << 64) - 1)
#: Texts are worked on in blocks, so that memory is bounded whatever their length.
BLOCK = 1 << 20
#: Bytes of text that a partition should hold.
PART_BYTES = 32 << 20


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, for x below 2^62; x is used up."""
    high = x >> SHIFT_31
    x &= MASK
    x += high
    np.right_shift(x, SHIFT_31, out=high)
    x &= MASK
    x += high
    np.subtract(x, MASK, out=high)  # wraps around where x is below P
    return np.minimum(x, high, out=x)


@cache
def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1), by doubling."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = reduced(out[:more] * np.uint64(pow(base, have, P)))
        have += more
    return out


@cache
def inverse_powers(base: int, n: int) -> np.ndarray:
    return powers(pow(base, -1, P), n)


def codes(text: str) -> np.ndarray:
    """The code points, plus one so that no code vanishes."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)


def _room(n: int) -> int:
    """A table size that suits n, of few different ones."""
    return 1 << max(12, (n - 1).bit_length())


class Prefix:
    """The prefix arrays of one text: hashes of spans, equality and longest common extensions."""

    def __init__(self, text: str):
        self.code, self.sums = codes(text), []
        for base in BASES:
            sums = np.zeros(len(self.code) + 1, np.uint64)
            np.cumsum(reduced(self.code * powers(base, _room(len(self.code) + 1))[: len(self.code)]), out=sums[1:])
            self.sums.append(reduced(sums))

    def span(self, start: int, end: int) -> int:
        """The hash of text[start:end], the same wherever that string stands."""
        out = 0
        for base, sums in zip(BASES, self.sums, strict=True):
            out = out << 31 | (int(sums[end]) - int(sums[start])) * pow(base, -start, P) % P
        return out

    def extension(self, at: int, other: Prefix, there: int) -> int:
        """How many code points agree from text[at] and other[there] on, by binary search."""
        low, high = 0, min(len(self.code) - at, len(other.code) - there)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(at, at + mid) == other.span(there, there + mid):
                low = mid
            else:
                high = mid - 1
        return low


def fingerprint(text: str) -> tuple[str, np.ndarray]:
    """The fingerprint as text, and the cells of its sketch (-1: no span of that class)."""
    code = codes(text)
    n, whole, least = len(code), [0] * len(BASES), np.full(CLASSES, NONE, np.uint64)
    for at in range(0, max(n, 1), BLOCK):
        block = code[at : at + BLOCK + SPAN - 1]
        size, spans = min(BLOCK, n - at), max(min(len(block) - SPAN + 1, BLOCK), 1 if n < SPAN else 0)
        wide, hashes = min(SPAN, n), np.zeros(spans, np.uint64)
        for k, base in enumerate(BASES):
            sums = np.zeros(len(block) + 1, np.uint64)
            np.cumsum(reduced(block * powers(base, _room(len(block) + 1))[: len(block)]), out=sums[1:])
            sums = reduced(sums)
            whole[k] = (whole[k] + int(sums[size]) * pow(base, at, P)) % P
            if n and spans:
                hashes = hashes << np.uint64(31) | reduced((sums[wide : wide + spans] + np.uint64(P) - sums[:spans]) * inverse_powers(base, _room(len(block) + 1))[:spans])
        if n and spans:
            # One mixing step makes minima fair; then the top bits name the class, and sorting finds each class's least.
            hashes = (hashes * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes >> np.uint64(29))
            hashes *= np.uint64(0xBF58476D1CE4E5B9)
            hashes.sort()
            first = np.searchsorted(hashes, EDGES)
            found = hashes[np.minimum(first, spans - 1)]
            least = np.minimum(least, np.where((first < spans) & (found >> SHIFT == EDGES >> SHIFT), found & REST, NONE))
    cells = np.where(least == NONE, -1, (least >> np.uint64(42)).astype(np.int64))
    text_of = np.maximum(cells, 0).astype(">u2").tobytes().hex()
    if (gone := np.flatnonzero(cells < 0)).size:
        marks = bytearray(text_of, "ascii")
        for k in gone.tolist():
            marks[4 * k : 4 * k + 4] = b"...."
        text_of = marks.decode()
    return f"{n:x}-{whole[0]:08x}{whole[1]:08x}-{text_of}", cells


def likeness(a: tuple[str, np.ndarray], b: tuple[str, np.ndarray]) -> float:
    """The share of classes that agree, of those that either has; 1 for equal fingerprints."""
    if a[0] == b[0]:
        return 1.0
    some = (a[1] >= 0) | (b[1] >= 0)
    return float((some & (a[1] == b[1])).sum() / max(1, some.sum()))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points gives way to the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_edited", pa.int64()), ("common_next", pa.int64())])


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (part, guest, doc_id, text), dealt by ranges of the id and sorted in each part; behind the rows of a part
    come its guests, copies of the next part's first row (the last part's: the first row of all). Texts move once."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n_bytes, some = slim.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(n_bytes or 0) // PART_BYTES))
    parts = max(1, min(parts, some))
    # Bounds and first ids: a number for each part, no more.
    at = slim.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts) if parts > 1 else F.array()).first()[0]
    bounds = np.unique(np.array(at or [], np.int64))

    def part_of(ids: pa.Array) -> np.ndarray:
        return np.where(np.asarray(ids.is_valid()), np.searchsorted(bounds, np.asarray(ids.fill_null(0)), "right"), 0)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, part = batch.column(0), part_of(batch.column(0))
            found = [(int(p), None if (own := ids.filter(pa.array(part == p))).null_count else min(own.to_pylist())) for p in np.unique(part)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int64())], names=["part", "first"])

    rows = map_arrow(slim.select("doc_id"), least, "part int, first long").groupBy("part").agg(F.min("first").alias("first"), F.bool_or(F.col("first").isNull()).alias("empty")).collect()
    firsts = {r["part"]: None if r["empty"] else r["first"] for r in rows}
    order = sorted(firsts)
    host = {p: order[i - 1] for i, p in enumerate(order)}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            part = part_of(ids)
            first = pa.array([firsts[int(p)] for p in part], pa.int64())
            lead = np.array([a == b for a, b in zip(ids.to_pylist(), first.to_pylist(), strict=True)], bool)
            own = pa.array(np.flatnonzero(lead))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.zeros(len(part), bool)), *batch.columns], names=["part", "guest", "doc_id", "text"])
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array([host[int(p)] for p in part[lead]], pa.int32()), pa.array(np.ones(len(own), bool)), *(c.take(own) for c in batch.columns)], names=["part", "guest", "doc_id", "text"])

    rows = map_arrow(slim, dealt, "part int, guest boolean, doc_id long, text string")
    return rows.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("guest", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())


def compared(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited forms, with likenesses to the edited form and the next text, and how
    many code points they have in common with these from the front (the longest common extension of both fronts)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, met_guest = None, False
        for batch in batches:
            out = []
            for guest, doc, words in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if met_guest:
                    continue
                met_guest = guest
                words = words or ""
                now = (doc, words, *(held[2:] if held and held[1] == words else (fingerprint(words), Prefix(words))))
                if held is not None:
                    out.append(row(held, now))
                held = now
            yield pa.RecordBatch.from_pylist(out, schema=OUT)

    def row(one: tuple, after: tuple) -> dict:
        doc, words, own, prefix = one
        other = edited(words, after[1])
        mark = fingerprint(other)
        return {"doc_id": doc, "n_chars": len(words), "edited_sha256": hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": own[0], "edited_fingerprint": mark[0], "near_edited": likeness(own, mark), "near_next": likeness(own, after[2]), "common_edited": prefix.extension(0, Prefix(other), 0), "common_next": prefix.extension(0, after[3], 0)}

    return map_arrow(with_next(docs, id_col, text), rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long")
