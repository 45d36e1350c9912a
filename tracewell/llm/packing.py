"""Vector best-fit packing of token pieces into sequences.

Every document becomes its token ids and an end id; only longer ones are cut. A piece is a vector (tokens, documents,
attention cost = tokens squared). Sequences have a capacity in each dimension. The open sequence takes, of all pieces
that fit in every dimension, the one with the largest weighted dot product with what is left ("dot"), or the one that
leaves the smallest weighted residual norm ("norm").

Pieces of one length are alike, so the choice runs over the histogram of lengths, which the capacity bounds: one
choice makes a pattern, used as often as the counts allow. The driver sees the histogram only (a row a length); the
pieces learn their places from their rank within their length. The number of patterns follows the number of lengths.

Defined results: a null text is empty and holds the end id only; a very long text is one row a piece, its ids are held
as a whole; rows with the same id are packed on their own; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.shipping import map_arrow

from .common import hash_key, running_before, slice_digits, written

SEQUENCE = 2048
#: At most so many pieces in a sequence, and so much attention cost; both only bind when set lower.
MOST_PIECES, MOST_COST = SEQUENCE, SEQUENCE**2
WEIGHTS = (1.0, 0.25, 0.5)
END_ID = 0
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


@cache
def encoder(vocabulary: str | None = None) -> Callable[[str], list[int]]:
    """The ids of a text by a tokenizers file (default: the public one), without added special tokens, once a worker.

    Strings of special tokens in a text are those tokens, as that library has it. Texts without any go through the same
    vocabulary as ranks, where the file is the public one; that gives the same ids in a fourth of the time."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = vocabulary or public_tokenizers.path(VOCABULARY)
    whole = Tokenizer.from_file(path)
    marks = [token.content for token in whole.get_added_tokens_decoder().values()]
    exact = lambda text: whole.encode(text, add_special_tokens=False).ids
    if vocabulary:
        return exact
    with open(public_tokenizers.path(RANKS), "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    plain = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: exact(text) if any(mark in text for mark in marks) else plain(text)


def cuts(n: int, sequence: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first one takes what the whole sequences behind it leave."""
    first = n % sequence or sequence
    return [(0, min(first, n)), *((at, sequence) for at in range(first, n, sequence))]


def tokenised(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece: its place in its document and the checksum of its ids."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            known: dict[str, list[tuple[int, int, int, int]]] = {}
            for doc, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words or ""
                if (found := known.get(words)) is None:
                    ids = np.array([*encode(words), end_id], "<u4")
                    found = known[words] = [(k, at, n, zlib.crc32(ids[at : at + n])) for k, (at, n) in enumerate(cuts(len(ids), sequence))]
                rows += [(doc, *x) for x in found]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PACKED.types[:5], strict=True)], names=PACKED.names[:5])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")), pieces, PIECES)


def plan(counts: dict[int, int], capacity: tuple[int, int, int] = (SEQUENCE, MOST_PIECES, MOST_COST), weights: tuple[float, float, float] = WEIGHTS, by: str = "dot") -> list[tuple[int, int, int, int, int, int]]:
    """Places for counts[length] pieces of each length: rows (length, first rank, behind the last rank, uses in each
    sequence, first sequence, offset in the sequence), in order of length and rank."""
    lengths = np.array(sorted(counts), np.int64)
    left = np.array([counts[n] for n in lengths.tolist()], np.int64)
    if not len(lengths):
        return []
    size = np.stack([lengths, np.ones_like(lengths), lengths**2], 1)
    limit = np.array(capacity, np.int64)
    if (size > limit).any():
        raise ValueError("a piece exceeds a sequence")
    share, weight = size / limit, np.array(weights)
    used, rows, sequence = np.zeros_like(left), [], 0
    while left.any():
        room, taken, offset = limit.copy(), [], 0
        avail = left.copy()
        while True:
            fits = np.flatnonzero((avail > 0) & (size <= room).all(1))
            if not len(fits):
                break
            rest = room / limit
            score = share[fits] @ (weight * rest) if by == "dot" else -(((rest - share[fits]) ** 2) @ weight)
            k = fits[len(fits) - 1 - int(np.argmax(score[::-1]))]
            # The same class again and again, as long as it stays the best: it does while a larger one can't fit.
            uses = int(min(avail[k], (room // size[k]).min())) if by == "dot" and k == fits[-1] else 1
            taken.append((k, uses, offset))
            avail[k] -= uses
            room -= size[k] * uses
            offset += int(lengths[k]) * uses
        uses_of: dict[int, int] = {}
        for k, uses, _ in taken:
            uses_of[k] = uses_of.get(k, 0) + uses
        times = min(int(left[k]) // uses for k, uses in uses_of.items())
        for k, uses, at in taken:
            rows.append((int(lengths[k]), int(used[k]), int(used[k]) + times * uses, uses, sequence, at))
            used[k] += times * uses
            left[k] -= times * uses
        sequence += times
    return sorted(rows)


def packed(pieces: DataFrame, capacity: tuple[int, int, int] = (SEQUENCE, MOST_PIECES, MOST_COST), weights: tuple[float, float, float] = WEIGHTS, by: str = "dot", seed: str = "pack-1") -> DataFrame:
    """pieces with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length
    places = np.array(plan(counts, capacity, weights, by), np.int64).reshape(-1, 6)
    keyed = pieces.withColumn("_key", F.concat(hash_key(F.col("doc_id"), seed), F.col("piece").cast("string")))
    ranked = running_before(keyed, ["length"], "_key", ["ids_crc32", "start"], F.lit(1), "_rank", slice_digits(sum(counts.values())))
    wide = 1 + int(places[:, 2].max(initial=0))  # orders (length, rank) as one number; Python's ints, as ranks may be large
    starts = places[:, 0].astype(float) * wide + places[:, 1] if len(places) and int(places[:, 0].max()) * wide < 2**52 else None
    by_length = {int(n): places[places[:, 0] == n] for n in np.unique(places[:, 0])} if starts is None else {}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            if starts is not None:
                row = places[np.searchsorted(starts, length.astype(float) * wide + rank, "right") - 1]
            else:
                row = np.empty((len(length), 6), np.int64)
                for n in np.unique(length):
                    at = length == n
                    row[at] = by_length[int(n)][np.searchsorted(by_length[int(n)][:, 1], rank[at], "right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 4] + nth // row[:, 3]), pa.array(row[:, 5] + nth % row[:, 3] * length)], schema=PACKED)

    return map_arrow(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank"), placed, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, **how) -> DataFrame:
    """Pieces of all documents with their places. The token counts are written first, so texts are read once."""
    return packed(written(tokenised(docs, **how), "pieces"))
