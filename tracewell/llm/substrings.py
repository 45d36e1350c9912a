"""Substring dedup with difference-cover anchors.

A run of WINDOW words that also starts earlier (smaller id, or earlier in the same text) is a repeat; every word that a
repeat covers goes. Only windows of WINDOW - v + 1 words at places that lie in a difference cover modulo v are hashed
first. A difference cover has, for any two places, an equal shift below v that moves both into it; so two equal runs of
WINDOW words share an anchor at the same distance from their starts. Anchors that meet another one are then extended:
all full windows around them are hashed, and the earliest of each keeps its words.

What moves between tasks: anchors (4 bytes of hash and a place) packed by hash range, texts by id once (both later steps
read the same exchange), full windows around shared anchors (8 bytes and a place) packed by hash range. In each step a
task first settles what meets within its own batch and sends one copy a hash onward, so a passage that a third of all
texts share stays small everywhere. Numbers of ranges follow the input's size; no task holds more than its range.

Defined results: a null text has no words; a null id sorts first; rows with the same id count in order of their text;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.shipping import map_arrow, ship

from .wordhash import WORDS, hashed, run_hashes, xxhash64

WINDOW = 20
#: Anchors or windows that a task holds at once, bytes of text that a group of texts has, about.
RANGE, GROUP_BYTES = 1 << 20, 12 << 20
#: Bytes of text whose anchors are settled together before they are sent.
BATCH = 16 << 20
NO_ID = -(1 << 63)

SENT = "dest int, kind int, part int, n int, data binary"
SENT_ARROW = pa.schema([("dest", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])
KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])
PROBE, KNOWN = 0, 1


@cache
def difference_cover(v: int) -> tuple[int, ...]:
    """The first smallest set of residues modulo v whose differences give every residue."""
    for size in range(1, v + 1):
        for rest in itertools.combinations(range(1, v), size - 1):
            cover = (0, *rest)
            if len({(a - b) % v for a in cover for b in cover}) == v:
                return cover
    return (0,)


@cache
def period(window: int) -> int:
    """q*q + q + 1 has a perfect cover of q + 1 residues; the largest one that leaves anchors of a third of the window."""
    fit = [v for v in (1, 3, 7, 13, 21, 31) if window - v + 1 >= max(1, window // 3)]
    return fit[-1]


def _pack(dest: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(dest, rows, bytes of the columns one behind the other) for each dest."""
    order = np.argsort(dest, kind="stable")
    dest = dest[order]
    columns = [c[order] for c in columns]
    edges = np.flatnonzero(np.diff(dest)) + 1
    for a, b in zip(np.concatenate([[0], edges]).tolist(), np.concatenate([edges, [len(dest)]]).tolist(), strict=True):
        if b > a:
            yield int(dest[a]), b - a, b"".join(c[a:b].tobytes() for c in columns)


def _unpack(rows: list[tuple[int, bytes]], *types: str) -> list[np.ndarray]:
    found: list[list[np.ndarray]] = [[] for _ in types]
    for n, data in rows:
        at = 0
        for k, kind in enumerate(types):
            found[k].append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(x) if x else np.empty(0, kind) for x, kind in zip(found, types, strict=True)]


def _shared(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the keys that occur more than once: all their places in order of key, and a number for each key."""
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    if not same.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    group = np.cumsum(np.concatenate([[True], ~same]))
    return order[many], group[many]


def _parts(doc: np.ndarray, parts: int) -> np.ndarray:
    return np.mod(xxhash64(doc), parts).astype(np.int32)


def _send(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SENT_ARROW.types, strict=True)], schema=SENT_ARROW)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str | None]]]:
    """(ids, texts) of some BATCH bytes each."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            ids.append(doc)
            texts.append(text)
            size += len(text or "")
            if size >= BATCH:
                yield np.array(ids, np.int64), texts
                ids, texts, size = [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts


def anchors(window: int, ranges: int, parts: int):
    """Map step: (id, text) to packed anchors, by hash range."""
    v = period(window)
    width, cover = window - v + 1, np.zeros(v, bool)
    cover[list(difference_cover(v))] = True

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _texts(batches):
            words, begin = hashed(texts)
            count = np.diff(begin)
            owner = np.repeat(np.arange(len(ids)), count)
            place = np.arange(len(words)) - np.repeat(begin[:-1], count)
            at = np.flatnonzero(cover[place % v] & (place + width <= count[owner]) & (count[owner] >= window))
            key = run_hashes(words, at, width)
            doc, where = ids[owner[at]], place[at].astype(np.uint32)
            met, group = _shared(key)
            rows = [(part % ranges, KNOWN, part, n, data) for part, n, data in _pack(_parts(doc[met], parts), doc[met], where[met])]
            # One of each group goes on, to meet those of other tasks.
            on = np.ones(len(key), bool)
            on[met[1:][np.diff(group) == 0]] = False
            dest = ((key[on] >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)
            rows += [(dest, PROBE, 0, n, data) for dest, n, data in _pack(dest, key[on].astype(np.uint32), doc[on], where[on])]
            yield _send(rows)

    return step


def meeting(parts: int):
    """A task has all anchors of its hash range: those that meet another one go to their texts."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = []
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
            probes += [(n, data) for _, kind, _, n, data in rows if kind == PROBE]
            yield _send([(part, KNOWN, part, n, data) for _, kind, part, n, data in rows if kind == KNOWN])
        key, doc, where = _unpack(probes, "<u4", "<i8", "<u4")
        met, _ = _shared(key)
        yield _send([(part, KNOWN, part, n, data) for part, n, data in _pack(_parts(doc[met], parts), doc[met], where[met])])

    return step


def _group(left: pa.Table) -> tuple[np.ndarray, list[str | None], np.ndarray, list[int | None]]:
    """Ids, texts, and a number for each row of the same id, in order; and the ids as they were."""
    rows = sorted(zip(left["doc_id"].to_pylist(), left["text"].to_pylist(), left["given"].to_pylist(), strict=True), key=lambda r: (r[0], r[2] is not None, r[1] is not None, r[1] or ""))
    ids = np.array([r[0] for r in rows], np.int64)
    first = np.searchsorted(ids, ids, "left")
    return ids, [r[1] for r in rows], (np.arange(len(ids)) - first).astype(np.int64), [r[2] for r in rows]


def extended(window: int, ranges: int, parts: int):
    """Texts with the places of their shared anchors: hashes of all full windows around them, by hash range."""
    reach = period(window)

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, where = _unpack(list(zip(right["n"].to_pylist(), right["data"].to_pylist(), strict=True)), "<i8", "<u4")
        if not len(doc) or not left.num_rows:
            return pa.Table.from_batches([], SENT_ARROW)
        ids, texts, nth, _ = _group(left)
        use = np.flatnonzero(np.isin(ids, doc))
        ids, nth, texts = ids[use], nth[use], [texts[k] for k in use.tolist()]
        keys, docs, places = [], [], []
        # In portions, so that memory follows the group's text and not its word arrays.
        size = np.cumsum([len(t or "") for t in texts])
        for chunk in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(size // (4 << 20))) + 1):
            words, begin = hashed([texts[k] for k in chunk.tolist()])
            count = np.diff(begin)
            # Anchors go to every row of their id; a row that has fewer words is left out.
            marks = np.zeros(len(words) + 1, np.int64)
            own = ids[chunk]
            first, last = np.searchsorted(own, doc, "left"), np.searchsorted(own, doc, "right")
            for shift in range(int((last - first).max(initial=0))):
                row = first + shift
                ok = row < last
                row, at = row[ok], where[ok].astype(np.int64)
                low, high = np.maximum(at - reach + 1, 0), np.minimum(at, count[row] - window)
                some = low <= high
                np.add.at(marks, begin[row[some]] + low[some], 1)
                np.add.at(marks, begin[row[some]] + high[some] + 1, -1)
            at = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
            keys.append(run_hashes(words, at, window))
            owner = np.searchsorted(begin, at, "right") - 1
            docs.append(own[owner])
            places.append(at - begin[owner] + (nth[chunk][owner] << 40))
        key, doc, where = np.concatenate(keys), np.concatenate(docs), np.concatenate(places)
        met, group = _shared(key)  # stable: in order of id and place within each key
        later = np.concatenate([[False], np.diff(group) == 0])[: len(met)]
        late = met[later]
        part = left["part"][0].as_py()
        rows = [(part % ranges, KNOWN, part, len(late), doc[late].tobytes() + where[late].tobytes())] if len(late) else []
        on = np.ones(len(key), bool)
        on[late] = False
        other = run_dest(key[on], ranges)
        rows += [(dest, PROBE, 0, n, data) for dest, n, data in _pack(other, key[on], doc[on], where[on])]
        return pa.Table.from_batches([_send(rows)], SENT_ARROW)

    return step


def run_dest(key: np.ndarray, ranges: int) -> np.ndarray:
    """The hash range of a window."""
    return ((key ^ (key >> np.uint64(29))) % np.uint64(ranges)).astype(np.int64)


def repeats(parts: int):
    """A task has all windows of its hash range: all but the earliest of each go back to their texts."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = []
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
            probes += [(n, data) for _, kind, _, n, data in rows if kind == PROBE]
            yield _send([(part, KNOWN, part, n, data) for _, kind, part, n, data in rows if kind == KNOWN])
        key, doc, where = _unpack(probes, "<u8", "<i8", "<i8")
        met, group = _shared(key)
        doc, where = doc[met], where[met]
        order = np.lexsort((where, doc, group))
        later = np.concatenate([[False], np.diff(group[order]) == 0])[: len(met)]
        late = order[later]
        yield _send([(part, KNOWN, part, n, data) for part, n, data in _pack(_parts(doc[late], parts), doc[late], where[late])])

    return step


def removal(window: int):
    """Texts with the places of their repeats: the words that stay, joined by one space."""

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, where = _unpack(list(zip(right["n"].to_pylist(), right["data"].to_pylist(), strict=True)), "<i8", "<i8")
        order = np.argsort(doc, kind="stable")
        doc, where = doc[order], where[order]
        ids, texts, nth, given = _group(left)
        first, last = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
        out = []
        for k, text in enumerate(texts):
            words = WORDS.findall(text or "")
            n, gone = len(words), 0
            if last[k] > first[k]:
                own = where[first[k] : last[k]]
                own = own[own >> 40 == nth[k]] & ((1 << 40) - 1)
                marks = np.zeros(n + 1, np.int64)
                np.add.at(marks, own, 1)
                np.add.at(marks, own + window, -1)
                stays = np.cumsum(marks[:-1]) == 0
                words = list(itertools.compress(words, stays.tolist()))
                gone = n - len(words)
            out.append((given[k], n, gone, " ".join(words)))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, KEPT.types, strict=True)], schema=KEPT)

    return step


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, text): what is left of every text."""
    spark = docs.sparkSession
    ship(spark)
    given = F.col(id_col).cast("long")
    slim = docs.select(F.coalesce(given, F.lit(NO_ID)).alias("doc_id"), F.col(text).alias("text"), given.alias("given"))
    n_bytes = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A word has some 6 bytes with its blank.
    words = n_bytes // 6
    parts, near, full = max(least, n_bytes // GROUP_BYTES), max(least, words // 3 // RANGE), max(least, words // RANGE)
    keyed = slim.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    texts = keyed.groupBy("part")

    sent = map_arrow(slim.select("doc_id", "text"), anchors(window, near, parts), SENT)
    found = map_arrow(sent.repartitionById(near, F.col("dest")), meeting(parts), SENT)
    sent = texts.cogroup(found.groupBy("part")).applyInArrow(extended(window, full, parts), SENT)
    found = map_arrow(sent.repartitionById(full, F.col("dest")), repeats(parts), SENT)
    return texts.cogroup(found.groupBy("part")).applyInArrow(removal(window), "doc_id long, n_words long, n_removed long, text string")
