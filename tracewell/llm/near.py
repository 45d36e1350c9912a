"""MinHash near-dedup with order MinHash.

A text is its words; its k-mers are runs of five words, each labelled with its occurrence number. Under each of TABLES
hash orders the two least labelled k-mers, kept in their order in the text, are a key: texts agree in a key with a
probability that falls with their edit distance, order of passages included. Texts under SHORT words are also keyed by
word pairs, as five-word runs rarely survive an edit there.

Equal word sequences are first collapsed to one class. A class first meets, of the least classes of its groups, the one
that it shares most keys with. Then in each group of classes with the same key a class meets the group's least, and in
groups of up to WHOLE and one all pairs are candidates; only texts of one component of more than WHOLE and one, which
they can't change, are not compared again. Of larger groups only those with several components go on
(`groups.all_met`): there all classes of different components meet, but those whose counts of words show that they can't
be similar enough.
Candidates whose word counts fit are verified by banded alignment of the whole word sequences (similarity 1 - edits /
longer length, at least SIMILARITY).

Defined results: a null text has no words; texts without words are one class; ids name documents, so rows of the same id
share its class (the least class of its texts), and null ids are one document; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.shipping import map_arrow, portions

from .common import bucketed, settled_alone, written
from .components import components
from .groups import all_met, more_links
from .wordhash import BASE, hashed, mixed, numbers, run_hashes

K, TABLES, SIMILARITY = 5, 32, 0.8
SHORT, SHORT_K, SHORT_TABLES = 50, 2, 16
#: From here on five-word runs are keyed; texts of SHORT words still meet those of SIMILARITY times as many.
LONG = int(SHORT * SIMILARITY)
#: Classes before it in a group's order that a class meets, where these are all.
WHOLE = 64
#: Words are counted in so many classes, and in so many finer ones; an edit changes two of these counts by one at most.
COUNTS = (256, 1024)
BOUNDS = [(0, COUNTS[0], 2), (COUNTS[0], sum(COUNTS), 2)]
NO_ID = -(1 << 63)
#: Words that an alignment compares at a time.
RUN = 16
TOP = np.uint64((1 << 64) - 1)

SKETCH = "doc_id long, given long, high long, low long, n int, key array<long>, words binary"
SKETCH_ARROW = pa.schema([("doc_id", pa.int64()), ("given", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("n", pa.int32()), ("key", pa.list_(pa.int64())), ("words", pa.binary())])


def order_minhash(words: np.ndarray, begin: np.ndarray, k: int, tables: int, seed: int) -> np.ndarray:
    """The keys of each text, a column a table; every text must have k words at least."""
    count = np.diff(begin) - k + 1
    first = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(owner)) - first[owner]
    mers = run_hashes(words, begin[:-1][owner] + place, k)
    # Occurrence numbers: equal k-mers of a text, in order.
    mark = mers ^ mixed(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(mark, kind="stable")
    fresh = np.concatenate([[True], np.diff(mark[order]) != 0])
    nth = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    if nth.any():
        label = np.empty(len(order), np.uint64)
        label[order] = nth
        mers = np.where(label > 0, mixed(mers + label * np.uint64(0x9E3779B97F4A7C15)), mers)
    keys = np.empty((len(count), tables), np.uint64)
    turns, flips = numbers(seed, tables) | np.uint64(1), numbers(seed + 1, tables)
    for t in range(tables):
        value = (mers ^ flips[t]) * turns[t]
        where = []
        for _ in range(2):
            low = np.minimum.reduceat(value, first[:-1])
            at = np.flatnonzero(value == low[owner])
            at = at[np.concatenate([[True], np.diff(owner[at]) != 0])]  # one a text
            where.append(at)
            value[at] = TOP
        a, b = mers[where[0]], mers[where[1]]
        none = count < 2
        swap = where[1] < where[0]
        one, two = np.where(swap, b, a), np.where(swap, a, b)
        keys[:, t] = mixed(np.where(none, a, one) * np.uint64(3) + np.where(none, np.uint64(0), mixed(two)) + np.uint64(seed * 1000 + t))
    return keys


def sketches(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each text: digest of its words, their number, keys, and the words as 16-bit hashes (an
    alignment takes two different words for the same once in 65,536 times)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = max(1, int(len(batch) * (2 << 20) // max(1, batch.nbytes)))
            for at in range(0, len(batch), size):
                yield rows(batch.slice(at, size))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        words, begin = hashed(batch.column(1).to_pylist())
        count = np.diff(begin)
        parts = [words[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
        digest = [hashlib.blake2b(p.tobytes(), digest_size=16).digest() for p in parts]
        high, low = (pa.array(np.frombuffer(b"".join(d[i : i + 8] for d in digest), "<i8")) for i in (0, 8))
        found: list[list[int]] = [[] for _ in ids]
        for k, tables, chosen in ((K, TABLES, count >= max(LONG, K)), (SHORT_K, SHORT_TABLES, (count < SHORT) & (count >= SHORT_K))):
            use = np.flatnonzero(chosen)
            if not len(use):
                continue
            own = np.concatenate([[0], np.cumsum(count[use])])
            keys = order_minhash(np.concatenate([parts[i] for i in use]), own, k, tables, 100 + k)
            for i, x in zip(use.tolist(), keys.view(np.int64).tolist(), strict=True):
                found[i] += x
        small = [(p >> np.uint64(48)).astype("<u2").tobytes() for p in parts]
        return pa.RecordBatch.from_arrays([pa.array([NO_ID if d is None else d for d in ids], pa.int64()), pa.array(ids, pa.int64()), high, low, pa.array(count.astype(np.int32)), pa.array(found, SKETCH_ARROW.field("key").type), pa.array(small, pa.binary())], schema=SKETCH_ARROW)

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")), step, SKETCH)


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The edit distance of two word sequences if it is at most `most`, else most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(np.argmin(same))
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = a[::-1][:n] == b[::-1][:n]
    tail = n if same.all() else int(np.argmin(same))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return min(max(len(a), len(b)), most + 1)
    # No alignment keeps more words than the two have in common.
    names, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    common = int(np.minimum(np.bincount(number[: len(a)], minlength=len(names)), np.bincount(number[len(a) :], minlength=len(names))).sum())
    if max(len(a), len(b)) - common > most:
        return most + 1
    return _aligned(number[: len(a)], number[len(a) :], most)


def _aligned(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The cost of the best alignment, if at most `most`, else most + 1: for each cost the furthest place that is reached
    on each diagonal of the band, which grows with the cost and narrows to what can still end in the corner."""
    n, m = len(a), len(b)
    goal = m - n
    first = sliding_window_view(np.concatenate([a, np.full(RUN, -1, a.dtype)]), RUN)
    second = sliding_window_view(np.concatenate([b, np.full(RUN, -2, b.dtype)]), RUN)
    low = high = 0
    reach = np.zeros(1, np.int64)
    for cost in range(most + 1):
        if cost:
            down, up = max(low - 1, goal - (most - cost), -n), min(high + 1, goal + (most - cost), m)
            if down > up:
                return most + 1
            old = np.full(up - down + 3, -(1 << 40), np.int64)  # old[i] stands on diagonal down - 1 + i
            at = max(low, down - 1)
            old[at - down + 1 : min(high, up + 1) - down + 2] = reach[at - low : min(high, up + 1) - low + 1]
            low, high = down, up
            # A word changed, a word of b alone, a word of a alone.
            reach = np.maximum(np.maximum(old[1:-1] + 1, old[:-2]), old[2:] + 1)
            reach = np.minimum(reach, np.minimum(n, m - np.arange(low, high + 1)))
        going = np.flatnonzero(reach >= 0)
        while len(going):
            x = reach[going]
            same = first[x] == second[x + going + low]
            run = np.where(same.all(1), RUN, same.argmin(1))
            reach[going] = x + run
            going = going[run == RUN]
        if low <= goal <= high and reach[goal - low] >= n:
            return cost
    return most + 1


def similar(a: bytes, b: bytes, least: float = SIMILARITY) -> float:
    """The similarity of two word sequences, or 0 if it is below `least`."""
    x, y = np.frombuffer(a, "<u2"), np.frombuffer(b, "<u2")
    longer = max(len(x), len(y))
    if not longer:
        return 1.0
    most = int((1 - least) * longer + 1e-9)
    d = distance(x, y, most)
    return 0.0 if d > most else 1 - d / longer


def verified(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of node numbers whose texts (node, words) are similar enough, with the similarity."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = max(1, int(len(batch) * (8 << 20) // max(1, batch.nbytes)))
            for at in range(0, len(batch), size):
                part = batch.slice(at, size)
                score = np.array([similar(x, y, least) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)], float)
                keep = pa.array(np.flatnonzero(score > 0))
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep), pa.array(score[score > 0])], names=["a", "b", "similarity"])

    left = texts.select(F.col("node").alias("a"), F.col("words").alias("one"))
    right = texts.select(F.col("node").alias("b"), F.col("words").alias("two"))
    return map_arrow(pairs.join(right, "b").join(left, "a").select("a", "b", "one", "two"), step, "a long, b long, similarity double")


def needed(seen: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """(node, words) of the classes that share a key with another, dealt by node."""
    some = members.select("node").distinct().join(classes.select("node", F.col("high").alias("_high"), F.col("low").alias("_low")), "node")
    # Not an equality of columns, so that rows are dealt by node alone; it matters only where ids are repeated.
    same = (F.col("high").bitwiseXOR(F.col("_high")) == 0) & (F.col("low").bitwiseXOR(F.col("_low")) == 0)
    both = seen.select(F.col("doc_id").alias("node"), "high", "low", "words").join(some, "node").filter(same)
    return both.dropDuplicates(["node", "high", "low"]).select("node", "words")


def counted(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(node, size, sketch) of the texts (node, words) of members: how many of their words fall into each of COUNTS[0]
    and of COUNTS[1] classes, 255 at most."""

    def mark(words: np.ndarray) -> bytes:
        return b"".join(np.minimum(np.bincount(words % many, minlength=many), 255).astype(np.uint8).tobytes() for many in COUNTS)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 8 << 20):
            words = [np.frombuffer(w, "<u2") for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int32()), pa.array([mark(w) for w in words], pa.binary())], names=["node", "size", "sketch"])

    return map_arrow(texts.join(members.select("node").distinct(), "node", "left_semi").select("node", "words"), step, "node long, size int, sketch binary")


def links(seen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From the written sketches: classes (high, low, node, n, copies), verified links (a, b) of nodes, and components
    (node, component) of the linked ones."""
    classes = written(seen.groupBy("high", "low").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("key").alias("key")), "classes")
    # Dealt by key once: counting the groups and finding their members both read the same exchange.
    parts = int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = classes.select("node", "n", F.explode("key").alias("key")).repartition(parts, "key")
    groups = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = written(keyed.join(groups.select("key", "hub"), "key"), "members")
    sizes = classes.select("node", F.col("n").alias("n"))
    fits = F.least("n", "other_n") >= F.lit(SIMILARITY) * F.greatest("n", "other_n") - 1e-9

    def pairs(members: DataFrame) -> DataFrame:
        """(a, b), a < b: of members with hub and hub_n."""
        return members.filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))

    hub_sizes = sizes.groupBy(F.col("node").alias("hub")).agg(F.max("n").alias("other_n"))
    met = written(members.groupBy("hub", "node", "n").agg(F.count(F.lit(1)).alias("keys")).join(hub_sizes, "hub").filter(fits).filter("node <> hub"), "met")
    texts = bucketed(needed(seen, classes, members), "node")
    likely = F.max_by("hub", F.struct("keys", F.bitwise_not(F.col("hub")))).alias("hub")
    first = written(pairs(met.groupBy("node").agg(likely)).distinct(), "pairs")
    found = written(verified(first, texts), "links")
    component = written(components(found), "components")
    # Texts of one large component don't meet again; they are left out before pairs are rows.
    large = component.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > WHOLE + 1).join(component, "component").select("node", "component")
    apart = lambda one, two: F.coalesce(one != two, F.lit(True))
    hubs = large.select(F.col("node").alias("hub"), F.col("component").alias("other"))
    by_hub = pairs(met.join(large, "node", "left").join(hubs, "hub", "left").filter(apart(F.col("component"), F.col("other"))))
    group = Window.partitionBy("key")
    here = F.struct("node", "n", "component")
    sized = members.join(large, "node", "left").select("key", "node", "n", "component", F.count(F.lit(1)).over(group).alias("members"), F.collect_list(here).over(group.orderBy("node", "n").rowsBetween(-WHOLE, -1)).alias("before"))
    small = F.col("members") <= WHOLE + 1
    others = F.filter("before", lambda o: apart(o["component"], F.col("component")))
    whole = sized.filter(small).select("node", "n", F.explode(others).alias("o")).select("node", "n", F.col("o.node").alias("hub"), F.col("o.n").alias("other_n"))
    left = written(members.select("key", "node", "n", F.count(F.lit(1)).over(group).alias("members")).filter(~small).drop("members"), "left")
    tried = by_hub.union(pairs(whole.filter(fits)))
    found, component, tried = more_links(tried.distinct(), lambda p: verified(p, texts), found, component, first)
    left = left.select("key", "node").distinct()
    found, component = all_met(left, lambda p: verified(p, texts).select("a", "b"), found.select("a", "b"), component, tried, counted(texts, left), BOUNDS, SIMILARITY)
    return classes, found, component


def classified(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, text_class, class_id, links, kept): one row a row of docs. class_id is the least id of all
    documents that a chain of verified links joins, text_class that of those with the same words; links counts the
    links of the text class that were verified: two texts that others have joined before need not have been compared.
    It is written."""
    return settled_alone(docs.sparkSession, lambda: _classified(docs, id_col, text), "classified")


def _classified(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    seen = written(sketches(docs, id_col, text), "sketches")
    classes, found, component = links(seen)
    degree = found.select(F.col("a").alias("node")).union(found.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    named = classes.select("high", "low", "node").join(component, "node", "left").join(degree, "node", "left")
    out = seen.select("doc_id", "given", "high", "low", "n").join(named, ["high", "low"]).withColumn("class_id", F.coalesce("component", "node"))
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(F.col("given").alias("doc_id"), F.col("n").cast("long").alias("n_words"), null("node").alias("text_class"), null("class_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), (F.col("doc_id") == F.col("class_id")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that are their group's least. Ids name documents: all rows of such an id stay, but those that are
    the same in every column once only. Columns stay."""
    kept = classified(docs).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    # The row travels whole in one column, so that no name of its columns can clash.
    out = docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct("*").alias("_row"))
    out = out.join(kept, F.col("_id").eqNullSafe(F.col("_kept")), "left_semi")
    mark = F.md5(F.to_json("_row", {"ignoreNullFields": "false"}))
    return out.withColumn("_mark", mark).dropDuplicates(["_id", "_mark"]).select("_row.*")
