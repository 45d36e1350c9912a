"""Links within groups that share a key, without all pairs of large groups as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.shipping import map_arrow

from .common import written
from .components import components, merged

#: Nodes of a group that are all compared at first; members of a part of a larger group; pairs that a task bounds at a
#: time, and keys that it looks at at a time.
FEW, PART, PAIRS, KEYS = 3, 512, 1 << 14, 1 << 11

Verify = Callable[[DataFrame], DataFrame]
#: Gets members (key, node, component, n) of groups with several components and returns the pairs (a, b) to be verified.
Meet = Callable[[DataFrame], DataFrame]
#: (from, to, factor): in these places of two sketches the sum of differences, and that of the sizes, is together at most
#: factor times the edits.
Bounds = list[tuple[int, int, int]]


def linked(keyed: DataFrame, verify: Verify, meet: Meet | None = None) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) and components (node, component) of the linked nodes, from rows (key, node). verify gets pairs (a, b),
    a below b, each once, and returns those that are links.

    Every node of a group meets the group's least; in groups of up to FEW, which is 3, all nodes meet. In larger ones all
    nodes of different components meet after that: in the pairs that `meet` returns of them, else as in `all_met`."""
    # Dealt by key once: counting the groups and finding their members both read the same exchange.
    keyed = keyed.select("key", "node").repartition(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub"), F.max("node").alias("last")).filter("n > 1")
    members = written(keyed.join(groups.hint("shuffle_hash"), "key"), "members")
    ends = F.when(F.col("n") <= FEW, F.array("hub", "last")).otherwise(F.array("hub"))
    met = members.select("node", F.explode(ends).alias("other")).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    tried = written(met.filter("a < b").distinct(), "pairs")
    found = written(verify(tried), "links")
    component = written(components(found), "components")
    large = members.filter(F.col("n") > FEW).select("key", "node")
    if meet is None:
        return all_met(large, verify, found, component, tried)
    left = written(several(large, component), "several")
    return more_links(meet(left), verify, found, component, tried)[:2]


def all_met(large: DataFrame, verify: Verify, found: DataFrame, component: DataFrame, tried: DataFrame, sketches: DataFrame | None = None, bounds: Bounds = [], least: float = 0.0) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """Links and components after all nodes of different components that share a key (key, node) have met: first each
    node the nearest of each part of its groups, then all. sketches (node, size, sketch: bytes) and bounds leave out
    pairs that cannot have a similarity (1 - edits / larger size) of `least`, and no others; without sketches none."""
    if sketches is None:
        sketches = large.select("node", F.lit(0).alias("size"), F.lit(b"").alias("sketch")).distinct()
    else:
        sketches = written(sketches, "bounds")
    for nearest in (True, False):
        fresh = possible(several(large, component), sketches, bounds, least, nearest).distinct()
        found, component, tried = more_links(fresh, verify, found, component, tried)
    return found, component


def several(members: DataFrame, component: DataFrame) -> DataFrame:
    """The members (key, node) of groups with nodes of several components, with their components and the groups' sizes n."""
    label = members.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = label.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("_low"), F.max("component").alias("_high"))
    return label.join(groups.filter("_low < _high").select("key", "n"), "key")


def joined(members: DataFrame, marks: DataFrame, many: int, factor: int, least: float) -> DataFrame:
    """Pairs (a, b), a below b, of members (key, node, component, n) of a group and of different components that can have
    a similarity (1 - edits / larger size) of `least`, each once, by a join: marks (node, size, bits: `many` long numbers)
    differ in bits and size together by `factor` times the edits at most. Most of a large group is often one component,
    so its nodes are met by the group's others only, which go to all parts of the group of about PART members. Nodes that
    share several groups meet in that of the least key only."""
    most_in = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("in")).groupBy("key").agg(F.max(F.struct("in", "component"))["component"].alias("main"))
    own = members.groupBy("node").agg(F.collect_set("key").alias("keys"))
    t = members.join(most_in, "key").withColumn("parts", F.ceil(F.col("n") / PART).cast("int")).withColumn("other", F.col("component") != F.col("main")).join(marks.join(own, "node"), "node")
    t = t.withColumn("keys", F.filter("keys", lambda k: k < F.col("key")))
    named = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("key", "part", "node", "component", "size", "bits", "keys", "other")]
    one = t.filter("other").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*named("a"))
    two = t.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).select(*named("b"))
    differ = F.abs(F.col("size_a") - F.col("size_b"))
    most = F.floor(F.lit(1 - least) * F.greatest("size_a", "size_b") + 1e-6)
    bits = differ
    for i in range(many):
        bits = bits + F.bit_count(F.get("bits_a", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i))))
    apart = (F.col("component_a") != F.col("component_b")) & (~F.col("other_b") | (F.col("node_a") < F.col("node_b")))
    close = apart & (differ <= most) & (bits <= most * factor) & ~F.arrays_overlap("keys_a", "keys_b")
    pairs = one.join(two, (F.col("key_a") == F.col("key_b")) & (F.col("part_a") == F.col("part_b")) & close)
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def possible(members: DataFrame, sketches: DataFrame, bounds: Bounds, least: float, nearest: bool) -> DataFrame:
    """Pairs (a, b), a below b, of members (key, node, component, n) of a group and of different components that can be
    similar enough; with `nearest`, of each member in each part of its group the nearest one only.

    A group is dealt to parts of about PART members, and any two parts meet in one row, so that pairs are no rows. Nodes
    that share several groups meet in that of the least key only."""
    parts = F.ceil(F.col("n") / PART).cast("int")
    own = members.groupBy("node").agg(F.collect_set("key").alias("keys"))
    t = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(sketches.join(own, "node"), "node")
    t = t.withColumn("keys", F.filter("keys", lambda k: k < F.col("key")))
    t = t.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")
    cells = t.groupBy("key", low, high).agg(F.collect_list(F.struct((F.col("part") > F.col("other")).alias("second"), "node", "component", "size", "sketch", "keys")).alias("rows"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1)
            ends = np.concatenate([[0], np.cumsum(np.diff(np.asarray(rows.offsets)))])
            second, node, component, size, sketch, keys = rows.flatten().flatten()
            many, keys = np.asarray(pc.list_value_length(keys)), np.asarray(keys.flatten())
            first = np.concatenate([[0], np.cumsum(many)])
            second, node, component, size = (x.to_numpy(zero_copy_only=False) for x in (second, node, component, size))
            marks = np.frombuffer(b"".join(sketch.to_pylist()), np.uint8).reshape(len(node), -1)
            out: list[list[np.ndarray]] = [[], []]
            for apart, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                one, two = (np.flatnonzero(~second[a:b]) + a, np.flatnonzero(second[a:b]) + a) if apart else (np.arange(a, b), np.arange(a, b))
                met = shared(one - a, two - a, np.repeat(np.arange(b - a), many[a:b]), keys[first[a] : first[b]], b - a)
                i, j = near_pairs(one, two, not apart, component, size, marks, bounds, least, nearest, met)
                out[0].append(node[i])
                out[1].append(node[j])
            if out[0]:
                x, y = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y), pa.int64()), pa.array(np.maximum(x, y), pa.int64())], names=["a", "b"])

    return map_arrow(cells.select((F.col("low") < F.col("high")).alias("apart"), "rows"), step, "a long, b long")


def shared(one: np.ndarray, two: np.ndarray, owner: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Whether a place of `one` and a place of `two`, of n, have one of their keys (owner, key) in common."""
    out = np.zeros((len(one), len(two)), bool)
    _, key, times = np.unique(keys, return_inverse=True, return_counts=True)
    some = times[key] > 1
    names, key = np.unique(key[some], return_inverse=True)
    owner = owner[some]
    for at in range(0, len(names), KEYS):
        here = (key >= at) & (key < at + KEYS)
        has = np.zeros((n, min(KEYS, len(names) - at)), np.float32)
        has[owner[here], key[here] - at] = 1
        out |= has[one] @ has[two].T > 0
    return out


def near_pairs(one: np.ndarray, two: np.ndarray, same: bool, component: np.ndarray, size: np.ndarray, marks: np.ndarray, bounds: Bounds, least: float, nearest: bool, met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of places, one of each list (if they are the same, each pair once), of different components, not `met`
    elsewhere and within all bounds; with `nearest`, the nearest of each place."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    wide = max(1, PAIRS // max(1, len(two)))
    for at in range(0, len(one), wide):
        some = one[at : at + wide]
        apart = (component[some][:, None] != component[two][None, :]) & ~met[at : at + wide]
        if same:
            apart &= some[:, None] < two[None, :]
        i, j = np.nonzero(apart)
        i, j = some[i], two[j]
        longer = np.maximum(size[i], size[j])
        most = np.floor((1 - least) * longer + 1e-6)
        away = longer - np.minimum(size[i], size[j])
        use = away <= most
        i, j, most, away = i[use], j[use], most[use], away[use]
        for start, end, factor in bounds:
            away = (np.abs(marks[i, start:end].astype(np.int16) - marks[j, start:end]).sum(1) + np.abs(size[i] - size[j])) / factor
            use = away <= most
            i, j, most, away = i[use], j[use], most[use], away[use]
        found.append((i, j, away / np.maximum(most, 1)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j, away = map(np.concatenate, zip(*found, strict=True))
    if nearest:
        keep = np.zeros(len(i), bool)
        for end in (i, j):
            order = np.lexsort((away, end))
            keep[order[np.concatenate([[True], np.diff(end[order]) != 0])[: len(order)]]] = True
        i, j = i[keep], j[keep]
    return i, j


def more_links(fresh: DataFrame, verify: Verify, found: DataFrame, component: DataFrame, tried: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links, components and tried pairs after more pairs."""
    fresh = written(fresh.join(tried, ["a", "b"], "left_anti"), "pairs")
    more = written(verify(fresh), "links")
    if more.isEmpty():
        return found, component, tried.union(fresh)
    return found.union(more), merged(component, more), tried.union(fresh)
