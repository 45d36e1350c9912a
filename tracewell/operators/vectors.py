"""Dense search, signatures, bands and late interaction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.shipping import map_arrow, portions

#: Query vectors that are sent to all tasks at once (numbers, not rows); beyond that queries go block by block.
BLOCK_NUMBERS = 4 << 20
LEAST = 0.04
#: Products that a task holds at a time, and bytes of vectors that it turns into Python objects.
PRODUCTS, PORTION = 4 << 20, 1 << 20


def blocks(queries: DataFrame, vectors: str) -> Iterator[list[tuple]]:
    """The queries' (query_id, vectors) in blocks of BLOCK_NUMBERS numbers or so."""
    rows, size = [], 0
    for r in queries.select("query_id", vectors).toLocalIterator():
        rows.append((r[0], r[1]))
        size += sum(len(v) if isinstance(v, list) else 1 for v in r[1])
        if size >= BLOCK_NUMBERS:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def best_rows(score: np.ndarray, stamp: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best rows: by score, then the latest stamp, then key. Ties at the k-th place are looked at."""
    use = np.arange(len(score))
    if len(use) > k:
        use = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    later = np.unique(stamp[use], return_inverse=True)[1]
    return use[np.lexsort((key[use], -later, -score[use]))[:k]]


def dense_top(nodes: DataFrame, queries: DataFrame, k: int, least: float = LEAST, key: str = "node_id", order: str = "timestamp") -> DataFrame:
    """(query_id, key, similarity, rank): the k nodes with the largest scalar product, ties by the latest `order`, then
    by key.

    Queries (query_id, vector) go to the nodes in blocks of a fixed size; each partition of nodes keeps its own best k of
    each query, so only candidates move. The cut at `least` comes after the k, as a rank is a rank among all."""
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, {key} {nodes.schema[key].dataType.simpleString()}, {order} string, similarity double"
    best = None
    for rows in blocks(queries, "vector"):
        shared = nodes.sparkSession.sparkContext.broadcast((np.array([v for _, v in rows], np.float64), [q for q, _ in rows]))

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vectors, names = shared.value
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            of_key = None
            for batch in batches:
                if not len(batch):
                    continue
                of_key = batch.column(0).type
                own = np.concatenate([np.array(part.column(2).to_pylist(), np.float32) for part in portions(iter([batch]), PORTION)]).astype(np.float64)
                wide = max(1, PRODUCTS // len(own))
                stamp, keys = (np.array(batch.column(i).to_pylist(), object) for i in (1, 0))
                stamp = np.array(["" if x is None else x for x in stamp])
                new = []
                for q in range(len(names)):
                    if q % wide == 0:
                        score = own @ vectors[q : q + wide].T
                    rows = (score[:, q % wide], stamp, keys)
                    if held:
                        rows = tuple(np.concatenate(pair) for pair in zip(held[q], rows, strict=True))
                    at = best_rows(*rows, k)
                    new.append(tuple(x[at] for x in rows))
                held = new
            for name, (score, stamp, keys) in zip(names, held, strict=False):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys.tolist(), of_key), pa.array(stamp.tolist(), pa.string()), pa.array(score)], names=["query_id", key, order, "similarity"])

        part = map_arrow(nodes.select(key, F.col(order).cast("string").alias(order), "embedding"), step, schema)
        best = part if best is None else best.unionByName(part)
    if best is None:
        return nodes.sparkSession.createDataFrame([], schema + ", rank int")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc(order), key)
    return best.withColumn("rank", F.row_number().over(ranked)).filter((F.col("rank") <= k) & (F.col("similarity") > least))


def band_matches(postings: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(query_id, key, matches): in how many different bands a row meets a query."""
    return postings.join(wanted, "band").groupBy("query_id", key).agg(F.count_distinct("band").alias("matches"))


def best_of_keys(nodes: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """(query_id, key, facet, similarity): for each query vector (query_id, facet, vector) and each key the best scalar
    product with the key's nodes (key, embedding). Query vectors go to the nodes in blocks of a fixed size, and each
    partition keeps one number for each of its keys and query vectors, so no pair is a row."""
    of, facet = (queries.schema[c].dataType.simpleString() for c in ("query_id", "facet"))
    schema = f"query_id {of}, key {nodes.schema[key].dataType.simpleString()}, facet {facet}, similarity double"
    out = nodes.sparkSession.createDataFrame([], schema)
    for rows in blocks(queries.select(F.struct("query_id", "facet").alias("query_id"), "vector"), "vector"):
        shared = nodes.sparkSession.sparkContext.broadcast(([tuple(q) for q, _ in rows], np.array([v for _, v in rows], np.float64)))

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, vectors = shared.value
            held: dict = {}
            kind = None
            for batch in batches:
                kind = batch.column(0).type
                keys = np.array(batch.column(0).to_pylist(), object)
                if not len(keys):
                    continue
                score = np.array(batch.column(1).to_pylist(), np.float32).astype(np.float64) @ vectors.T
                for own in dict.fromkeys(keys.tolist()):
                    best = score[[k == own for k in keys]].max(0)
                    held[own] = np.maximum(held[own], best) if own in held else best
            for own, best in held.items():
                columns = ([q for q, _ in names], [own] * len(names), [f for _, f in names], best)
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], kind), pa.array(columns[2]), pa.array(columns[3])], names=["query_id", "key", "facet", "similarity"])

        out = out.unionByName(map_arrow(nodes.select(key, "embedding"), step, schema))
    return out.groupBy("query_id", "key", "facet").agg(F.max("similarity").alias("similarity"))


def maxsim(pairs: DataFrame) -> DataFrame:
    """(query_id, key, similarity) from (query_id, key, facet, similarity): the mean over a query's facets of the best
    similarity, 0 at least."""
    best = pairs.groupBy("query_id", "key", "facet").agg(F.greatest(F.lit(0.0), F.max("similarity")).alias("best"))
    return best.groupBy("query_id", "key").agg(F.avg("best").alias("similarity"))


def late_interaction(pairs: DataFrame, queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, node_id, similarity) for pairs (query_id, node_id): MaxSim of the queries' facets and the nodes'.

    Facets of queries go to the nodes in blocks of a fixed size; a node's vectors move once a block, beside the ids of
    the block's queries that ask for it."""
    out = None
    for rows in blocks(queries, "facets"):
        shared = nodes.sparkSession.sparkContext.broadcast({q: np.array(f, np.float64) for q, f in rows})
        own = nodes.sparkSession.createDataFrame([(q,) for q, _ in rows], "query_id string")
        asked = pairs.join(own, "query_id", "left_semi").groupBy("node_id").agg(F.collect_list("query_id").alias("asking"))

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in portions(batches, PORTION):
                found = []
                for node, asking, facets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held = np.array(facets, np.float64).T
                    found += [(q, node, float(np.maximum(0.0, (a @ held).max(1)).mean()) if len(a := shared.value[q]) else 0.0) for q in asking]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["query_id", "node_id", "similarity"])

        part = map_arrow(asked.join(nodes, "node_id").select("node_id", "asking", "facets"), step, "query_id string, node_id string, similarity double")
        out = part if out is None else out.unionByName(part)
    return nodes.sparkSession.createDataFrame([], "query_id string, node_id string, similarity double") if out is None else out
