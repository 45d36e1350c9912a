"""The navigation index: session, episode and exchange nodes with terms, vectors, anchors, bands, postings and edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import columns, text
from tracewell.functions.shipping import map_arrow, portions
from tracewell.operators import links, turns
from tracewell.sources.tables import settled

# How many of a session's most frequent terms stand in its text, and the edition of the features, which goes
# up when they change, so that a store is built anew.
SALIENT = 420
FEATURES = 2

NODE = "node_id string, level string, session_id string, archive_path string, parent_id string, line_start long, line_end long, timestamp string, text string, user string"
MADE = NODE + ", norm string, content_hash string, terms array<string>, tokens array<string>, embedding array<float>, facets array<array<float>>, bands array<string>, anchors array<string>"


@dataclass
class Index:
    """The index's tables; nodes are written, the rest derives from them."""

    nodes: DataFrame
    exchanges: DataFrame
    edges: DataFrame

    @property
    def anchors(self) -> DataFrame:
        return self.nodes.filter("level = 'exchange'").select("node_id", F.explode("anchors").alias("anchor"))

    @property
    def bands(self) -> DataFrame:
        return self.nodes.filter("level = 'exchange'").select("node_id", "timestamp", F.explode("bands").alias("band"))

    @property
    def postings(self) -> DataFrame:
        """Tokens with counts, and terms of several tokens as units; dl counts tokens."""
        t = self.nodes.select("node_id", "level", "session_id", "timestamp", F.size("tokens").alias("dl"), F.explode(F.concat("tokens", F.filter("terms", lambda x: x.rlike(r"[^\p{L}\p{N}]")))).alias("term"))
        return t.groupBy("node_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def _features(rows: DataFrame) -> DataFrame:
    """One pass over the texts for all that has no JVM expression."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("norm", pa.string()), ("content_hash", pa.string()), ("terms", pa.list_(pa.string())), ("tokens", pa.list_(pa.string())), ("embedding", pa.list_(pa.float32())), ("facets", pa.list_(pa.list_(pa.float32()))), ("bands", pa.list_(pa.string())), ("anchors", pa.list_(pa.string()))])
        for batch in portions(batches):
            levels, bodies, users = (batch.column(i).to_pylist() for i in (1, 8, 9))
            bodies = [x or "" for x in bodies]
            # One batch of vectors: every body, and the facets of first parts.
            spoken = [text.node_facets(user, body) if user is not None else [] for body, user in zip(bodies, users, strict=True)]
            vectors = text.embedded([*bodies, *(f for own in spoken for f in own)])
            at, out = len(bodies), []
            for row, (level, body, own) in enumerate(zip(levels, bodies, spoken, strict=True)):
                facets = [vectors[row], *vectors[at : at + len(own)]]
                at += len(own)
                keys = text.routing_terms(body, None)
                found = level in ("exchange", "tool")
                stable = [a for a in text.anchors(body)[1] if text.indexable(a)] if found else []
                signs = {b for f in facets for b in text.bands(text.signature(f))} if level == "exchange" else set()
                tokens = [t for k in keys for t in text.pattern(r"[^\W_]+").findall(k)]
                out.append({"norm": text.normalize(body), "content_hash": text.fingerprint(body), "terms": keys, "tokens": tokens, "embedding": vectors[row].astype(np.float32), "facets": [f.astype(np.float32) for f in facets], "bands": sorted(signs), "anchors": stable})
            made = pa.RecordBatch.from_pylist(out, schema=schema)
            yield pa.RecordBatch.from_arrays([*batch.columns, *made.columns], names=[*batch.schema.names, *schema.names])

    return map_arrow(rows.select(*[f.split(" ")[0] for f in NODE.split(", ")]), step, MADE)


def _keys(rows: DataFrame) -> DataFrame:
    """(archive_path, term): the terms of each message, for the salient ones."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            found = [(a, t) for a, body in zip(*(c.to_pylist() for c in batch.columns), strict=True) for t in text.terms(body, None)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], names=["archive_path", "term"])

    messages = rows.select("archive_path", F.col("user_message").alias("m")).unionByName(rows.select("archive_path", F.col("assistant_message").alias("m")))
    return map_arrow(messages, step, "archive_path string, term string")


def nodes(exchange: DataFrame, boundary: DataFrame, salient: int = SALIENT, about: DataFrame | None = None) -> DataFrame:
    """All nodes, without their features. about: (archive_path, project, cwd, git_branch) of archives, where known."""
    none = F.lit(None).cast("string")
    key = F.left(F.sha2(F.lower("archive_path"), 256), F.lit(12))
    combined = F.concat(F.lit("User: "), "user_message", F.lit("\n\nAssistant: "), "assistant_message")
    parts = turns.chunks(exchange.withColumn("text", combined))
    parts = parts.select(F.format_string("exchange:%s:%03d", "id", "part").alias("node_id"), F.lit("exchange").alias("level"), "session_id", "archive_path", none.alias("parent_id"), "line_start", "line_end", "timestamp", F.col("chunk").alias("text"), F.when(F.col("part") == 0, F.col("user_message")).alias("user"))

    session = F.concat_ws(":", F.lit("session"), "session_id", key)
    in_epochs = turns.epochs(exchange, boundary)
    said = F.concat(F.lit("User: "), "user_message", F.lit("\nAssistant: "), "assistant_message")
    windows = turns.episodes(in_epochs).withColumn("n", F.row_number().over(Window.partitionBy("archive_path").orderBy("epoch", "window")) - 1)
    inside = in_epochs.select(F.col("archive_path").alias("a"), F.col("epoch").alias("e"), F.col("line_start").alias("at"), F.col("timestamp").alias("ts"), said.alias("said"))
    met = windows.join(inside, (F.col("archive_path") == F.col("a")) & (F.col("epoch") == F.col("e")) & F.col("at").between(F.col("line_start"), F.col("line_end")))
    episode = met.groupBy("archive_path", "session_id", "n", "line_start", "line_end").agg(F.array_sort(F.collect_list(F.struct("at", "said"))).alias("s"), F.max(F.struct("at", "ts")).alias("end"))
    episode = episode.select(F.concat_ws(":", F.lit("episode"), "session_id", key, F.lpad(F.col("n").cast("string"), 5, "0")).alias("node_id"), F.lit("episode").alias("level"), "session_id", "archive_path", session.alias("parent_id"), "line_start", "line_end", F.col("end.ts").alias("timestamp"), F.array_join(F.transform("s", lambda x: x["said"]), "\n\n").alias("text"), none.alias("user"))

    # The first four, the last four and the prompts between; short sessions say some twice.
    order = Window.partitionBy("archive_path")
    p = exchange.withColumn("i", F.row_number().over(order.orderBy("line_start")) - 1).withColumn("n", F.count(F.lit(1)).over(order))
    i, n = F.col("i"), F.col("n")
    groups = F.array_compact(F.array(F.when(i < 4, 0), F.when(i >= n - 4, 1), F.when((i >= 4) & (i < n - 4), 2)))
    prompts = p.withColumn("g", F.explode(groups)).groupBy("archive_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "i", "user_message"))), lambda x: x["user_message"]), "\n").alias("prompts"))
    ends = exchange.groupBy("archive_path", "session_id").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.max(F.struct("line_start", "timestamp")).alias("last"))
    epochs = boundary.groupBy("archive_path").agg((F.count(F.lit(1)) + 1).alias("epochs"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("summary_text") != "", F.struct("line_number", F.col("summary_text").alias("s"))))), lambda x: x["s"]), "\n").alias("summary"))
    ranked = _keys(exchange).groupBy("archive_path", "term").agg(F.count(F.lit(1)).alias("df"))
    ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy("archive_path").orderBy(F.desc("df"), "term"))).filter(F.col("n") <= salient)
    terms = ranked.groupBy("archive_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "term"))), lambda x: x["term"]), " ").alias("salient"))
    s = ends.join(prompts, "archive_path").join(epochs, "archive_path", "left").join(terms, "archive_path", "left")
    if about is not None:
        s = s.join(about.select("archive_path", "project", "cwd", "git_branch"), "archive_path", "left")
    known = lambda name: F.coalesce(name, F.lit("")) if about is not None else F.lit("")
    body = F.concat_ws("\n", F.concat(F.lit("Project: "), known("project")), F.concat(F.lit("Working directory: "), known("cwd")), F.concat(F.lit("Git branch: "), known("git_branch")), F.concat(F.lit("Compaction epochs: "), F.coalesce("epochs", F.lit(1)).cast("string")), F.nullif("summary", F.lit("")), "prompts", F.concat(F.lit("Key terms: "), F.coalesce("salient", F.lit(""))))
    s = s.select(session.alias("node_id"), F.lit("session").alias("level"), "session_id", "archive_path", none.alias("parent_id"), "line_start", "line_end", F.col("last.timestamp").alias("timestamp"), body.alias("text"), none.alias("user"))
    return s.unionByName(episode).unionByName(parts)


def edges(made: DataFrame) -> DataFrame:
    """Parts of one exchange, consecutive exchanges, shared anchors."""
    t = made.filter("level = 'exchange'")
    same = links.following_edges(t, ["session_id", "line_start"], ["node_id"], "node_id", "same-exchange", links.SAME_EXCHANGE)
    primary = t.groupBy("session_id", "line_start").agg(F.min("node_id").alias("node_id"))
    following = links.following_edges(primary, ["session_id"], ["line_start"], "node_id", "temporal", links.TEMPORAL)
    shared = links.shared_anchor_edges(t.select("node_id", F.explode("anchors").alias("anchor")), "node_id")
    return same.unionByName(following).unionByName(shared)


def without_copies(exchange: DataFrame, forks: DataFrame) -> DataFrame:
    """Exchanges without those whose question a forked archive repeats from its parent session; an archive of copies only keeps
    them. forks: (archive_path, session_id, forked_from_id)."""
    parents = forks.filter("forked_from_id <> ''").select("archive_path", F.col("forked_from_id").alias("_parent"))
    said = turns.asked(exchange)
    marks = exchange.select(F.col("session_id").alias("_parent"), said.alias("_said")).distinct()
    own = exchange.select("id", "archive_path", said.alias("_said")).join(parents, "archive_path")
    held = own.join(marks, ["_parent", "_said"], "left_semi").select("id", "archive_path", F.lit(True).alias("_copy"))
    left = own.join(held.select("id"), "id", "left_anti").select("archive_path").distinct()
    gone = held.join(left, "archive_path", "left_semi").select("id")
    return exchange.join(gone, "id", "left_anti")


def tool_rows(events: DataFrame, exchange: DataFrame) -> DataFrame:
    """Tool events as nodes of their own, beside the exchange that holds them, with the anchors of all their text."""
    from tracewell.sources import events as transcripts

    of = exchange.groupBy("archive_path").agg(F.first("session_id").alias("session_id"), F.max("timestamp").alias("_late"))
    t = transcripts.tool_nodes(events, exchange).join(of, "archive_path")
    return t.select("node_id", F.lit("tool").alias("level"), "session_id", "archive_path", "parent_id", F.col("line").alias("line_start"), F.col("line").alias("line_end"), F.coalesce(F.nullif("timestamp", F.lit("")), "_late").alias("timestamp"), "text", F.lit(None).cast("string").alias("user"), F.col("anchors").alias("_found"))


def made(lines: DataFrame, events: DataFrame | None = None, sessions: DataFrame | None = None, kept: Callable[[DataFrame, str], DataFrame] = settled) -> tuple[DataFrame, DataFrame]:
    """(nodes, exchanges) of transcript lines. events and sessions (`sources.events`) add tool events, what is known of
    the archives, and forks, whose copied turns go. kept: writes both and reads them again."""
    exchange = turns.exchanges(lines)
    about = None
    if sessions is not None:
        about = sessions.withColumnRenamed("path", "archive_path")
        exchange = without_copies(exchange, about)
    exchange = kept(exchange, "exchanges")
    rows = nodes(exchange, turns.compactions(lines), about=about)
    if events is None:
        return kept(_features(rows), "nodes"), exchange
    tools = settled(tool_rows(events, exchange), "tools")
    with_tools = _features(rows.unionByName(tools.drop("_found")))
    # Tools are exchange nodes as all others; their anchors are those of all they said.
    more = tools.select("node_id", F.col("_found").alias("_more"))
    stable = F.filter(columns.stable_anchors(F.coalesce("_more", F.array().cast("array<string>"))), lambda a: a != "")
    with_tools = with_tools.join(more, "node_id", "left").withColumn("anchors", F.array_distinct(F.concat("anchors", stable))).drop("_more")
    return kept(with_tools.withColumn("level", F.when(F.col("level") == "tool", "exchange").otherwise(F.col("level"))), "nodes"), exchange


def build(lines: DataFrame, events: DataFrame | None = None, sessions: DataFrame | None = None) -> Index:
    """The index of transcript lines; `store.Store` keeps one on disk."""
    node, exchange = made(lines, events, sessions)
    return Index(node, exchange, settled(edges(node), "edges"))
