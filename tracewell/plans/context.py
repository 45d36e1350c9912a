"""Calls over the index, the ledger and the experiences: checked arguments, answers as large as the context allows.

Each call takes a table of requests, so that many are one job; what a single request would raise is a column `error`."""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.shipping import map_arrow
from tracewell.operators import evidence, ledger, lifecycle
from tracewell.sources.tables import settled

from . import recall as recalls
from .index import Index

# Bounds of arguments, modes and profiles, and what profiles show.
LEAST_QUERY, MOST_HITS, MOST_SESSION = 2, 20, 256
MODES, PROFILES = ("fast", "auto", "deep"), ("auto", "minimal", "compact", "standard", "diagnostic")
SNIPPETS, HITS = {"compact": 120, "standard": 240}, {"compact": 3}
CONTEXT_HITS, CONTEXT_EXPERIENCES = 4, 3
NOT_READY = "no index has been published yet, so nothing can be said from history"
SESSION_KEYS = ("session_id", "sessionId", "thread_id", "threadId", "conversation_id", "conversationId")
SESSION_HOLDERS = ("session", "thread", "conversation", "context", "client")
SESSION_DEPTH = 2


def valid_session(value: Any, source: str) -> str:
    """A session's id without blanks at its ends, "" for none; ids with blanks or control signs inside are refused."""
    name = str("" if value is None else value).strip()
    if len(name) > MOST_SESSION or any(c.isspace() or c < " " for c in name):
        raise ValueError(f"invalid session id from {source}")
    return name


def resolved_session(*named: Any, metadata: tuple[Any, ...] = (), environment: tuple[str, ...] = (), required: bool = True) -> str:
    """The first session id that is said: by an argument, by metadata (its own keys before those of what it holds, two
    levels deep), by a variable of the environment that the caller names. Another session is never guessed."""

    def said() -> Iterator[tuple[Any, str]]:
        yield from ((value, "arguments") for value in named)
        for whole in metadata:
            todo = [(whole, 0)]
            while todo:
                value, depth = todo.pop(0)
                if isinstance(value, Mapping):
                    yield from ((value[k], f"metadata {k}") for k in SESSION_KEYS if k in value)
                    # What a part holds comes before the next part.
                    todo = [(value[k], depth + 1) for k in SESSION_HOLDERS if k in value and depth < SESSION_DEPTH] + todo
        yield from ((os.environ.get(name), name) for name in environment)

    found = next((name for value, source in said() if (name := valid_session(value, source))), "")
    if required and not found:
        raise ValueError("session context unavailable; pass session_id or current_session_id")
    return found


def budgets(requests: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """requests with profile, max_chars, ranges and what they follow from. A request's own window, used tokens and profile
    count; what is missing comes from the session's transcript (session_id, context_window, visible_since), if there is
    an index. Without one, nothing is clamped to what remains."""
    own = lambda name, kind: F.coalesce(F.greatest(F.col(name).cast(kind), F.lit(0)), F.lit(0)) if name in requests.columns else F.lit(0).cast(kind)
    t = requests.withColumns({"_window": own("context_window", "long"), "_used": own("context_tokens_used", "long")})
    t = t.withColumn("detection_source", F.when(F.col("_window") > 0, "caller").otherwise("unknown"))
    if sessions is not None:
        known = sessions.select(F.col("session_id").alias("current_session_id"), F.col("context_window").alias("_own"), F.col("visible_since").alias("_said"))
        t = t.join(known, "current_session_id", "left")
        t = t.withColumn("detection_source", F.when((F.col("_window") == 0) & (F.col("_own") > 0), "transcript").otherwise(F.col("detection_source")))
        t = t.withColumns({"_window": F.when(F.col("_window") > 0, F.col("_window")).otherwise(F.coalesce("_own", F.lit(0))), "_used": F.when(F.col("_used") > 0, F.col("_used")).otherwise(F.coalesce(F.ceil(F.col("_said") / lifecycle.CHARS_PER_TOKEN), F.lit(0)))}).drop("_own", "_said")
    t = lifecycle.budgets(t, "_window", "_used")
    if "response_profile" in requests.columns:
        asked = F.coalesce("response_profile", F.lit("auto"))
        t = t.withColumn("profile", F.when(asked == "auto", F.col("profile")).otherwise(asked))
        t = lifecycle.sized(t, clamped=sessions is not None)
    elif sessions is None:
        t = lifecycle.sized(t, clamped=False)
    return t.withColumns({"context_window_tokens": F.nullif("_window", F.lit(0)), "estimated_tokens_used": F.nullif("_used", F.lit(0))}).drop("_window", "_used")


def checked(requests: DataFrame, limit: int, mode: str) -> DataFrame:
    """requests (query_id, query, ...) with error: what is wrong with a request, else null."""
    if not 1 <= limit <= MOST_HITS:
        raise ValueError(f"limit must be between 1 and {MOST_HITS}")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    short = F.length(F.trim(F.coalesce("query", F.lit("")))) < LEAST_QUERY
    error = F.when(short, "query must contain at least two characters")
    if "response_profile" in requests.columns:
        error = error.when(~F.coalesce("response_profile", F.lit("auto")).isin(*PROFILES), "invalid response_profile")
    return requests.withColumn("error", error)


def answered(of: Index | None, requests: DataFrame, sessions: DataFrame | None = None, limit: int = 8, mode: str = "auto") -> DataFrame:
    """One row a request (query_id, query, current_session_id, context_window, context_tokens_used, response_profile):
    the answer of recall in its profile's shape, index_not_ready where there is no index, or an error."""
    asked = budgets(checked(requests, limit, mode), None if of is None else sessions)
    asked = settled(asked, "requests")
    if of is None:
        return asked.select("query_id", F.trim("query").alias("query"), "error", "profile", "max_chars", F.when(F.col("error").isNull(), "index_not_ready").alias("answerability"), F.lit(False).alias("safe_to_answer"), F.when(F.col("error").isNull(), NOT_READY).alias("abstention_reason"))
    able = asked.filter("error is null")
    answers, hits = recalls.recall(of, able.select("query_id", F.trim("query").alias("query"), "current_session_id"), limit, mode)
    return profiled(asked, answers, hits, limit)


def by_profile(values: Mapping[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(F.col("profile") == name, F.lit(value)).otherwise(out)
    return out


def profiled(asked: DataFrame, answers: DataFrame, hits: DataFrame, limit: int) -> DataFrame:
    """Answers cut to their profiles: minimal has a locator only, compact three short hits, standard all hits with longer
    snippets and the calibration, diagnostic everything. Ranges stop at what the budget recommends."""
    hit = F.struct(*[c for c in ("rank", "node_id", "session_id", "archive_path", "line_start", "line_end", "context_line_start", "context_line_end", "timestamp", "confidence", "routes", "exact_match", "matched_anchors", "all_anchors", "snippet")])
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("results"))
    scores = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "similarity", "late_similarity", "coverage"))).alias("scores"))
    t = asked.select("query_id", F.trim("query").alias("query"), "error", "profile", "max_chars", F.col("ranges").alias("_most")).join(answers.drop("query"), "query_id", "left").join(listed, "query_id", "left").join(scores, "query_id", "left")
    cut = by_profile(SNIPPETS, 1 << 20)
    most = F.least(by_profile(HITS, limit), F.lit(limit))
    # Anchors of hits are checked as a whole by the plan.
    shown = F.transform(F.slice(F.coalesce("results", F.array().cast(listed.schema["results"].dataType)), F.lit(1), most), lambda h: h.withField("snippet", F.left(h["snippet"], cut)))
    top = F.get(F.col("results"), F.lit(0))
    first = F.when(F.col("results").isNotNull(), F.struct(*[top[c].alias(c) for c in ("session_id", "archive_path", "context_line_start", "context_line_end", "confidence", "exact_match")]))
    minimal, diagnostic = F.col("profile") == "minimal", F.col("profile") == "diagnostic"
    calibrated = F.col("profile").isin("standard", "diagnostic")
    reason = F.when(~F.col("safe_to_answer"), "evidence is weak, ambiguous or incomplete; do not answer from memory")
    return t.select(
        "query_id", "query", "error", "profile", "max_chars", "answerability", "safe_to_answer", reason.alias("abstention_reason"),
        F.slice("ranges", F.lit(1), F.greatest(F.col("_most"), F.lit(1))).alias("ranges"), "combined_coverage", (F.col("answerability") == "multi_evidence_found").alias("multi_evidence_supported"),
        F.when(minimal, first).alias("top_locator"), F.when(~minimal, shown).alias("results"),
        F.when(calibrated, F.struct("top_score_margin", "coverage", "similarity", "direct_anchor_bypass", "direct_anchor_absence_bypass", "ordinal_ambiguous")).alias("calibration"),
        F.when(diagnostic, F.col("scores")).alias("scores"),
    )


def prepared(of: Index | None, turns: DataFrame, experiences: DataFrame, sessions: DataFrame | None = None, include_recall: str = "auto") -> DataFrame:
    """One row a turn (session_id, turn, user_request, and what `budgets` reads): the task after it, the experiences that
    help, and recall where the request leans on history (or always, or never)."""
    if include_recall not in ("auto", "yes", "no"):
        raise ValueError("include_recall must be auto, yes or no")
    key = F.concat_ws("\0", "session_id", F.col("turn").cast("string"))
    rows = settled(turns.withColumn("query_id", key), "turns")
    task = ledger.transitions(rows.select("session_id", "turn", "user_request", F.lit("auto").alias("action")))
    cap = by_profile(ledger.PROFILE_ITEMS, ledger.MOST_ITEMS)
    asked = rows.withColumns({"query": F.col("user_request"), "current_session_id": F.col("session_id"), "response_profile": F.lit("auto")})
    size = budgets(asked, None if of is None else sessions).select("query_id", "profile", "max_chars", "ranges", "detection_source", "context_window_tokens", "estimated_tokens_used")
    size = size.withColumnRenamed("ranges", "recommended_ranges")
    help_ = ledger.recalled_experiences(experiences, asked.select("query_id", "query"), CONTEXT_EXPERIENCES)
    help_ = help_.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "experience_key", "score"))).alias("experiences"))
    history = F.lit(include_recall == "yes") if include_recall != "auto" else F.col("user_request").rlike(ledger.HISTORY)
    leaning = asked.filter(history).select("query_id", "query", "current_session_id", *[c for c in ("context_window", "context_tokens_used") if c in asked.columns], F.lit("auto").alias("response_profile"))
    answer = answered(of, leaning, sessions, CONTEXT_HITS)
    answer = answer.select("query_id", F.struct(*[c for c in answer.columns if c != "query_id"]).alias("recall"))
    task = task.select("session_id", "turn", F.col("transition").alias("task_transition"), F.col("reason").alias("task_transition_reason"), (F.col("transition") == "ambiguous").alias("task_needs_disambiguation"), "task_id", "objective", "items")
    out = rows.select("session_id", "turn", "query_id").join(task, ["session_id", "turn"], "left").join(size, "query_id").join(help_, "query_id", "left").join(answer, "query_id", "left")
    return out.withColumn("items", F.least(F.col("items"), cap)).drop("query_id")


RAW = "request_id string, evidence_text string, total_chars long, returned_chars long, complete boolean, next_offset_chars long, chunk_sha256 string, error string"


def raw_pages(requests: DataFrame, seeks: DataFrame) -> DataFrame:
    """Pages of raw lines: one row a request (request_id, archive_path, line_start, line_end, offset_chars, max_chars).

    Each request starts at the last seek point (archive_path, line_number, byte_offset, prefix_sha256, prefix_length) at
    or before its first line, whose bytes must be as they were; bytes that are no UTF-8 show as U+FFFD. Files are opened
    by tasks and read in pieces, whatever a line's length."""
    at = seeks.select("archive_path", F.struct("line_number", "byte_offset", "prefix_sha256", "prefix_length").alias("s"))
    near = requests.join(at, "archive_path", "left").groupBy(*requests.columns).agg(F.max(F.when(F.col("s.line_number") <= F.col("line_start"), F.col("s"))).alias("s"))
    wrong = F.when((F.col("line_start") < 1) | (F.col("line_end") < F.col("line_start")), "line_start and line_end must be a positive ordered range").when(F.col("offset_chars") < 0, "offset_chars must not be negative").when(~F.col("max_chars").between(evidence.LEAST_PAGE, evidence.MOST_PAGE), f"max_chars must be between {evidence.LEAST_PAGE} and {evidence.MOST_PAGE}").when(F.col("s").isNull(), "archive_path is not in the index")
    rows = near.select(F.col("request_id").cast("string").alias("request_id"), "archive_path", "line_start", "line_end", "offset_chars", "max_chars", "s.line_number", "s.byte_offset", "s.prefix_sha256", "s.prefix_length", wrong.alias("error"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in RAW.split(", ")]
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            out = [evidence.raw_page(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([o.get(n) for o in out], t) for n, t in zip(names, types, strict=True)], names=names)

    return map_arrow(rows, step, RAW)
