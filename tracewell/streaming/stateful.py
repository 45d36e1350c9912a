"""Streams: exchanges that grow as lines arrive, the task ledger, and retention with timers."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.functions.shipping import ship
from tracewell.operators import ledger, lifecycle, turns

EXCHANGE = "id string, archive_path string, line_start long, line_end long, user_message string, assistant_message string"
DECISION = "session_id string, decision string, reason string, missing_since long"


def exchanges(lines: DataFrame) -> DataFrame:
    """Exchanges of a stream of lines (archive_path, line, role, text), update mode: the last exchange of an archive comes
    again under the same id whenever it grows. What a user line is follows the rules of the batch (`turns`): meta lines
    stand aside, wrappers go, delegations open exchanges, those of approval reviews are not shown. State: the open
    exchange of each archive."""
    import hashlib

    ship(lines.sparkSession)
    lines = lines.withColumn("kind", F.when(F.col("role") == "user", turns.turn_kind(F.col("text")))).withColumn("asked", F.when(F.col("role") == "user", turns.user_text(F.col("text"))))

    def grow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        path = key[0]
        now = json.loads(state.get[0]) if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values("line").to_dict("records"):
            if r["role"] == "user" and r["kind"] != "meta":
                if now:
                    out.append(now | {"line_end": max(now["line_start"], r["line"] - 1)})
                mark = hashlib.sha256(f"{path}:{r['line']}".encode()).hexdigest()[:32]
                now = {"id": mark, "archive_path": path, "line_start": r["line"], "line_end": r["line"], "user_message": r["asked"], "assistant_message": "", "said": 0}
            elif now:
                if r["role"] == "assistant" and r["text"] is not None:
                    text = r["text"][: turns.EVENT_CHARS]
                    joined = f"{now['assistant_message']}\n{text}" if now["said"] else text
                    now |= {"assistant_message": joined[: turns.PENDING_CHARS], "said": now["said"] + 1}
                now["line_end"] = r["line"]
        if now:
            out.append(now)
            state.update((json.dumps(now),))
        shown = [{k: v for k, v in x.items() if k != "said"} for x in out if not x["user_message"].lstrip(" ").startswith(turns.REVIEW)]
        yield pd.DataFrame(shown, columns=[f.split(" ")[0] for f in EXCHANGE.split(", ")])

    return lines.groupBy("archive_path").applyInPandasWithState(grow, EXCHANGE, "state string", "update", GroupStateTimeout.NoTimeout)


def tasks(requests: DataFrame) -> DataFrame:
    """The task ledger over a stream of turns (session_id, turn, user_request, action). State: each session's task."""
    ship(requests.sparkSession)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        task = ledger.loaded(state.get[0]) if state.exists else None
        task, out = ledger.folded(key[0], pd.concat(list(batches)), task)
        state.update((ledger.dumped(task),))
        yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in ledger.TURN.split(", ")])

    return requests.groupBy("session_id").applyInPandasWithState(fold, ledger.TURN, "state string", "update", GroupStateTimeout.NoTimeout)


def watched(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState, grace_ms: int) -> Iterator[pd.DataFrame]:
    """The decision over a session from its new sightings or its timer."""
    columns = [f.split(" ")[0] for f in DECISION.split(", ")]
    if state.hasTimedOut:
        since = state.get[0]
        state.remove()
        yield pd.DataFrame([(key[0], "delete", "grace-period-over", since)], columns=columns)
        return
    last = pd.concat(list(batches)).sort_values("at_ms").iloc[-1]
    if last["archived"]:
        said = ("delete", "thread-archived", None)
    elif last["present"]:
        said = ("keep", "source-present", None)
    else:
        since = state.get[0] if state.exists else int(last["at_ms"])
        said = ("delete", "grace-period-over", since) if last["at_ms"] - since >= grace_ms else ("wait", "source-missing", since)
    if said[0] == "wait":
        state.update((said[2],))
        # What is left of the grace, however often the source is seen missing.
        state.setTimeoutDuration(max(1, grace_ms - (int(last["at_ms"]) - said[2])))
    elif state.exists:
        state.remove()
    yield pd.DataFrame([(key[0], *said)], columns=columns)


def retention(sightings: DataFrame, grace_ms: int = lifecycle.GRACE_MS) -> DataFrame:
    """Decisions over a stream of sightings (session_id, at_ms, present, archived). A session that is gone starts a timer;
    it is deleted when the timer ends, on its own, or kept when it comes back first. State: since when it is missing."""
    ship(sightings.sparkSession)

    def watch(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return watched(key, batches, state, grace_ms)

    return sightings.groupBy("session_id").applyInPandasWithState(watch, DECISION, "since long", "update", GroupStateTimeout.ProcessingTimeTimeout)
