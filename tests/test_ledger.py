"""Tasks, experiences, retention, evidence pages, content rules, transcripts and streams."""

import json

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.operators import evidence, intervals, ledger, lifecycle, scan
from tracewell.sources import events, lines
from tracewell.streaming import stateful


def run(*requests, action="auto"):
    task, out = None, []
    for r in requests:
        task, said = ledger.turned("s", task, r, action)
        out.append((said["transition"], said["reason"]))
    return task, out


def test_turns_change_tasks_only_when_sure():
    task, out = run("Design a water meter parser\nIt must reject negative values", "ok", "what is the status?", "also add a unit test", "switch task: write a poem about rivers")
    assert [t for t, _ in out] == ["started", "unchanged", "unchanged", "amended", "replaced"]
    assert {i["kind"] for i in ledger.items_of("It must run\nVerify the output; draw a map")} == {"constraint", "acceptance", "requirement"}
    assert run("Parse the meter file")[0].objective == "Parse the meter file"
    assert ledger.turned("s", task, "", "complete") == (None, {"transition": "cleared", "reason": "complete", "similarity": None, "overlap": None})
    assert run("Parse the meter file", "zebra umbrella xylophone")[1][1] == ("ambiguous", "preserve_active_task")


def test_amending_keeps_the_objective_and_the_last_items():
    task, _ = run("Build the report", *[f"also add section number {i} to it" for i in range(30)])
    assert task.objective == "Build the report" and len(task.items) == 18 and "29" in task.items[-1]["text"]
    assert len(task.shown("minimal")["items"]) == 4 and ledger.loaded(ledger.dumped(task)) == task and ledger.loaded("") is None
    assert "Build the report" in ledger.hint("s", task) and ledger.needs_history("what did we say last time?")


def test_transitions_fold_each_session(spark):
    rows = [("a", 1, "Write a parser for logs", "auto"), ("a", 2, "thanks", "auto"), ("b", 1, "Draw a map of rivers", "auto"), ("a", 3, "cancel that", "clear"), ("b", 2, None, "auto")]
    got = {(r["session_id"], r["turn"]): r["transition"] for r in ledger.transitions(spark.createDataFrame(rows, "session_id string, turn long, user_request string, action string")).collect()}
    assert got == {("a", 1): "started", ("a", 2): "unchanged", ("a", 3): "cleared", ("b", 1): "started", ("b", 2): "rejected"}


def test_experiences(spark):
    rows = [("rotate-logs", 1, "Rotate logs", "disk full", "compress and rotate the old logs", "space", "1"), ("rotate-logs", 2, "Rotate logs", "disk full", "delete logs older than a month", "space", "2"), ("bake-bread", 1, "Bake bread", "hungry", "knead the dough", "bread", "1"), ("gone", 1, "logs", "logs", "logs", "logs", "1")]
    df = spark.createDataFrame(rows, "experience_key string, version int, title string, situation string, guidance string, outcome string, updated_at string")
    current = ledger.current_experiences(df, spark.createDataFrame([("gone",)], "experience_key string"))
    assert {(r["experience_key"], r["version"]) for r in current.collect()} == {("rotate-logs", 2), ("bake-bread", 1)}
    got = ledger.recalled_experiences(current, spark.createDataFrame([("q", "logs fill the disk")], "query_id string, query string")).collect()
    assert got[0]["experience_key"] == "rotate-logs" and got[0]["score"] >= 0.12


@pytest.mark.parametrize("known", [True, False])
def test_retention(spark, known):
    now, week = 10_000_000_000, lifecycle.GRACE_MS
    ids = ["archived", "short", "present", "stale", "fresh", "legacy"]
    archives = spark.createDataFrame([(i, i != "legacy") for i in ids], "session_id string, crossed boolean")
    threads = spark.createDataFrame([("archived", True)], "session_id string, archived boolean") if known else None
    sources = spark.createDataFrame([("short", False), ("present", True)], "session_id string, long boolean")
    missing = spark.createDataFrame([("stale", now - week), ("fresh", now - 5)], "session_id string, missing_since long")
    got = {r["session_id"]: (r["decision"], r["reason"]) for r in lifecycle.retention(archives, threads, sources, missing, now).collect()}
    assert got["short"] == ("delete", "below-compaction-boundary") and got["present"] == ("keep", "source-present") and got["stale"] == ("delete", "grace-period-over")
    assert got["fresh"] == ("wait", "source-missing") and got["legacy"] == ("delete", "legacy-short-archive")
    assert got["archived"] == (("delete", "thread-archived") if known else ("wait", "source-missing"))


def test_pages_join_to_the_whole(spark):
    rows = [("a", i, ("user", "assistant")[i % 2], f"line {i} " + "é" * (i * 37 % 900), "t") for i in range(1, 30)]
    df = spark.createDataFrame(rows, "archive_path string, line long, role string, text string, timestamp string")
    for view in ("raw", "text"):
        shown = evidence.rendered(df, view).cache()
        whole = "".join(r["rendered"] for r in shown.filter("line between 3 and 20").orderBy("line").collect())
        at, out = 0, ""
        while at is not None:
            ask = spark.createDataFrame([("q", "a", 3, 20, at, 4000)], "request_id string, archive_path string, line_start int, line_end int, offset_chars int, max_chars int")
            r = evidence.page(shown, ask).collect()[0]
            out, at = out + r["evidence_text"], r["next_offset_chars"]
        assert out == whole


def test_media_view_is_bounded(spark):
    rows = [("a", i, "tool", f"[attachment {i}] shot", "") for i in range(1, 21)] + [("a", 21, "tool", "no media", ""), ("a", 22, "assistant", "x" * 9000, ""), ("a", 23, "assistant", "x" * 9000, "")]
    got = evidence.rendered(spark.createDataFrame(rows, "archive_path string, line long, role string, text string, timestamp string"), "media").orderBy("line").collect()
    assert [r["line"] for r in got] == [*range(1, 10), 22] and got[8]["role"] == "media-navigation" and "omitted 3000 middle chars" in got[9]["rendered"]


def test_integrity(spark):
    was = spark.createDataFrame([(n, 100, 1, "t") for n in ("same", "grew", "shrank", "changed", "rewritten", "missing")], "archive_path string, size long, mtime long, tail_sha256 string")
    now = spark.createDataFrame([("same", 100, 1, "t"), ("grew", 120, 2, "t"), ("shrank", 90, 2, "t"), ("changed", 100, 2, "t"), ("rewritten", 120, 2, "u")], "archive_path string, size long, mtime long, tail_sha256 string")
    got = {r["archive_path"]: r["state"] for r in evidence.integrity(now, was).collect()}
    assert got == {"same": "same", "grew": "grew", "shrank": "shrank", "changed": "changed", "rewritten": "not-append-only", "missing": "missing"}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 60)), min_size=1, max_size=12), st.lists(st.tuples(st.integers(0, 300), st.integers(0, 60)), min_size=1, max_size=12))
def test_ranges_meet_once(spark, left, right):
    a = spark.createDataFrame([("g", i, s, s + n) for i, (s, n) in enumerate(left)], "g string, l int, a_start long, a_end long")
    b = spark.createDataFrame([("g", i, s, s + n) for i, (s, n) in enumerate(right)], "g string, r int, b_start long, b_end long")
    got = sorted((x["l"], x["r"]) for x in intervals.overlapping(a, b, "g", 16).collect())
    assert got == sorted((i, j) for i, (s, n) in enumerate(left) for j, (t, m) in enumerate(right) if s + n >= t and s <= t + m)


def test_rules_find_and_spare(spark):
    body = "fine\nmail a.b@c.org now\npassword = abcdefghijkl1\n-----BEGIN PRIVATE KEY-----\n/Users/someone/x"
    df = spark.createDataFrame([("a.txt", body), ("b.zip", "x"), ("c.bin", "a\0b@c.org"), ("d.txt", None)], "path string, text string")
    got = {(r["path"], r["line"], r["rule"]) for r in scan.findings(df, "path", "text", denied=("FINE",)).collect()}
    assert got == {("a.txt", 1, "private-denylist"), ("a.txt", 2, "email-address"), ("a.txt", 3, "credential-assignment"), ("a.txt", 4, "private-key"), ("a.txt", 5, "personal-home-path"), ("b.zip", 0, "forbidden-publishable-file"), ("c.bin", 0, "binary-artifact")}


def archive(folder):
    def said(role, body):
        return {"timestamp": "2024-01-01T00:00:00Z", "type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": "input_text", "text": body}]}}

    rows = [
        {"type": "session_meta", "payload": {"id": "first-id", "cwd": "/work/river", "git": {"branch": "main"}, "context_window": 1000}}, {"type": "session_meta", "payload": {"id": "parent-id"}},
        said("user", "<environment_context>x</environment_context>"), said("user", "measure the river"), {"type": "event_msg", "payload": {"type": "user_message", "message": "measure the river"}}, said("assistant", "it is deep"),
        {"type": "response_item", "payload": {"type": "function_call", "name": "gauge", "arguments": {"path": "/srv/river/depth.csv", "image": "data:image/png;base64," + "A" * 40}}},
        {"type": "response_item", "payload": {"type": "reasoning", "encrypted_content": "hidden"}}, {"type": "compacted", "payload": {"message": "so far so deep"}}, said("user", "and the lake?"), said("assistant", "B" * 3000),
    ]
    file = folder / "0123abcd-0000-0000-0000-0123456789ab.jsonl"
    file.write_text("\n".join(json.dumps(r) for r in rows) + "\nnot json\n[1]\n")
    return file


def test_transcripts_become_exchanges(spark, tmp_path):
    from tracewell.operators import turns

    archive(tmp_path)
    lines.register(spark)
    raw = spark.read.format("bounded_lines").load(str(tmp_path))
    rows = raw.orderBy("line").collect()
    assert [r["line"] for r in rows] == list(range(1, 14)) and all(a["next_offset"] == b["byte_offset"] for a, b in zip(rows, rows[1:], strict=False))
    found = events.parsed(raw).cache()
    session = events.sessions(found)
    s = session.collect()[0]
    assert (s["session_id"], s["project"], s["git_branch"], s["context_window"]) == ("first-id", "river", "main", 1000)
    t = events.as_lines(found, session)
    ex = turns.exchanges(t).orderBy("line_start").collect()
    assert [(e["line_start"], e["line_end"], e["user_message"]) for e in ex] == [(4, 9, "measure the river"), (10, 13, "and the lake?")]
    assert "it is deep" in ex[0]["assistant_message"] and "depth.csv" in ex[0]["assistant_message"] and "hidden" not in ex[0]["assistant_message"]
    assert ex[1]["assistant_message"] == "[opaque payload omitted from index: 3000 chars]"
    assert [c["line_number"] for c in turns.compactions(t).collect()] == [9]
    tool = events.tool_nodes(found, turns.exchanges(t)).collect()[0]
    assert tool["parent_id"] == f"exchange:{ex[0]['id']}:000" and "/srv/river/depth.csv" in tool["anchors"] and "kind=data" in tool["text"]


def test_oversized_lines_are_drained(tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "MOST_BYTES", 1000)
    monkeypatch.setattr(lines, "CHUNK", 64)
    monkeypatch.setattr(lines, "EDGE", 100)
    file = tmp_path / "x.jsonl"
    big = b'{"role":"user","text":"' + b"word " * 500 + b'needle_in_the_middle ' + b"word " * 500 + b'"}'
    file.write_bytes(b"{}\n" + big + b"\n{}")
    with file.open("rb") as handle:
        rows = list(lines.bounded_lines(handle, "x"))
    assert [r[11] for r in rows] == [False, True, False] and rows[1][4] is None and rows[1][10] == len(big) + 1 and "needle_in_the_middle" in rows[1][12]
    assert rows[1][5] == big[:100] and rows[1][6] == (big + b"\n")[-100:] and rows[2][2] == rows[1][3]


def drained(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_streams_grow_exchanges_and_refuse_rewritten_files(spark, tmp_path):
    lines.register(spark)
    folder, file = tmp_path / "in", tmp_path / "in/a.jsonl"
    folder.mkdir()
    file.write_text("one\ntwo\n")
    reader = lines.LineStream(str(folder))
    first = reader.latestOffset()
    file.write_text("one\ntwo\nthree\npart")
    second = reader.latestOffset()
    parts = reader.partitions(first, second)
    assert [r[4] for p in parts for r in reader.read(p)] == [b"three\n"]
    file.write_text("ONE\ntwo\nthree\nfour\n")
    with pytest.raises(RuntimeError):
        reader.partitions(first, reader.latestOffset())


def test_stateful_folds_equal_batch(spark, tmp_path):
    schema = "archive_path string, line long, role string, text string"
    talk = [("a", 1, "user", "hi"), ("a", 2, "assistant", "yes"), ("a", 3, "assistant", "and"), ("a", 4, "user", "more"), ("b", 1, "user", "solo")]
    for n, part in enumerate((talk[:2], talk[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    drained(stateful.exchanges(source), "grown")
    last = {}
    for r in spark.table("grown").collect():
        if r["id"] not in last or r["line_end"] >= last[r["id"]]["line_end"]:
            last[r["id"]] = r
    assert sorted((r["archive_path"], r["line_start"], r["line_end"], r["assistant_message"]) for r in last.values()) == [("a", 1, 3, "yes\nand"), ("a", 4, 4, ""), ("b", 1, 1, "")]


def test_streamed_tasks_equal_batch(spark, tmp_path):
    schema = "session_id string, turn long, user_request string, action string"
    rows = [("a", 1, "Write a parser for logs", "auto"), ("a", 2, "also handle dates", "auto"), ("a", 3, "ok", "auto")]
    for n, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    drained(stateful.tasks(source), "tasks")
    got = sorted((r["turn"], r["transition"], r["items"]) for r in spark.table("tasks").collect())
    want = sorted((r["turn"], r["transition"], r["items"]) for r in ledger.transitions(spark.createDataFrame(rows, schema)).collect())
    assert got == want


def test_folds_do_not_depend_on_batches():
    rows = pd.DataFrame([("a", i, t, "auto") for i, t in enumerate(["Write a parser", "also dates", "thanks", "new task: paint"])], columns=["session_id", "turn", "user_request", "action"])
    whole = ledger.folded("a", rows, None)
    task, out = None, []
    for i in range(4):
        task, more = ledger.folded("a", rows.iloc[[i]], task)
        out += more
    assert (task, out) == whole
