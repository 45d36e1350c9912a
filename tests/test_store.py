"""The index on disk, calls over it, raw pages, and streams that follow the batch rules."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import ledger, turns, vectors
from tracewell.plans import context, index
from tracewell.plans.store import Store, status
from tracewell.sources import events, lines
from tracewell.streaming import stateful

LINES = "archive_path string, session_id string, line long, role string, text string, timestamp string"
TALKS = {
    "alpha": [("user", "Which tokenizer checkpoint did we freeze for the harbour project?"), ("assistant", "We froze commit 9f8e7d6c5b4a for the harbour tokenizer.")],
    "beta": [("user", "Plan the garden irrigation with rain sensors"), ("assistant", "Use two valves and one rain sensor."), ("user", "And the pump?"), ("assistant", "A small solar pump drives the irrigation.")],
    "gamma": [("user", "What is the learning rate at first?"), ("assistant", "The learning rate is one percent.")],
}


def table(spark, talks):
    return spark.createDataFrame([(f"talks/{k}", k, i + 1, role, body, f"2024-01-01T00:00:{i:02d}") for k, t in talks.items() for i, (role, body) in enumerate(t)], LINES)


def levels(of):
    return {r["what"]: r["rows"] for r in status(of).collect()}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    kept = Store(spark, "file://" + str(tmp_path_factory.mktemp("store")))
    kept.report = kept.sync(table(spark, TALKS))
    return kept


def test_archives_are_synchronised_one_by_one(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    assert store.snapshot() is None and store.versions() == []
    assert store.sync(table(spark, TALKS)) == {"unchanged": 0, "new": 3, "changed": 0, "stale": 0, "version": 1}
    first = store.snapshot()
    assert store.sync(table(spark, TALKS)) == {"unchanged": 3, "new": 0, "changed": 0, "stale": 0, "version": 1}
    grown = {**TALKS, "beta": [*TALKS["beta"], ("user", "Thanks, what about frost?"), ("assistant", "Drain the valves.")]}
    del grown["gamma"]
    grown["delta"] = [("user", "a new talk about sails"), ("assistant", "sails and masts")]
    before = levels(first)
    assert store.sync(table(spark, grown)) == {"unchanged": 1, "new": 1, "changed": 1, "stale": 1, "version": 2}
    after = store.snapshot()
    assert levels(first) == before  # a reader keeps the version that it opened
    whole = index.build(table(spark, grown))
    assert levels(after) == levels(whole)
    columns = [c for c in whole.nodes.columns if c not in ("embedding", "facets")]
    rows = lambda i: sorted(map(str, i.nodes.select(*columns).collect()))
    assert rows(after) == rows(whole) and sorted(map(str, after.edges.collect())) == sorted(map(str, whole.edges.collect()))
    assert store.vacuum() > 0 and store.versions() == [2] and rows(store.snapshot()) == rows(whole)


def test_a_version_without_a_manifest_does_not_exist(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    store.sync(table(spark, TALKS))
    spark.range(3).write.parquet(f"file://{tmp_path}/data/2/nodes")  # a writer that died
    (tmp_path / "manifest/2").mkdir()
    assert store.versions() == [1] and levels(store.snapshot())["archives"] == 3
    assert store.sync(table(spark, {"beta": TALKS["beta"]}))["version"] == 3 and levels(store.snapshot())["archives"] == 1
    store.vacuum()
    assert store.versions() == [3] and not (tmp_path / "data/2").exists()


def test_status_reads_the_index(store):
    got = levels(store.snapshot())
    assert got["nodes:session"] == 3 and got["nodes:exchange"] == 4 and got["archives"] == 3 and got["tool nodes"] == 0 and got["edges:temporal"] >= 1 and got["facets"] >= 10


REQUEST = "query_id string, query string, current_session_id string, context_window long, context_tokens_used long, response_profile string"


def test_calls_without_an_index_say_so(spark):
    asked = spark.createDataFrame([("a", "solar pump", None, 1000, 950, "auto"), ("b", "x", None, None, None, "auto"), ("c", "solar pump", None, None, None, "loud")], REQUEST)
    got = {r["query_id"]: r for r in context.answered(None, asked).collect()}
    assert got["a"]["answerability"] == "index_not_ready" and not got["a"]["safe_to_answer"] and got["a"]["profile"] == "minimal" and got["a"]["max_chars"] == 4000
    assert got["b"]["error"] == "query must contain at least two characters" and got["c"]["error"] == "invalid response_profile" and got["b"]["answerability"] is None
    with pytest.raises(ValueError):
        context.answered(None, asked, limit=21)
    with pytest.raises(ValueError):
        context.answered(None, asked, mode="slow")


def test_profiles_say_less_and_less(spark, store):
    asked = spark.createDataFrame([(p, "solar pump for irrigation valves", None, None, None, p) for p in context.PROFILES[1:]], REQUEST)
    rows = {r["query_id"]: r for r in context.answered(store.snapshot(), asked).collect()}
    size = {p: len(json.dumps({k: v for k, v in r.asDict(recursive=True).items() if v is not None}, default=str)) for p, r in rows.items()}
    assert size["minimal"] < 2500 and size["minimal"] < size["compact"] <= size["standard"] < size["diagnostic"]
    assert rows["minimal"]["results"] is None and rows["minimal"]["top_locator"]["session_id"] == "beta" and rows["minimal"]["calibration"] is None
    assert len(rows["compact"]["results"]) <= 3 and all(len(h["snippet"]) <= 120 for h in rows["compact"]["results"])
    assert rows["standard"]["calibration"] and rows["standard"]["scores"] is None and rows["diagnostic"]["scores"]
    assert {r["answerability"] for r in rows.values()} == {"evidence_found"}


def test_budgets_come_from_transcripts_where_callers_say_nothing(spark):
    sessions = spark.createDataFrame([("s", 1000, 2280)], "session_id string, context_window long, visible_since long")
    asked = spark.createDataFrame([("a", "q", "s", None, None, "auto"), ("b", "q", "s", 100_000, 10, "auto"), ("c", "q", "t", None, None, "auto"), ("d", "q", "s", None, None, "standard")], REQUEST)
    got = {r["query_id"]: r for r in context.budgets(asked, sessions).collect()}
    assert (got["a"]["profile"], got["a"]["detection_source"], got["a"]["max_chars"], got["a"]["estimated_tokens_used"]) == ("minimal", "transcript", 1000, 950)
    assert (got["b"]["profile"], got["b"]["detection_source"]) == ("standard", "caller") and (got["c"]["detection_source"], got["c"]["max_chars"]) == ("unknown", 24_000)
    assert (got["d"]["profile"], got["d"]["max_chars"]) == ("standard", 1000)


def test_contexts_are_prepared(spark, store):
    said = [("alpha", 1, "Write a parser for logs"), ("alpha", 2, "as we did last time with the solar pump irrigation"), ("alpha", 3, "ok")]
    rows = spark.createDataFrame(said, "session_id string, turn long, user_request string")
    known = spark.createDataFrame([("parse-logs", "Log parser", "logs", "write a parser for logs by lines", "worked", "2024-01-01")], "experience_key string, title string, situation string, guidance string, outcome string, updated_at string")
    got = {r["turn"]: r for r in context.prepared(store.snapshot(), rows, known).collect()}
    assert got[1]["task_transition"] == "started" and got[1]["experiences"][0]["experience_key"] == "parse-logs" and got[1]["recall"] is None
    assert got[2]["recall"]["answerability"] is not None and got[3]["task_transition"] == "unchanged" and got[3]["objective"] == got[1]["objective"]
    never = {r["turn"]: r for r in context.prepared(None, rows, known, include_recall="yes").collect()}
    assert all(r["recall"]["answerability"] == "index_not_ready" for r in never.values())


def test_sessions_are_never_guessed(monkeypatch):
    assert context.resolved_session(None, "b", metadata=({"session_id": "c"},)) == "b"
    assert context.resolved_session("", None, metadata=({"client": {"context": {"threadId": "deep"}}}, {"sessionId": "late"})) == "deep"
    assert context.resolved_session(metadata=({"session": {"session": {"session": {"session_id": "too deep"}}}},), required=False) == ""
    monkeypatch.setenv("OWN_SESSION", "env")
    assert context.resolved_session(environment=("OWN_SESSION",)) == "env"
    with pytest.raises(ValueError):
        context.resolved_session(environment=("NO_SUCH",))
    with pytest.raises(ValueError):
        context.resolved_session("a b")


def test_raw_pages_rebuild_the_bytes(spark, tmp_path):
    file = tmp_path / "a.jsonl"
    body = [b'{"n": 1}', b"\xff\xfe broken " + "é".encode()[:1], ("日本" * 900).encode(), b"last"]
    file.write_bytes(b"\n".join(body) + b"\n")
    at, seeks = 0, []
    for n, line in enumerate(body):
        if n % 2 == 0:
            seeks.append((str(file), n + 1, at, hashlib.sha256(file.read_bytes()[at : at + 8]).hexdigest(), 8))
        at += len(line) + 1
    seek = spark.createDataFrame(seeks, "archive_path string, line_number long, byte_offset long, prefix_sha256 string, prefix_length int")
    schema = "request_id string, archive_path string, line_start long, line_end long, offset_chars long, max_chars long"
    ask = lambda *rows: {r["request_id"]: r for r in context.raw_pages(spark.createDataFrame(rows, schema), seek).collect()}
    whole = (b"\n".join(body[1:3]) + b"\n").decode("utf-8", "replace")
    text, offset = "", 0
    while offset is not None:
        page = ask(("p", str(file), 2, 3, offset, 1000))["p"]
        text, offset = text + page["evidence_text"], page["next_offset_chars"]
    assert text == whole and page["complete"] and page["total_chars"] == len(whole)
    wrong = ask(("a", str(file), 0, 3, 0, 1000), ("b", str(file), 3, 2, 0, 1000), ("c", str(file), 1, 1, -1, 1000), ("d", str(file), 1, 1, 0, 10), ("e", "nowhere", 1, 1, 0, 1000))
    assert all(r["error"] for r in wrong.values()) and len(wrong) == 5
    file.write_bytes(b"X" + file.read_bytes()[1:])
    assert "changed" in ask(("p", str(file), 1, 1, 0, 1000))["p"]["error"]


def transcript(folder, name, session, turns_, parent=None):
    said = lambda role, body: {"timestamp": "2024-01-01T00:00:00Z", "type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": "input_text", "text": body}]}}
    head = {"type": "session_meta", "payload": {"id": session, "cwd": "/work/river", "git": {"branch": "main"}, **({"forked_from_id": parent} if parent else {})}}
    rows = [head, *(said("user" if i % 2 == 0 else "assistant", x) for i, x in enumerate(turns_))]
    rows.insert(3, {"type": "response_item", "payload": {"type": "function_call", "name": "gauge", "arguments": {"path": f"/srv/{session}/depth-0001.csv", "note": "needle_value_77"}}})
    (folder / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")


def test_transcripts_reach_the_index_with_tools_and_without_copies(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    transcript(folder, "one", "north", ["measure the river", "it is deep", "and the lake", "it is shallow"])
    transcript(folder, "two", "south", ["measure the river", "it is deep", "something new here", "yes, new"], parent="north")
    lines.register(spark)
    found = index.settled(events.parsed(spark.read.format("bounded_lines").load(str(folder))), "events")
    sessions = events.sessions(found)
    store = Store(spark, f"file://{tmp_path}/index")
    store.sync(events.as_lines(found, sessions), found, sessions)
    of = store.snapshot()
    asked = {r["user_message"]: r["session_id"] for r in of.exchanges.collect()}
    assert asked["something new here"] == "south" and sorted(r["session_id"] for r in of.exchanges.filter("user_message = 'measure the river'").collect()) == ["north"]
    tools = of.nodes.filter(F.col("node_id").startswith("exchange:tool:")).collect()
    assert len(tools) == 2 and all(t["level"] == "exchange" and "needle_value_77" in t["text"] for t in tools)
    assert {"/srv/north/depth-0001.csv"} <= {a for t in tools for a in t["anchors"]}
    assert levels(of)["tool nodes"] == 2
    body = of.nodes.filter("level = 'session'").first()["text"]
    assert body.startswith("Project: river\nWorking directory: /work/river\nGit branch: main\n")
    asked = spark.createDataFrame([("q", "where is /srv/south/depth-0001.csv", None, None, None, "diagnostic")], REQUEST)
    got = context.answered(of, asked).first()
    assert got["results"][0]["session_id"] == "south" and "/srv/south/depth-0001.csv" in got["results"][0]["matched_anchors"]


def test_ties_of_dense_search_go_by_time_and_key(spark):
    rows = [(i, "2024" if i != 4 else "2025", [1.0, 0.0]) for i in range(6)] + [(9, "2024", [0.5, 0.5])]
    for parts in (1, 3):
        nodes = spark.createDataFrame(rows, "node_id long, timestamp string, embedding array<float>").repartition(parts)
        asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
        got = [(r["rank"], r["node_id"]) for r in vectors.dense_top(nodes, asked, 3).orderBy("rank").collect()]
        assert got == [(1, 4), (2, 0), (3, 1)]


def test_experiences_are_ranked_as_pairs_would_be(spark):
    r = random.Random(1)
    words = [f"word{i}" for i in range(40)]
    rows = [(f"key-{i}", " ".join(r.sample(words, 3)), "", " ".join(r.sample(words, 8)), "", f"2024-01-{1 + i % 28:02d}") for i in range(60)]
    known = spark.createDataFrame(rows, "experience_key string, title string, situation string, guidance string, outcome string, updated_at string").repartition(5)
    asks = [(f"q{i}", " ".join(r.sample(words, 4))) for i in range(6)] + [("q9", "key-3"), ("q8", "nothing alike")]
    got = {}
    for x in ledger.recalled_experiences(known, spark.createDataFrame(asks, "query_id string, query string")).collect():
        got.setdefault(x["query_id"], {})[x["rank"]] = (x["experience_key"], x["score"])
    from tracewell.functions import text

    for name, query in asks:
        own, scored = text.routing_terms(query), []
        for key, title, situation, guidance, outcome, at in rows:
            body = "\n".join((title, situation, guidance, outcome))
            have = set(text.routing_terms(body))
            score = 0.62 * sum(t in have for t in own) / max(1, len(own)) + 0.38 * max(0.0, float(text.embed(query) @ text.embed(body))) + 0.5 * (text.normalize(query) in text.normalize(body) or text.normalize(query) == key)
            scored.append((round(score, 3), at, key))
        best = [s for s in sorted(scored, key=lambda s: (-s[0], tuple(-ord(c) for c in s[1]), s[2])) if s[0] >= 0.12][:3]
        assert [round(got.get(name, {})[k + 1][1], 3) for k in range(len(best))] == pytest.approx([s[0] for s in best], abs=2e-3)


def drained(stream, name):
    stream.writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).start().awaitTermination(120)


def test_streamed_exchanges_follow_the_batch_rules(spark, tmp_path):
    talk = [("user", "<environment_context>x</environment_context>"), ("assistant", "nobody asked"), ("user", "  measure <in-app-browser-context a='1'>zz</in-app-browser-context> it"), ("assistant", ""), ("assistant", "deep"), ("user", "<recommended_plugins>p"), ("assistant", "more"), ("user", turns.REVIEW + " go"), ("assistant", "reviewed"), ("user", turns.DELEGATION + " do it"), ("assistant", "done"), ("tool", "x")]
    rows = [("a", "s", i + 1, role, body, "") for i, (role, body) in enumerate(talk)]
    for n in range(0, len(rows), 5):
        spark.createDataFrame(rows[n : n + 5], LINES).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    source = spark.readStream.schema(LINES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    drained(stateful.exchanges(source), "ruled")
    last = {}
    for r in spark.table("ruled").collect():
        if r["id"] not in last or r["line_end"] >= last[r["id"]]["line_end"]:
            last[r["id"]] = r
    keys = ["id", "line_start", "line_end", "user_message", "assistant_message"]
    want = turns.exchanges(spark.createDataFrame(rows, LINES)).select(*keys).collect()
    assert sorted(tuple(r[k] for k in keys) for r in last.values()) == sorted(map(tuple, want)) and len(want) == 2


def test_timers_run_for_what_is_left_of_the_grace():
    """Seen missing again and again, a session is deleted a grace after the first time."""
    class State:
        exists, value, timeout, hasTimedOut = False, None, None, False

        @property
        def get(self):
            return self.value

        def update(self, value):
            self.exists, self.value = True, value

        def setTimeoutDuration(self, ms):
            self.timeout = ms

        def remove(self):
            self.exists, self.value = False, None

    import pandas as pd

    state, day = State(), 24 * 3600 * 1000
    for at, left in ((0, 7 * day), (3 * day, 4 * day), (6 * day, day)):
        rows = pd.DataFrame([("s", at, False, False)], columns=["session_id", "at_ms", "present", "archived"])
        said = next(iter(stateful.watched(("s",), iter([rows]), state, 7 * day)))
        assert said.iloc[0]["decision"] == "wait" and state.timeout == left
    rows = pd.DataFrame([("s", 7 * day, False, False)], columns=["session_id", "at_ms", "present", "archived"])
    assert next(iter(stateful.watched(("s",), iter([rows]), state, 7 * day))).iloc[0]["decision"] == "delete"
