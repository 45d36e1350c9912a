"""Golden behaviour of recall on a small corpus of invented conversations."""

import sqlite3
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.operators import lexical, turns, vectors
from tracewell.plans import catalogue, index, recall

TALKS = {
    "alpha": [("user", "Which tokenizer checkpoint did we freeze for the harbour project?"), ("assistant", "We froze commit 9f8e7d6c5b4a for the harbour tokenizer."), ("system", "summary of the harbour work"), ("user", "Where are the logs of job-4711?"), ("assistant", "They are in /srv/logs/job-4711/run.log on the build host."), ("user", "What is the latest learning rate?"), ("assistant", "The learning rate is three percent.")],
    "beta": [("user", "Plan the garden irrigation with rain sensors"), ("assistant", "Use two valves and one rain sensor."), ("user", "And the pump?"), ("assistant", "A small solar pump drives the irrigation valves.")],
    "gamma": [("user", "<environment_context>x</environment_context>"), ("user", "Plan the garden irrigation with rain sensors"), ("assistant", "Use two valves and one rain sensor.")],
    "delta": [("assistant", "nobody asked"), ("user", "What is the learning rate at first?"), ("assistant", "The learning rate is one percent.")],
}
ASKED = [
    ("commit", "who froze 9f8e7d6c5b4a", None), ("path", "open /srv/logs/job-4711/run.log", None), ("absent", "find 0xdeadbeefcafe", None), ("topic", "solar pump for irrigation valves", None),
    ("copy", "Plan the garden irrigation with rain sensors", None), ("nothing", "quantum chromodynamics lattice", None), ("nth", "the second message about garden irrigation pump valves", None), ("mine", "the second message about garden irrigation", "beta"),
]


@pytest.fixture(scope="module")
def built(spark):
    rows = [(f"talks/{k}", k, i + 1, role, body, f"2024-01-0{n + 1}T00:00:{i:02d}") for n, (k, t) in enumerate(TALKS.items()) for i, (role, body) in enumerate(t)]
    return index.build(spark.createDataFrame(rows, "archive_path string, session_id string, line long, role string, text string, timestamp string"))


@pytest.fixture(scope="module")
def answered(spark, built):
    answers, hits = recall.recall(built, spark.createDataFrame(ASKED, "query_id string, query string, current_session_id string"))
    return {r["query_id"]: r for r in answers.collect()}, [r for r in hits.orderBy("query_id", "rank").collect()]


def test_exchanges(built):
    rows = {(r["session_id"], r["line_start"]): r for r in built.exchanges.collect()}
    assert set(rows) == {("alpha", 1), ("alpha", 4), ("alpha", 6), ("beta", 1), ("beta", 3), ("gamma", 2), ("delta", 2)}
    assert rows["alpha", 1]["line_end"] == 3 and rows["gamma", 2]["assistant_message"] == "Use two valves and one rain sensor."


def test_nodes(built):
    levels = {r["level"]: r["count"] for r in built.nodes.groupBy("level").count().collect()}
    assert levels == {"session": 4, "episode": 5, "exchange": 7}  # a system line opens a second epoch
    anchors = {r["anchor"] for r in built.anchors.collect()}
    assert {"9f8e7d6c5b4a", "/srv/logs/job-4711/run.log", "job-4711"} <= anchors


def test_exact_values_bypass_everything_else(answered):
    answers, hits = answered
    for name, line in (("commit", 1), ("path", 4)):
        r = answers[name]
        assert r["direct_anchor_bypass"] and r["answerability"] == "evidence_found" and (r["top_session_id"], r["line_start"]) == ("alpha", line) and r["confidence"] == "high"
        assert "local-vector-exchange" not in r["routes"] and "exact-anchor-direct" in r["routes"]


def test_absent_values_and_topics_abstain(answered):
    answers, hits = answered
    assert answers["absent"]["direct_anchor_absence_bypass"] and not answers["absent"]["safe_to_answer"] and not [h for h in hits if h["query_id"] == "absent"]
    assert answers["nothing"]["answerability"] == "insufficient_evidence"


def test_topics_are_found(answered):
    r = answered[0]["topic"]
    assert (r["top_session_id"], r["line_start"]) == ("beta", 3) and r["safe_to_answer"] and "sparse-exchange" in r["routes"]


def test_copies_are_shown_once(answered):
    own = [h for h in answered[1] if h["query_id"] == "copy"]
    assert own[0]["exact_match"] and len({h["content_hash"] for h in own}) == len(own)
    assert [h["rank"] for h in own] == list(range(1, len(own) + 1))


def test_ordinals_select_within_the_topic(answered):
    r = answered[0]["mine"]
    assert (r["top_session_id"], r["line_start"]) == ("beta", 3) and any(x == "ordinal-2" for x in r["routes"])


def test_plans_merge_ranges(answered):
    for r in answered[0].values():
        for a, b in zip(r["ranges"] or [], (r["ranges"] or [])[1:], strict=False):
            assert a["archive_path"] != b["archive_path"] or a["line_end"] + 1 < b["line_start"]


def test_bm25_is_that_of_fts5(spark):
    docs = {1: "red green blue", 2: "red red apple", 3: "green tea and green grass", 4: "blue sky over the blue sea", 5: "nothing here"}
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(id unindexed, t)")
    con.executemany("insert into f values (?, ?)", docs.items())
    want = {int(i): -s for i, s in con.execute("select id, bm25(f, 0.0, 2.3) from f where f match 'red OR blue OR grass'")}
    rows = spark.createDataFrame([(i, t.split()) for i, t in docs.items()], "id long, terms array<string>")
    wanted = spark.createDataFrame([("q", t) for t in ("red", "blue", "grass")], "query_id string, term string")
    got = {r["id"]: r["score"] for r in lexical.bm25(lexical.postings(rows, "id", F.col("terms")), wanted, lexical.corpus(rows, F.col("terms")), "id").collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_episodes_slide_until_the_tail_is_covered(spark):
    for n in (1, 9, 10, 11, 18, 19, 30):
        rows = [("a", "s", i * 2 + 1, i * 2 + 2, 0) for i in range(n)]
        df = spark.createDataFrame(rows, "archive_path string, session_id string, line_start long, line_end long, epoch int")
        got = sorted((r["window"], r["line_start"], r["exchanges"]) for r in turns.episodes(df).collect())
        want, start = [], 0
        while True:
            want.append((len(want), start * 2 + 1, min(10, n - start)))
            if start + 10 >= n:
                break
            start += 8
        assert got == want


def test_chunks_cover_the_text(spark):
    for n in (0, 1, 12_000, 12_001, 23_200, 23_201, 50_000):
        body = "".join(chr(97 + i % 26) for i in range(n))
        got = [r["chunk"] for r in turns.chunks(spark.createDataFrame([(body,)], "text string")).orderBy("part").collect()]
        assert got[0] + "".join(c[800:] for c in got[1:]) == body and all(len(c) <= 12_000 for c in got)


def peak_of(step, batch):
    """(rows, MB of Python objects and arrays at most) of a function on batches."""
    tracemalloc.start()
    rows = sum(len(out) for out in step(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return rows, peak


def test_a_batch_of_nodes_or_queries_takes_little_memory(spark, monkeypatch):
    """Features come portion by portion, however many rows a batch has."""
    steps = []
    for module in (index, recall):
        monkeypatch.setattr(module, "map_arrow", lambda df, step, schema: steps.append(step))
    names = [f.split(" ")[0] for f in index.NODE.split(", ")]
    index._features(spark.createDataFrame([], index.NODE))
    recall.understood(spark.createDataFrame([], "query_id string, query string, current_session_id string"))
    said = [" ".join(f"word{(i * 7919 + k * 104729) % 5003}" for k in range(60)) for i in range(800)]
    node = {"level": ["exchange"] * 800, "text": [f"User: {t}" for t in said], "user": said}
    asked = {"query_id": [str(i) for i in range(800)], "query": said}
    nodes = pa.RecordBatch.from_pydict({n: pa.array(node.get(n, [None] * 800), pa.int64() if n.startswith("line_") else pa.string()) for n in names})
    queries = pa.RecordBatch.from_pydict({n: pa.array(asked.get(n, [None] * 800), pa.string()) for n in ("query_id", "query", "current_session_id")})
    for step, batch, most in ((steps[0], nodes, 60), (steps[1], queries, 60)):
        rows, peak = peak_of(step, batch)
        assert rows == 800 and peak < most


def test_dense_search_in_parts_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PRODUCTS", 64)
    monkeypatch.setattr(vectors, "PORTION", 256)
    r = np.random.default_rng(3)
    held, asked = r.normal(size=(40, 8)).astype(np.float32), r.normal(size=(9, 8))
    nodes = spark.createDataFrame([(f"n{i:02d}", "t", x.tolist()) for i, x in enumerate(held)], "node_id string, timestamp string, embedding array<float>").repartition(2)
    queries = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(asked)], "query_id string, vector array<double>")
    got = {(x["query_id"], x["rank"]): x["node_id"] for x in vectors.dense_top(nodes, queries, 5, -9.0).collect()}
    score = asked @ held.astype(float).T
    assert got == {(f"q{i}", n + 1): f"n{k:02d}" for i in range(9) for n, k in enumerate(np.argsort(-score[i])[:5].tolist())}


def test_every_hundredth_session_asks(spark):
    rows = [(s, f"question of {s}", 1) for s in ("0", "7", "100", "250", "300", "x")]
    held = index.Index(None, spark.createDataFrame(rows, "session_id string, user_message string, line_start long"), None)
    assert {r["query_id"] for r in catalogue.last_questions(held).collect()} == {"0", "100", "300"}
