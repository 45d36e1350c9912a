"""Text features: anchors, terms, query understanding, vectors, signatures."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.functions import columns, text
from tracewell.functions.shipping import ship


def test_normal_form():
    assert text.normalize("  Ａ B\tc\n") == "a b c"
    assert text.normalize(None) == "" and text.fingerprint("A  b") == hashlib.sha256(b"a b").hexdigest()


@pytest.mark.parametrize(
    ("body", "anchor"),
    [("at 0xDEADBEEF now", "0xdeadbeef"), ("commit 3f2a9c1b7", "3f2a9c1b7"), ("run --max-depth=3", "--max-depth"), ("in /srv/data/file.txt.", "/srv/data/file.txt"), ("see https://a.b/c?d=1", "https://a.b/c?d=1"), ("since v2.10.3", "v2.10.3"), ("step_00123 ran", "step_00123"), ("id 123e4567-e89b-12d3-a456-426614174000", "123e4567-e89b-12d3-a456-426614174000")],
)
def test_decisive_anchors(body, anchor):
    every, decisive = text.anchors(body)
    assert anchor in decisive and anchor in every and text.indexable(anchor)


def test_traps_of_anchors():
    assert "1234567" in text.anchors("pay 1234567 now")[1]  # seven digits read as hexadecimal
    assert text.anchors("12345 and 7b and 3..9")[1] == [] and set(text.anchors("12345 and 7b and 3..9")[0]) == {"12345", "7b", "3..9"}
    quoted = text.anchors("say 'two words' twice")[1]
    assert quoted == ["two words"] and not text.indexable("two words")


def test_terms():
    assert text.terms("camelCase foo_bar the 配置文件 8k") == ["8k", "camelcase", "camel", "case", "foo_bar", "foo", "bar", "配置", "置文", "文件", "配置文", "置文件"]
    assert text.terms("字") == [] and text.terms("a the of") == [] and len(text.terms(" ".join(f"word{i}" for i in range(9000)))) <= text.MOST_TERMS
    long_text = " ".join(f"token{i:06d}" for i in range(5000))
    found = text.routing_terms(long_text)
    assert found[0] == "token000000" and any(t > "token004500" for t in found if t.startswith("token0")) and len(found) <= text.ROUTING_TERMS


@pytest.mark.parametrize(("query", "n"), [("the 3rd one", 3), ("second message", 2), ("第十二次对话", 12), ("第一百零五条", 105), ("第两次", 2), ("nothing", None), ("第 7 轮", 7), ("per second", 2)])
def test_ordinals(query, n):
    assert text.ordinal(query) == n


def test_understanding():
    q = text.understood("latest 配置 of job-123")
    assert q.direction == "latest" and "config" in q.terms and "latest" not in q.terms and q.decisive == ("job-123",) and q.concepts[0][0] == "配置"
    assert text.understood("the second latest").direction == "ordinal"
    assert text.understood("concurrent jobs").direction == "latest"  # no word boundary


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=200))
def test_vectors_are_unit_or_zero_and_bands_rebuild_signatures(body):
    v = text.embed(body)
    assert np.isclose(np.linalg.norm(v), 1) or not v.any()
    s = text.signature(v)
    assert sum(int(b[2:], 16) << 8 * int(b[0]) for b in text.bands(s)) == s % (1 << 64)


def test_zero_vector_sets_all_bits():
    assert text.signature(np.zeros(384)) == -1


def test_facets_and_clauses():
    assert text.clauses("one thing and another; third") == ["one thing", "another", "third"]
    assert text.clauses("") == [] and len(text.clauses("x" * 10_000)) == 4
    assert len(text.node_facets("question?", "y" * 9000)) == 4 and len(text.query_facets(text.understood("a1b2c3d4 x"), "a1b2c3d4 x")) == 2


def test_opaque_runs_are_masked():
    run = "A" * 3000
    assert text.opaque_masked(f"see {run} end") == "see [opaque payload omitted from index: 3000 chars] end"
    assert text.opaque_masked("short") == "short" and text.opaque_masked(None) is None


def test_columns_agree_with_python(spark):
    ship(spark)
    bodies = ["Hello  World 0xdeadbeef", "", None, "配置 v1.2.3", "  x\ty "]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, t string")
    rows = df.select("i", columns.normalize("t").alias("n"), columns.terms("t").alias("w"), columns.anchors("t").alias("a"), columns.embed("t").alias("e"), columns.plain(F.col("t")).alias("p")).collect()
    for r in rows:
        body = bodies[r["i"]]
        assert r["n"] == text.normalize(body) == r["p"] and r["w"] == text.routing_terms(body) and r["a"]["every"] == text.anchors(body or "")[0]
        assert np.allclose(r["e"], text.embed(body or ""), atol=1e-6)


def test_sql_signatures_agree_with_python(spark):
    rng = np.random.default_rng(0)
    vectors = [rng.normal(size=64).astype(np.float32).tolist() for _ in range(20)]
    df = spark.createDataFrame([(v,) for v in vectors], "v array<float>").withColumn("s", columns.pool_signature("v"))
    for r in df.select("v", "s", columns.band_keys(F.col("s")).alias("b"), columns.dot("v", "v").alias("d")).collect():
        assert r["s"] == text.signature(np.array(r["v"])) and r["b"] == text.bands(r["s"])
        assert np.isclose(r["d"], float(np.dot(np.array(r["v"], np.float64), np.array(r["v"], np.float64))))
