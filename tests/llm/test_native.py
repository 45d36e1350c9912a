"""Sharding, mixing and fuzzy lines."""

import collections
import hashlib
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracewell.llm import common, groups, lines, mixing, near, sharding

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slim(df):
    return df.select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).alias("text_crc32"))


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_shards_are_even_gapless_and_follow_the_mixture(spark, shards):
    sources = lambda i: "abc"[min(2, i % 6 // 2)] if i % 5 else "hot"
    rows = slim(cases.docs(spark, [f"t{i}" for i in range(500)], source=sources))
    got = sharding.interleaved(rows, 500, shards).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(500))
    held = collections.defaultdict(list)
    for r in got:
        held[r["shard"]].append(r["slot"])
    assert set(held) == set(range(shards)) and max(map(len, held.values())) - min(map(len, held.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in held.values())
    total = collections.Counter(sources(i) for i in range(500))
    for s in range(shards):
        own = collections.Counter(r["source"] for r in got if r["shard"] == s)
        assert all(abs(own[k] - n / shards) <= 2 for k, n in total.items())
    again = sharding.interleaved(rows, 500, shards).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_shards_of_awkward_and_empty_tables(spark):
    df = cases.awkward(spark)
    got = sharding.interleaved(slim(df), df.count()).collect()
    assert len(got) == df.count() and len({(r["shard"], r["slot"]) for r in got}) == len(got)
    assert sharding.interleaved(slim(cases.empty(spark)), 0).count() == 0


def fill(sizes, share=1.5, most=2):
    """Targets by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        out = {s: most * sizes[s] for s in full} | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if out[s] > most * sizes[s] + 1e-9}
        if not over:
            return out
        full |= over


def test_mix_meets_its_targets(spark):
    texts = [cases.prose(i, 5 + i * 7 % 40) for i in range(300)]
    sources = lambda i: None if i % 11 == 0 else "big" if i % 3 else f"s{i % 4}"
    df = cases.docs(spark, texts, source=sources).select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    got = mixing.mix(df, 300).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["size"] == len(WORD.findall(texts[r["doc_id"]]))
    want = fill(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 0.51 for s in sizes)
    # Epochs first: two documents of a source differ by one epoch at most, but for the cut.
    for s in sizes:
        whole = {r["taken"] // r["size"] for r in got if r["source"] == s}
        assert max(whole) - min(whole) <= 1


def test_mixed_documents_are_what_the_mix_says(spark):
    texts = [cases.prose(i, 20) + "\n tail" for i in range(60)]
    df = cases.docs(spark, texts, source=lambda i: "ab"[i % 2])
    got = mixing.mixed_documents(df).collect()
    plan = {r["doc_id"]: r for r in mixing.mix(df.withColumn("size", mixing.words(F.col("text"))), 60).collect()}
    words = collections.Counter()
    for r in got:
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert all(words[i] == plan[i]["taken"] for i in range(60))


def test_mix_of_awkward_and_empty_tables(spark):
    df = cases.awkward(spark)
    assert set(mixing.mixed_documents(df).columns) == set(df.columns)
    sized = df.drop("size", "taken").withColumn("size", mixing.words(F.col("text")))
    assert mixing.mix(sized, df.count()).count() == df.count()
    assert mixing.mixed_documents(cases.empty(spark)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def test_lines_of_a_group_keep_the_first(spark):
    line = [cases.prose(i, 14) for i in range(40)]
    near = [cases.edited(x, 0.05, i) for i, x in enumerate(line)]
    texts = [line[i] + "\n" + line[(i + 1) % 40].upper() + "!\n--\nown " + cases.prose(100 + i, 9) for i in range(40)] + [near[i] for i in range(40)]
    df = cases.docs(spark, texts)
    got = {r["doc_id"]: r for r in lines.judged(df).collect()}
    every = [(d, i, plain(x)) for d, t in enumerate(texts) for i, x in enumerate(t.split("\n")) if plain(x)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    different = sorted({n for _, _, n in every})
    links = 0
    for i, a in enumerate(different):
        for b in different[:i]:
            if distance(a, b) <= 0.2 * max(len(a), len(b)):
                links += 1
                parent[root(a)] = root(b)
    first = {}
    for d, i, n in every:
        first.setdefault(root(n), (d, i))
    want = collections.defaultdict(list)
    for d, i, n in every:
        if first[root(n)] != (d, i):
            want[d].append(i)
    assert links >= 15
    assert sum(got[d]["removed"] != want[d] for d in range(len(texts))) <= 3  # SimHash may miss a pair at the limit
    assert all(got[d]["n_lines"] == len(t.split("\n")) for d, t in enumerate(texts))
    kept = {r["doc_id"]: r for r in lines.without_fuzzy_lines(df).collect()}
    for d, t in enumerate(texts):
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in got[d]["removed"])
        assert kept[d]["text"] == left and kept[d]["n_chars"] == len(left)


def test_lines_with_few_flips_share_a_block(spark):
    """The pigeonhole bound: texts that differ in fewer bits than blocks meet."""
    text = cases.prose(3, 400)
    df = cases.docs(spark, [text, text.replace(text.split(" ")[200], "another", 1)])
    assert sum(r["n_removed"] for r in lines.judged(df).collect()) == 1


def test_a_hot_line_and_hot_near_lines_stay_linear(spark):
    base = cases.prose(5, 30).split(" ")
    texts = ["the same line everywhere\n" + " ".join([*base[:i % 30], f"w{i}", *base[i % 30 + 1 :]]) for i in range(200)]
    got = lines.judged(cases.docs(spark, texts)).collect()
    assert sum(r["n_removed"] for r in got) >= 199 + 195


def typos(line, seed, words=3):
    r = random.Random(seed)
    parts = line.split(" ")
    for i in r.sample(range(len(parts)), words):
        at = r.randrange(len(parts[i]))
        parts[i] = parts[i][:at] + r.choice("qwxz") + parts[i][at + 1 :]
    return " ".join(parts)


def test_lines_with_scattered_typos_are_found(spark):
    line = [cases.prose(2000 + i, 12) for i in range(300)]
    got = lines.judged(cases.docs(spark, line + [typos(x, i) for i, x in enumerate(line)])).collect()
    assert sum(r["n_removed"] for r in got if r["doc_id"] >= 300) >= 200


def test_a_group_of_unrelated_and_like_nodes_is_settled(spark):
    """Two keys that 400 nodes share, and links between i and i + 200 only: found wherever the nodes stand."""
    order = list(range(400))
    random.Random(5).shuffle(order)
    rows = [(key, order[i]) for i in range(400) for key in (1, 2)]
    like = {tuple(sorted((order[i], order[i + 200]))) for i in range(200)}
    table = spark.createDataFrame([(a, b) for a, b in like], "a long, b long")
    asked = []

    def verify(pairs):
        asked.append(pairs.count())
        return pairs.join(table, ["a", "b"], "left_semi")

    found, component = groups.linked(spark.createDataFrame(rows, "key long, node long"), verify)
    assert {(x["a"], x["b"]) for x in found.collect()} == like
    assert {x["node"]: x["component"] for x in component.collect()} == {n: a for a, b in like for n in (a, b)}
    assert sum(asked) <= 400 * 399 // 2


def test_nodes_with_one_large_group_in_common_meet(spark, monkeypatch):
    """Every node has one key of 40 in common with its partner, and else keys of large groups of its own side."""
    monkeypatch.setattr(groups, "PART", 7, raising=False)
    rows = [(1, i) for i in range(40)] + [(2 + i % 2, i) for i in range(40)]
    rows += [(10 + k, i) for k in range(20) for i in range(40) if (i < 20) == (k < 10)]
    like = {(i, 39 - i) for i in range(20)}
    table = spark.createDataFrame(list(like), "a long, b long")
    found, component = groups.linked(spark.createDataFrame(rows, "key long, node long"), lambda pairs: pairs.join(table, ["a", "b"], "left_semi"))
    assert {(x["a"], x["b"]) for x in found.collect()} == like
    assert {x["node"]: x["component"] for x in component.collect()} == {n: a for a, b in like for n in (a, b)}


def test_nodes_with_many_groups_in_common_are_one_pair(spark, monkeypatch):
    """Every pair is a row once, in whichever parts and however many groups two nodes meet."""
    monkeypatch.setattr(groups, "PART", 7)
    rows = [(k, i, i // 3, 30) for k in (5, -2, 9) for i in range(30)] + [(-7, i, i // 3, 8) for i in range(8)]
    members = spark.createDataFrame(rows, "key long, node long, component long, n long")
    sketches = members.select("node", F.lit(0).alias("size"), F.lit(b"").alias("sketch")).distinct()
    got = [(x["a"], x["b"]) for x in groups.possible(members, sketches, [], 0.0, False).collect()]
    assert sorted(got) == [(a, b) for a in range(30) for b in range(a + 1, 30) if a // 3 != b // 3]


def test_counts_bound_edits(spark):
    """No pair that is similar enough is left out."""
    r = random.Random(4)
    every = [cases.prose(50 + i, r.randint(3, 30)) for i in range(40)] + ["", "x", "日本語 の 行", "é" * 300]
    for t in list(every):
        other = list(t)
        for _ in range(r.randint(0, max(1, len(t) // 5))):
            at = r.randrange(len(other) + 1)
            other[at : at + r.randint(0, 1)] = r.choice(["", "q", " ", "é"])
        every.append("".join(other))
    table = spark.createDataFrame([(1, i, t) for i, t in enumerate(every)], "key long, k long, norm string")
    members = table.select("key", F.col("k").alias("node"), F.col("k").alias("component"), F.lit(len(every)).alias("n"))
    bounds = [(0, lines.CLASSES[0], 2), (lines.CLASSES[0], sum(lines.CLASSES), 4)]
    got = {(x["a"], x["b"]) for x in groups.possible(members, lines.counted(table, members), bounds, lines.SIMILARITY, False).collect()}
    pairs = [(a, b) for b in range(len(every)) for a in range(b)]
    want = {(a, b) for a, b in pairs if lines.distance(every[a], every[b], 10**6) <= int((1 - lines.SIMILARITY) * max(len(every[a]), len(every[b])) + 1e-6)}
    assert want <= got and len(got) < len(pairs) / 4


def test_a_frequent_word_makes_no_large_groups(spark):
    """Unrelated lines, half of whose words are the same two or three."""
    r = random.Random(6)
    every = [" ".join(w for x in cases.prose(7000 + i, 60).split(" ") for w in (x, *r.choice([("the",), ("the", "of"), ("the", "the", "and")]))) for i in range(300)]
    table = spark.createDataFrame(list(enumerate(every)), "k long, norm string")
    groups_of = lines.block_keys(table).distinct().groupBy("key").count()
    assert groups_of.agg(F.max("count")).first()[0] <= 10


def test_lines_are_verified_as_brute_force_does(spark):
    """Insertions, deletions, changes and moves of words, unrelated lines, and lines without blanks."""
    r = random.Random(8)
    every = []
    for i in range(150):
        words = cases.prose(3000 + i, r.randint(4, 60)).split(" ")
        other = list(words)
        for _ in range(r.randint(1, max(1, len(words) // 4))):
            at = r.randrange(len(other))
            edit = r.choice(["drop", "add", "change", "typo", "move"])
            if edit == "drop" and len(other) > 1:
                other.pop(at)
            elif edit == "add":
                other.insert(at, cases.prose(r.randint(1, 999), 1))
            elif edit == "change":
                other[at] = cases.prose(r.randint(1, 999), 1)
            elif edit == "typo":
                other[at] = other[at][:-1] + "q"
            else:
                other.insert(r.randrange(len(other)), other.pop(at))
        every += [" ".join(words), " ".join(other)]
    every += ["x" * 300, "x" * 280 + "y" * 20, "日本語のテキスト" * 20, "日本語のテキスト" * 19 + "違う文章です"]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(every)], "k long, norm string")
    pairs = [(i, i + 1) for i in range(0, len(every), 2)] + [(i, i + 2) for i in range(0, 100, 2)]
    got = {(x["a"], x["b"]) for x in lines.verified(spark.createDataFrame(pairs, "a long, b long"), table).collect()}
    want = {(a, b) for a, b in pairs if distance(every[a], every[b]) <= 0.2 * max(len(every[a]), len(every[b])) + 1e-9}
    assert got == want and len(want) > 60


def test_columns_with_clashing_names_stay(spark):
    names = ["_key", "_rank", "_n", "_source", "_bucket", "_slice", "_value", "_row", "key", "rank", "n", "at", "bucket", "place", "before", "_rest", "_epochs", "SHARD", "taken"]
    df = cases.awkward(spark).withColumn("text_crc32", F.lit(1)).withColumn("size", F.lit(3))
    for i, name in enumerate(names):
        df = df.withColumn(name, F.lit(i))
    n = df.count()
    for out, new in ((sharding.interleaved(df, n), ["shard", "slot"]), (mixing.mix(df, n), ["source_size", "target", "taken"])):
        assert out.columns[-len(new) :] == new and out.count() == n
        for i, name in enumerate(names):
            if name.lower() not in new:
                assert {x[0] for x in out.select(name).distinct().collect()} == {i}


def test_many_sources_of_one_row_are_spread(spark):
    rows = [(i, f"host{i}", 1, 1) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text_crc32 long, size long")
    out = sharding.interleaved(df, 4000).collect()
    counts = collections.Counter(x["shard"] for x in out)
    assert set(counts.values()) == {100}
    assert all(sorted(x["slot"] for x in out if x["shard"] == s) == list(range(100)) for s in range(40))


@pytest.mark.parametrize("op", [lines.judged, lines.without_fuzzy_lines, near.classified])
def test_tables_of_steps_are_removed(spark, op):
    """Only the operator's own table stays, in the shared folder and of the catalogue's tables."""
    docs = cases.docs(spark, [f"{cases.prose(i % 40, 30)}\n{cases.edited(cases.prose(i % 7, 30), 0.05, i)}" for i in range(60)])
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before, names = set(folder.glob("*")), {t.name for t in spark.catalog.listTables()}
    out = op(docs)
    assert out.count() == 60
    assert len(set(folder.glob("*")) - before) == 1 and {t.name for t in spark.catalog.listTables()} <= names


def test_lines_of_awkward_and_empty_tables(spark):
    df = cases.awkward(spark)
    out = lines.without_fuzzy_lines(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert lines.judged(df).count() == df.count()
    assert lines.judged(cases.empty(spark)).count() == 0 and lines.without_fuzzy_lines(cases.empty(spark)).count() == 0


def test_running_sums_match_a_plain_loop(spark):
    rows = [(i, "g" if i % 3 else None, hashlib.md5(str(i % 50).encode()).hexdigest(), i % 7) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, g string, key string, v long")
    got = {r["i"]: r["out"] for r in common.running_before(df, ["g"], "key", ["i"], F.col("v"), "out", 1).collect()}
    sums = collections.Counter()
    for i, g, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        assert got[i] == sums[g]
        sums[g] += v


def test_lines_run_no_python_on_executors(spark, monkeypatch):
    """Hashing, meeting in groups of more than a few and verifying are DataFrame functions."""

    def refused(*_args, **_named):
        raise AssertionError("Python on the executors")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(spark.range(0)), name, refused)
    base = cases.prose(5, 30).split(" ")
    texts = [" ".join([*base[: i % 30], f"w{i}", *base[i % 30 + 1 :]]) + "\n" + cases.prose(9000 + i, 12) for i in range(40)]
    docs = cases.docs(spark, texts)
    assert sum(r["n_removed"] for r in lines.judged(docs).collect()) >= 38
    assert lines.without_fuzzy_lines(docs).count() == 40


def test_marks_leave_out_no_like_lines(spark, monkeypatch):
    """Every pair that is similar enough comes once, in whichever parts and groups its lines meet."""
    monkeypatch.setattr(groups, "PART", 7)
    r = random.Random(14)
    every = [cases.prose(50 + i, r.randint(3, 60)) for i in range(30)] + ["x", "日本語 の 行", "é" * 300]
    for t in list(every):
        other = list(t)
        for _ in range(r.randint(0, len(t) // 5)):
            at = r.randrange(len(other) + 1)
            other[at : at + r.randint(0, 1)] = r.choice(["", "q", " ", "é"])
        every.append("".join(other))
    n = len(every)
    table = spark.createDataFrame(list(enumerate(every)), "k long, norm string")
    members = spark.createDataFrame([(key, i, i, n) for i in range(n) for key in (1, -3)], "key long, node long, component long, n long")
    got = [(x["a"], x["b"]) for x in groups.joined(members, lines.odd_runs(table, members), lines.MARKS, lines.EDIT, lines.SIMILARITY).collect()]
    pairs = [(a, b) for b in range(n) for a in range(b)]
    want = {(a, b) for a, b in pairs if lines.distance(every[a], every[b], 10**6) <= int((1 - lines.SIMILARITY) * max(len(every[a]), len(every[b])) + 1e-6)}
    assert len(got) == len(set(got)) and want <= set(got) and len(want) > 20 and len(got) < len(pairs) / 4


def test_an_alignment_is_no_less_than_the_distance(spark):
    """Passages that one of two lines lacks are skipped, and the bound is never below the edit distance."""
    words = [[f"{w}{j}" if j % 3 else w for j, w in enumerate(cases.prose(400 + i, 80).split(" "))] for i in range(12)]
    rows = [(w, w[:20] + w[30 + i :]) for i, w in enumerate(words)] + [(w[:10] + w[20:], w) for w in words] + [(w[:40], words[i - 1][:40]) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "one array<string>, two array<string>")
    for x in df.select("one", "two", lines.aligned(F.col("one"), F.col("two")).alias("cost")).collect():
        one, two = " ".join(x["one"]), " ".join(x["two"])
        assert x["cost"] >= lines.distance(one, two, 10**6)
        if len(x["one"]) != len(x["two"]):
            assert x["cost"] <= abs(len(one) - len(two)) + 40
