"""Small tables with everything that is awkward."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string, taken string, key string, k string, class_id string, _key string"


def prose(seed, n, names=300):
    r = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bcdfglmnprst" for b in "aeiou" for c in ("n", "r", "st", "l", "ng")][:names]
    return " ".join(r.choice(words) for _ in range(n))


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(w + "x" if r.random() < share else w for w in text.split(" "))


def awkward_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    base = prose(1, 120)
    texts = [None, "", " ", "\n\n", "a", "one two", base, base, edited(base, 0.03, 5), prose(2, 3000), "é" * 50, "日本語 " * 30, "x" * 5000, "\x00 zero", "word " * 60]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, base, None, None, None), (None, None, None, None, None), (6, base, "en", "s0", len(base)), (6, base, "en", "s0", len(base)), (7, prose(9, 30), "fr", None, 3)]
    return [(*r, "a", "b", "c", "d", "e", "f", "g") for r in rows]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source if isinstance(source, str) else source(i), len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
