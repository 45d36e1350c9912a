"""Fuzzy line dedup (DataFrame functions only).

Lines are normalised (lower case; runs of ASCII signs that are no letters or digits become one blank) and collapsed to
different lines. A line's features are its words, in lines under SHORT letters its runs of GRAM letters, each with its
occurrence number, so that no block is of one frequent word alone. A feature's hash
deals it to one block of the line and casts its votes, weighted by letters, in that block's SimHash only, so an edit
disturbs the blocks of the features that it touches and no other: by the pigeonhole principle lines with fewer touched
features than blocks agree in a whole block. Blocks have about as many letters in any line; their number is a power of
two that follows the line's length, and lines near such an edge have blocks of both numbers. Lines with few blocks are
dealt several times.

Lines that agree in a block are a group. Each meets the group's first, then all of other components, but those whose
runs of letters show that they can't be similar enough (`groups.joined`). Pairs are
verified by edit similarity (Levenshtein, at least SIMILARITY). No number depends on the size of the table.
Connected groups keep the earliest occurrence (id, then line); all others go.

Different lines are written once, bucketed by their 64-bit hash, so that neither hashing nor verifying moves them again.

Defined results: null and empty texts have no lines to drop; lines without letters or digits always stay; a very long
line has more blocks, and verifying it takes time by the square of its length unless an alignment of its words settles
it; ids name documents, so rows of the same id with the same lines keep the same ones, and null ids come first; an empty
table gives an empty table; other columns stay.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.shipping import map_arrow, portions

from .common import bucketed, settled_alone, written
from .groups import joined, linked

SIMILARITY = 0.8
GRAM, SHORT = 3, 96
#: From so many letters on words are features; lines of SHORT letters still meet those of SIMILARITY times as many.
LONG = math.ceil(SIMILARITY * SHORT)
#: By kind of line (words, letter runs): letters that a block stands for, the weight of votes that makes a block count,
#: and how many blocks a line should have at least, over all times that it is dealt.
PER, LEAST, BLOCKS = (20, 5), (16, 4), (8, 12)
#: Two lines of words that share less than this part of their words are taken for different.
SHARED = 0.4
#: From 2^MANY blocks on their number grows by this power of the length only, as many are left when few words change.
MANY, GROWTH = 4, 0.75
#: Votes for each letter that a block of words stands for, so that it counts.
FULL = 0.5
#: Lines whose lengths differ by less than this share always have blocks in common sizes.
EDGE = 0.1
#: A word votes with its letters, up to so many; up to LITTLE letters with 1. Lines with longer words than WORD are taken
#: as letter runs.
MOST_VOTES, LITTLE, WORD = 8, 3, 24
LONG_WORD = f"[^ ]{{{WORD + 1}}}"
#: Votes are counted in lanes of 9 bits, seven to a number. Of a block of more votes than HALF the sums are hashed.
LANE, LANES, COUNTS, HALF = 9, 7, 9, 255
ONES = sum(1 << LANE * i for i in range(LANES))
#: Bytes of lines that are counted at a time.
PORTION = 1 << 20
#: Letters, and pairs of letters, are counted in so many classes.
CLASSES = (32, 128)
#: How many words an alignment looks ahead for a short word, and for others.
AHEAD, FAR = 4, 40
#: Numbers of 64 bits that mark a line's runs of letters, and how many of these and of the size an edit changes.
MARKS, EDIT = 32, 6
BREAK = "\n"
#: ASCII signs but blank and line break, one by one: Java looks these up in a table, and ranges one after another.
SIGNS = "".join(f"\\x{i:02X}" for i in [*range(0x0A), *range(0x0B, 0x20), *range(0x21, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def normalised(text: Column) -> Column:
    """Of a text or a line: lower case, runs of ASCII signs as one blank; line breaks stay. Single blanks are no match."""
    return F.regexp_replace(F.lower(text), f"[{SIGNS}][{SIGNS}\\x20]*| [{SIGNS}\\x20]+", " ")


def line_rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc_id, line, norm, k) of all lines that have letters or digits."""
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(normalised(F.col(text)), BREAK)).alias("line", "_line"))
    lines = lines.select("doc_id", "line", F.trim("_line").alias("norm")).filter("norm <> ''")
    return lines.withColumn("k", F.xxhash64("norm"))


def block_keys(lines: DataFrame) -> DataFrame:
    """(node, key) of lines (k, norm): the SimHash of each block of each line, with the block's place, as one number. A
    line's blocks have different places, so each row comes once."""
    of = lambda values: F.when(F.col("kind") == 0, values[0]).otherwise(values[1])
    size = F.length("norm")
    # A line between LONG and SHORT letters is of both kinds; one without blanks is of letter runs.
    letters, words = F.lit(1), F.lit(0)
    worded = (size >= LONG) & ~F.col("norm").rlike(LONG_WORD)
    kinds = F.when(~worded, F.array(letters)).when(size < SHORT, F.array(words, letters)).otherwise(F.array(words))
    rows = lines.select("k", "norm", size.alias("size"), F.explode(kinds).alias("kind"))
    edge = F.lit(" " * (GRAM - 1))
    found = F.when(F.col("kind") == 0, F.split("norm", " ")).otherwise(_runs(F.concat(edge, "norm", edge)))
    x = F.log2(F.col("size") / of(PER))
    x = F.least(x, MANY + (x - MANY) * GROWTH)
    level = lambda more: F.greatest(F.lit(0), F.floor(x + F.lit(more + 1e-9)).cast("int"))
    rows = rows.select("k", "kind", "size", F.sort_array(F.transform(found, _feature)).alias("found"), level(0.0).alias("low"), level(-math.log2(1 - EDGE)).alias("high"))
    power = lambda v: F.call_function("shiftleft", F.lit(1).cast("long"), v)
    times = lambda v: F.when(F.col(v) == 0, 1).otherwise(F.ceil(of(BLOCKS) / power(F.col(v))).cast("int"))
    # Each time that a line is dealt is a number: the level, and from 0 how often it has been dealt at this level.
    dealt = lambda v: F.sequence(F.col(v) * 64, F.col(v) * 64 + times(v) - 1)
    turns = F.when(F.col("low") == F.col("high"), dealt("low")).otherwise(F.concat(dealt("low"), dealt("high")))
    rows = rows.select("k", "kind", "size", "found", F.explode(turns).alias("turn"))
    rows = rows.select("k", "kind", "size", "found", "turn", F.posexplode("found").alias("at", "f"))
    # Features are in order, so a word's occurrences follow one another. Each is a feature of its own: a word that comes
    # often is dealt to as many blocks and decides none of them alone.
    nth = F.col("at") - F.array_position("found", F.col("f"))
    rows = rows.select("k", "kind", "size", "turn", F.col("f").bitwiseAND(F.lit(15)).alias("weight"), F.xxhash64("f", nth).alias("hash"))
    level, part = F.shiftright("turn", 6), F.col("turn").bitwiseAND(F.lit(63))
    block = F.shiftrightunsigned(F.xxhash64(part, "hash"), 20).bitwiseAND(power(level) - 1)
    place = F.shiftleft(block, 16).bitwiseOR((F.col("turn") * 2 + F.col("kind")).cast("long"))
    # Shifted by j, a hash has the bits j, j + 9, and so on at the ends of the lanes.
    vote = lambda j: F.try_sum(F.shiftrightunsigned("hash", j).bitwiseAND(F.lit(ONES)) * F.col("weight")).alias(f"v{j}")
    votes = rows.select("k", place.alias("place"), "size", "hash", "weight").groupBy("k", "place").agg(F.max("size").alias("size"), F.sum("weight").alias("votes"), *[vote(j) for j in range(COUNTS)])
    kind, level = F.col("place").bitwiseAND(F.lit(1)), F.shiftright("place", 7).bitwiseAND(F.lit(511)).cast("int")
    share = F.when(kind == 0, F.greatest(F.lit(LEAST[0]), FULL * F.col("size") / power(level))).otherwise(LEAST[1])
    votes = votes.filter((level == 0) | (F.col("votes") >= share))
    # All lanes at once: with HALF - votes / 2 added, a lane reaches HALF + 1 where most votes are for it.
    half = F.lit(ONES) * (F.lit(HALF) - F.shiftright(F.least("votes", F.lit(HALF)), 1))
    simhash = F.lit(0).cast("long")
    for j in range(COUNTS):
        simhash = simhash.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.try_add(F.col(f"v{j}"), half), LANE - 1).bitwiseAND(F.lit(ONES)), j))
    held = F.when(F.col("votes") <= HALF, simhash).otherwise(F.xxhash64(*[f"v{j}" for j in range(COUNTS)]))
    return votes.select(F.col("k").alias("node"), F.xxhash64("place", held).alias("key"))


def _runs(text: Column) -> Column:
    """All runs of GRAM letters of a text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))


def _feature(f: Column) -> Column:
    """The hash of a word or of a run of letters, with its weight as the last four bits."""
    weight = F.when(F.length(f) <= LITTLE, 1).otherwise(F.least(F.length(f), F.lit(MOST_VOTES)))
    return F.xxhash64(f).bitwiseAND(F.lit(-16)).bitwiseOR(weight.cast("long"))


def odd_runs(lines: DataFrame, members: DataFrame) -> DataFrame:
    """(node, size, bits) of the lines (k, norm) of members: whether the number of their runs of GRAM letters in each of
    64 * MARKS classes is odd. An edit changes three such runs into three others, or three into two or two into three, and
    so with the size at most EDIT of all."""
    own = lines.select(F.col("k").alias("node"), "norm").join(members.select("node").distinct(), "node", "left_semi")
    rows = own.select("node", F.length("norm").alias("size"), F.explode_outer(_runs(F.col("norm"))).alias("run"))
    rows = rows.select("node", "size", F.xxhash64("run").alias("hash"), F.col("run").isNotNull().alias("some"))
    place = F.pmod(F.shiftright("hash", 6), F.lit(MARKS)).cast("int")
    bit = F.when(F.col("some"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("hash").bitwiseAND(F.lit(63)).cast("int"))).otherwise(0)
    rows = rows.select("node", "size", place.alias("place"), bit.alias("bit")).groupBy("node", "size", "place").agg(F.bit_xor("bit").alias("bit"))
    held = rows.groupBy("node", "size").agg(F.map_from_entries(F.collect_list(F.struct("place", "bit"))).alias("held"))
    return held.select("node", "size", F.transform(F.sequence(F.lit(0), F.lit(MARKS - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("long"))).alias("bits"))


def counted(lines: DataFrame, members: DataFrame) -> DataFrame:
    """In Arrow batches, for `groups.possible`; the operator itself uses `odd_runs`.

    (node, size, sketch) of the lines (k, norm) of members: how many of their letters fall into each of CLASSES[0]
    classes, and of their pairs of letters into each of CLASSES[1], 255 at most. An edit changes two counts of letters by
    one at most, and four of pairs, or one and three of them and the size."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, PORTION):
            texts = batch.column(1).to_pylist()
            sizes = np.array([len(t) for t in texts], np.int64)
            codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            owner = np.repeat(np.arange(len(texts)), sizes)
            pairs = (codes[:-1] * 31 + codes[1:]) * 0x9E3779B1 >> 16
            inside = owner[:-1] == owner[1:]
            both = [(owner, codes), (owner[:-1][inside], pairs[inside])]
            marks = [np.bincount(own * many + value % many, minlength=len(texts) * many).reshape(len(texts), many) for (own, value), many in zip(both, CLASSES, strict=True)]
            marks = np.minimum(np.concatenate(marks, 1), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), pa.array([m.tobytes() for m in marks], pa.binary())], names=["node", "size", "sketch"])

    own = lines.select(F.col("k").alias("node"), "norm").join(members.select("node").distinct(), "node", "left_semi")
    return map_arrow(own.select("node", "norm"), step, "node long, size int, sketch binary")


def distance(one: str, two: str, most: int) -> int:
    """In plain Python, to hold the operator against: the edit distance of two texts if it is at most `most`, else a
    number above it; columns of the table as bits of one long number (Myers' algorithm), between the equal ends."""
    n = min(len(one), len(two))
    head = len(os.path.commonprefix([one, two]))
    tail = len(os.path.commonprefix([one[head:][::-1], two[head:][::-1]]))
    one, two = one[head : len(one) - tail], two[head : len(two) - tail]
    if len(one) > len(two):
        one, two = two, one
    n = len(one)
    if not n or len(two) - n > most:
        return len(two)
    places: dict[str, int] = {}
    for i, c in enumerate(one):
        places[c] = places.get(c, 0) | 1 << i
    every, last = (1 << n) - 1, 1 << (n - 1)
    up, down, cost, left = every, 0, n, len(two)
    for c in two:
        left -= 1
        same = places.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = down | (every & ~(across | up)), up & across
        if more & last:
            cost += 1
        elif less & last:
            cost -= 1
        if cost - left > most:
            return cost - left
        same |= down
        more = (more << 1 | 1) & every
        up, down = (less << 1 & every) | (every & ~(same | more)), more & same
    return cost


def aligned(one: Column, two: Column) -> Column:
    """The cost in letters of one way to turn a line into another, both as arrays of words: word by word, where a word
    that comes soon after in the other line skips the words before it, and one before which the other line goes on goes.
    A bound of the edit distance from above, in time by the number of words."""
    letters = lambda words: F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w) + 1)
    # How many words on a word comes in words behind a place, from 1; 0 or null if it doesn't.
    soon = lambda words, at, w: F.array_position(F.slice(words, at + 1, F.when(F.length(w) > LITTLE + 1, FAR).otherwise(AHEAD)), w).cast("int")

    def moved(state: Column, i: Column, word: Column, other: Column, found: Column) -> Column:
        at, later, back = state["at"], found["later"], found["back"]
        skips = (later > 0) & ((back == 0) | (later <= back))
        lacks = other.isNull() | (back > 0)
        cost = F.when(skips, letters(F.slice(two, at + 1, later - 1))).when(lacks, F.length(word) + 1).otherwise(F.levenshtein(word, other))
        return F.struct((at + F.when(skips, later).when(lacks, 0).otherwise(1)).alias("at"), (state["cost"] + cost).alias("cost"))

    def step(state: Column, i: Column) -> Column:
        word, other = F.get(one, i), F.get(two, state["at"])
        found = F.struct(F.coalesce(soon(two, state["at"], word), F.lit(0)).alias("later"), F.coalesce(soon(one, i + 1, other), F.lit(0)).alias("back"))
        # An array of one element binds what is used several times.
        apart = F.get(F.transform(F.array(found), lambda f: moved(state, i, word, other, f)), F.lit(0))
        return F.when(word == other, F.struct((state["at"] + 1).alias("at"), state["cost"].alias("cost"))).otherwise(apart)

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("cost"))
    rest = lambda s: s["cost"] + letters(F.slice(two, s["at"] + 1, F.size(two)))
    return F.aggregate(F.sequence(F.lit(0), F.size(one) - 1), start, step, rest)


def verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (a, b) of line hashes whose lines are similar enough. Lines of words must share some of them; an
    alignment of the words settles most pairs that are alike, and the others pay for the edit distance."""
    one, two = (lines.select(F.col("k").alias(k), F.col("norm").alias(t)) for k, t in (("a", "one"), ("b", "two")))
    both = pairs.join(one, "a").join(two, "b")
    longer = F.greatest(F.length("one"), F.length("two"))
    most = F.floor(F.lit(1 - SIMILARITY) * longer + 1e-6).cast("int")
    # No edit distance is below the difference of lengths.
    both = both.select("a", "b", "one", "two", longer.alias("longer"), most.alias("most")).filter(F.abs(F.length("one") - F.length("two")) <= F.col("most"))
    # What a generator gives is computed once; the optimiser would copy other columns into each place that uses them.
    once = lambda **c: F.inline(F.array(F.struct(*[v.alias(k) for k, v in c.items()])))
    words = lambda c: F.when(F.col("longer") >= SHORT, F.split(c, " "))
    both = both.select("a", "b", "one", "two", "longer", "most", once(first=words("one"), second=words("two")))
    worded = F.col("first").isNotNull() & (F.least(F.size("first"), F.size("second")) * WORD >= F.col("longer"))
    shared = F.size(F.array_intersect("first", "second")) >= F.lit(SHARED) * F.least(F.size(F.array_distinct("first")), F.size(F.array_distinct("second")))
    both = both.select("a", "b", "one", "two", "most", "first", "second", once(worded=worded)).filter(~F.col("worded") | shared)
    close = F.when(F.col("worded"), aligned(F.col("first"), F.col("second")) <= F.col("most")).otherwise(False)
    both = both.select("a", "b", "one", "two", "most", once(close=close))
    return both.filter(F.when(F.col("close"), True).otherwise(F.expr("levenshtein(one, two, most) >= 0"))).select("a", "b")


def grouped_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line, class_doc, class_line, removed) for every occurrence of a line that has others like it, written."""
    return settled_alone(docs.sparkSession, lambda: _grouped(docs, id_col, text), "grouped")


def _grouped(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    rows = line_rows(docs, id_col, text)
    # Partial sums before the shuffle: a line that a third of all texts share is one row a task.
    lines = bucketed(rows.groupBy("k").agg(F.first("norm").alias("norm")), "k")
    places = written(rows.select("doc_id", "line", "k"), "lines")
    meet = lambda members: joined(members, written(odd_runs(lines, members), "marks"), MARKS, EDIT, SIMILARITY)
    found = linked(block_keys(lines), lambda pairs: verified(pairs, lines), meet)[1].withColumnRenamed("node", "k")
    firsts = places.groupBy("k").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count(F.lit(1)).alias("times"))
    alone = firsts.join(found, "k", "left")
    keepers = alone.filter("component is not null").groupBy("component").agg(F.min("first").alias("keeper"))
    marked = alone.filter("times > 1 or component is not null").join(keepers, "component", "left").select("k", F.coalesce("keeper", "first").alias("keeper"))
    out = places.join(marked, "k")
    stays = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("line") == F.col("keeper.line"))
    return out.select("doc_id", "line", F.col("keeper.doc_id").alias("class_doc"), F.col("keeper.line").alias("class_line"), (~stays).alias("removed"))


def judged(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of docs: doc_id, n_lines, n_removed, removed (line numbers from 0) and classes (line, and the
    occurrence that its group keeps) of the lines that have others like them."""
    marks = grouped_lines(docs, id_col, text).distinct().groupBy(F.col("doc_id").alias("_id")).agg(
        F.sort_array(F.collect_list(F.when(F.col("removed"), F.col("line")))).alias("removed"),
        F.sort_array(F.collect_list(F.struct("line", "class_doc", "class_line"))).alias("classes"),
    )
    none = F.array().cast("array<int>")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(F.coalesce(F.length(text), F.lit(0)) > 0, F.size(F.split(text, BREAK))).otherwise(0).cast("long").alias("n_lines"))
    out = own.join(marks, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", none).alias("removed"), F.coalesce("classes", F.array().cast("array<struct<line:int,class_doc:bigint,class_line:int>>")).alias("classes"))


def without_fuzzy_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", copied: float | None = None) -> DataFrame:
    """docs without the lines that go; n_chars, where there is such a column, follows. Columns stay. With `copied`, rows
    that lose at least this share of their letters go as a whole: they are copies of earlier texts, and what is left of
    them no later stage could tell to be one."""
    gone = grouped_lines(docs, id_col, text).filter("removed").select(F.col("doc_id").alias("_id"), "line").distinct().groupBy("_id").agg(F.collect_list("line").alias("_gone"))
    # The row travels whole in one column, so that no name of its columns can clash.
    out = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_own")).join(gone, F.col("_own").eqNullSafe(F.col("_id")), "left")
    old = F.col("_row")[text]
    out = out.withColumn("_lines", F.split(old, BREAK)).withColumn("_left", F.array_sort(F.array_except(F.sequence(F.lit(1), F.size("_lines")), F.transform("_gone", lambda i: i + 1))))
    left = F.array_join(F.transform("_left", lambda i: F.element_at("_lines", i)), BREAK)
    changed = F.col("_gone").isNotNull() & old.isNotNull()
    out = out.withColumn("_text", F.when(changed, left).otherwise(old))
    if copied is not None:
        out = out.filter(~changed | (F.length("_text") > F.lit(1 - copied) * F.length(old)))
    row = F.col("_row").withField(text, F.col("_text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(changed, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row")["n_chars"]))
    return out.select(row.alias("_row")).select("_row.*")
