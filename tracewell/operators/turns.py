"""From transcript lines to exchanges, epochs, episodes, chunks and their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.columns import plain

# Sizes and overlaps, prefixes that decide what a user line is.
CHUNK, CHUNK_OVERLAP = 12_000, 800
EPISODE, EPISODE_OVERLAP = 10, 2
EVENT_CHARS, PENDING_CHARS = 96_000, 384_000  # of what a stream keeps of an open exchange
SEEK_EVERY = 128
PLUGINS, ENVIRONMENT, ENVIRONMENT_END = "<recommended_plugins>", "<environment_context>", "</environment_context>"
DELEGATION = "<codex_delegation>"
BROWSER = r"(?is)<in-app-browser-context\b[^>]*>.*?</in-app-browser-context>\s*"
HEADING = r"(?i)^\s*##\s*My request for Codex:\s*"
REVIEW = "The following is the Codex agent history whose request action you are assessing."


def conversation_lines(conversations: DataFrame) -> DataFrame:
    """Conversations as transcript lines: (archive_path, session_id, line, role, text, timestamp)."""
    line = (F.col("turn") + 1).cast("long")
    return conversations.select(F.concat(F.lit("conversations/"), F.col("conv_id").cast("string")).alias("archive_path"), F.col("conv_id").cast("string").alias("session_id"), line.alias("line"), "role", F.coalesce("text", F.lit("")).alias("text"), F.lpad(line.cast("string"), 10, "0").alias("timestamp"))


def turn_kind(text: Column) -> Column:
    """user, delegation, or meta for user lines that neither open nor close an exchange."""
    t = F.trim(text)
    meta = (t == "") | t.startswith(PLUGINS) | (t.startswith(ENVIRONMENT) & t.endswith(ENVIRONMENT_END))
    return F.when(meta, "meta").when(t.startswith(DELEGATION), "delegation").when(user_text(text) == "", "meta").otherwise("user")


def user_text(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.startswith(DELEGATION), t).otherwise(F.trim(F.regexp_replace(F.trim(F.regexp_replace(t, BROWSER, "")), HEADING, "")))


def exchanges(lines: DataFrame) -> DataFrame:
    """One user line and all visible output up to the next one: gaps and islands over each archive.

    Meta user lines stand aside, output before the first user line is dropped, and so are exchanges of an approval
    review. line_end is the line before the next user line, or the archive's last."""
    by_line = Window.partitionBy("archive_path").orderBy("line")
    t = lines.withColumn("kind", F.when(F.col("role") == "user", turn_kind(F.col("text"))))
    t = t.withColumn("last_line", F.max("line").over(Window.partitionBy("archive_path")))
    t = t.filter(F.col("role").isin("user", "assistant") & (F.coalesce("kind", F.lit("")) != "meta"))
    t = t.withColumn("island", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(by_line)).filter("island > 0")
    said = F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("line", "text"))))
    t = t.groupBy("archive_path", "session_id", "island").agg(
        F.min("line").alias("line_start"), F.max("last_line").alias("last_line"), F.max(F.when(F.col("role") == "user", user_text(F.col("text")))).alias("user_message"),
        F.max(F.when(F.col("role") == "user", F.col("timestamp"))).alias("timestamp"), F.max("kind").alias("turn_kind"), F.array_join(F.transform(said, lambda s: s["text"]), "\n").alias("assistant_message"),
    )
    following = F.lead("line_start").over(Window.partitionBy("archive_path").orderBy("line_start"))
    t = t.withColumn("line_end", F.greatest("line_start", F.coalesce(following - 1, F.col("last_line"))))
    t = t.filter(~F.ltrim("user_message").startswith(REVIEW))
    number = F.left(F.sha2(F.concat_ws(":", "archive_path", F.col("line_start").cast("string")), 256), F.lit(32))
    return t.select(number.alias("id"), "archive_path", "session_id", "timestamp", "line_start", "line_end", "user_message", "assistant_message", "turn_kind")


def compactions(lines: DataFrame) -> DataFrame:
    """System lines are the boundaries of context epochs."""
    return lines.filter(F.col("role") == "system").select("archive_path", F.col("line").alias("line_number"), F.col("text").alias("summary_text"))


def epochs(exchange: DataFrame, boundary: DataFrame) -> DataFrame:
    """exchange with epoch: the number of boundaries before it. One pass over both, sorted by line."""
    marks = boundary.select("archive_path", F.col("line_number").alias("line_start"), F.lit(1).alias("_mark"))
    order = Window.partitionBy("archive_path").orderBy("line_start", F.col("_mark").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return exchange.withColumn("_mark", F.lit(0)).unionByName(marks, allowMissingColumns=True).withColumn("epoch", F.sum("_mark").over(order)).filter("_mark = 0").drop("_mark")


def episodes(in_epochs: DataFrame, size: int = EPISODE, overlap: int = EPISODE_OVERLAP) -> DataFrame:
    """Sliding windows of exchanges within an epoch: (archive_path, session_id, epoch, window, line_start, line_end,
    exchanges); the last window is the first that reaches the end."""
    step = max(1, size - overlap)
    epoch = Window.partitionBy("archive_path", "epoch")
    t = in_epochs.withColumn("_i", F.row_number().over(epoch.orderBy("line_start")) - 1).withColumn("_n", F.count(F.lit(1)).over(epoch))
    # Window w covers places w * step to w * step + size - 1 and exists if the one before it misses the end.
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - size) / step)).cast("int")
    low = F.greatest(F.lit(0), F.ceil((F.col("_i") - (size - 1)) / step)).cast("int")
    high = F.least(F.floor(F.col("_i") / step).cast("int"), last)
    t = t.filter(low <= high).withColumn("window", F.explode(F.sequence(low, high)))
    return t.groupBy("archive_path", "session_id", "epoch", "window").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.count(F.lit(1)).alias("exchanges"))


def nth_user_turn(exchange: DataFrame, n: int) -> DataFrame:
    """The nth user exchange of each session that has one; delegations don't count."""
    order = Window.partitionBy("session_id").orderBy("line_start")
    return exchange.filter("turn_kind = 'user'").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") == n)


def neighbours(exchange: DataFrame, reach: int = 200) -> DataFrame:
    """Each different line range with the context from its predecessor to its successor, if they are within reach."""
    t = exchange.select("session_id", "line_start", "line_end").distinct()
    order = Window.partitionBy("session_id").orderBy("line_start", "line_end")
    before, after = F.lag("line_start").over(order), F.lead(F.struct("line_start", "line_end")).over(order)
    near = lambda c: F.col("line_start") - c <= reach
    return t.select("session_id", "line_start", "line_end", F.when(near(before), before).otherwise(F.col("line_start")).alias("context_start"), F.when(after["line_start"] - F.col("line_end") <= reach, after["line_end"]).otherwise(F.col("line_end")).alias("context_end"))


def chunks(texts: DataFrame, text: str = "text", limit: int = CHUNK, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """texts with part and chunk: overlapping slices that cover the text and end with it."""
    step = limit - overlap
    n = F.length(text)
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / step)).cast("int")
    return texts.withColumn("part", F.explode(F.sequence(F.lit(0), F.when(n <= limit, F.lit(1)).otherwise(count) - 1))).withColumn("chunk", F.substring(F.col(text), F.col("part") * step + 1, F.lit(limit)))


def seek_points(lines: DataFrame, every: int = SEEK_EVERY) -> DataFrame:
    return lines.filter((F.col("line") - 1) % every == 0)


def fork_remainder(child: DataFrame, parent: DataFrame, key: str, text: str) -> DataFrame:
    """The child's rows whose text does not occur in the parent (same key); all of them where nothing would remain."""
    mark = F.sha2(plain(F.col(text)), 256)
    known = parent.select(F.col(key).alias("_k"), mark.alias("_m")).distinct()
    own = child.withColumn("_mark", mark)
    fresh = own.join(known, (F.col(key) == F.col("_k")) & (F.col("_mark") == F.col("_m")), "left").withColumn("_fresh", F.col("_m").isNull()).drop("_k", "_m")
    some = F.max(F.col("_fresh").cast("int")).over(Window.partitionBy(key))
    return fresh.withColumn("_some", some).filter(F.col("_fresh") | (F.col("_some") == 0)).drop("_mark", "_fresh", "_some")


def asked(exchange: DataFrame) -> Column:
    """A digest of what the user says in an exchange."""
    return F.sha2(plain(F.col("user_message")), 256)
