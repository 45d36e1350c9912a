"""Evidence reading: rendered views of line ranges in pages, integrity checks."""

from __future__ import annotations

import codecs
import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
LEAST_PAGE, DEFAULT_PAGE, MOST_PAGE = 1_000, 60_000, 250_000
MEDIA_EVENTS, MEDIA_CHARS = 8, 6_000
OMITTED = "[additional media-bearing tool events omitted from compact media view; use view=text or view=raw for the complete line range]"
ATTACHMENT = "[attachment "


def rendered(lines: DataFrame, view: str = "text") -> DataFrame:
    """lines (archive_path, line, role, text, timestamp) with `rendered`; lines that show nothing are left out.

    raw: the text and a line break. text: a header and the text. media: user and assistant lines and tool lines with
    attachments, each different one once, at most MEDIA_EVENTS tool lines and then one note, long ones cut inside."""
    if view not in ("raw", "text", "media"):
        raise ValueError("view must be raw, text or media")
    if view == "raw":
        return lines.withColumn("rendered", F.concat("text", F.lit("\n")))
    role, text = F.col("role"), F.col("text")
    t = lines.filter(text != "")
    if view == "media":
        t = t.filter(role.isin("user", "assistant") | ((role == "tool") & F.contains(text, F.lit(ATTACHMENT))))
        mark = F.sha2(F.concat(role, F.lit("\0"), text), 256)
        t = t.withColumn("_n", F.row_number().over(Window.partitionBy("archive_path", mark).orderBy("line"))).filter("_n = 1")
        order = Window.partitionBy("archive_path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        t = t.withColumn("_tools", F.sum(F.when(role == "tool", 1).otherwise(0)).over(order))
        t = t.filter((role != "tool") | (F.col("_tools") <= MEDIA_EVENTS + 1))
        note = (role == "tool") & (F.col("_tools") == MEDIA_EVENTS + 1)
        t = t.withColumns({"text": F.when(note, F.lit(OMITTED)).otherwise(cut_inside(text)), "role": F.when(note, F.lit("media-navigation")).otherwise(role)}).drop("_n", "_tools")
    head = F.concat(F.lit("[raw line "), F.col("line").cast("string"), F.lit(" role="), F.col("role"), F.lit(" timestamp="), F.coalesce("timestamp", F.lit("")), F.lit(" raw_prefix_sha256="), F.sha2(F.left(F.encode("text", "UTF-8").cast("string"), F.lit(4096)), 256), F.lit("]\n"))
    return t.withColumn("rendered", F.concat(head, F.col("text"), F.lit("\n")))


def cut_inside(text: Column, most: int = MEDIA_CHARS) -> Column:
    half = most // 2
    note = F.concat(F.lit("\n[media view omitted "), (F.length(text) - 2 * half).cast("string"), F.lit(" middle chars; full_text_sha256="), F.sha2(text, 256), F.lit("; use view=text or view=raw]\n"))
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(half)), note, F.right(text, F.lit(half)))).otherwise(text)


def page(view: DataFrame, requests: DataFrame) -> DataFrame:
    """One row a request (request_id, archive_path, line_start, line_end, offset_chars, max_chars): the page's text, its
    checksum and the next offset (null when the range is complete)."""
    t = requests.join(view.select("archive_path", "line", "rendered"), "archive_path").filter(F.col("line").between(F.col("line_start"), F.col("line_end")))
    order = Window.partitionBy("request_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_from", F.coalesce(F.sum(F.length("rendered")).over(order), F.lit(0)))
    size = F.length("rendered")
    t = t.withColumn("_total", F.sum(size).over(Window.partitionBy("request_id")))
    start = F.greatest(F.lit(0), F.col("offset_chars") - F.col("_from"))
    count = F.least(size, F.col("offset_chars") + F.col("max_chars") - F.col("_from")) - start
    t = t.withColumn("_piece", F.when(count > 0, F.struct("line", F.substring(F.col("rendered"), (start + 1).cast("int"), count.cast("int")).alias("text"))))
    t = t.groupBy("request_id", "archive_path", "line_start", "line_end", "offset_chars", "max_chars").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_piece")), lambda p: p["text"]), "").alias("evidence_text"), F.max("_total").alias("total_chars"))
    t = t.withColumn("returned_chars", F.length("evidence_text"))
    end = F.col("offset_chars") + F.col("returned_chars")
    t = t.withColumn("complete", end >= F.col("total_chars"))
    return t.withColumn("next_offset_chars", F.when(~F.col("complete"), end)).withColumn("chunk_sha256", F.sha2("evidence_text", 256))


def integrity(now: DataFrame, indexed: DataFrame) -> DataFrame:
    """(archive_path, state) of (size, mtime, tail_sha256 at the indexed end) against what was indexed: missing, shrank,
    changed, not-append-only, grew or same. Readers refuse all but the last two."""
    was = indexed.select("archive_path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("tail_sha256").alias("_tail"))
    t = was.join(now, "archive_path", "left")
    state = (
        F.when(F.col("size").isNull(), "missing").when(F.col("size") < F.col("_size"), "shrank")
        .when((F.col("size") == F.col("_size")) & (F.col("mtime") != F.col("_mtime")), "changed")
        .when((F.col("size") > F.col("_size")) & (F.col("tail_sha256") != F.col("_tail")), "not-append-only")
        .when(F.col("size") > F.col("_size"), "grew").otherwise("same")
    )
    return t.select("archive_path", state.alias("state"))


#: Bytes of a file that are read at a time.
PIECE = 1 << 16


def raw_page(request: dict) -> dict:
    """One page of raw lines, from the request's seek point on; see `plans.context.raw_pages`."""
    out = {"request_id": request["request_id"], "error": request["error"]}
    if request["error"]:
        return out
    try:
        handle = open(request["archive_path"], "rb")
    except OSError:
        return out | {"error": "indexed archive is no longer available"}
    with handle:
        handle.seek(request["byte_offset"])
        if hashlib.sha256(handle.read(request["prefix_length"])).hexdigest() != request["prefix_sha256"]:
            return out | {"error": "archive content changed after indexing; synchronise the index"}
        handle.seek(request["byte_offset"])
        line, first, last = request["line_number"], request["line_start"], request["line_end"]
        begin, end = request["offset_chars"], request["offset_chars"] + request["max_chars"]
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        kept, total = [], 0

        def show(data: bytes, final: bool = False) -> None:
            nonlocal total
            text = decoder.decode(data, final)
            if total < end and total + len(text) > begin:
                kept.append(text[max(0, begin - total) : end - total])
            total += len(text)

        while line <= last and (piece := handle.readline(PIECE)):
            if line >= first:
                show(piece)
            line += piece.endswith(b"\n")
        show(b"", True)
    text = "".join(kept)
    complete = begin + len(text) >= total
    return out | {"evidence_text": text, "total_chars": total, "returned_chars": len(text), "complete": complete, "next_offset_chars": None if complete else begin + len(text), "chunk_sha256": hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()}
