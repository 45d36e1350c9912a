"""Transcript files as lines with offsets: a Python data source that never holds more of a line than its bound."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

# Bounds of a line, of its edges, of the prefix that is checked and of the words that are kept.
MOST_BYTES, CHUNK, EDGE, PREFIX, TAIL = 8 << 20, 64 << 10, 64 << 10, 4096, 4096
SKETCH_WORDS, SKETCH_CARRY, SKETCH_CHARS = 8_000, 512, 96_000
WORD = r"(?<![A-Za-z0-9+/=])(?:/[A-Za-z0-9_.@%:+~-]+(?:/[A-Za-z0-9_.@%:+~-]+)*|[A-Za-z_][A-Za-z0-9_.:@/+~-]{3,239}|[㐀-鿿]{2,80})(?![A-Za-z0-9+/=])"

SCHEMA = "path string, line long, byte_offset long, next_offset long, raw binary, prefix binary, suffix binary, prefix_sha256 string, prefix_length int, raw_sha256 string, raw_bytes long, oversized boolean, lexical_sketch string"


class Sketch:
    """The different words of a line that passes by in pieces."""

    def __init__(self) -> None:
        self.words: dict[str, None] = {}
        self.carry = ""

    def add(self, piece: bytes) -> None:
        text = self.carry + piece.decode("utf-8", "ignore")
        for m in re.finditer(WORD, text):
            if len(self.words) >= SKETCH_WORDS:
                break
            if len(m[0]) <= 240:
                self.words.setdefault(m[0])
        self.carry = text[-SKETCH_CARRY:]


def bounded_lines(handle: BinaryIO, path: str, offset: int = 0, line: int = 1) -> Iterator[tuple]:
    """Rows of SCHEMA from an offset on. A line above MOST_BYTES is drained in chunks: its edges, its digest and a
    sketch of its words remain."""
    handle.seek(offset)
    while piece := handle.readline(MOST_BYTES + 1):
        head, size, digest, tail = piece[:EDGE], len(piece), hashlib.sha256(piece), piece[-EDGE:]
        over = len(piece) > MOST_BYTES and not piece.endswith(b"\n")
        sketch = Sketch()
        if over:
            sketch.add(piece)
            while not tail.endswith(b"\n") and (more := handle.readline(CHUNK)):
                digest.update(more)
                sketch.add(more)
                size += len(more)
                tail = (tail + more)[-EDGE:]
        yield (path, line, offset, offset + size, None if over else piece, head, tail, hashlib.sha256(head[:PREFIX]).hexdigest(), min(len(head), PREFIX), digest.hexdigest(), size, over, " ".join(sketch.words)[:SKETCH_CHARS])
        offset += size
        line += 1


def transcripts(root: str) -> list[str]:
    """All *.jsonl files under a folder (or the one file), sorted; none where the folder is missing."""
    if os.path.isfile(root):
        return [root]
    return sorted(os.path.join(folder, name) for folder, _, names in os.walk(root) for name in names if name.endswith(".jsonl"))


def guard(path: str, size: int) -> str:
    """The digest of the last bytes before an offset: an append leaves it as it is."""
    with open(path, "rb") as handle:
        handle.seek(max(0, size - TAIL))
        return hashlib.sha256(handle.read(min(size, TAIL))).hexdigest()


def whole_lines(path: str) -> int:
    """Where the last line that has ended ends, looked for from the end of the file."""
    with open(path, "rb") as handle:
        at = handle.seek(0, os.SEEK_END)
        while at:
            start = max(0, at - CHUNK)
            handle.seek(start)
            found = handle.read(at - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
    return 0


class FilePart(InputPartition):
    def __init__(self, path: str, offset: int = 0, line: int | None = 1, end: int | None = None):
        super().__init__(path)
        self.path, self.offset, self.line, self.end = path, offset, line, end


class LineReader(DataSourceReader):
    """One task a file, as a line's number depends on all before it."""

    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        return [FilePart(p) for p in transcripts(self.root)] or [FilePart("")]

    def read(self, part: FilePart) -> Iterator[tuple]:
        if part.path:
            with open(part.path, "rb") as handle:
                yield from bounded_lines(handle, part.path, part.offset, part.line)


class LineStream(DataSourceStreamReader):
    """What has been appended. An offset holds size and guard of each file; a file that shrank or whose tail
    changed is an error, never a silent skip."""

    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: [end, guard(path, end)] for path in transcripts(self.root) for end in [whole_lines(path)]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts = []
        for path, (size, _) in end.items():
            had, mark = start.get(path, [0, None])
            if size < had or (had and guard(path, had) != mark):
                raise RuntimeError(f"{path} was rewritten after it was read; build its index again")
            if size > had:
                parts.append(FilePart(path, had, None, size))
        return parts

    def read(self, part: FilePart) -> Iterator[tuple]:
        with open(part.path, "rb") as handle:
            # Counted by the task: the driver reads the ends of files only.
            line, left = 1, part.offset
            while left:
                piece = handle.read(min(CHUNK, left))
                line, left = line + piece.count(b"\n"), left - len(piece)
            for row in bounded_lines(handle, part.path, part.offset, line):
                if part.end is not None and row[2] >= part.end:
                    return
                yield row

    def commit(self, end: dict) -> None:
        pass


class BoundedLines(DataSource):
    """spark.read.format("bounded_lines").load(folder), and the same with readStream. Files are opened by tasks, so the
    folder must be mounted on every executor."""

    @classmethod
    def name(cls) -> str:
        return "bounded_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LineReader:
        return LineReader(self.options["path"])

    def streamReader(self, schema: StructType) -> LineStream:
        return LineStream(self.options["path"])


def register(spark: SparkSession) -> None:
    from tracewell.functions.shipping import ship

    ship(spark)
    spark.dataSource.register(BoundedLines)
