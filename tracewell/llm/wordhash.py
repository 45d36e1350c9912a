"""Hashes of words and of runs of words, by whole batches of texts."""

from __future__ import annotations

import re
from functools import cache

import numpy as np

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are hashed at a time.
BLOCK = 2 << 20
BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2^64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def numbers(seed: int, n: int) -> np.ndarray:
    """n fixed random 64-bit numbers."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


@cache
def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def room(n: int) -> int:
    return 1 << max(12, int(n).bit_length())


def word_hashes(data: bytes, seed: int = 1) -> np.ndarray:
    """The 64-bit hash of each word of UTF-8 data, in order."""
    out = []
    for block in _blocks(data):
        raw = np.frombuffer(block, np.uint8)
        word = ~BLANK[raw]
        first = word.copy()
        first[1:] &= ~word[:-1]
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        raw, word = raw[starts[0] :], word[starts[0] :]
        starts = starts - starts[0]
        place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
        value = numbers(seed, 256)[raw] * (numbers(seed + 1, room(place.max() + 1))[place] | np.uint64(1))
        value[~word] = 0
        out.append(mixed(np.add.reduceat(value, starts)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _blocks(data: bytes):
    """The data cut behind blanks into pieces of some BLOCK bytes (a longer word stays whole)."""
    at = 0
    while len(data) - at > BLOCK:
        cut = max(data.rfind(bytes([b]), at, at + BLOCK) for b in (0x20, *range(0x09, 0x0E))) + 1
        if cut <= at:
            found = re.compile(rb"[\x20\x09-\x0D]").search(data, at + BLOCK)
            cut = found.end() if found else len(data)
        yield data[at:cut]
        at = cut
    yield data[at:]


def hashed(texts: list[str | None], seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts in a row, and where each text's words begin (one entry more than texts)."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    parts, counts, group, size = [], [], [], 0

    def flush() -> None:
        # A blank line stands between texts; a marker word ends each, to count the words.
        if group:
            marks = word_hashes(b" \xff ".join([*group, b""]), seed)
            end = np.flatnonzero(marks == mark)
            counts.extend(np.diff(np.concatenate([[-1], end])) - 1)
            parts.append(np.delete(marks, end))

    mark = word_hashes(b"\xff", seed)[0]  # no UTF-8 text has this byte
    for x in data:
        if size + len(x) > BLOCK and group:
            flush()
            group, size = [], 0
        group.append(x)
        size += len(x) + 3
    flush()
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum(np.array(counts, np.int64))]).astype(np.int64)


def run_hashes(words: np.ndarray, at: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """The hash of words[at : at + width], for each at, from prefix sums."""
    n = len(words)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(base, room(n))[:n], out=sums[1:])
    return mixed((sums[at + width] - sums[at]) * powers(pow(base, -1, 1 << 64), room(n))[at])


def xxhash64(ids: np.ndarray, seed: int = 42) -> np.ndarray:
    """The xxhash64 of 64-bit numbers, as Spark's function of that name gives it for a bigint."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    k = turned(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1
    h = (np.uint64(seed) + p5 + np.uint64(8)) ^ k
    h = turned(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)
