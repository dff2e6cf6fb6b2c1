"""``functions.text.tokens`` for a whole Arrow batch of lower-cased texts, by arrays of their bytes.

The regular expression tells letters and digits apart a character at a time, and its tokens reach Python as lists of
strings; where only Python reads them, texts are shipped and split there. What a letter is, is asked of the session once.

So is what a character becomes in lower case: the session's ``lower`` takes any text with a character beyond ASCII apart and
costs more than all the rest of its scan. ``shipped`` leaves to it only texts with a character whose lower case depends on its
neighbours (a capital sigma); the others reach Python as they are and are lower-cased by the bytes of their batch.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ragtide.config import TOKEN_PATTERN
from ragtide.functions.text import col_

_CODE_POINTS = 0x110000
_SURROGATES = (0xD800, 0xDFFF)
#: Bytes of text that are marked at once (and one text at least).
BLOCK_BYTES = 4 << 20
#: First and last code points of the runs of token characters.
Runs = tuple[tuple[int, int], ...]

#: Characters that ``lower`` changes, with what they become: (code point, text).
Lowers = tuple[tuple[int, str], ...]
#: More characters that depend on their neighbours than these are not looked for; every text is left to ``lower`` then.
_MOST_SOUGHT = 4
_RUNS: dict[str, Runs] = {}
_LOWERS: list[tuple[Lowers, tuple[str, ...]]] = []


def _characters(spark: SparkSession):
    """Every character ``c`` and its code point ``id``."""
    every = spark.range(0, _CODE_POINTS, 1, 8).where(~F.col("id").between(*_SURROGATES))
    return every.withColumn("c", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')"))


def token_runs() -> Runs:
    """The characters of ``TOKEN_PATTERN`` as the session's regular expressions know them (by its Java's Unicode version)."""
    if TOKEN_PATTERN not in _RUNS:
        spark = SparkSession.active()
        found = _characters(spark).where(F.col("c").rlike(f"^{TOKEN_PATTERN}$"))
        ids = np.sort(found.toArrow()["id"].to_numpy())
        first = np.r_[True, ids[1:] > ids[:-1] + 1]
        last = np.r_[first[1:], True]
        _RUNS[TOKEN_PATTERN] = tuple(zip(ids[first].tolist(), ids[last].tolist()))
    return _RUNS[TOKEN_PATTERN]


def _lowers() -> tuple[Lowers, tuple[str, ...]]:
    """What the session's ``lower`` changes, and those characters that it changes by what stands beside them."""
    if not _LOWERS:
        low = lambda *parts: F.lower(F.concat(*parts))
        c, before, after = F.col("c"), F.lit("A"), F.lit("\u0307")
        beside = (low(before, c) != F.concat(F.lower(before), F.lower(c))) | (low(c, before) != F.concat(F.lower(c), F.lower(before))) | (
            low(c, after) != F.concat(F.lower(c), F.lower(after)))
        rows = _characters(SparkSession.active()).select("id", "c", F.lower("c").alias("low"), beside.alias("beside")).where(
            "low <> c or beside").orderBy("id").collect()
        _LOWERS.append((tuple((r["id"], r["low"]) for r in rows), tuple(r["c"] for r in rows if r["beside"])))
    return _LOWERS[0]


def lowers() -> Lowers:
    """What ``token_lists`` needs to lower-case what ``shipped`` gives."""
    return _lowers()[0]


def shipped(text: Column | str) -> Column:
    """``text`` as it goes to ``token_lists`` with ``lowers``: as it is, unless its lower case depends on more than each character."""
    t, sought = col_(text), _lowers()[1]
    if len(sought) > _MOST_SOUGHT:
        return F.lower(t)
    alone = F.is_valid_utf8(t)
    for c in sought:
        alone &= ~F.contains(t, F.lit(c))
    return F.when(alone, t).otherwise(F.lower(t))


@lru_cache(maxsize=2)
def _tables(runs: Runs) -> tuple[bytes, np.ndarray]:
    """Whether a byte is a token's (ASCII; others not yet), and whether a code point is."""
    points = np.zeros(_CODE_POINTS, bool)
    for a, z in runs:
        points[a: z + 1] = True
    return points[:128].tobytes() + bytes(128), points


@lru_cache(maxsize=2)
def _lower_tables(low: Lowers) -> tuple[bytes, np.ndarray, dict[int, str]]:
    """Lower case of ASCII bytes, and of code points (-1: not one character of as many bytes), and all that changes."""
    plain, points = bytearray(range(256)), np.arange(_CODE_POINTS, dtype=np.int32)
    for c, to in low:
        same = len(to) == 1 and len(to.encode()) == len(chr(c).encode())
        points[c] = ord(to) if same else -1
        if c < 128 and same:
            plain[c] = ord(to)
    return bytes(plain), points, dict(low)


def _code_points(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where characters beyond ASCII begin in UTF-8 ``text``, the bytes that follow, and their code points."""
    lead = np.flatnonzero(text >= 0xC0)
    head = text[lead].astype(np.int32)
    more = 1 + (head >= 0xE0) + (head >= 0xF0)
    point = head & (0x3F >> more)
    for i in (1, 2, 3):
        follows = np.flatnonzero(more >= i)
        point[follows] = point[follows] << 6 | text[np.minimum(lead[follows] + i, len(text) - 1)] & 0x3F
    return lead, more, np.minimum(point, _CODE_POINTS - 1)


def _lowered(text: np.ndarray, rows: np.ndarray, low: Lowers) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 ``text`` and the borders of its rows, in lower case."""
    plain, points, every = _lower_tables(low)
    # code points of one byte that become several
    odd = [c for c in range(128) if points[c] < 0]
    lead, more, point = _code_points(text)
    to = points[point]
    if (to < 0).any() or any((text == c).any() for c in odd):
        data = text.tobytes()
        texts = [data[a:z].decode("utf-8", "replace").translate(every).encode() for a, z in zip(rows[:-1], rows[1:])]
        return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    text = np.frombuffer(bytearray(text).translate(plain), np.uint8)
    at = np.flatnonzero(to != point)
    lead, more, to = lead[at], more[at], to[at]
    marks = np.array([0, 0xC0, 0xE0, 0xF0])
    for i in range(4):  # the byte i of a character
        some = more >= i
        six = to[some] >> 6 * (more[some] - i)
        text[lead[some] + i] = marks[more[some]] | six if i == 0 else 0x80 | six & 0x3F
    return text, rows


def _marks(text: np.ndarray, runs: Runs) -> np.ndarray:
    """Which bytes of UTF-8 ``text`` belong to token characters."""
    plain, points = _tables(runs)
    mark = np.frombuffer(bytearray(text).translate(plain), bool).copy()
    lead, more, point = _code_points(text)
    if len(lead):
        ok = points[point]
        for i in range(4):
            at = lead[ok & (more >= i)] + i
            mark[at[at < len(mark)]] = True
    return mark


def token_lists(texts: pa.Array, runs: Runs, low: Lowers = ()) -> pa.Array:
    """A list of tokens for each lower-cased text, null for null. With ``low``, texts are lower-cased here."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    valid = texts.is_valid() if texts.null_count else None
    if valid is not None:
        texts = pc.fill_null(texts, "")
    large = pa.types.is_large_string(texts.type)
    n, width = len(texts), np.int64 if large else np.int32
    ends = np.frombuffer(texts.buffers()[1], width)[texts.offset: texts.offset + n + 1] if n else np.zeros(1, width)
    text = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    kept, heads, counts, a, total = [], [], [], 0, 0
    while a < n:
        z = max(a + 1, int(np.searchsorted(ends, ends[a] + BLOCK_BYTES, "right")) - 1)
        block, rows = text[ends[a]: ends[z]], ends[a: z + 1].astype(np.int64) - ends[a]
        if low:
            block, rows = _lowered(block, rows, low)
        mark = _marks(block, runs)
        first = mark.copy()
        first[1:] &= ~mark[:-1]
        opens = rows[:-1][rows[:-1] < len(mark)]
        first[opens] = mark[opens]  # no token spans two texts
        counts.append(np.diff(np.searchsorted(np.flatnonzero(first), rows)))
        heads.append(np.flatnonzero(first[mark]) + total)
        kept.append(block[mark])
        total += len(kept[-1])
        a = z
    offsets = np.concatenate([*heads, [total]]).astype(width)
    data = np.concatenate(kept) if kept else np.zeros(0, np.uint8)
    words = (pa.LargeStringArray if large else pa.StringArray).from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
    of = np.concatenate([[0], np.cumsum(np.concatenate(counts))] if counts else [[0]]).astype(width)
    lists = pa.LargeListArray if large else pa.ListArray
    return lists.from_arrays(pa.array(of), words, mask=None if valid is None else pc.invert(valid))
