"""Suffix-array dedup: remove every byte covered by a long string of an earlier document.

A byte of a document goes if some ``length``-byte string (50) that covers it
also starts in a document with a smaller doc_id. The classes of equal strings come from a
suffix sort with common-prefix lengths (``ragtide.llm.induced``). What the Spark
jobs around it do is to bring equal strings into one shard and nothing else:

1. Every ``length``-byte string belongs to the least hash of the 16-byte strings
   inside it. Consecutive strings with the same least hash form a *segment*, so
   a text is cut into segments without knowing other texts, and equal strings
   always lie in segments with the same hash.
2. Hashes that occur in two or more documents are found by shuffling packed
   (hash, document, place) arrays, some 9 bytes for 19 bytes of text. A hash that a batch
   of documents shares is sent once per batch, so a passage that a third of all
   documents hold does not crowd a task.
3. Only the segments of shared hashes are cut out and sent to the shard of their
   hash. Equal segments of a batch, and then of a shard, are kept once, with the
   smallest document that holds them.
4. Each shard sorts its segments' suffixes. A class of suffixes that agree in
   ``length`` bytes belongs to its smallest document; in the others the string is
   removed. Shards are spooled to the task's scratch files beyond the memory
   limit, and sorted a part at a time.
5. The removed ranges return to their documents and are merged.

A task works on one part of its rows at a time. Parts are dealt by hash, and a
part whose weight is beyond the memory limit is dealt again, so that parts do not
grow with the shard. Only the rows of a single value of the DIGITS (some 1 in
32768 of a shard, or one hash or document that holds more) are not divided further.

Nothing is sampled or capped. Ranges are decided on the input alone.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.llm.common import partitions, schema_of, written
from ragtide.llm.induced import repeats
from ragtide.operators.numbering import numbered

SUBSTRING = 16
#: Bytes of text handled at a time when texts are hashed, and when they are cut.
CHUNK = 4_000_000
CUT_CHUNK = 16_000_000
#: Ways in which rows are dealt to parts, and how many times a part can be dealt again.
PARTS = 8
DIGITS = 5
#: Bytes of a spool that go to its scratch file as one value.
RUN = 1_000_000
#: Weight of one row of numbers against one suffix in the memory limit.
ROW = 5
#: Suffixes (and queue tuples) that a task keeps in memory; beyond that, scratch files.
MEMORY = 16_000_000


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays of numbers as one compressed value; equal bytes of the numbers lie together."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        out.append(np.array([len(a), ord(a.dtype.char)], np.int64).tobytes())
        out.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=level).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    at, out = 0, []
    while at < len(data):
        n, char = np.frombuffer(data, np.int64, 2, at)
        dtype = np.dtype(chr(char))
        at += 16
        size = int(n) * dtype.itemsize
        planes = np.frombuffer(data, np.uint8, size, at).reshape(dtype.itemsize, int(n))
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(-1))
        at += size
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _high(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The high 40 bits of hashes, as two arrays. With the shard, which other bits decide, they tell hashes apart;
    a rare collision only sends a segment that has no copy."""
    return (key >> np.uint64(24)).astype(np.uint32), (key >> np.uint64(56)).astype(np.uint8)


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)


def segments(buf: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, strings) of the segments of texts joined in ``buf``: ``strings`` consecutive
    ``length``-byte strings begin at ``place``, and ``hash`` is the least hash inside each of them."""
    empty = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = min(SUBSTRING, length)
    if len(buf) < length:
        return empty
    starts = np.concatenate([[0], ends[:-1]])
    long_enough = ends - starts >= length
    if not long_enough.any():
        return empty
    h, width = buf.astype(np.uint64) + np.uint64(1), 1
    base = 0x9E3779B97F4A7C15
    power = lambda n: np.uint64(pow(base, n, 1 << 64))
    with np.errstate(over="ignore"):
        while width * 2 <= k:  # hashes of twice as long substrings from two neighbours
            h = h[:-width] * power(width) + h[width:]
            width *= 2
        if width < k:  # overlapping halves are a hash of the whole, too
            h = h[: len(buf) - k + 1] * power(k) + h[k - width:]
    h = _mix(h)
    window, span, step = length - k + 1, h, 1
    while step * 2 <= window:
        span = np.minimum(span[:-step], span[step:])
        step *= 2
    if step < window:
        span = np.minimum(span[: len(span) - (window - step)], span[window - step:])
    inside = np.zeros(len(buf) + 1, np.int64)
    inside[starts[long_enough]] += 1
    np.subtract.at(inside, ends[long_enough] - length + 1, 1)
    inside = np.cumsum(inside)[: len(span)] > 0
    cut = np.ones(len(span) + 1, bool)
    cut[1:-1] = (span[1:] != span[:-1]) | (inside[1:] != inside[:-1])
    cut[starts[long_enough]] = True
    at = np.flatnonzero(cut)
    place, strings = at[:-1], np.diff(at)
    use = inside[place]
    return _mix(span[place[use]]), place[use], strings[use]


def _groups(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, rows) for each value, rows in their order."""
    order = np.argsort(bucket, kind="stable")
    values = bucket[order]
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(bucket[rows[0]]), rows


def _shared(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each entry's key occurs with two or more values of ``doc``."""
    if len(key) == 0:
        return np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    k, d = key[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    many = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
    out = np.empty(len(key), bool)
    out[order] = np.repeat(many, np.diff(first, append=len(k)))
    return out


class _Rows:
    """Collects (to, kind, data) rows and gives them out as record batches of bounded size."""

    SCHEMA = "to int, kind int, data binary"

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, bytes]] = []
        self.size = 0

    def add(self, to: int, kind: int, data: bytes) -> None:
        self.rows.append((to, kind, data))
        self.size += len(data)

    def full(self) -> bool:
        return self.size > 8_000_000

    def batch(self) -> pa.RecordBatch:
        to, kind, data = zip(*self.rows) if self.rows else ((), (), ())
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())],
                                          names=["to", "kind", "data"])


REQUEST, KNOWN, SEGMENTS = 0, 1, 2


def _texts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each text) of a string column; nulls are empty."""
    col = col.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets[1:] - offsets[0]


def _chunks(sizes: np.ndarray, chunk: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``chunk`` bytes."""
    at, total = 0, np.concatenate([[0], np.cumsum(sizes)])
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, total[at] + chunk, side="right")) - 1)
        yield at, end
        at = end


def _ask(n: int, length: int):
    """Texts -> hashes to look up (REQUEST, by hash) and places of hashes already known as shared (KNOWN, by document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows()
        for b in batches:
            dk, rk = b.column(0).to_numpy(), b.column(1).to_numpy()
            buf, ends = _texts(b.column(2))
            starts = ends - np.diff(ends, prepend=0)
            for a, z in _chunks(ends - starts, CHUNK):
                lo = starts[a]
                key, place, strings = segments(buf[lo: ends[z - 1]], ends[a:z] - lo, length)
                row = np.searchsorted(ends[a:z] - lo, place, side="right") + a
                start = place - (starts[row] - lo)
                known = _shared(key, dk[row])
                for to, i in _groups(_home(dk[row[known]], rk[row[known]], n)):
                    i = np.flatnonzero(known)[i]
                    out.add(to, KNOWN, pack(dk[row[i]], rk[row[i]], *_high(key[i]), start[i].astype(np.uint32),
                                            strings[i].astype(np.uint32)))
                once = np.unique(key[known])
                rest = np.flatnonzero(~known)
                known_to = dict(_groups((once % np.uint64(n)).astype(np.int64)))
                asked = dict(_groups((key[rest] % np.uint64(n)).astype(np.int64)))
                for to in sorted(known_to.keys() | asked.keys()):
                    i = rest[asked.get(to, np.zeros(0, np.int64))]
                    rows, local = np.unique(row[i], return_inverse=True)
                    out.add(to, REQUEST, pack(
                        *_high(key[i]), local.astype(np.uint32), start[i].astype(np.uint32), strings[i].astype(np.uint32),
                        dk[rows], rk[rows], *_high(once[known_to.get(to, np.zeros(0, np.int64))])))
                if out.full():
                    yield out.batch()
        yield out.batch()

    return run


def _answer(n: int, memory: int):
    """Requests of one range of hashes -> places of the shared ones, by document. KNOWN places pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _Grouped(lambda key, *_: key >> np.uint64(16), memory)
        out = _Rows()
        for b in batches:
            for to, kind, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                if kind == KNOWN:
                    out.add(to, kind, data)
                    if out.full():
                        yield out.batch()
                    continue
                low, high, local, start, strings, dk, rk, *shared = unpack(data)
                got.add(_joined(low, high), dk[local], rk[local], start, strings)
                known = _joined(*shared)  # rows without strings
                none = np.zeros(len(known), np.uint32)
                got.add(known, none.astype(dk.dtype), none.astype(rk.dtype), none.astype(start.dtype), none.astype(strings.dtype))
        for key, dk, rk, start, strings in got.drain():
            known, asked = key[strings == 0], strings > 0
            key, dk, rk, start, strings = (x[asked] for x in (key, dk, rk, start, strings))
            use = np.flatnonzero(_shared(key, dk) | np.isin(key, known))
            for to, i in _groups(_home(dk[use], rk[use], n)):
                i = use[i]
                out.add(to, KNOWN, pack(dk[i], rk[i], *_high(key[i] << np.uint64(24)), start[i], strings[i]))
                if out.full():
                    yield out.batch()
        yield out.batch()

    return run


def _by_document(memory: int):
    """Places of a range of documents -> one row (document key, places) for each document with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _Grouped(_by_row, memory)
        for b in batches:
            for x in b.column(2).to_pylist():
                got.add(*unpack(x))
        for dk, rk, low, high, start, strings in got.drain():
            yield from _placed(dk, rk, _joined(low, high), start, strings)

    return run


def _placed(dk: np.ndarray, rk: np.ndarray, key: np.ndarray, start: np.ndarray, strings: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(dk) == 0:
        return
    order = np.lexsort((start, rk, dk))
    dk, rk, key, start, strings = (x[order] for x in (dk, rk, key, start, strings))
    new = np.concatenate([[True], (dk[1:] != dk[:-1]) | (rk[1:] != rk[:-1])])
    fresh = new | np.concatenate([[True], start[1:] != start[:-1]])  # repeated rows asked for the same places
    dk, rk, key, start, strings, new = (x[fresh] for x in (dk, rk, key, start, strings, new))
    first = np.flatnonzero(new)
    ends = np.append(first[1:], len(dk))
    for a in range(0, len(first), 2000):
        f, e = first[a: a + 2000], ends[a: a + 2000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(dk[f]), pa.array(rk[f]),
             pa.array([pack(*_high(key[i:j] << np.uint64(24)), start[i:j], strings[i:j]) for i, j in zip(f, e)], pa.binary())],
            names=["_of_dk", "_of_rk", "_places"])


def _cut(n: int, length: int):
    """Texts with places -> distinct segments by shard (SEGMENTS), and ranges that a smaller document of
    the same batch already holds (KNOWN, by document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows()
        for b in batches:
            all_dk, all_rk = b.column(0).to_numpy(), b.column(1).to_numpy()
            texts = b.column(2).cast(pa.binary()).to_pylist()
            places = b.column(3).to_pylist()
            for a, z in _chunks(np.fromiter((len(t or b"") for t in texts), np.int64, len(texts)), CUT_CHUNK):
                number: dict[bytes, int] = {}
                seg, row, key, start = [], [], [], []
                for r in range(a, z):
                    text = texts[r]
                    low, high, s, m = unpack(places[r])
                    seg += [number.setdefault(text[i:j], len(number))
                            for i, j in zip(s.tolist(), (s + m + np.uint32(length - 1)).tolist())]
                    row.append(np.full(len(s), r))
                    key.append(_joined(low, high))
                    start.append(s)
                seg, row = np.array(seg, np.int64), np.concatenate(row)
                key, start = np.concatenate(key), np.concatenate(start)
                dk, rk = all_dk[row], all_rk[row]
                distinct = list(number)
                size = np.fromiter(map(len, distinct), np.int64, len(distinct))
                least = np.full(len(distinct), np.iinfo(np.int64).max)
                np.minimum.at(least, seg, dk)
                gone = np.flatnonzero(dk > least[seg])
                for to, i in _groups(_home(dk[gone], rk[gone], n)):
                    i = gone[i]
                    out.add(to, KNOWN, pack(dk[i], rk[i], start[i], (start[i] + size[seg[i]]).astype(np.uint32)))
                seg_key = np.zeros(len(distinct), np.uint64)
                seg_key[seg] = key
                stay = np.flatnonzero(dk == least[seg])
                stay = stay[np.argsort(seg[stay], kind="stable")]
                first = np.searchsorted(seg[stay], np.arange(len(distinct) + 1))
                part = (seg_key // np.uint64(n)) % np.uint64(PARTS**DIGITS)
                for to, s in _groups((seg_key % np.uint64(n)).astype(np.int64)):
                    s = s[np.argsort(part[s], kind="stable")]
                    count = first[s + 1] - first[s]
                    occ = stay[np.repeat(first[s], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
                    body = np.frombuffer(b"".join([distinct[i] for i in s]), np.uint8)
                    step = np.diff(part[s].astype(np.uint16), prepend=np.uint16(0))  # small numbers, as parts ascend
                    out.add(to, SEGMENTS, pack(body, size[s].astype(np.uint32), step, count.astype(np.uint32),
                                               dk[occ], rk[occ], start[occ], level=3))
                if out.full():
                    yield out.batch()
        yield out.batch()

    return run


class _Spool:
    """Pieces (arrays) of one part, in memory up to a common limit, then packed in a scratch file."""

    held = 0

    def __init__(self, limit: int):
        self.limit, self.pieces, self.file, self.sizes = limit, [], None, []
        self.run: list[list[np.ndarray]] = []  # pieces that go to the file together
        self.run_bytes = self.weight = 0

    def add(self, weight: int, *arrays: np.ndarray) -> None:
        size = sum(a.nbytes for a in arrays)
        self.weight += weight
        if _Spool.held + size > self.limit:
            self.run.append([a.copy() for a in arrays])
            self.run_bytes += size
            if self.run_bytes > RUN:
                self._write()
        else:
            _Spool.held += size
            self.pieces.append([a.copy() for a in arrays])

    def _write(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        data = pack(*(np.concatenate(x) for x in zip(*self.run)))
        self.file.write(data)
        self.sizes.append(len(data))
        self.run, self.run_bytes = [], 0

    def drain(self) -> Iterator[list[np.ndarray]]:
        while self.pieces:
            arrays = self.pieces.pop()
            _Spool.held -= sum(a.nbytes for a in arrays)
            yield arrays
        yield from self.run
        self.run = []
        if self.file is not None:
            self.file.seek(0)
            for n in self.sizes:
                yield unpack(self.file.read(n))
            self.file.close()


def _range(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its count."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _rows_of(piece: list[np.ndarray], i: np.ndarray) -> tuple[int, list[np.ndarray]]:
    """Weight and arrays of the rows ``i`` of a piece (part, numbers ...)."""
    return ROW * len(i), [x[i] for x in piece]


def _segments_of(piece: list[np.ndarray], i: np.ndarray) -> tuple[int, list[np.ndarray]]:
    """Weight and arrays of the segments ``i`` of a piece (part, body, size, count, dk, rk, start)."""
    part, body, size, count, dk, rk, start = piece
    n, occ = size.astype(np.int64), count.astype(np.int64)
    at, first = np.cumsum(n) - n, np.cumsum(occ) - occ
    weight = int(n[i].sum() + len(i) + ROW * occ[i].sum())
    if i[-1] - i[0] + 1 == len(i):  # neighbours, as pieces arrive in the order of their parts
        b, o = slice(at[i[0]], at[i[-1]] + n[i[-1]]), slice(first[i[0]], first[i[-1]] + occ[i[-1]])
    else:
        b, o = _range(at[i], n[i]), _range(first[i], occ[i])
    return weight, [part[i], body[b], size[i], count[i], dk[o], rk[o], start[o]]


class _Parts:
    """Deals the rows of pieces to parts by a digit of their first array, a number below PARTS ** DIGITS. Parts
    heavier than ``memory`` are dealt again by the next digit when they are read."""

    def __init__(self, take, memory: int, digit: int = 0):
        self.take, self.memory, self.digit = take, memory, digit
        self.spools = [_Spool(8 * memory) for _ in range(PARTS)]

    def add(self, piece: list[np.ndarray]) -> None:
        digit = piece[0].astype(np.int64) // PARTS ** (DIGITS - 1 - self.digit) % PARTS
        for p, i in _groups(digit):
            weight, arrays = self.take(piece, i)
            self.spools[p].add(weight, *arrays)

    def drain(self) -> Iterator[Iterator[list[np.ndarray]]]:
        """The pieces of each part; a part is to be read whole before the next."""
        for spool in self.spools:
            if spool.weight > self.memory and self.digit + 1 < DIGITS:
                finer = _Parts(self.take, self.memory, self.digit + 1)
                for piece in spool.drain():
                    finer.add(piece)
                yield from finer.drain()
            elif spool.weight:
                yield spool.drain()


class _Grouped:
    """Rows of numbers, given back joined: all at once, or beyond ``memory`` in parts by ``hash_of`` a row, so that
    rows with one hash stay together."""

    def __init__(self, hash_of, memory: int):
        self.hash_of, self.memory = hash_of, memory
        self.rows: list[list[np.ndarray]] = []
        self.weight = 0
        self.parts: _Parts | None = None

    def add(self, *piece: np.ndarray) -> None:
        self.rows.append(list(piece))
        self.weight += ROW * len(piece[0])
        if self.weight <= self.memory:
            return
        if self.parts is None:
            _Spool.held = 0
            self.parts = _Parts(_rows_of, self.memory)
        for x in self.rows:
            self.parts.add([(self.hash_of(*x) % np.uint64(PARTS**DIGITS)).astype(np.uint16), *x])
        self.rows = []

    def drain(self) -> Iterator[list[np.ndarray]]:
        if self.parts is None:
            if self.rows:
                rows, self.rows = self.rows, []
                yield [np.concatenate(x) for x in zip(*rows)]
            return
        for pieces in self.parts.drain():
            yield [np.concatenate(x) for x in list(zip(*pieces))[1:]]


def _by_row(dk: np.ndarray, rk: np.ndarray, *_: np.ndarray) -> np.ndarray:
    """Hash of a document's key."""
    with np.errstate(over="ignore"):
        return _mix(dk.astype(np.uint64) * np.uint64(31) + rk.astype(np.uint64))


def _home(dk: np.ndarray, rk: np.ndarray, n: int) -> np.ndarray:
    """The range that a document belongs to; by other bits than what it is dealt by within a task."""
    return ((_by_row(dk, rk) >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def removed_ranges(pieces: Iterator[list[np.ndarray]], length: int, memory: int) -> tuple[np.ndarray, ...]:
    """(dk, rk, start, end) removed, from the segments of one part of a shard."""
    number: dict[bytes, int] = {}
    occ: list[list[np.ndarray]] = []
    for piece in pieces:
        _, body, size, count, dk, rk, start = piece
        data = body.tobytes()
        ends = np.cumsum(size.astype(np.int64))
        ids = np.fromiter((number.setdefault(data[e - s: e], len(number)) for s, e in zip(size.tolist(), ends.tolist())),
                          np.int64, len(size))
        occ.append([np.repeat(ids, count), dk, rk, start.astype(np.int64)])
    if not occ:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64))
    seg, dk, rk, start = (np.concatenate(x) for x in zip(*occ))
    order = np.argsort(seg, kind="stable")
    seg, dk, rk, start = (x[order] for x in (seg, dk, rk, start))
    texts = list(number)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.minimum.reduceat(dk, np.searchsorted(seg, np.arange(len(texts))))
    ends = np.cumsum(size + 1)  # with the separator
    begins = ends - size - 1
    gone = np.zeros(int(ends[-1]) + 1, bool)

    def classes(pos: np.ndarray, starts: np.ndarray) -> None:
        """The smallest document keeps the string; it is gone from all larger ones."""
        s = np.searchsorted(ends, pos, side="right")
        inside = pos + length < ends[s]  # a string must not reach the separator; all of a class do, or none
        least = np.repeat(np.minimum.reduceat(owner[s], starts), np.diff(starts, append=len(pos)))
        gone[pos[inside & (owner[s] > least)]] = True

    repeats(texts, length, memory, classes)
    later = dk > owner[seg]
    out = [[dk[later], rk[later], start[later], start[later] + size[seg[later]]]]
    edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
    a, z = edge[::2], edge[1::2]
    if len(a):
        s = np.searchsorted(ends, a, side="right")
        own = np.flatnonzero(~later)  # the smallest document may hold the segment at several places
        lo, hi = np.searchsorted(seg[own], s, side="left"), np.searchsorted(seg[own], s, side="right")
        count = hi - lo
        r = np.repeat(np.arange(len(a)), count)
        o = own[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        from_ = start[o] + a[r] - begins[s[r]]
        out.append([dk[o], rk[o], from_, from_ + (z - a)[r] - 1 + length])
    return tuple(np.concatenate(x) for x in zip(*out))


def _sort_shard(n: int, length: int, memory: int):
    """One shard's segments -> removed ranges by document. KNOWN ranges pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows()
        _Spool.held = 0
        parts = _Parts(_segments_of, memory)
        for b in batches:
            for to, kind, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                if kind == KNOWN:
                    out.add(to, kind, data)
                    if out.full():
                        yield out.batch()
                    continue
                body, size, step, count, dk, rk, start = unpack(data)
                parts.add([np.cumsum(step, dtype=np.uint16), body, size, count, dk, rk, start])
        held: list[tuple[np.ndarray, ...]] = []

        def ranges() -> Iterator[tuple[int, bytes]]:
            dk, rk, start, end = (np.concatenate(x) for x in zip(*held))
            held.clear()
            for to, i in _groups(_home(dk, rk, n)):
                yield to, pack(dk[i], rk[i], start[i].astype(np.uint32), end[i].astype(np.uint32))

        for pieces in parts.drain():
            held.append(removed_ranges(pieces, length, memory))
            # One value for each range of documents, not one for each part as well, unless they get large.
            if sum(len(x[0]) for x in held) < 2_000_000:
                continue
            for to, data in ranges():
                out.add(to, KNOWN, data)
                if out.full():
                    yield out.batch()
        for to, data in ranges() if held else ():
            out.add(to, KNOWN, data)
            if out.full():
                yield out.batch()
        yield out.batch()

    return run


def _merge(memory: int):
    """Removed ranges of a range of documents -> (document key, spans), spans merged and flattened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _Grouped(_by_row, memory)
        for b in batches:
            for x in b.column(2).to_pylist():
                got.add(*unpack(x))
        for arrays in got.drain():
            yield from _merged(*arrays)

    return run


def _merged(dk: np.ndarray, rk: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((start, rk, dk))
    dk, rk, start, end = (x[order] for x in (dk, rk, start.astype(np.int64), end.astype(np.int64)))
    new = np.concatenate([[True], (dk[1:] != dk[:-1]) | (rk[1:] != rk[:-1])]) if len(dk) else np.zeros(0, bool)
    base = np.cumsum(new) << 33  # places of different documents never touch
    reach = np.maximum.accumulate(base + end)
    fresh = np.ones(len(dk), bool)
    fresh[1:] = (base + start)[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(dk)) - 1
    spans = np.stack([start[first], reach[last] - base[last]], 1).ravel() if len(first) else np.zeros(0, np.int64)
    doc = np.flatnonzero(new[first])
    ends = np.append(doc[1:], len(first))
    for a in range(0, len(doc), 2000):
        d, e = doc[a: a + 2000], ends[a: a + 2000]
        lists = pa.ListArray.from_arrays(pa.array(np.append(d, e[-1:]) * 2 - d[0] * 2, pa.int32()),
                                         pa.array(spans[d[0] * 2: e[-1] * 2]))
        yield pa.RecordBatch.from_arrays([pa.array(dk[first[d]]), pa.array(rk[first[d]]), lists], names=["_of_dk", "_of_rk", "spans"])


def _keyed(docs: DataFrame, names: list[str]) -> DataFrame:
    """``names`` with ``_dk``, the order of doc_ids with null last, and ``_rk``, which tells the rows of one ``_dk`` apart.

    ``_rk`` is 0 where a doc_id stands on one row, as it should. Rows that share a doc_id, or have none, get a number by
    doc_id and text (told apart by 128 bits of hash), so different texts never share a key. If there are any, the documents are written with their
    keys, as they are read three times."""
    ids = docs.groupBy("doc_id").count()
    top = (1 << 63) - 1
    facts = ids.agg(F.min("doc_id").cast("long").alias("least"), F.max("doc_id").cast("long").alias("most"),
                    F.max(F.col("doc_id").isNull()).alias("nulls"), F.max("count").alias("rows")).first()
    order, shift = F.col("doc_id").cast("long"), 0
    if facts["nulls"] and facts["most"] == top:  # null needs a place of its own above
        if facts["least"] == -top - 1:
            raise ValueError("doc_ids from the smallest to the largest long, and nulls, have no order in a long")
        shift = 1
    dk = F.coalesce(order - F.lit(shift).cast("long"), F.lit(top))
    if not facts["nulls"] and (facts["rows"] or 0) < 2:
        return docs.select(*names, dk.alias("_dk"), F.lit(0).cast("long").alias("_rk"))
    is_null = F.col("doc_id").isNull()
    hashes = [F.xxhash64("doc_id", is_null, "text").alias("_h1"), F.xxhash64(F.lit(1), "text", "doc_id", is_null).alias("_h2")]
    shared = ids.where("count > 1 or doc_id is null").select(F.col("doc_id").alias("_id"))
    rows = docs.select("doc_id", *hashes).join(shared, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    numbers = written(numbered(rows.select("_h1", "_h2").distinct(), ["_h1", "_h2"], "_rk", 1), "suffix-rows")
    keyed = docs.select(*names, dk.alias("_dk"), *hashes).join(numbers, ["_h1", "_h2"], "left")
    return written(keyed.select(*names, "_dk", F.coalesce("_rk", F.lit(0).cast("long")).alias("_rk")), "suffix-keyed")


def removed_spans(docs: DataFrame, length: int = 50, memory: int = MEMORY) -> DataFrame:
    """``docs`` with ``spans``: [start, end, start, end, ...] of the maximal removed byte runs (null: none).

    ``docs`` needs doc_id and text. Null and short texts lose nothing. Rows with
    one doc_id do not count as earlier than each other, and a null doc_id counts as larger than all others.
    Repeated rows get the same spans. A column named spans is replaced. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    names = [c for c in docs.columns if c.lower() != "spans"]
    keyed = _keyed(docs.select(*names), names)
    per_doc = "_of_dk long, _of_rk long, "

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(n, F.col("to"))

    asked = dealt(keyed.select("_dk", "_rk", "text").mapInArrow(_ask(n, length), _Rows.SCHEMA))
    places = dealt(asked.mapInArrow(_answer(n, memory), _Rows.SCHEMA)).mapInArrow(_by_document(memory), per_doc + "_places binary")
    same = (F.col("_dk") == F.col("_of_dk")) & (F.col("_rk") == F.col("_of_rk"))
    # The join sorts by document, so batches are the same on every attempt. It takes all columns, needed or not, so
    # that the shuffled documents are the same as in the last join and are shuffled once for both.
    whole = keyed.join(places, same).select("_dk", "_rk", "text", "_places", *[c for c in names if c != "text"])
    cut = whole.mapInArrow(_cut(n, length), _Rows.SCHEMA)
    ranges = dealt(dealt(cut).mapInArrow(_sort_shard(n, length, memory), _Rows.SCHEMA))
    spans = ranges.mapInArrow(_merge(memory), per_doc + "spans array<long>")
    return keyed.join(spans, same, "left").select(*names, "spans")


def kept_bytes(text: str | None, spans: list[int] | None) -> bytes:
    data = (text or "").encode()
    if not spans:
        return data
    edges = [0, *spans, len(data)]
    return b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2]))


def digest(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of ``removed_spans``' result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, count, sha = [], [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                kept = kept_bytes(text, spans)
                total = len((text or "").encode())
                size.append(total)
                gone.append(total - len(kept))
                count.append(len(spans or ()) // 2)
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()),
                 pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removed.select("doc_id", "text", "spans").mapInArrow(
        run, schema_of(removed, ["doc_id"], "n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def kept_text(removed: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` with the kept bytes as text; bytes of characters that were cut through go too.

    n_chars, if among ``columns``, is counted anew. A null text stays null."""
    schema = removed.select(*columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by = dict(zip([*columns, "spans"], b.columns))
            texts = [t if not s else kept_bytes(t, s).decode("utf-8", "ignore")
                     for t, s in zip(by["text"].to_pylist(), by["spans"].to_pylist())]
            new = {"text": pa.array(texts, by["text"].type)}
            if "n_chars" in by:
                new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], by["n_chars"].type)
            yield pa.RecordBatch.from_arrays([new.get(c, by[c]) for c in columns], names=columns)

    return removed.select(*columns, "spans").mapInArrow(run, schema)
