"""Suffix sorting by external induced sorting, with common-prefix lengths.

The suffixes of a text are S-type (smaller than the suffix after them) or
L-type (larger). Sorting the leftmost S-type ones is enough: reading sorted
suffixes from the smallest on induces the order of all L-type suffixes, and
reading those from the largest on induces that of all S-type ones. The leftmost
S-type suffixes themselves are sorted by naming the substrings between them and
recursing on the string of names, until that string fits into memory.

A suffix that is read hands its predecessor to a priority queue keyed by (first
character, order of the rest). Predecessors arrive in the order of their rests,
so the queue is one file per character, appended at one end and read from the
other. The tuples in it are (position, common prefix with the one before);
prefixes of induced suffixes follow from those read in between. Queues beyond
``memory`` tuples go to unnamed temporary files of the task. A text larger than
that is itself kept in such a file.

Only the first ``depth`` characters matter here: suffixes that agree so far
may come in any order, and longer common prefixes count as ``depth``.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np


class Memory:
    """Tuples that all queues of one sort may hold in memory."""

    def __init__(self, limit: int):
        self.limit, self.used = limit, 0


class Queue:
    """First-in first-out runs of (position, prefix) arrays; the arrivals beyond the limit are on disk."""

    def __init__(self, memory: Memory):
        self.memory = memory
        self.runs: list[tuple[np.ndarray, np.ndarray] | tuple[int, int, np.dtype]] = []
        self.file = None
        self.last: tuple[int, int] | None = None  # position and prefix of the last arrival

    def push(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        if len(pos) == 0:
            return
        self.last = (int(pos[-1]), int(lcp[-1]))
        if self.memory.used + len(pos) > self.memory.limit:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.seek(0, 2)
            at = self.file.tell()
            self.file.write(pos.tobytes())
            self.file.write(lcp.tobytes())
            self.runs.append((at, len(pos), pos.dtype))
        else:
            self.memory.used += len(pos)
            self.runs.append((pos, lcp))

    def run(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        r = self.runs[i]
        if len(r) == 2:
            return r
        at, n, dtype = r
        self.file.seek(at)
        data = self.file.read(n * (dtype.itemsize + 1))
        return np.frombuffer(data, dtype, n), np.frombuffer(data, np.uint8, n, n * dtype.itemsize)

    def take(self, start: int, stop: int, at_most: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Runs from ``start`` on (from ``stop`` back if that is smaller) as one, up to about ``at_most`` tuples,
        and the run to go on with."""
        step = 1 if stop > start else -1
        i, n, got = start, 0, []
        while i != stop and n < at_most:
            got.append(self.run(i))
            n += len(got[-1][0])
            i += step
        if step < 0:
            got.reverse()
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]), i

    def close(self) -> None:
        self.memory.used -= sum(len(r[0]) for r in self.runs if len(r) == 2)
        self.runs = []
        if self.file is not None:
            self.file.close()


def types(t: np.ndarray) -> np.ndarray:
    """True for S-type positions; the last one (the unique smallest character) is S-type."""
    n = len(t)
    s = np.empty(n, bool)
    up = t[:-1] < t[1:]
    same = np.flatnonzero(t[:-1] == t[1:])
    s[:-1] = up
    s[-1] = True
    if len(same):
        # a run of equal characters has the type of its last position
        ends = np.flatnonzero(np.diff(same, append=same[-1] + 2) != 1)
        starts = np.concatenate([[0], ends[:-1] + 1])
        s[same] = np.repeat(s[same[ends] + 1], ends - starts + 1)
    return s


def _seed_chunks(seeds: np.ndarray, first: np.ndarray, alphabet: np.ndarray) -> dict[int, tuple[int, int]]:
    """Character -> slice of the seeds (sorted by first character)."""
    cut = np.searchsorted(first, alphabet, side="left")
    end = np.searchsorted(first, alphabet, side="right")
    return {int(c): (int(a), int(b)) for c, a, b in zip(alphabet, cut, end) if b > a}


class _Induction:
    """One pair of passes over a text with given sorted seeds."""

    def __init__(self, t: np.ndarray, s_type: np.ndarray, alphabet: np.ndarray, memory: Memory, depth: int,
                 carry_prefixes: bool):
        self.t, self.alphabet, self.depth, self.carry = t, alphabet, depth, carry_prefixes
        # First characters of the suffixes of either type, ``none`` for the others: one lookup tells both. The last
        # suffix is none's predecessor; position -1, before the first suffix, looks it up.
        self.none = 255 if t.dtype == np.uint8 else -1
        self.large = np.where(s_type, t.dtype.type(self.none), t)
        self.small = np.where(s_type, t, t.dtype.type(self.none))
        self.small[-1] = self.none
        self.memory = memory
        size = int(alphabet[-1]) + 1
        self.queues: dict[int, Queue] = {}
        self.least = np.zeros(size, np.uint8)  # least prefix read since the last arrival at each queue

    def _queue(self, c: int) -> Queue:
        q = self.queues.get(c)
        if q is None:
            q = self.queues[c] = Queue(self.memory)
        return q

    def read(self, pos: np.ndarray, lcp: np.ndarray, want_s: bool) -> None:
        """Take suffixes in order and hand their predecessors of the wanted type to the queues."""
        prev = pos - 1
        ch = (self.small if want_s else self.large)[prev]
        at = np.flatnonzero(ch != self.none)
        prev, ch = prev[at], ch[at]
        order = np.argsort(ch, kind="stable")
        sorted_ch = ch[order]
        cuts = np.flatnonzero(sorted_ch[1:] != sorted_ch[:-1]) + 1
        groups = np.split(order, cuts) if len(order) else []
        if not self.carry:
            for g in groups:
                q = self._queue(int(ch[g[0]]))
                q.push(prev[g], np.zeros(len(g), np.uint8))
            return
        lowest = lcp.min() if len(lcp) else 255
        ext = np.append(lcp, np.uint8(255))
        np.minimum(self.least, lowest, out=self._next)
        for g in groups:
            c = int(ch[g[0]])
            i = at[g]  # places in this chunk
            # least prefix between consecutive arrivals; the first also spans the chunks before
            seg = np.minimum.reduceat(ext, np.concatenate([[0], i + 1]))
            tail = seg[-1]
            new = seg[:-1].copy()
            new[0] = min(new[0], self.least[c])
            new = np.minimum(new, self.depth - 1) + np.uint8(1)
            q = self._queue(c)
            if q.last is None:
                new[0] = 0
            q.push(prev[g], new)
            self._next[c] = tail
        self.least, self._next = self._next, self.least

    def prefix(self, a: int, b: int) -> int:
        """Common prefix of two suffixes, up to the depth, by comparison."""
        n = min(self.depth, len(self.t) - max(a, b))
        diff = np.flatnonzero(self.t[a: a + n] != self.t[b: b + n])
        return int(diff[0]) if len(diff) else n

    def run(self, seeds: np.ndarray, seed_lcp: np.ndarray, emit: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """Both passes. ``emit`` gets all suffixes but the last one, from the largest to the smallest, each with
        its common prefix with the one emitted before it."""
        chunk = 1 << 20
        first = self.t[seeds]
        slices = _seed_chunks(seeds, first, self.alphabet)
        self.least = np.full(len(self.least), 255, np.uint8)
        self._next = self.least.copy()
        for c in self.alphabet.tolist():  # smallest first: L-type suffixes of c, then its seeds
            q, i = self.queues.get(c), 0
            while q is not None and i < len(q.runs):  # arrivals of the same character are read in their turn
                pos, lcp, i = q.take(i, len(q.runs), chunk)
                self.read(pos, lcp, False)
            if c in slices:
                a, b = slices[c]
                pos, lcp = seeds[a:b], seed_lcp[a:b].copy()
                if self.carry:
                    lcp[0] = self.prefix(q.last[0], int(pos[0])) if q is not None and q.last else 0
                for k in range(0, len(pos), chunk):
                    self.read(pos[k: k + chunk], lcp[k: k + chunk], False)
        large = self.queues  # the sorted L-type suffixes by character
        self.queues = {}
        self.least[:] = 255
        for c in reversed(self.alphabet.tolist()):  # largest first: S-type suffixes of c, then its L-type ones
            q, i = self.queues.get(c), 0
            while q is not None and i < len(q.runs):
                pos, lcp, i = q.take(i, len(q.runs), chunk)
                emit(pos, lcp)
                self.read(pos, lcp, True)
            got = large.pop(c, None)
            if got is not None:
                after = 0  # prefix of the next larger L-type suffix with the one read before it
                if self.carry and q is not None and q.last:
                    after = self.prefix(q.last[0], got.last[0])
                k = len(got.runs) - 1
                while k >= 0:
                    pos, lcp, k = got.take(k, -1, chunk)
                    down = np.empty_like(lcp)
                    down[0] = after
                    down[1:] = lcp[:0:-1]
                    after = lcp[0]
                    pos = pos[::-1]
                    emit(pos, down)
                    self.read(pos, down, True)
                got.close()
            if (q := self.queues.pop(c, None)) is not None:
                q.close()


def _adjacent_prefix(t: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix lengths of pairs of different suffixes, up to ``depth``, by shrinking comparison."""
    out = np.full(len(a), depth, np.int64)
    live = np.arange(len(a))
    if t.dtype == np.uint8:  # eight characters at a time
        padded = np.zeros(len(t) + depth + 8, np.uint8)
        padded[: len(t)] = t
        word = np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))
        for k in range(0, depth, 8):
            x = word[a + k] ^ word[b + k]
            differ = np.flatnonzero(x)
            first = x[differ]
            first = np.bitwise_count((first & (~first + np.uint64(1))) - np.uint64(1)) >> 3
            out[live[differ]] = np.minimum(depth, k + first.astype(np.int64))
            same = np.flatnonzero(x == 0)
            live, a, b = live[same], a[same], b[same]
            if len(live) == 0:
                break
        return out
    padded = np.concatenate([t, np.zeros(depth, t.dtype)])
    for k in range(depth):
        same = padded[a + k] == padded[b + k]
        out[live[~same]] = k
        live, a, b = live[same], a[same], b[same]
        if len(live) == 0:
            break
    return out


def _names(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray, depth: int) -> tuple[np.ndarray, int]:
    """Names of the substrings between leftmost S-type positions, in text order; equal ones share a name."""
    index = np.empty(len(t), lms.dtype)
    index[lms] = np.arange(len(lms))
    place = index[ordered]
    length = np.diff(lms, append=lms[-1]) + 1
    length = np.minimum(length, depth)[place]
    common = _adjacent_prefix(t, ordered[:-1], ordered[1:], depth)
    differ = (length[1:] != length[:-1]) | (common < length[1:])
    rank = np.concatenate([[0], np.cumsum(differ)])
    names = np.empty(len(lms), np.int64)
    names[place] = rank
    return names, int(rank[-1]) + 1


def _in_memory(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a short string, by doubling, up to ``depth`` characters."""
    n = len(names)
    order = np.argsort(names)
    sorted_key = names[order]
    h = 1
    rank = np.empty(n, np.int64)  # place of the first suffix that has agreed so far
    tied = np.arange(n)  # places whose suffixes still agree with a neighbour
    while True:
        new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        start = np.maximum.accumulate(np.where(new, tied, 0))
        rank[order[tied]] = start
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
        if h >= min(depth, n) or len(tied) == 0:
            return order
        some = order[tied]
        after = np.where(some + h < n, rank[np.minimum(some + h, n - 1)] + 1, 0)
        key = rank[some] * (n + 1) + after
        by = np.argsort(key)
        order[tied] = some[by]
        sorted_key = key[by]
        h *= 2


def sort_suffixes(t: np.ndarray, depth: int, memory: int, emit: Callable[[np.ndarray, np.ndarray], None] | None = None,
                  ) -> np.ndarray | None:
    """Sort the suffixes of ``t`` (integers >= 0; the last one is the only 0) by their first ``depth`` characters.

    With ``emit``, hands over (positions, prefixes) from the largest suffix to
    the smallest but the last character's; without, returns the sorted leftmost S-type positions.
    """
    s = types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if len(t) < 1 << 31:
        lms = lms.astype(np.int32)
    alphabet = np.unique(t) if t.dtype != np.uint8 else np.flatnonzero(np.bincount(t, minlength=256))
    queue_memory = Memory(memory)
    if len(lms) > 1:
        # First induction: any order of the seeds of one character sorts the substrings.
        start = lms[np.argsort(t[lms], kind="stable")]
        got: list[np.ndarray] = []
        is_lms = np.zeros(len(t), bool)
        is_lms[lms] = True
        _Induction(t, s, alphabet, queue_memory, depth, False).run(
            start, np.zeros(len(start), np.uint8), lambda pos, _: got.append(pos[is_lms[pos]]))
        ordered = np.concatenate([[lms[-1]], np.concatenate(got)[::-1]]).astype(lms.dtype)
        names, distinct = _names(t, lms, ordered, depth)
        if distinct < len(lms):
            if len(names) <= memory:
                by_rest = _in_memory(names, depth // 2 + 1)  # a name stands for two characters at least
            else:
                by_rest = sort_all(names, depth // 2 + 1, memory)
            ordered = lms[by_rest]
    else:
        ordered = lms
    if emit is None:
        return ordered
    prefixes = np.zeros(len(ordered), np.uint8)
    if len(ordered) > 1:
        prefixes[1:] = _adjacent_prefix(t, ordered[:-1], ordered[1:], depth)
    _Induction(t, s, alphabet, queue_memory, depth, True).run(ordered, prefixes, emit)
    return None


def sort_all(t: np.ndarray, depth: int, memory: int) -> np.ndarray:
    """All suffixes of ``t`` in order (the recursion's own use)."""
    got: list[np.ndarray] = []
    sort_suffixes(t, depth, memory, lambda pos, _: got.append(pos.copy()))
    return np.concatenate([[len(t) - 1], np.concatenate(got)[::-1]]) if got else np.array([len(t) - 1])


def repeats(segments: Iterator[bytes] | list[bytes], depth: int, memory: int,
            group: Callable[[np.ndarray, np.ndarray], None]) -> int:
    """Hand over every class of equal ``depth``-byte strings of the ``segments``.

    ``group`` gets (positions, starts): positions into the joined segments (each
    followed by one separator), and where in that array each class of two or more begins. Returns the joined length.
    """
    joined = bytearray()
    bounds = [0]
    for s in segments:
        joined += s
        joined += b"\xff"  # no byte of UTF-8
        bounds.append(len(joined))
    raw = np.frombuffer(bytes(joined), np.uint8)
    n = len(raw)
    if n > memory:
        with tempfile.TemporaryFile() as f:
            t = np.memmap(f, np.uint8, "w+", shape=(n + 1,))
            return _repeats(raw, t, bounds, depth, memory, group)
    return _repeats(raw, np.empty(n + 1, np.uint8), bounds, depth, memory, group)


def _repeats(raw: np.ndarray, t: np.ndarray, bounds: list[int], depth: int, memory: int,
             group: Callable[[np.ndarray, np.ndarray], None]) -> int:
    n = len(raw)
    np.add(raw, 2, out=t[:n], casting="unsafe")  # the separator 0xFF becomes 1
    t[n] = 0
    held: list[np.ndarray] = []

    def flush(pos: np.ndarray, starts: np.ndarray) -> None:
        sizes = np.diff(starts, append=len(pos))
        many = sizes > 1
        if many.any():
            keep = np.repeat(many, sizes)
            sizes = sizes[many]
            group(pos[keep], np.concatenate([[0], np.cumsum(sizes)[:-1]]))

    def emit(pos: np.ndarray, lcp: np.ndarray) -> None:
        new = np.flatnonzero(lcp < depth)  # a class begins where the prefix is shorter
        if len(new) == 0:
            held.append(pos)
            return
        if held or new[0] > 0:
            whole = np.concatenate([*held, pos[: new[0]]])
            if len(whole) > 1:
                flush(whole, np.array([0]))
            held.clear()
        flush(pos[new[0]: new[-1]], new[:-1] - new[0])
        held.append(pos[new[-1]:])

    if n:
        sort_suffixes(t, depth, memory, emit)
    if held:
        whole = np.concatenate(held)
        if len(whole) > 1:
            flush(whole, np.array([0]))
    return n
