"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of words with smallest period q (words q apart are equal) and
length >= max(shortest, 3 * q) that no neighbouring word extends. Texts are
joined to one string of word numbers, each followed by a separator of its own,
so that no repetition crosses texts. Over this string:

- ``Factors`` names every substring of 2^k words (prefix doubling); the last
  names order the suffixes. Names also tell how far two places agree, forward
  and backward, in a step for each k.
- ``RangeSuccessor`` is a wavelet tree over the suffix array: the occurrences of a
  block are an interval of the array, and the tree finds the first of them at
  or after a place.
- Dyadic blocks: a run of period q with 2^k <= q < 2^(k+1) holds an aligned block
  of b = 2^k words at i, and again at i + q, which is in the neighbouring window
  [i + b, i + 2b). Occurrences of one block that start within b places are an
  arithmetic progression. One or two of them are candidates as they stand. Three or more
  have the block's own period p as difference; a run that is not p-periodic breaks the
  p-periodic stretch around the block, and again q later, so q is the distance
  between the right ends, or the left ends, of the stretches around i and around the
  progression. Periods below 8 come from blocks of 8 words, whose next
  occurrence is exactly one period away.
- Each candidate is extended as far as its period holds. Multiples of a period give
  the same stretch, of which the smallest period is kept.

Blocks of all texts are asked at once; work is about n log n for n words, memory about
100 bytes a word of a string of at most ``WORDS`` words (a longer text is a string of its own).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.llm.common import schema_of

#: Words that are searched as one string.
WORDS = 1 << 18
#: Periods below 2^SMALL come from blocks of 2^SMALL words; runs must be at least 3 * 2^SMALL - 1 words long.
SMALL = 3
#: Beyond every place.
NOWHERE = 1 << 60
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Factors:
    """Names of all substrings of 2^k symbols, k = 0, 1, ..., until every name is unique.

    A name is the number of suffixes that are smaller, so it is also where the
    interval of its occurrences begins in ``order``, the suffix array. The last symbol must be unique."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        key = symbols[order]
        slots, names = np.arange(n), np.empty(n, np.int64)
        self.names, h = [], 1
        while True:
            new = np.ones(len(slots), bool)
            new[1:] = key[1:] != key[:-1]
            names[order[slots]] = np.maximum.accumulate(np.where(new, slots, 0))
            self.names.append(names.astype(np.int32 if n < 1 << 31 else np.int64))
            alone = new.copy()
            alone[:-1] &= new[1:]
            slots = slots[~alone]  # only names that several places share are sorted again
            if not len(slots):
                break
            at = order[slots]
            after = np.where(at + h < n, names[np.minimum(at + h, n - 1)] + 1, 0)
            key = names[at] * (n + 1) + after
            by = np.argsort(key, kind="stable")
            order[slots], key = at[by], key[by]
            h *= 2
        self.order = order

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from ``a`` on equal those from ``b`` on (a < b)."""
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            length += (names[a + length] == names[b + length]).astype(np.int64) << k
        return length

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before ``a`` equal those before ``b`` (a < b)."""
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, x = self.names[k], a - length - (1 << k)
            same = (x >= 0) & (names[np.maximum(x, 0)] == names[np.maximum(x + b - a, 0)])
            length += same.astype(np.int64) << k
        return length


class RangeSuccessor:
    """Wavelet tree over a permutation of 0..n-1, a bit vector with counts for each binary digit."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.digits = max(1, (n - 1).bit_length())
        self.n, self.levels = n, []
        v = values.astype(np.uint32 if n < 1 << 32 else np.uint64)
        for d in range(self.digits - 1, -1, -1):
            one = (v >> v.dtype.type(d)) & v.dtype.type(1) == 1
            bits = np.zeros((n // 64 + 1) * 8, np.uint8)
            packed = np.packbits(one, bitorder="little")
            bits[: len(packed)] = packed
            words = bits.view(np.uint64)
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((words, before, n - int(one.sum())))
            v = np.concatenate([v[~one], v[one]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        w = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[w] + np.bitwise_count(words[w] & mask)

    def __call__(self, left: np.ndarray, right: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest value >= ``least`` among places [left, right) of each query; NOWHERE if there is none."""
        lo, hi, smaller = left.astype(np.int64), right.astype(np.int64), np.zeros(len(left), np.int64)
        x = np.minimum(least, self.n - 1)
        for d, (words, before, zeros) in zip(range(self.digits - 1, -1, -1), self.levels):
            a, b = self._ones(words, before, lo), self._ones(words, before, hi)
            one = (x >> d) & 1 == 1
            smaller += np.where(one, (hi - b) - (lo - a), 0)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        found = (smaller < right - left) & (least < self.n)
        lo, hi = np.where(found, left, 0).astype(np.int64), np.where(found, right, 0).astype(np.int64)
        nth, value = np.where(found, smaller, 0), np.zeros(len(left), np.int64)
        for words, before, zeros in self.levels:
            a, b = self._ones(words, before, lo), self._ones(words, before, hi)
            low = (hi - b) - (lo - a)
            one = nth >= low
            nth = np.where(one, nth - low, nth)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
            value = value * 2 + one
        return np.where(found, value, NOWHERE)


def candidates(factors: Factors, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) pairs, among them one for each run in texts of at most ``longest`` words."""
    n, places, periods = len(factors.order), [], []
    successor = None
    k = SMALL
    while 3 << k <= longest and k < len(factors.names):
        b, names = 1 << k, factors.names[k]
        i = np.arange(0, n - b + 1, b)
        shared = np.bincount(names, minlength=n)  # occurrences, at the name where their interval begins
        i = i[shared[names[i]] > 1]
        if len(i):
            successor = successor or RangeSuccessor(factors.order)
            left = names[i].astype(np.int64)
            right = left + shared[left]
            if k == SMALL:
                near = successor(left, right, i + 1)
                hit = near < i + b
                places.append(i[hit])
                periods.append((near - i)[hit])
            first = successor(left, right, i + b)
            hit = first < i + 2 * b
            i, left, right, first = i[hit], left[hit], right[hit], first[hit]
            second = successor(left, right, first + 1)
            third = successor(left, right, np.minimum(second, n - 1) + 1)
            many, end = third < i + 2 * b, i + 2 * b
            for at, ok in ((first, ~many), (second, ~many & (second < end))):
                places.append(i[ok])
                periods.append((at - i)[ok])
            i, at, p = i[many], first[many], (second - first)[many]
            right_ends = (at + factors.forward(at, at + p)) - (i + factors.forward(i, i + p))
            left_ends = (at - factors.backward(at, at + p)) - (i - factors.backward(i, i + p))
            for q in (right_ends, left_ends):
                ok = (q > 0) & (q < 2 * b) & (i + q < n)
                places.append(i[ok])
                periods.append(q[ok])
        k += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *places]), np.concatenate([none, *periods])


def repetitions(symbols: np.ndarray, longest: int, shortest: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every run, by start, then period. The last symbol must be unique."""
    if shortest < (3 << SMALL) - 1:
        raise ValueError(f"runs shorter than {(3 << SMALL) - 1} words are not searched for")
    none = np.zeros(0, np.int64)
    if longest < shortest:
        return none, none, none
    factors = Factors(symbols)
    i, q = candidates(factors, longest)
    start = i - factors.backward(i, i + q)
    length = i + q + factors.forward(i, i + q) - start
    ok = length >= np.maximum(shortest, 3 * q)
    start, length, q = start[ok], length[ok], q[ok]
    by = np.lexsort((q, length, start))
    start, length, q = start[by], length[by], q[by]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, q = start[first], length[first], q[first]
    by = np.lexsort((q, start))
    return start[by], length[by], q[by]


def search(texts: list[list[bytes]], shortest: int = 24) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, given as its words."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    longest = int(sizes.max(initial=0))
    if longest < shortest:
        return out
    coded = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    symbols = np.empty(int(sizes.sum()) + len(texts), np.int64)
    ends = starts + sizes
    is_word = np.ones(len(symbols), bool)
    is_word[ends] = False
    symbols[is_word] = coded.indices.to_numpy(zero_copy_only=False)
    symbols[ends] = len(coded.dictionary) + np.arange(len(texts))
    start, length, period = repetitions(symbols, longest, shortest)
    of = np.searchsorted(starts, start, side="right") - 1
    for t, s, size, q in zip(of.tolist(), (start - starts[of]).tolist(), length.tolist(), period.tolist()):
        out[t].append((s, size, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The text without what any run repeats after its first period; words joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def find_runs(docs: DataFrame, keep: list[str], text: str = "text", shortest: int = 24,
              with_text: bool = False) -> DataFrame:
    """Runs of every whole text.

    Returns the ``keep`` columns (which may have any names but those that follow), n_words, ``runs`` (by start, then period),
    ``collapsed_sha256``, and with ``with_text`` the ``collapsed`` text itself. Every row gets its own result: null and
    empty texts have no words and no runs, and collapse to the empty text; repeated rows each get theirs. No row leaves its task, so an
    empty table gives an empty result and a very long text takes one task about 100 bytes of memory a word.
    """
    more = f"n_words long, runs {RUNS}, collapsed_sha256 string" + (", collapsed string" if with_text else "")
    schema = schema_of(docs, keep, more)
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, at = b.column(len(keep)).cast(pa.binary()), 0
            while at < b.num_rows:
                texts, total, first = [], 0, at
                while at < b.num_rows and (not texts or total < WORDS):
                    texts.append((column[at].as_py() or b"").split())
                    total += len(texts[-1])
                    at += 1
                found = search(texts, shortest)
                left = [collapsed(t, r) for t, r in zip(texts, found)]
                cols = [b.column(i).slice(first, at - first) for i in range(len(keep))]
                cols += [pa.array([len(t) for t in texts], pa.int64()),
                         pa.array([[dict(zip(("start", "length", "period"), x)) for x in r] for r in found], runs_type),
                         pa.array([hashlib.sha256(t).hexdigest() for t in left])]
                if with_text:
                    cols.append(pa.array(left, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(*keep, F.col(text)).mapInArrow(run, schema)


def digest(found: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, n_runs, the run with the greatest exponent (ties: smallest start, then period), and the hashes."""
    # length / period compared exactly, by products; runs come by start, then period, so the first of equals stays
    best = F.reduce("runs", F.get("runs", F.lit(0)),
                    lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(*keep, "runs", "collapsed_sha256", best.alias("_best")).select(
        *keep, F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.floor(F.expr("1000 * _best.length div _best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), "collapsed_sha256")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, with repetition planted where crc32(doc_id) % 10 is 0: from word a = g % n on, the text's next
    p = 1 + floor((n - a) / (3 + g % 8)) words come again and again, with g = floor(crc32 / 10). A null id, or a
    text without words, is left as it is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    out = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    out = out.withColumn("n", F.size("w")).withColumn("g", F.expr("h div 10"))
    out = out.withColumn("a", F.expr("int(g % n)")).withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    period = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.expr("int((n - a + p - 1) div p)")))
    whole = F.concat(F.slice("w", 1, F.col("a")), F.slice(period, 1, F.col("n") - F.col("a")))
    return out.select("doc_id", F.when(F.col("n") > 0, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))
