"""Periodic runs against a brute-force search, over random texts and the given documents."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragtide.llm import periods, queries

SPACES = " \t\n\r\x0b\x0c"


def brute(words, shortest=24):
    """Every run by trying every period; the first period that gives a stretch is its smallest."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        same = np.array([words[j] == words[j + q] for j in range(n - q)], bool)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e + q - s >= max(shortest, 3 * q):
                found.setdefault((s, e + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def words_of(text):
    for c in SPACES[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plant(doc_id, words):
    """The contract's planted repetition, word by word."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def expected(words):
    runs = brute(words)
    drop = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def random_words(rng):
    kind = rng.random()
    if kind < 0.2:
        return [rng.choice("ab") for _ in range(rng.randint(0, 200))]
    if kind < 0.35:  # a Fibonacci word, whose runs overlap at every scale
        a, b = "a", "ab"
        for _ in range(rng.randint(3, 11)):
            a, b = b, b + a
        return list(b[:300])
    out = []
    while len(out) < rng.randint(30, 400):  # periods that hold runs of shorter periods
        some = rng.choice(["ab", "abc", "abcdefgh", "a"])
        base = [rng.choice(some) for _ in range(rng.randint(1, 60))]
        if rng.random() < 0.5:
            base = base[: rng.randint(1, 4)] * rng.randint(1, 12) + base
        out += (base * rng.randint(1, 6))[: rng.randint(1, 400)]
        if rng.random() < 0.5:
            out.append(rng.choice("abz"))
    return out


def test_search_equals_brute_force():
    rng, runs = random.Random(13), 0
    for _ in range(80):
        texts = [random_words(rng) for _ in range(rng.randint(1, 10))]
        texts += texts[:2]  # copies in one string do not meet
        want = [brute(t) for t in texts]
        assert periods.search([[w.encode() for w in t] for t in texts]) == want
        runs += sum(map(len, want))
    assert runs > 500


def test_every_alignment_of_every_period():
    """Runs of exactly three periods, at every offset to the dyadic blocks."""
    rng = random.Random(7)
    for q in [*range(1, 20), 31, 32, 33, 63, 64, 65]:
        for before in range(0, 70, 3):
            root = [b"r%d" % rng.randint(0, 3) for _ in range(q - 1)] + [b"end"]
            text = [b"p%d" % i for i in range(before)] + (root * 24)[: max(24, 3 * q)] + [b"x"]
            assert periods.search([text]) == [brute(text)] != [[]]


def test_range_successor():
    rng = random.Random(3)
    for n in (1, 2, 63, 64, 65, 1000):
        v = np.random.default_rng(n).permutation(n)
        tree = periods.RangeSuccessor(v)
        for _ in range(100):
            lo = rng.randint(0, n)
            hi, x = rng.randint(lo, n), rng.randint(0, n + 2)
            want = min((y for y in v[lo:hi].tolist() if y >= x), default=periods.NOWHERE)
            assert tree(np.array([lo]), np.array([hi]), np.array([x])).tolist() == [want]


def test_names_tell_how_far_places_agree():
    s = np.array([0, 1, 0, 1, 0, 1, 2, 0, 1, 0, 3])
    f = periods.Factors(s)
    assert f.order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    assert f.forward(np.array([0, 0, 6]), np.array([2, 7, 10])).tolist() == [4, 3, 0]
    assert f.backward(np.array([2, 3, 0]), np.array([4, 10, 5])).tolist() == [2, 3, 0]


def test_short_runs_are_refused():
    with pytest.raises(ValueError):
        periods.search([[b"a"] * 30], shortest=12)


def test_query_over_documents(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    with_runs = 0
    for d in docs:
        words = words_of(d.text or "")
        if len(words) > 2000:
            continue  # too slow for the brute force
        want = expected(plant(d.doc_id, words))
        assert got[d.doc_id] == want
        with_runs += want[0] > 0
    assert with_runs > 10


def test_edge_cases(spark):
    long = "w0 w1 w2 w3 w4 " * 40_000
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a " * 23), (5, "\x0b" + "a " * 24), (6, "x " + "a b c " * 9 + "y"),
            (6, "x " + "a b c " * 9 + "y"), (None, "é\u00a0 " * 30), (None, None), (7, long)]
    df = spark.createDataFrame([(i, t, "r", "z") for i, t in rows], "doc_id long, text string, runs string, _best string")
    out = periods.find_runs(df, ["doc_id"], with_text=True)
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()]
    assert got[:5] == [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 23, [], " ".join("a" * 23)),
                       (5, 24, [(0, 24, 1)], "a")]
    assert got[5] == got[6] == (6, 29, [(1, 27, 3)], "x a b c y")
    assert got[7] == (None, 30, [(0, 30, 1)], "é\u00a0") and got[8] == (None, 0, [], "")
    assert got[9] == (7, 200_000, [(0, 200_000, 5)], "w0 w1 w2 w3 w4")
    first = periods.digest(out, ["doc_id"]).where("doc_id = 1").first()
    assert (first.n_runs, first.start, first.length, first.period, first.exponent_milli) == (0, None, None, None, None)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periods.digest(periods.find_runs(periods.planted(empty), ["doc_id"]), ["doc_id"]).count() == 0


def test_planted_repetition(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 90))) for i in range(300)] + [(None, "a b"), (20, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("w", F.lit(1))
    got = [(r.doc_id, r.text) for r in periods.planted(df).collect()]
    assert got == [(i, t if t is None else " ".join(plant(i, t.split()))) for i, t in rows]
