"""Vector codes against a plain version of the same rounds, and the trie walk against plain distances."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from ragtide.llm import codes, queries

SCHEMA = "vec_id long, embedding array<double>, label int, code string, _v string"


def plain(rows, parts=8, entries=16, rounds=6):
    """vec_id, label, code, error, label_error of (vec_id, vector, label) rows, and the codebooks."""
    kept = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = sorted(((i, [math.floor(x * 4096) for x in v], y) for i, v, y in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    size = len(kept[0][1])
    kept = [(i, v + [0] * (-size % parts), y) for i, v, y in kept if len(v) == size]
    w = len(kept[0][1]) // parts
    cut = [[tuple(v[p * w : (p + 1) * w]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = [nearest(c[p], books[p])[1] for c in cut]
            for k in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, of) if o == k]
                if mine:
                    books[p][k] = tuple(sum(x) // len(mine) for x in zip(*mine))
    best = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in b) for b in best]
    total = {}
    for (_, _, y), e in zip(kept, error):
        total[y] = total.get(y, 0) + e
    out = [(i, y, "".join(f"{k:02x}" for _, k in b), e, total[y]) for (i, _, y), b, e in zip(kept, best, error)]
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return out, hashlib.sha256(text.encode()).hexdigest()


def compressed(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    out, books = codes.compress(df, **more)
    return sorted((tuple(r) for r in out.collect()), key=repr), codes.digest(books)


def check(spark, rows, **more):
    want, sha = plain(rows, **more)
    assert compressed(spark, rows, **more) == (sorted(want, key=repr), sha)
    return want


def test_walk_equals_plain_distances_and_shares_prefixes():
    rng = np.random.default_rng(5)
    for dims, wide in ((1, 3), (4, 3), (8, 2), (8, 1000)):
        leaves = np.unique(rng.integers(-wide, wide, (9000, dims)), axis=0)
        entries = rng.integers(-wide, wide, (16, dims))
        entries[7] = entries[2]  # a tie
        want = ((leaves[:, None, :] - entries[None]) ** 2).sum(axis=2)
        walk = codes.Walk(entries.astype(object))
        cuts = sorted(rng.integers(0, len(leaves), 3).tolist())
        parts = [walk(x) for x in np.split(leaves, cuts) if len(x)]
        assert np.array_equal(np.concatenate([x[0] for x in parts]), want.argmin(axis=1))
        assert np.array_equal(np.concatenate([x[1] for x in parts]), want.min(axis=1))
        shuffled = rng.permutation(leaves)  # order is for sharing only, not for results
        assert np.array_equal(codes.Walk(entries.astype(object))(shuffled)[1],
                              ((shuffled[:, None, :] - entries[None]) ** 2).sum(axis=2).min(axis=1))


def test_random_vectors(spark):
    rng = random.Random(12)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(16)], rng.choice([0, 1, 2, None])) for i in range(300)]
    check(spark, rows)
    coarse = [(i, [rng.randint(-2, 2) / 4096 for _ in range(24)], 1) for i in range(200)]  # many ties and equal parts
    check(spark, coarse, rounds=3)


def test_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    rng = random.Random(3)
    some = [(rng.randint(0, 30), [rng.uniform(-1, 1) for _ in range(8)], i % 3) for i in range(40)]
    hot = [(100 + i, [0.25] * 8, None) for i in range(60)]
    odd = [(None, [0.5] * 8, None), (None, [0.5] * 8, None), (-1, None, 1), (-2, [0.1] * 7 + [None], 1),
           (-3, [nan] * 8, 1), (-4, [inf] + [0.0] * 7, 1), (7, [0.1] * 9, 1), (8, [], 1)]
    check(spark, some + some[:5] + hot + odd)
    check(spark, hot)  # one distinct vector, as every entry
    check(spark, some[:3])  # fewer vectors than entries
    check(spark, [(i, [0.1 * i] * 11, 0) for i in range(20)])  # a length that 8 does not divide
    check(spark, [(i, [1e12 * (i % 5 - 2), 3.0 * i] * 4, 0) for i in range(20)])  # beyond 64-bit squares of small parts
    check(spark, [(i, [], 0) for i in range(3)])
    assert compressed(spark, [(1, None, 1)]) == ([], hashlib.sha256(b"").hexdigest()) == compressed(spark, [])


def test_integers_beyond_a_long_are_the_nearest_long(spark):
    got, _ = compressed(spark, [(1, [1e300] * 8, 0), (2, [0.0] * 8, 0)], entries=1, rounds=1)
    assert [r[3] for r in got] == [codes.MOST] * 2 and [r[4] for r in got] == [codes.MOST] * 2


def test_too_many_entries_are_refused(spark):
    with pytest.raises(ValueError):
        compressed(spark, [(1, [0.0] * 8, 0)], entries=257)


def test_query_leaves_no_trie_behind(spark):
    import glob

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{folder}/codes-trie*"))
    assert queries.op12_vector_codes(spark, "/root/testdata/sf0.001").count() == 500
    assert set(glob.glob(f"{folder}/codes-trie*")) == before
