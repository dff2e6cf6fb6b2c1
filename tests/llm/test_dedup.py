"""SimHash and suffix dedup against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from ragtide.llm import induced, simhash, suffix
from ragtide.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, extra=""):
    rows = [(i, t, "en", "s", 0 if t is None else len(t)) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def brute_fingerprint(text, shingle=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i: i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fp, bits):
    parent = {i: i for i in range(len(fp))}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fp)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= bits:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fp))]


def texts_with_copies(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            t = r.choice(out).split(" ")
            for _ in range(r.choice([0, 1, 2, 6])):
                if t:
                    t[r.randrange(len(t))] = r.choice(words)
            out.append(" ".join(t))
        else:
            out.append(" ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 4, 5, 80, 300]))))
    return out


def test_fingerprints_equal_the_definition():
    for t in [None, "", " \t\n", "One", "One two Three", "a b c d", "A b c d e", "é É ñ\x0bx y z w v",
              " ".join(map(str, range(9000))), *texts_with_copies(3, 30)]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_spark_hash_is_the_same_hash(spark):
    got = spark.sql("select xxhash64('one two three four')").first()[0]
    assert got & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"one two three four", 42)


@pytest.mark.parametrize("hot", [256, 2])
def test_components_equal_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (4, hot))
    texts = [*texts_with_copies(5, 250), None, "", " ", "same text", "same text"]
    docs = frame(spark, [(100 + 3 * i, t) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fp = [brute_fingerprint(t) for t in texts]
    want = brute_components(fp, 4)
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert got[100 + 3 * i].fingerprint == f"{fp[i]:016x}"
        assert got[100 + 3 * i].component_id == 100 + 3 * want[i]


@pytest.mark.parametrize("bits", [4, 3])
def test_crowds_lose_no_component(spark, bits):
    r = random.Random(2)
    fp = {r.getrandbits(64) for _ in range(40)}
    for base in list(fp)[:4]:  # crowds around a value, and a chain leading away
        fp |= {base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(150)}
        x = base
        for _ in range(10):
            x ^= sum(1 << b for b in r.sample(range(64), bits))
            fp.add(x)
    fp = sorted(fp)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fp]
    df = spark.createDataFrame(signed, "fp long")
    root = brute_components(fp, bits)
    for hot in (10**6, 5):
        roots = {x.node & (1 << 64) - 1: x.root for x in components(simhash.links(df, bits, hot), "t").collect()}
        classes = defaultdict(set)
        for i, x in enumerate(fp):
            classes[root[i]].add(roots.get(x, ("alone", x)))
        assert all(len(c) == 1 for c in classes.values())
        assert len({next(iter(c)) for c in classes.values()}) == len(classes)


def test_components_of_a_long_path_and_a_star(spark):
    r = random.Random(1)
    ids = list(range(200))
    r.shuffle(ids)
    edges = {(min(a, b), max(a, b)) for a, b in zip(ids, ids[1:])} | {(1000, 1000 + k) for k in range(1, 80)}
    got = {x.node: x.root for x in components(spark.createDataFrame(sorted(edges), "a long, b long"), "t").collect()}
    assert got == {**{i: 0 for i in range(200)}, **{1000 + k: 1000 for k in range(80)}}


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert simhash.near_duplicates(empty).collect() == []
    assert suffix.digest(suffix.removed_spans(empty)).collect() == []


# --- suffix sorting ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("memory", [100_000, 7, 1])
@pytest.mark.parametrize("depth", [50, 3])
def test_induced_sorting_equals_plain_sorting(memory, depth):
    r = random.Random(memory + depth)
    for _ in range(120):
        t = np.array([r.randint(1, r.choice([1, 2, 4])) for _ in range(r.randint(1, 70))] + [0], np.uint8)
        pos, lcp = [], []
        induced.sort_suffixes(t, depth, memory, lambda p, c: (pos.append(p.copy()), lcp.append(c.copy())))
        pos, lcp = np.concatenate(pos)[::-1], np.concatenate(lcp)[::-1]
        assert sorted(pos.tolist()) == list(range(len(t) - 1))
        heads = [t[p: p + depth].tobytes() for p in pos]
        assert heads == sorted(heads)
        for i in range(len(pos) - 1):
            common = next((k for k, (x, y) in enumerate(zip(heads[i], heads[i + 1])) if x != y),
                          min(len(heads[i]), len(heads[i + 1])))
            assert lcp[i] == common


def brute_removed(docs, length=50):
    """doc_id -> set of removed byte places, for (doc_id, text) with distinct ids."""
    first = {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i: i + length], d)
    out = {}
    for d, t in docs:
        b = (t or "").encode()
        out[d] = {j for i in range(len(b) - length + 1) if first[b[i: i + length]] < d for j in range(i, i + length)}
    return out


def overlapping_texts(seed, n):
    r = random.Random(seed)
    passages = ["".join(r.choice("abcdé ") for _ in range(r.choice([49, 50, 51, 120]))) for _ in range(12)]
    out = []
    for _ in range(n):
        t = ""
        for _ in range(r.randint(0, 5)):
            t += r.choice(passages) if r.random() < 0.6 else "".join(r.choice("xyzü\n") for _ in range(r.randint(1, 90)))
        out.append(t)
    return out + [None, "", "ab" * 300, "ab" * 200 + "c", "a" * 700, "a" * 49, "a" * 50, out[0], out[0] + "tail"]


@pytest.mark.parametrize("memory", [suffix.MEMORY, 300])
def test_removed_bytes_equal_brute_force(spark, memory):
    docs = [(7 * i + 1, t) for i, t in enumerate(overlapping_texts(memory, 120))]
    random.Random(0).shuffle(docs)
    df = frame(spark, docs).repartition(5)
    removed = suffix.removed_spans(df, 50, memory)
    want, by_id = brute_removed(docs), dict(docs)
    got = {r.doc_id: r for r in suffix.digest(removed).collect()}
    assert len(got) == len(docs)
    for d, gone in want.items():
        b = (by_id[d] or "").encode()
        runs = sum(1 for j in gone if j - 1 not in gone)
        kept = bytes(x for j, x in enumerate(b) if j not in gone)
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans) == (len(b), len(gone), runs), d
        assert got[d].kept_sha256 == hashlib.sha256(kept).hexdigest()
    texts = {r.doc_id: r.text for r in suffix.kept_text(removed, ["doc_id", "text", "n_chars"]).collect()}
    for d, gone in want.items():
        kept = bytes(x for j, x in enumerate((by_id[d] or "").encode()) if j not in gone)
        assert (texts[d] or "") == kept.decode("utf-8", "ignore")


def test_parts_stay_within_memory():
    """A shard larger than memory is sorted in parts of at most that weight, whatever its size."""
    r, memory = random.Random(4), 20_000
    seen, pieces = [], []
    for m in range(30):  # messages of 400 segments, in the order of their parts
        part = np.sort(np.array([r.randrange(suffix.PARTS**suffix.DIGITS) for _ in range(400)], np.uint16))
        size, count = np.full(400, 60, np.uint32), np.full(400, 2, np.uint32)
        body = np.repeat((part % 251).astype(np.uint8), 60)
        dk = np.repeat(part.astype(np.int64), 2)
        pieces.append([part, body, size, count, dk, dk.astype(np.int32), dk.astype(np.uint32)])
    suffix._Spool.held = 0
    parts = suffix._Parts(suffix._segments_of, memory)
    for p in pieces:
        parts.add(p)
    for group in parts.drain():
        got = [np.concatenate(x) for x in zip(*group)]
        assert len(got[1]) + len(got[2]) + suffix.ROW * len(got[4]) <= memory
        assert (got[1] == np.repeat((got[0] % 251).astype(np.uint8), 60)).all() and (got[4] == np.repeat(got[0], 2)).all()
        seen.append(got[0])
    assert len(seen) > suffix.PARTS and sorted(np.concatenate(seen)) == sorted(np.concatenate([p[0] for p in pieces]))
    assert all(not set(a) & set(b) for a, b in zip(seen, seen[1:]))


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    long = "the quick brown fox jumps over the lazy dog and runs away again"
    rows = [(5, long, 1), (5, long, 1), (None, long + "!", 2), (2, "x" + long, 3), (5, "other" + long, 4), (None, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted((r.doc_id or 99, r.n_bytes, r.n_removed) for r in suffix.digest(suffix.removed_spans(df)).collect())
    n = len(long)
    assert got == [(2, n + 1, 0), (5, n, n), (5, n, n), (5, n + 5, n), (99, 0, 0), (99, n + 1, n)]
    wide = spark.createDataFrame([(1, long, 1, 2, 3), (2, long, 1, 2, 3)], "doc_id long, text string, dk int, rk int, fp int")
    assert sorted(len(r.spans or ()) for r in suffix.removed_spans(wide).collect()) == [0, 2]
    assert {r.component_id for r in simhash.near_duplicates(wide).collect()} == {1}


def test_oracle_sql_agrees(spark):
    import duckdb

    from ragtide.llm.queries import ORACLE_SQL, QUERIES

    sf_small = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_small}/documents.parquet'")
    want = con.execute(ORACLE_SQL["op3_suffix_array_dedup"]).fetchall()
    got = QUERIES["op3_suffix_array_dedup"](spark, sf_small).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_rows_without_an_id_never_share_a_key(spark):
    """Null ids and shared ids, with texts whose 64-bit hashes agree in half of their bits."""
    from pyspark.sql import functions as F

    passage = "seventy bytes that an earlier document holds, and all of these as well"
    texts = spark.range(300_000).select(F.concat(F.lit("a"), F.repeat(F.lit("."), (F.col("id") % 37).cast("int")),
                                                 F.col("id").cast("string"), F.lit(" " + passage)).alias("text"))
    half = texts.select("text", F.shiftright(F.xxhash64(F.lit(None).cast("long"), "text"), 32).alias("h"))
    pairs = half.join(half.groupBy("h").count().where("count > 1"), "h").select("text").limit(30)
    picked = [r.text for r in pairs.collect()]
    assert len(picked) >= 8
    docs = [(1, passage)] + [(None, t) for t in picked] + [(9, t + "!") for t in picked[:6]] + [(None, picked[0]), (2**63 - 1, passage)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = suffix.removed_spans(df).collect()
    assert len(got) == len(docs)
    earliest = {}
    for d, t in docs:
        for i in range(len(t) - 49):
            k = t[i : i + 50]
            earliest[k] = min(earliest.get(k, 2**64), 2**64 if d is None else d)
    for r in got:
        gone = {j for i in range(len(r.text) - 49) for j in range(i, i + 50)
                if earliest[r.text[i : i + 50]] < (2**64 if r.doc_id is None else r.doc_id)}
        assert list(r.spans or ()) == ([min(gone), max(gone) + 1] if gone else []), (r.doc_id, r.text, r.spans)
        assert len(gone) >= (70 if r.doc_id != 1 else 0)
    first = spark.createDataFrame([(2**63 - 1, passage), (None, passage)], "doc_id long, text string")
    assert sorted((r.doc_id is None, list(r.spans or ())) for r in suffix.removed_spans(first).collect()) == [
        (False, []), (True, [0, len(passage)])]
    with pytest.raises(ValueError):
        suffix.removed_spans(spark.createDataFrame([(2**63 - 1, ""), (-(2**63), ""), (None, "")], "doc_id long, text string"))
