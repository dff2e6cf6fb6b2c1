"""Decontamination against a plain search for windows, and its SQL on the given tables."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from ragtide.llm import decontaminate as dc
from ragtide.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, w string, k1 string, h string, items string"
ITEMS = "item_id long, text string, len string, digest string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, n):
    """doc_id, n_words, n_hit, items, spans by comparing every window with every item window."""
    windows = {}
    for i, text in items:
        w = words(text)
        size = min(n, len(w))
        for a in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + size]), set()).add("" if i is None else str(i))
    out = []
    for d, text in docs:
        w, hit, held = words(text), set(), set()
        for size in range(1, n + 1):
            for a in range(len(w) - size + 1):
                found = windows.get(tuple(w[a : a + size]))
                if found:
                    held |= found
                    hit |= set(range(a, a + size))
        spans = []
        for x in sorted(hit):
            if spans and sum(spans[-1]) == x:
                spans[-1] = (spans[-1][0], spans[-1][1] + 1)
            else:
                spans.append((x, 1))
        out.append((d, len(w), len(hit), len(held), sorted(held), spans))
    return out


def found_in(spark, docs, items, n, **more):
    d = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in docs], DOCS)
    i = spark.createDataFrame([(*r, "x", "x") for r in items], ITEMS)
    found = dc.contamination(d, i, n, **more)
    rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items, [tuple(s) for s in r.spans]) for r in found.collect()]
    return d, found, rows


def tables(rng):
    def text(size):
        return " ".join(rng.choice(["a", "b", "c", "Dd", "É", "x9", "y"]) for _ in range(size))

    items = [(rng.randint(0, 12), text(rng.choice([0, 3, 4, 7, 9]))) for _ in range(25)]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    return docs, items


def test_random_texts(spark):
    for seed in range(4):
        docs, items = tables(random.Random(seed))
        for n in (3, 5):
            _, _, rows = found_in(spark, docs, items, n)
            want = plain(docs, items, n)
            assert sorted(rows) == sorted(want)
            assert any(r[2] for r in want) and not all(r[2] for r in want)


def test_several_broadcast_sets_give_the_same(spark):
    docs, items = tables(random.Random(9))
    assert sorted(found_in(spark, docs, items, 4, most=7)[2]) == sorted(plain(docs, items, 4))


def test_blocks_lose_no_window(spark):
    """Windows at, before and across the borders of blocks, in a text of several blocks."""
    base = [f"w{i}" for i in range(3 * dc.BLOCK + 7)]
    items = [(i, " ".join(base[a : a + 10])) for i, a in
             enumerate(x for b in (0, dc.BLOCK, 2 * dc.BLOCK, 3 * dc.BLOCK - 3) for x in range(max(0, b - 11), b + 2))]
    items += [(1000, base[dc.BLOCK - 1]), (1001, f"{base[-1]}"), (1002, f"{base[0]} {base[1]}")]
    docs = [(1, " ".join(base)), (2, " ".join(base[1:])), (3, "none")]
    assert sorted(found_in(spark, docs, items, 10)[2]) == sorted(plain(docs, items, 10))


def test_edge_cases(spark):
    ten = "One two, THREE four-five six\nseven eight 9 tEn"
    docs = [(1, None), (2, ""), (3, " .,;[]\x00\x7f"), (None, ten), (None, ten), (None, "other"), (4, ten + " " + ten),
            (5, "İstanbul ÀÉ"), (6, "àé"), (7, "x" + ten), (7, "x" + ten), (8, "w " * 300_000 + ten), (9, "the end")]
    items = [(5, ten), (5, ten), (40, ten + " eleven"), (None, "ÀÉ"), (3, None), (4, "?!"), (12, "THE end")]
    _, found, rows = found_in(spark, docs, items, 10)
    assert sorted(map(repr, rows)) == sorted(map(repr, plain(docs, items, 10)))
    got = {r.doc_id: r for r in dc.digest(found).collect()}
    assert got[1].items_sha256 == hashlib.sha256(b"").hexdigest() and not got[1].contaminated
    assert got[4].items_sha256 == hashlib.sha256(b"40,5").hexdigest() and got[4].n_hit == 20
    assert got[5].items_sha256 == hashlib.sha256(b"").hexdigest() and got[5].n_items == 1  # the null id, as the empty text
    assert got[6].n_hit == 0  # letters beyond ASCII keep their case
    _, _, none = found_in(spark, docs, [], 10)
    assert [r[2:] for r in none] == [(0, 0, [], [])] * len(docs)
    assert found_in(spark, [], items, 10)[2] == []


def test_equal_hashes_are_verified(spark):
    """A window of the set with a document window's hash, but other words, is no hit."""
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    items = dc.item_windows(spark.createDataFrame([(1, "b c")], "item_id long, text string"), 2)
    k1, k2 = dc._keys()
    keyed = docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))
    right = dc.scan(keyed, items, [2], 2, own_row=True)
    wrong = dc.scan(keyed, items.withColumn("digest", F.sha2(F.lit("other"), 256)), [2], 2, own_row=True)
    zero = dc.scan(keyed, items.withColumn("h", F.lit(0).cast("long")), [2], 2, own_row=True)
    assert sorted(r["at"] for r in right.collect()) == [0, 2]
    assert [r["at"] for r in wrong.collect()] == [0] == [r["at"] for r in zero.collect()]


def test_remove_words_or_documents(spark):
    docs = [(1, "Say: one, two (three) four! bye."), (2, "one two three four"), (3, "one two"), (4, None),
            (5, "one two three four one two three four; end"), (5, "(one two three x")]
    items = [(1, "One two three"), (2, "four")]
    d, found, rows = found_in(spark, docs, items, 3)
    left = sorted((r.doc_id, r.text) for r in dc.remove(d, found).where("text is not null").collect())
    assert left == [(1, "Say: bye."), (2, ""), (3, "one two"), (5, "(x"), (5, "end")]
    assert dc.remove(d, found).columns == d.columns
    assert sorted(r.doc_id for r in dc.remove(d, found, whole=True).collect()) == [3, 4]


def test_query_equals_its_sql(spark):
    import duckdb

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name in ("op11_benchmark_decontamination", "op12_vector_codes"):
        out = queries.QUERIES[name](spark, sf)
        cur = con.execute(queries.ORACLE_SQL[name])
        at = [[c[0] for c in cur.description].index(c) for c in out.columns]
        assert sorted(map(tuple, out.collect())) == sorted(tuple(r[i] for i in at) for r in cur.fetchall())


def test_no_python_on_the_way(spark):
    out = queries.op11_benchmark_decontamination(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|Arrow|Pandas|MapElements|SerializeFromObject|CartesianProduct|NestedLoop", plan)
