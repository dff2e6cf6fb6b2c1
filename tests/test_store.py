"""The versioned store: edits, removals, interrupted loads, ids, statistics, and what stays on disk."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from ragtide.operators.numbering import numbered
from ragtide.operators.passages import with_keys
from ragtide.plans.index import build_passages, passage_stats
from ragtide.sources import paths, store, versions

ARTICLES = "doc_key {}, law string, article string, title string, content string"


def corpus(spark, docs, key_type="bigint"):
    rows = [(k, "L", str(k), "T", c) for k, c in docs.items()]
    return spark.createDataFrame(rows, ARTICLES.format(key_type))


def load(spark, name, docs, key_type="bigint", **more):
    arts = corpus(spark, docs, key_type)
    return store.index_incremental(spark, build_passages(arts, "lines"), name, documents=arts, **more)


def rows(df):
    return sorted(((r.doc_key, r.metadata.chunk_index, r.metadata.chunk_content) for r in df.collect()), key=repr)


def expected(docs):
    return sorted(((k, i, line) for k, c in docs.items() if c is not None for i, line in enumerate(c.split("\n"))), key=repr)


def assert_stats(spark, name):
    """The statistics that loads have added up equal a count over the store."""
    passages, kept = store.snapshot(spark, name)
    direct = passage_stats(passages)
    assert (kept.n_docs, kept.avgdl) == (direct.n_docs, direct.avgdl)
    assert sorted(map(tuple, kept.vocab.collect())) == sorted(map(tuple, direct.vocab.collect()))


def scratch_of(spark):
    return set(paths.names(spark, store.ensure_checkpoint_dir(spark)))


@pytest.fixture
def name(spark, scratch_dir, own_checkpoints):
    n = f"store_{os.path.basename(scratch_dir).replace('-', '_').lower()}"
    store.open_store(spark, n, os.path.join(scratch_dir, "store"))
    yield n
    if spark.catalog.tableExists(n):
        store.drop(spark, n)


def test_edits_removals_and_empty_articles(spark, name):
    docs = {1: "a\nb", 2: "same", 3: "same", 4: "", None: "null key"}
    assert load(spark, name, docs) == 6
    assert load(spark, name, docs) == 0
    assert len(versions.numbers(spark, store._root(spark, name))) == 2  # a load without changes makes no version
    assert load(spark, name, {1: "a\nb\nc", 2: "same"}) == 3
    docs[1] = "a\nb\nc"
    assert rows(store.load(spark, name)) == expected(docs)
    load(spark, name, {2: None})  # its content is gone
    docs.pop(2)
    assert rows(store.load(spark, name)) == expected(docs)
    load(spark, name, {5: "new"}, removed=spark.createDataFrame([(3,), (77,)], "doc_key bigint"))
    docs.pop(3)
    docs[5] = "new"
    assert rows(store.load(spark, name)) == expected(docs) == rows(spark.table(name))
    assert_stats(spark, name)
    docs = {5: "new", 2: "back", None: "null key"}
    assert load(spark, name, docs, full=True) == 1  # everything else leaves
    assert rows(store.load(spark, name)) == expected(docs)
    assert store.count(spark, name) == 3
    assert_stats(spark, name)


def test_a_reader_finishes_on_the_version_it_began_with(spark, name):
    load(spark, name, {1: "old", 2: "two"})
    before, sql = store.load(spark, name), spark.table(name)
    load(spark, name, {1: "new"})
    store.compact(spark, name)
    store.vacuum(spark, name)  # within the time that superseded versions stay
    assert rows(before) == rows(sql) == expected({1: "old", 2: "two"})
    assert rows(store.load(spark, name)) == expected({1: "new", 2: "two"})


@pytest.mark.parametrize("failing", ["commit", "segment", "numbered"])
def test_an_interrupted_load_leaves_the_last_version(spark, name, failing):
    monkeypatch = pytest.MonkeyPatch()
    load(spark, name, {1: "old", 2: "two"})
    root = store._root(spark, name)
    before, scratch = versions.latest(spark, root), scratch_of(spark)
    kept = {k: paths.names(spark, f"{root}/{k}") for k in versions.KINDS}

    def lost(*_, **__):
        raise RuntimeError("lost")

    if failing == "commit":
        monkeypatch.setattr(versions, "commit", lost)
    elif failing == "numbered":
        monkeypatch.setattr(store, "numbered", lost)
    else:
        write, calls = store._Load.segment, []
        monkeypatch.setattr(store._Load, "segment", lambda self, *a: lost() if calls else (calls.append(1), write(self, *a))[1])
    with pytest.raises(RuntimeError):
        load(spark, name, {1: "new", 3: "three"})
    monkeypatch.undo()
    assert versions.latest(spark, root) == before and rows(store.load(spark, name)) == expected({1: "old", 2: "two"})
    assert {k: paths.names(spark, f"{root}/{k}") for k in versions.KINDS} == kept and scratch_of(spark) == scratch
    assert load(spark, name, {1: "new", 3: "three"}) == 2
    assert_stats(spark, name)


def test_of_two_loads_from_one_version_one_ends(spark, name):
    monkeypatch = pytest.MonkeyPatch()
    load(spark, name, {1: "a"})
    arts = corpus(spark, {2: "b"})
    write, other = store._Load.commit, []

    def overtaken(self, **changes):
        if not other:
            other.append(1)
            load(spark, name, {3: "c"})
        return write(self, **changes)

    monkeypatch.setattr(store._Load, "commit", overtaken)
    with pytest.raises(versions.VersionTaken):
        store.index_incremental(spark, build_passages(arts, "lines"), name, documents=arts)
    monkeypatch.undo()
    assert rows(store.load(spark, name)) == expected({1: "a", 3: "c"})
    assert load(spark, name, {2: "b"}) == 1
    assert rows(store.load(spark, name)) == expected({1: "a", 2: "b", 3: "c"})
    assert len({r.passage_id for r in store.load(spark, name).collect()}) == 3


def test_nothing_is_left_behind(spark, name):
    scratch = scratch_of(spark)
    docs = {i: f"line {i}\nmore" for i in range(50)}
    load(spark, name, docs)
    for i in range(3):
        docs[i] = f"edited {i}"
        load(spark, name, {i: docs[i]})
    assert scratch_of(spark) == scratch
    root = store._root(spark, name)
    v = versions.latest(spark, root)
    assert v.segments() == {f"{k}/{n}" for k in versions.KINDS for n in paths.names(spark, f"{root}/{k}")}
    assert len(v.passages) == 4 and v.n_dead == 6  # an edit adds a segment; it does not write the store anew
    store.compact(spark, name)
    paths.make(spark, f"{root}/passages/left-by-a-killed-load")
    gone = store.vacuum(spark, name, keep_ms=0)
    assert "passages/left-by-a-killed-load" in gone and len(versions.numbers(spark, root)) == 1
    v = versions.latest(spark, root)
    assert v.segments() == {f"{k}/{n}" for k in versions.KINDS for n in paths.names(spark, f"{root}/{k}")}
    assert (len(v.passages), v.n_dead, v.removed) == (1, 0, ())
    assert rows(store.load(spark, name)) == expected(docs) == rows(spark.table(name))
    assert load(spark, name, docs, full=True) == 0
    assert_stats(spark, name)
    store.drop(spark, name)
    assert not paths.exists(spark, root) and not spark.catalog.tableExists(name)


def test_a_store_is_found_by_its_folder(spark, name):
    """Another application's catalog does not know the view; the folder has all that there is."""
    load(spark, name, {1: "a"})
    root = store._root(spark, name)
    spark.sql(f"DROP VIEW {name}")
    store.open_store(spark, name, root)
    assert rows(spark.table(name)) == expected({1: "a"})


def test_statistics_over_many_loads(spark, name, monkeypatch):
    """Random loads, edits and removals; small segments are merged on the way."""
    monkeypatch.setattr(store, "MERGE_AT", 4)
    rng, docs = random.Random(4), {}
    for _ in range(store.MERGE_AT + 3):
        batch = {rng.randint(0, 12): " ".join(rng.choice("ab cd ef gh".split()) for _ in range(rng.randint(1, 4)))
                 for _ in range(rng.randint(1, 3))}
        docs.update(batch)
        load(spark, name, batch)
    v = versions.latest(spark, store._root(spark, name))
    assert len(v.terms) < store.MERGE_AT and len(v.documents) < store.MERGE_AT
    assert rows(store.load(spark, name)) == expected(docs)
    assert_stats(spark, name)
    again = store.write_stats(spark, name)
    assert again.n_docs == len(docs)
    assert_stats(spark, name)


def test_appended_copies_are_replaced_by_the_next_load(spark, name):
    arts = corpus(spark, {1: "a\nb", 2: "c"})
    for _ in range(2):
        assert store.index_incremental(spark, build_passages(arts, "lines"), name, mode="append") == 3
    assert store.count(spark, name) == 6
    assert_stats(spark, name)
    assert load(spark, name, {1: "a\nb", 2: "c"}) == 0
    store.index_incremental(spark, build_passages(corpus(spark, {1: "other"}), "lines"), name, mode="append")
    assert load(spark, name, {1: "a\nb"}) == 2
    assert rows(store.load(spark, name)) == expected({1: "a\nb", 2: "c\nc"})[:2] + [(2, 0, "c"), (2, 0, "c")]
    assert_stats(spark, name)


def test_ids_are_dense_unique_and_stay(spark, name):
    docs = {f"file#{i}": f"x {i}\ny" for i in range(300)}
    load(spark, name, docs, "string")
    first = {(r.doc_key, r.metadata.chunk_index): r.passage_id for r in store.load(spark, name).collect()}
    assert len(set(first.values())) == 600
    assert sorted({i >> 20 for i in first.values()}) == list(range(300))
    load(spark, name, {"file#7": "edited\ny", "file#300": "new"}, "string")
    again = {(r.doc_key, r.metadata.chunk_index): r.passage_id for r in store.load(spark, name).collect()}
    assert {k: again[k] for k in first} == first and again["file#300", 0] >> 20 == 300
    with pytest.raises(ValueError):
        load(spark, name, {1: "a number as key"})


def test_documents_of_more_chunks_than_an_id_block(spark, name):
    """(document 5, chunk 2^20) and (document 6, chunk 0) are two passages."""
    meta = [(5, 0), (5, 1 << 20), (5, (1 << 20) + 1), (5, 1 << 21), (6, 0), (6, 1), (1 << 60, 0)]
    chunks = spark.createDataFrame([(d, "L", "1", "T", c, 1 << 22, f"{d}.{c}") for d, c in meta],
                                   "doc_key bigint, law string, article string, title string, chunk_index int, "
                                   "total_chunks int, chunk_content string")
    from ragtide.operators.passages import pack_metadata

    keyed = with_keys(chunks)
    assert [r.passage_id for r in keyed.orderBy("doc_key", "chunk_index").collect()] == [
        5 << 20, None, None, None, 6 << 20, (6 << 20) + 1, None]
    passages = pack_metadata(keyed).withColumns({"passage_text": F.lit("t"), "embedding": F.lit(None).cast("array<float>")})
    assert store.index_incremental(spark, passages, name) == len(meta)
    ids = [r.passage_id for r in store.load(spark, name).collect()]
    assert len(set(ids)) == len(meta) and {i >> 20 for i in ids} == set(range(5))


def test_numbers_are_dense_and_repeatable(spark):
    df = spark.range(1000).select((F.col("id") % 700).alias("k"), F.when(F.col("id") % 7 > 0, "x").alias("z"))
    a = {(r.k, r.z): r.n for r in numbered(df, ["k", "z"], "n", 10).collect()}
    b = {(r.k, r.z): r.n for r in numbered(df.repartition(5), ["k", "z"], "n", 10).collect()}
    assert a == b and sorted(a.values()) == list(range(10, 10 + len(a)))
    assert numbered(df.limit(0), ["k", "z"], "n").count() == 0


def test_ingest_keeps_statistics_current_without_once(spark, scratch_dir, name):
    """A running corpus stream: after each micro-batch passages and statistics are those of one version."""
    import json

    from ragtide.streaming.corpus import start_index_stream

    src = os.path.join(scratch_dir, "in")
    os.makedirs(src)

    def put(file, texts):
        with open(os.path.join(scratch_dir, file), "w", encoding="utf-8") as f:
            json.dump([{"luật": "L", "điều": i, "tên_điều": "T", "nội_dung": t} for i, t in enumerate(texts)], f)
        os.rename(os.path.join(scratch_dir, file), os.path.join(src, file))

    put("a.json", ["one two", "three"])
    q = start_index_stream(spark, src, name, os.path.join(scratch_dir, "ck"), chunking="lines", available_now=False,
                           every="1 second")
    try:
        for n, more in ((2, ("b.json", ["four two"])), (3, ("c.json", ["five", "", "two"])), (6, None)):
            for _ in range(120):
                if store.count(spark, name) == n or q.exception():
                    break
                time.sleep(0.5)
            assert q.exception() is None and store.count(spark, name) == n
            assert_stats(spark, name)
            if more:
                put(*more)
    finally:
        q.stop()
    vocab = {r.token: r.df for r in store.load_stats(spark, name).vocab.collect()}
    assert vocab["two"] == 3 and vocab["five"] == 1


def test_passages_are_sorted_out_only_if_a_load_repeats_some(spark, scratch_dir, monkeypatch):
    """Whole passages, vectors included, are not shuffled by key for a load without repeats; one with repeats stores each once."""
    from ragtide.plans.index import build_passages
    from ragtide.sources import store

    rows = [(1, "l", "a", "t", "one\ntwo"), (2, "l", "b", "t", "three")]
    schema = "doc_key bigint, law string, article string, title string, content string"
    arts = spark.createDataFrame(rows, schema)
    twice = spark.createDataFrame(rows + rows[:1] + [(3, "l", "c", "t", "four")], schema)
    used, plain = [], type(arts).dropDuplicates
    monkeypatch.setattr(type(arts), "dropDuplicates", lambda self, *a: used.append(a) or plain(self, *a))
    name = "repeats_of_a_load"
    store.open_store(spark, name, f"{scratch_dir}/{name}")
    try:
        assert store.index_incremental(spark, build_passages(arts, chunking="lines"), name) == 3 and not used
        assert store.index_incremental(spark, build_passages(twice, chunking="lines"), name) == 1 and used
        assert store.count(spark, name) == 4
        assert store.load(spark, name).select("passage_id").distinct().count() == 4
    finally:
        store.drop(spark, name)
