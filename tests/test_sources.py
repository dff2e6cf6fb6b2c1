"""S1-S3 corpus files, S4-S10 passage store."""

import json
import os

from pyspark.sql import functions as F

from ragtide.sources import store
from ragtide.sources.corpus import read_corpus, read_corpus_files, write_corpus


def write(folder, name, text):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)


def corpus_folder(base):
    d = os.path.join(base, "corpus")
    os.makedirs(d)
    art = [{"luật": "Luật A", "điều": 1, "tên_điều": "Một", "nội_dung": "nội dung một"},
           {"luật": "Luật A", "điều": "2a", "tên_điều": "Hai", "nội_dung": "nội dung hai"}]
    write(d, "valid.json", json.dumps(art, ensure_ascii=False, indent=4))
    write(d, "truncated.json", json.dumps(art, ensure_ascii=False)[:-20])
    write(d, "notjson.json", "this is not json")
    write(d, "object.json", json.dumps({"luật": "X"}))
    write(d, "mixed.json", json.dumps([{"luật": "Luật B", "điều": 3, "tên_điều": "Ba", "nội_dung": ""}, 5]))
    write(d, "empty.json", "[]")
    write(d, "ignored.txt", json.dumps(art))
    return d


def test_merge_corpus_files(spark, scratch_dir):
    d = corpus_folder(scratch_dir)
    arts, rejects = read_corpus_files(spark, d)
    rows = sorted((r.law, r.article, r.title, r.content) for r in arts.collect())
    assert rows == [("Luật A", "1", "Một", "nội dung một"), ("Luật A", "2a", "Hai", "nội dung hai"),
                    ("Luật B", "3", "Ba", "")]
    rej = sorted((os.path.basename(r.path), r.reason) for r in rejects.collect())
    assert rej == [("mixed.json", "element 1 is not an object"), ("notjson.json", "malformed json"),
                   ("object.json", "root is not an array"), ("truncated.json", "malformed json")]
    assert arts.select("doc_key").distinct().count() == 3

    out = os.path.join(scratch_dir, "merged")
    write_corpus(arts, out)
    back = read_corpus(spark, out)
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in arts.collect())


def test_empty_content_disappears(spark, scratch_dir):
    from ragtide.plans.index import chunk_table

    arts, _ = read_corpus_files(spark, corpus_folder(scratch_dir))
    chunks = chunk_table(arts)
    assert sorted(r.law for r in chunks.select(F.col("metadata.law").alias("law")).collect()) == ["Luật A", "Luật A"]


def test_store_lifecycle(spark):
    from ragtide.catalog import articles
    from ragtide.plans.index import build_passages

    name = "passages_store_test"
    store.drop(spark, name)
    store.open_store(spark, name)
    assert spark.catalog.tableExists(name) and store.count(spark, name) == 0
    passages = build_passages(articles(spark, "/root/testdata/sf0.001"), chunking="recursive")
    first = store.index_incremental(spark, passages, name)
    assert first == passages.count() > 0
    assert store.index_incremental(spark, passages, name) == 0  # re-run adds nothing
    assert store.index_incremental(spark, passages, name, mode="append") == first  # original behaviour
    assert store.count(spark, name) == 2 * first
    loaded = store.load(spark, name)
    assert loaded.select("metadata.chunk_content").count() == 2 * first
    from ragtide.plans.index import passage_stats

    written = store.write_stats(spark, name)
    direct = passage_stats(loaded)
    assert (written.n_docs, written.avgdl) == (direct.n_docs, direct.avgdl)
    assert written.vocab.exceptAll(direct.vocab).count() == 0 and direct.vocab.exceptAll(written.vocab).count() == 0
    store.drop(spark, name)
    assert not spark.catalog.tableExists(name)


def test_a_file_beyond_the_variant_limit_gives_every_article(spark, scratch_dir):
    import json

    text = "x" * 100_000
    with open(os.path.join(scratch_dir, "big.json"), "w") as f:
        json.dump([{"luật": "L", "điều": i, "tên_điều": "T", "nội_dung": text} for i in range(1400)], f)
    with open(os.path.join(scratch_dir, "cut.json"), "w") as f:
        f.write('[{"luật": "L", "điều": 1}, {"luật"')
    with open(os.path.join(scratch_dir, "root.json"), "w") as f:
        f.write('{"luật": "L"}')
    from ragtide.sources.corpus import read_corpus_files

    arts, rejects = read_corpus_files(spark, scratch_dir)
    assert arts.select("article").distinct().count() == 1400
    assert sorted(r.reason for r in rejects.collect()) == ["malformed json", "root is not an array"]


def test_an_edited_article_replaces_its_passages(spark):
    from ragtide.plans.index import build_passages

    def corpus(*rows):
        return spark.createDataFrame(rows, "doc_key bigint, law string, article string, title string, content string")

    name = "reindex_edit_test"
    store.drop(spark, name)
    first = corpus((1, "L", "1", "T", "a\nb"), (2, "L", "2", "T", "same"), (3, "L", "2", "T", "same"))
    assert store.index_incremental(spark, build_passages(first, "lines"), name) == 4  # equal articles both stay
    edited = corpus((1, "L", "1", "T", "a\nb\nc"), (2, "L", "2", None, "same"), (4, "L", "2", "", "same"))
    store.index_incremental(spark, build_passages(edited, "lines"), name)
    rows = store.load(spark, name).select("passage_id", "doc_key", "metadata").collect()
    assert len({r.passage_id for r in rows}) == len(rows) == 6
    assert sorted((r.doc_key, r.metadata.total_chunks) for r in rows) == [(1, 3), (1, 3), (1, 3), (2, 1), (3, 1), (4, 1)]
    assert store.index_incremental(spark, build_passages(edited, "lines"), name) == 0
    store.drop(spark, name)
