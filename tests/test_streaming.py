"""Stream results equal batch results (availableNow triggers)."""

import json
import os
import time

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def test_session_stream_equals_batch(spark, scratch_dir):
    from ragtide.operators.session import session_context
    from ragtide.sources.testdata import SCHEMAS, table
    from ragtide.streaming.sessions import session_context_stream

    conv = table(spark, SF_SMALL, "conversations")
    src = os.path.join(scratch_dir, "turns")
    conv.filter("turn <= 2").coalesce(1).write.parquet(os.path.join(src, "a"))
    time.sleep(1.1)
    conv.filter("turn > 2").coalesce(1).write.parquet(os.path.join(src, "b"))
    stream = spark.readStream.schema(SCHEMAS["conversations"]).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(src)
    out = os.path.join(scratch_dir, "ctx")
    q = (session_context_stream(stream, timeout_ms=None).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(scratch_dir, "ck")).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(out).select("conv_id", "turn", "n_history", "history")
    want = session_context(conv).select("conv_id", "turn", "n_history", "history")
    assert got.count() == want.count() == conv.count()
    assert got.exceptAll(want).count() == 0


def test_question_stream_equals_batch(spark, scratch_dir):
    from ragtide.catalog import FLAGSHIP_OPTIONS, articles, models_for
    from ragtide.plans.answer import answer_questions
    from ragtide.plans.index import build_passages
    from ragtide.sources.testdata import table
    from ragtide.streaming.questions import start_answer_stream

    passages = build_passages(articles(spark, SF_SMALL), chunking="recursive").persist()
    models = models_for(passages)
    bench = table(spark, SF_SMALL, "benchmark")
    req = bench.select(F.col("item_id").alias("request_id"),
                       F.when(F.col("item_id") < 20, F.lit("2")).otherwise(F.lit("1")).alias("choice"),
                       F.col("text").alias("question"))
    extra = spark.createDataFrame([(900, "3", "q"), (901, "1", " Exit ")], "request_id bigint, choice string, "
                                                                          "question string")
    src = os.path.join(scratch_dir, "req")
    req.filter("request_id < 20").coalesce(1).write.parquet(os.path.join(src, "p1"))
    req.filter("request_id >= 20").unionByName(extra).coalesce(1).write.parquet(os.path.join(src, "p2"))
    out = os.path.join(scratch_dir, "out")
    q = start_answer_stream(spark, os.path.join(src, "*"), out, os.path.join(scratch_dir, "ck"),
                            lambda: (passages, models), FLAGSHIP_OPTIONS, max_files_per_trigger=1)
    q.awaitTermination()
    got = spark.read.parquet(f"{out}/answers").select("question_id", "model_kind", "answer")
    status = {r.request_id: r.status for r in spark.read.parquet(f"{out}/status").collect()}
    assert status[900] == "rejected" and status[901] == "ended" and status[0] == "accepted"
    accepted = req.select(F.col("request_id").alias("question_id"), "question", F.col("choice").alias("route"))
    want = answer_questions(accepted, passages, models, FLAGSHIP_OPTIONS).select("question_id", "model_kind",
                                                                                   "answer")
    assert got.count() == want.count() == 40
    assert got.exceptAll(want).count() == 0
    assert {r.model_kind for r in got.collect()} == {"gpt2", "llama"}


def test_corpus_stream_is_idempotent(spark, scratch_dir):
    from ragtide.plans.index import build_passages
    from ragtide.sources import store
    from ragtide.sources.corpus import read_corpus_files
    from ragtide.sources.testdata import table
    from ragtide.streaming.corpus import start_index_stream

    docs = table(spark, SF_SMALL, "documents").orderBy("doc_id").collect()
    src = os.path.join(scratch_dir, "corpus")
    os.makedirs(src)
    half = len(docs) // 2
    for part, chunk in enumerate((docs[:half], docs[half:])):
        arts = [{"luật": d.source, "điều": d.doc_id, "tên_điều": d.lang, "nội_dung": d.text} for d in chunk]
        with open(os.path.join(src, f"part{part}.json"), "w", encoding="utf-8") as f:
            json.dump(arts, f, ensure_ascii=False)
    with open(os.path.join(src, "broken.json"), "w") as f:
        f.write("[{")
    name = "stream_store_test"
    store.drop(spark, name)
    q = start_index_stream(spark, src, name, os.path.join(scratch_dir, "ck1"), os.path.join(scratch_dir, "rej"),
                           max_files_per_trigger=1)
    q.awaitTermination()
    n = store.count(spark, name)
    arts, _ = read_corpus_files(spark, src)
    assert n == build_passages(arts).count() > 0
    # a replay of every file (fresh checkpoint) appends nothing
    q = start_index_stream(spark, src, name, os.path.join(scratch_dir, "ck2"))
    q.awaitTermination()
    assert store.count(spark, name) == n
    assert spark.read.parquet(os.path.join(scratch_dir, "rej")).filter(
        F.col("path").endswith("broken.json")).count() == 1
    store.drop(spark, name)


def test_exit_closes_a_session_in_later_micro_batches(spark, scratch_dir):
    from ragtide.catalog import FLAGSHIP_OPTIONS, articles, models_for
    from ragtide.operators.answer import route_requests
    from ragtide.plans.index import build_passages
    from ragtide.streaming.questions import REQUEST_SCHEMA, SESSION_SCHEMA, start_answer_stream

    passages = build_passages(articles(spark, SF_SMALL).limit(5), chunking="recursive").persist()
    models = models_for(passages)
    rows = [(1, "1", "what is this", 7, 1), (2, "2", " EXIT ", 7, 2), (3, "1", "other session", 8, 1),
            (4, "1", "too late", 7, 3), (5, "1", "still open", 8, 2), (6, "9", "no route", 8, 3)]
    src = os.path.join(scratch_dir, "req")
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, f"{REQUEST_SCHEMA}, {SESSION_SCHEMA}").coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    out = os.path.join(scratch_dir, "out")
    start_answer_stream(spark, src, out, os.path.join(scratch_dir, "ck"), lambda: (passages, models), FLAGSHIP_OPTIONS,
                        max_files_per_trigger=1, sessions=True).awaitTermination()
    status = {r.request_id: r.status for r in spark.read.parquet(f"{out}/status").collect()}
    whole = route_requests(spark.createDataFrame(rows, f"{REQUEST_SCHEMA}, {SESSION_SCHEMA}"), session="session_id",
                           order="turn")
    assert status == {r.request_id: r.status for r in whole.collect()}
    assert status == {1: "accepted", 2: "ended", 3: "accepted", 4: "closed", 5: "accepted", 6: "rejected"}
    assert {r.question_id for r in spark.read.parquet(f"{out}/answers").collect()} == {1, 3, 5}
