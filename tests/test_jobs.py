"""Command-line jobs end to end: merge -> index -> count -> answer -> compare -> evaluate -> drop."""

import json
import os

from pyspark.sql import functions as F

from ragtide.jobs import run
from tests.conftest import SF_SMALL


def test_jobs_end_to_end(spark, scratch_dir, capsys):
    from ragtide.sources.testdata import table

    docs = table(spark, SF_SMALL, "documents").orderBy("doc_id").collect()
    src = os.path.join(scratch_dir, "json")
    os.makedirs(src)
    with open(os.path.join(src, "all.json"), "w", encoding="utf-8") as f:
        json.dump([{"luật": d.source, "điều": d.doc_id, "tên_điều": d.lang, "nội_dung": d.text} for d in docs], f,
                  ensure_ascii=False)
    merged, st = os.path.join(scratch_dir, "merged"), "jobs_store_test"
    run(["drop", "--store", st], spark)
    assert run(["merge", "--input", src, "--output", merged], spark) == 0
    run(["index", "--corpus", merged, "--store", st], spark)
    run(["count", "--store", st], spark)
    assert capsys.readouterr().out.strip().endswith("728")

    qpath = os.path.join(scratch_dir, "q")
    table(spark, SF_SMALL, "benchmark").select(F.col("item_id").alias("question_id"),
                                               F.col("text").alias("question")).write.parquet(qpath)
    run(["answer", "--questions", qpath, "--store", st, "--output", os.path.join(scratch_dir, "ans"),
         "--top-k", "4", "--model-kind", "llama"], spark)
    ans = spark.read.parquet(os.path.join(scratch_dir, "ans"))
    assert ans.count() == 40 and ans.filter(F.length("answer") > 0).count() == 40
    run(["compare", "--questions", qpath, "--store", st, "--output", os.path.join(scratch_dir, "cmp")], spark)
    assert spark.read.parquet(os.path.join(scratch_dir, "cmp")).select("method").distinct().count() == 2

    ppath = os.path.join(scratch_dir, "pairs")
    spark.createDataFrame([("the cat sat on the mat", "the cat on mat", "m1"), ("a b c", "a", "m2"),
                           ("a b c", "a", "m2")], "reference string, hypothesis string, model string") \
        .write.parquet(ppath)
    run(["evaluate", "--pairs", ppath, "--output", os.path.join(scratch_dir, "ev")], spark)
    by = {r.model: r for r in spark.read.parquet(os.path.join(scratch_dir, "ev", "by_model")).collect()}
    assert abs(by["m1"].avg_bleu - 0.1225504602011117) < 1e-12 and by["m2"].n_pairs == 2
    run(["drop", "--store", st], spark)
    assert not spark.catalog.tableExists(st)


def test_stream_commands(spark, scratch_dir):
    """ingest (corpus stream -> store + stats), then serve (question stream -> answers)."""
    from ragtide.sources import store
    from ragtide.sources.testdata import table

    docs = table(spark, SF_SMALL, "documents").orderBy("doc_id").collect()
    src = os.path.join(scratch_dir, "incoming")
    os.makedirs(src)
    with open(os.path.join(src, "a.json"), "w", encoding="utf-8") as f:
        json.dump([{"luật": d.source, "điều": d.doc_id, "tên_điều": d.lang, "nội_dung": d.text} for d in docs], f,
                  ensure_ascii=False)
    st = "jobs_stream_store_test"
    run(["drop", "--store", st], spark)
    run(["ingest", "--source", src, "--store", st, "--checkpoint", os.path.join(scratch_dir, "ck_in"), "--once"],
        spark)
    assert store.count(spark, st) == 728
    qdir = os.path.join(scratch_dir, "requests")
    table(spark, SF_SMALL, "benchmark").select(F.col("item_id").alias("request_id"), F.lit("2").alias("choice"),
                                               F.col("text").alias("question")).write.parquet(qdir)
    out = os.path.join(scratch_dir, "served")
    run(["serve", "--source", qdir, "--store", st, "--output", out, "--checkpoint",
         os.path.join(scratch_dir, "ck_q"), "--once"], spark)
    answers = spark.read.parquet(os.path.join(out, "answers"))
    assert answers.count() == 40 and answers.filter(F.col("model_kind") == "llama").count() == 40
    run(["drop", "--store", st], spark)
