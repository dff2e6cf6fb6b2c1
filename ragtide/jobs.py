"""Command-line Spark jobs (``spark-submit -m ragtide.jobs <command> ...`` or ``python -m ragtide.jobs``).

Commands mirror the original entry points, as table/stream jobs:

  merge     corpus folder of *.json -> merged corpus (+ rejects)          S1, S2
  index     merged corpus -> passage store (+ BM25 statistics)            C1, S4, S5, S10
  count     number of stored passages                                     S7
  drop      drop the store                                                S8
  compact   rewrite the store without dead rows; delete old versions      S10
  answer    questions table -> answers                                    C3
  compare   questions table -> plain vs rewrite+rerank lists              C4
  evaluate  (reference, hypothesis[, model]) table -> per-pair + means    C5
  serve     question stream -> answers (file source, foreachBatch)        T2
  ingest    corpus file stream -> store                                   T3

Tables are read/written as Parquet paths (``--questions``, ``--output`` ...).
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ragtide.config import RagOptions
from ragtide.operators.partitioning import temporary
from ragtide.session import ensure_checkpoint_dir, ship_package


def _served(spark: SparkSession, store_name: str):
    """Passages and models of one version of the store."""
    from ragtide.operators.embed import hashed_encoder
    from ragtide.operators.rerank import Bm25Scorer
    from ragtide.plans.retrieve import Models
    from ragtide.sources import store

    passages, stats = store.snapshot(spark, store_name)
    return passages, Models(scorer=Bm25Scorer(stats), encoder=hashed_encoder())


def _requests(questions):
    return questions.withColumnsRenamed({"question_id": "request_id", "route": "choice"})


def _options(a) -> RagOptions:
    return RagOptions(use_reranking=not a.no_rerank, use_query_rewriting=not a.no_rewrite, top_k=a.top_k,
                      model_kind=a.model_kind, dedupe_keep=a.keep)


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="ragtide.jobs")
    sub = p.add_subparsers(dest="cmd", required=True)
    m = sub.add_parser("merge")
    m.add_argument("--input", required=True)
    m.add_argument("--output", required=True)
    m.add_argument("--rejects")
    i = sub.add_parser("index")
    i.add_argument("--corpus", required=True)
    i.add_argument("--store", required=True)
    i.add_argument("--chunking", default="recursive", choices=["recursive", "lines"])
    i.add_argument("--mode", default="dedupe", choices=["dedupe", "append"])
    i.add_argument("--full", action="store_true", help="the corpus is complete: articles it leaves out are removed")
    i.add_argument("--path", help="folder of a new store; beside the database's tables if not given")
    for name in ("count", "drop", "compact"):
        c = sub.add_parser(name)
        c.add_argument("--store", required=True)
        if name == "compact":
            c.add_argument("--keep-hours", type=float, default=24.0, help="versions superseded longer ago are deleted")
    for name in ("answer", "compare"):
        a = sub.add_parser(name)
        a.add_argument("--questions", required=True,
                       help="parquet with question_id, question [, route [, session_id, turn]]; with routes, every "
                            "question comes out with a status")
        a.add_argument("--store", required=True)
        a.add_argument("--output", required=True)
        a.add_argument("--top-k", type=int, default=5)
        a.add_argument("--model-kind", default="gpt2")
        a.add_argument("--keep", default="first", choices=["first", "best"])
        a.add_argument("--no-rerank", action="store_true")
        a.add_argument("--no-rewrite", action="store_true")
        a.add_argument("--k", type=int, default=5)
    e = sub.add_parser("evaluate")
    e.add_argument("--pairs", required=True, help="parquet with reference, hypothesis [, model]")
    e.add_argument("--output", required=True)
    e.add_argument("--no-stem", action="store_true")
    s = sub.add_parser("serve")
    s.add_argument("--source", required=True)
    s.add_argument("--store", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--checkpoint", required=True)
    s.add_argument("--once", action="store_true")
    s.add_argument("--sessions", action="store_true", help="requests carry session_id and turn; exit closes a session")
    g = sub.add_parser("ingest")
    g.add_argument("--source", required=True)
    g.add_argument("--store", required=True)
    g.add_argument("--checkpoint", required=True)
    g.add_argument("--rejects")
    g.add_argument("--once", action="store_true")
    a = p.parse_args(argv)

    spark = spark or SparkSession.builder.appName(f"ragtide-{a.cmd}").getOrCreate()
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    with temporary(spark):
        return _run(a, spark)


def _run(a: argparse.Namespace, spark: SparkSession) -> int:
    from ragtide.sources import store

    if a.cmd == "merge":
        from ragtide.sources.corpus import read_corpus_files, write_corpus

        arts, rejects = read_corpus_files(spark, a.input)
        write_corpus(arts, a.output)
        if a.rejects:
            rejects.write.mode("overwrite").parquet(a.rejects)
    elif a.cmd == "index":
        from ragtide.plans.index import build_passages
        from ragtide.sources.corpus import read_corpus

        articles = read_corpus(spark, a.corpus)
        store.open_store(spark, a.store, a.path)
        added = store.index_incremental(spark, build_passages(articles, a.chunking), a.store, a.mode, articles, a.full)
        print(f"appended {added} passages")
    elif a.cmd == "count":
        print(store.count(spark, a.store))
    elif a.cmd == "compact":
        store.compact(spark, a.store)
        store.vacuum(spark, a.store, int(a.keep_hours * 3600 * 1000))
    elif a.cmd == "drop":
        store.drop(spark, a.store)
    elif a.cmd in ("answer", "compare"):
        from ragtide.plans.answer import answer_questions, answer_requests, answer_sessions
        from ragtide.plans.retrieve import compare_modes

        passages, models = _served(spark, a.store)
        questions = spark.read.parquet(a.questions)
        if a.cmd == "answer" and {"route", "session_id", "turn"} <= set(questions.columns):
            out = answer_sessions(_requests(questions), passages, models, _options(a))
        elif a.cmd == "answer" and "route" in questions.columns:
            out = answer_requests(_requests(questions), passages, models, _options(a))
        elif a.cmd == "answer":
            out = answer_questions(questions, passages, models, _options(a))
        else:
            out = compare_modes(questions, passages, models, a.k)
        out.write.mode("overwrite").parquet(a.output)
    elif a.cmd == "evaluate":
        from ragtide.operators.metrics import mean_by_model, metric_table

        pairs = spark.read.parquet(a.pairs)
        if "model" not in pairs.columns:
            pairs = pairs.withColumn("model", F.lit("model"))
        keys = ["pair_id"]
        if "pair_id" not in pairs.columns:
            # Content hash, then a number within equal hashes (ordered by content): unique and
            # deterministic, so every metric branch derives the same key for the same row.
            from pyspark.sql import Window

            cols = pairs.columns
            pairs = pairs.withColumn("pair_hash", F.xxhash64(*cols)).withColumn(
                "pair_dup", F.row_number().over(Window.partitionBy("pair_hash").orderBy(*cols)))
            keys = ["pair_hash", "pair_dup"]
        table = metric_table(pairs, keys, stem=not a.no_stem).join(pairs.select(*keys, "model"), keys)
        table.write.mode("overwrite").parquet(f"{a.output}/pairs")
        mean_by_model(table).write.mode("overwrite").parquet(f"{a.output}/by_model")
    elif a.cmd == "serve":
        from ragtide.streaming.questions import start_answer_stream

        q = start_answer_stream(spark, a.source, a.output, a.checkpoint,
                                lambda: _served(spark, a.store), available_now=a.once, sessions=a.sessions)
        q.awaitTermination()
    elif a.cmd == "ingest":
        from ragtide.streaming.corpus import start_index_stream

        q = start_index_stream(spark, a.source, a.store, a.checkpoint, a.rejects, available_now=a.once)
        q.awaitTermination()
    return 0


if __name__ == "__main__":
    raise SystemExit(run())
