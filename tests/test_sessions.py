"""Requests with statuses and sessions: what a generator keeps, batch against a plain loop, stream against batch."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from ragtide.operators.answer import default_generator, default_session_generator, generate_in_sessions
from tests.conftest import SF_SMALL

ASKED = "question_id long, session_id long, turn long, question string, model_kind string, context string, extra string"


def counting(prompt, question, context, model_kind, state):
    """A generator whose state is all that it was asked; it answers with it."""
    state = [*(state or []), question]
    return "|".join(state), state


def loop(rows, generator, states):
    """The same, request by request."""
    kept, out, last = dict(states), {}, {}
    for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2], r[0])):
        text, state = generator("", r[3] or "", r[5] or "", r[4], None if r[1] is None else kept.get(r[1]))
        out[r[0]] = text
        if r[1] is not None:
            kept[r[1]], last[r[1]] = state, r[0]
    return out, {q: kept[s] for s, q in last.items()}


def test_sessions_equal_a_loop(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, *range(9)]), rng.randint(0, 500), f"q{i}", "llama", "c", "x") for i in range(400)]
    states = {3: ["before"], 5: None, 100: ["no request now"]}
    df = spark.createDataFrame(rows, ASKED)
    st = spark.createDataFrame(list(states.items()), "session_id long, state array<string>")
    want, want_states = loop(rows, counting, states)
    for parts in (1, 7):
        got = generate_in_sessions(df.repartition(parts), counting, st).collect()
        assert {r.question_id: r.answer for r in got} == want
        assert {r.question_id: r.state for r in got if r.state is not None} == want_states
        assert all(r.extra == "x" and r.prompt for r in got)
    assert generate_in_sessions(df.limit(0), counting, st).count() == 0


def test_a_long_session_streams_through_one_state(spark):
    """A generator that keeps its last words only: 20,000 turns of one session, in several Arrow batches."""
    def last(prompt, question, context, model_kind, state):
        return (state or ["first"])[0], [question]

    n = 20_000
    df = spark.range(n).select(F.col("id").alias("question_id"), F.lit(1).cast("long").alias("session_id"),
                               (n - F.col("id")).alias("turn"), F.col("id").cast("string").alias("question"),
                               F.lit("llama").alias("model_kind"), F.lit("").alias("context"))
    out = generate_in_sessions(df, last)
    wrong = out.where(F.col("answer") != F.when(F.col("question_id") == n - 1, "first").otherwise(
        (F.col("question_id") + 1).cast("string")))
    assert wrong.count() == 0 and out.where("state is not null").select("question_id").collect()[0][0] == 0


def test_without_state_both_generators_agree(spark):
    rows = [(1, None, 1, "red fox", "llama", "A dog. The red fox! red", "x"), (2, None, 1, "fox", "gpt2", "a fox. b", "x"),
            (3, None, 1, "none", "llama", "", "x"), (4, None, 1, None, "llama", "first. second", "x")]
    df = spark.createDataFrame(rows, ASKED)
    got = {r.question_id: r.generated for r in generate_in_sessions(df).collect()}
    plain = df.withColumn("question", F.coalesce("question", F.lit(""))).withColumn("prompt", F.lit("p"))
    want = plain.withColumn("g", default_generator(*[F.col(c) for c in ("prompt", "question", "context", "model_kind")]))
    assert {r.question_id: r.g for r in want.collect() if r.question_id != 2} == {k: v for k, v in got.items() if k != 2}
    assert got[2].endswith(" a fox")
    text, state = default_session_generator("p", "and where?", "The fox is red. It is where?", "llama", ["fox", "red"])
    assert (text, state) == ("The fox is red", ["and", "where"])


@pytest.fixture(scope="module")
def served(spark):
    from ragtide.catalog import articles, models_for
    from ragtide.plans.index import build_passages

    passages = build_passages(articles(spark, SF_SMALL).limit(20), chunking="recursive").persist()
    return passages, models_for(passages)


def test_every_request_gets_a_status(spark, served):
    from ragtide.plans.answer import answer_questions, answer_requests

    rows = [(1, "1", "what"), (2, "9", "what"), (3, None, "what"), (4, "2", " Exit\n"), (5, "2", None), (1 << 61, "2", "what is it")]
    df = spark.createDataFrame(rows, "request_id long, choice string, question string")
    out = {r.request_id: r for r in answer_requests(df, *served).collect()}
    assert {k: r.status for k, r in out.items()} == {1: "accepted", 2: "rejected", 3: "rejected", 4: "ended", 5: "accepted",
                                                     1 << 61: "accepted"}
    assert all((r.answer is not None) == (r.status == "accepted") for r in out.values())
    assert out[1].model_kind == "gpt2" and out[1 << 61].n_docs == 4
    alone = answer_questions(spark.createDataFrame([(7, "what is it")], "question_id long, question string").withColumn(
        "route", F.lit("2")), *served).first()
    assert alone.answer == out[1 << 61].answer  # also for ids that no multiple of fits a long


def test_session_stream_equals_batch(spark, scratch_dir, served, own_checkpoints):
    from ragtide.plans.answer import answer_sessions
    from ragtide.sources import paths
    from ragtide.streaming import questions as stream

    rng = random.Random(8)
    rows, schema = [], f"{stream.REQUEST_SCHEMA}, {stream.SESSION_SCHEMA}"
    for turn in range(6):
        for session in (1, 2, 3, None):
            text = "exit" if (session, turn) == (2, 3) else " ".join(rng.choices("the and nd on th er of".split(), k=3))
            rows.append((len(rows), rng.choice("1229"), text, session, turn))
    src, out = os.path.join(scratch_dir, "req"), os.path.join(scratch_dir, "out")
    for part in range(3):
        spark.createDataFrame(rows[part * 8 : part * 8 + 8], schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    before = set(paths.names(spark, own_checkpoints))
    whole, stream.WHOLE = stream.WHOLE, 2
    try:
        stream.start_answer_stream(spark, src, out, os.path.join(scratch_dir, "ck"), lambda: served,
                                   max_files_per_trigger=1, sessions=True, generator=counting).awaitTermination()
    finally:
        stream.WHOLE = whole
    assert set(paths.names(spark, own_checkpoints)) == before  # micro-batches leave no table behind
    want = {r.request_id: r for r in answer_sessions(spark.createDataFrame(rows, schema), *served, generator=counting).collect()}
    got = {r.question_id: r.answer for r in spark.read.parquet(f"{out}/answers").collect()}
    assert got == {k: r.answer for k, r in want.items() if r.status == "accepted"}
    status = {r.request_id: r.status for r in spark.read.parquet(f"{out}/status").collect()}
    assert status == {k: r.status for k, r in want.items()} and set(status.values()) == {"accepted", "rejected", "ended", "closed"}
    states = {r.session_id: r.state for r in stream._states_before(spark, f"{out}/states", 3).collect()}
    assert states == {r.session_id: r.state for r in want.values() if r.state is not None}
    assert any("|" in a for a in got.values())


def test_comparison_returns_its_rewrites(spark, served):
    from ragtide.operators.rewrite import expand_queries
    from ragtide.plans.retrieve import compare_modes

    qs = spark.createDataFrame([(1, "which articles concern families"), (2, "x")], "question_id long, question string")
    out = compare_modes(qs, *served, 3).select("question_id", "rewrites").distinct().collect()
    want = {}
    for r in expand_queries(qs).where("query_ord > 0").orderBy("query_ord").collect():
        want.setdefault(r.question_id, []).append(r.query_text)
    assert {r.question_id: r.rewrites for r in out} == want


def test_histories_of_wanted_turns_equal_those_of_all(spark):
    from ragtide.operators.session import SEGMENT, session_context, session_history

    rng = random.Random(1)
    rows = [(s, t, rng.choice(["user", None, "assistant"]), rng.choice([None, "", "a\nb", f"t{t}"]))
            for s, n in ((1, 3 * SEGMENT + 2), (2, SEGMENT), (3, 1), (None, SEGMENT + 1), (4, 5)) for t in range(n)]
    rows = [(s, 7 * t - 3000 if s == 1 else t, *more) for s, t, *more in rows]  # gaps and negative numbers
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for wanted in ("role = 'user'", "true", "turn % 64 in (0, 1, 63) or conv_id is null"):
        got = session_history(df.repartition(5), wanted).collect()
        want = session_context(df).where(wanted).select(*df.columns, "n_history", "history").collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > 3
    assert session_history(df.where("false"), "true").count() == 0


def test_a_long_session_is_numbered_in_blocks(spark):
    from ragtide.operators.session import positions, session_history

    n = 100_000
    df = spark.range(n).select(F.lit(9).cast("long").alias("conv_id"), (F.col("id") * 2).alias("turn"), F.lit("user").alias("role"),
                               F.col("id").cast("string").alias("text"))
    at = positions(df, "conv_id", "turn").withColumn("task", F.spark_partition_id())
    assert at.where(F.col("position") != F.col("turn") / 2 + 1).count() == 0
    per_task = [r["count"] for r in at.groupBy("task").count().collect()]
    assert len(per_task) > 1 and max(per_task) < n / 2
    last = session_history(df, f"turn = {2 * n - 2} or turn = 128").orderBy("turn").collect()
    assert [r.n_history for r in last] == [64, n - 1]
    assert last[1].history == "\n".join(f"user: {i}" for i in range(n - 1))


def test_zipping_a_long_group(spark):
    from ragtide.operators.metrics import zip_pairs

    c = spark.range(5000).select(F.lit("g").alias("k"), F.col("id").alias("o"), F.col("id").alias("v"))
    r = spark.range(3000).select(F.lit("g").alias("k"), (F.col("id") * 3 + 1).alias("o"), F.col("id").alias("v"))
    out = zip_pairs(c, r, "k", "o", "v", "v")
    assert out.count() == 3000 and out.where("candidate <> reference or item_ord <> candidate + 1").count() == 0
