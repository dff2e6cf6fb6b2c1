"""C2 properties: partition invariance, dedupe idempotence, rerank-off path, keep='best'."""

import pytest
from pyspark.sql import functions as F

from ragtide.config import RagOptions
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def setup(spark):
    from ragtide.catalog import articles, models_for, questions
    from ragtide.plans.index import build_passages

    passages = build_passages(articles(spark, SF_SMALL), chunking="recursive").persist()
    return passages, models_for(passages), questions(spark, SF_SMALL)


def rows(df):
    return sorted(tuple(r) for r in df.select("question_id", "ctx_rank", "passage_id",
                                              F.round("score", 6).alias("s")).collect())


def test_partition_invariance(spark, setup):
    from ragtide.plans.retrieve import retrieve_fuse

    passages, models, qs = setup
    opts = RagOptions(top_k=4, model_kind="llama")
    a = rows(retrieve_fuse(qs, passages.repartition(1), models, opts))
    b = rows(retrieve_fuse(qs.repartition(5), passages.repartition(11), models, opts))
    assert a == b and len(a) == 160


def test_dedupe_idempotent_and_keep_best(spark, setup):
    from ragtide.operators.fuse import dedupe_first
    from ragtide.plans.retrieve import retrieve_fuse

    passages, models, qs = setup
    first = retrieve_fuse(qs, passages, models, RagOptions(top_k=4, model_kind="llama"))
    again = dedupe_first(first)
    assert first.count() == again.count()
    assert first.groupBy("question_id", "doc").count().filter("count > 1").count() == 0
    best = retrieve_fuse(qs, passages, models, RagOptions(top_k=4, model_kind="llama", dedupe_keep="best"))
    # keep='best' never lowers a document's score
    f = {(r.question_id, r.doc): r.score for r in first.collect()}
    for r in best.collect():
        if (r.question_id, r.doc) in f:
            assert r.score >= f[(r.question_id, r.doc)] - 1e-12


def test_no_rerank_path_scores_one(spark, setup):
    from ragtide.plans.retrieve import retrieve_fuse

    passages, models, qs = setup
    out = retrieve_fuse(qs, passages, models, RagOptions(use_reranking=False, use_query_rewriting=False, top_k=3,
                                                         model_kind="gpt2"))
    got = out.collect()
    assert {r.score for r in got} == {1.0}
    assert max(r.ctx_rank for r in got) == 1 and len(got) == 40  # gpt2: one context document
    assert all(r.doc.startswith("Luật: ") for r in got)


def test_questions_are_worked_on_by_all_tasks(spark):
    """Hits are few bytes but costly to score: their partitioning is explicit, so that AQE leaves it."""
    from ragtide.operators.partitioning import task_count
    from ragtide.plans.retrieve import by_question

    hits = spark.range(50).selectExpr("id % 20 as question_id", "id as rank")
    assert by_question(hits).rdd.getNumPartitions() == task_count(spark) >= 8
    assert "REPARTITION_BY_NUM" in by_question(hits)._jdf.queryExecution().executedPlan().toString()


def test_shared_terms_score_as_all_terms(spark):
    """BM25 looks only at terms that the document has; the sum is that over all of the query's terms."""
    import math

    from ragtide.operators.rerank import bm25_score, bm25_stats

    texts = ["a b b c", "c d", "a a a e", "", None]
    stats = bm25_stats(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    assert (stats.n_docs, stats.avgdl) == (5.0, 10 / 4)
    df = {r.token: r.df for r in stats.vocab.collect()}
    assert df == {"a": 2, "b": 1, "c": 2, "d": 1, "e": 1}
    pairs = spark.createDataFrame([("a b x", "a b b c"), ("d", "a b b c"), ("e a", "a a a e")], "q string, doc string")
    for r in bm25_score(pairs, "q", "doc", stats).collect():
        toks = r.doc.split()
        want = 0.0
        for t in sorted(set(r.q.split()) & set(df)):
            tf, idf = float(toks.count(t)), math.log(1 + (5 - df[t] + 0.5) / (df[t] + 0.5))
            want += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks) / 2.5))
        assert abs(r.score - want) < 1e-12


def _plain_vector(text):
    import hashlib
    import re

    counts = [0.0] * 384
    for t in re.findall(r"[^\W_]+", (text or "").lower()):
        counts[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 384] += 1
    norm = sum(c * c for c in counts) ** 0.5
    return [c / norm if norm else 0.0 for c in counts]


def test_hashed_vectors_by_plain_counts(spark):
    from ragtide.operators.embed import embed

    texts = ["a b a Straße", None, "", "... --", "Điều 7: a, b", "a" * 70 + " a", "b a B"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    for r in embed(df, "t").collect():
        assert r.embedding == pytest.approx(_plain_vector(r.t), abs=1e-7), r.t


def test_vectors_are_encoded_once_and_not_written(spark, own_checkpoints):
    """Texts are written, vectors go from the encoder to the kNN in one scan, and nothing else computes them."""
    import glob

    import pyarrow.parquet as pq

    from ragtide.catalog import line_passages, questions
    from ragtide.operators.embed import embed
    from ragtide.operators.knn import knn_exact

    passages = line_passages(spark, SF_SMALL)
    for f in glob.glob(f"{own_checkpoints}/passages-*/*.parquet"):
        assert "embedding" not in pq.read_schema(f).names
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "hashed_unit_vectors" not in plan(passages.select("passage_id", "metadata"))
    qs = embed(questions(spark, SF_SMALL), "question", "query_vec").localCheckpoint()
    for few in (64 << 20, 0):  # queries are broadcast; queries and passages meet in a grid
        found = knn_exact(qs, passages, 3, qid="question_id", max_broadcast_bytes=few)
        assert plan(found).count("hashed_unit_vectors(") == 1


def test_vocabulary_is_the_sum_of_its_batches():
    import pyarrow as pa

    from ragtide.operators.rerank import _batch_frequencies

    batches = [pa.RecordBatch.from_arrays([pa.array(t, pa.list_(pa.string()))], ["t"])
               for t in ([["a", "b", "a"], None, ["a"]], [], [[], None], [["b"]])]
    got = [tuple(r.values()) for b in _batch_frequencies(iter(batches)) for r in b.to_pylist()]
    assert got == [("a", 2, 0, 0), ("b", 1, 0, 0), (None, 3, 2, 4), (None, 2, 1, 0), ("b", 1, 0, 0), (None, 1, 1, 1)]


def test_tokens_of_a_batch_are_those_of_the_expression(spark, monkeypatch):
    """Texts split by arrays give the expression's tokens: every code point, Java's letters, no token across texts."""
    import pyarrow as pa

    from ragtide.functions import words
    from ragtide.functions.text import tokens

    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["a b", "b", None, "", "ΟΔΟΣ. ΟΔΟΣ", "İstanbul ſ", "Điều 7:Straße_x", "...", "x", "三四 ５٣½ 𝒜𝔟 é", "ࡰ 一"]
    texts += [" a".join(every[i: i + 997]) for i in range(0, len(every), 997)] + ["".join(every[1::7]), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1)
    rows = df.select(F.lower("t").alias("low"), tokens("t").alias("toks")).collect()
    for size in (words.BLOCK_BYTES, 1):
        monkeypatch.setattr(words, "BLOCK_BYTES", size)
        for kind in (pa.string(), pa.large_string()):
            low = pa.array(["cut off"] + [r.low for r in rows], kind).slice(1)
            assert words.token_lists(low, words.token_runs()).to_pylist() == [r.toks for r in rows]
    assert words.token_lists(pa.array([], pa.string()), words.token_runs()).to_pylist() == []


def test_batches_are_lower_cased_as_the_session_does(spark, monkeypatch):
    """Texts go to Python as they are and are lower-cased there: every code point, also those whose lower case has other bytes.
    Only texts with a character that depends on its neighbours are lower-cased before."""
    import pyarrow as pa

    from ragtide.functions import words
    from ragtide.functions.text import tokens

    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["A B", None, "", "ΟΔΟΣ. ΟΔΟΣ", "İstanbul ſ", "Điều 7:Straße_X", "...", "ÉÈ", "三 𝒜𝔟 É 𐐀", "K Å ẞ Ⱥ ǅ", "B"]
    texts += [" A".join(every[i: i + 997]) for i in range(0, len(every), 997)] + ["".join(every[1::7]), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1)
    rows = df.select("t", words.shipped("t").alias("s"), tokens("t").alias("toks")).collect()
    by_text = {r.t: r.s for r in rows}
    assert by_text["Điều 7:Straße_X"] == "Điều 7:Straße_X" and by_text["ΟΔΟΣ. ΟΔΟΣ"] == "οδος. οδος"
    runs, low = words.token_runs(), words.lowers()
    for size in (words.BLOCK_BYTES, 1):
        monkeypatch.setattr(words, "BLOCK_BYTES", size)
        for kind in (pa.string(), pa.large_string()):
            got = pa.array(["Cut off"] + [r.s for r in rows], kind).slice(1)
            assert words.token_lists(got, runs, low).to_pylist() == [r.toks for r in rows]
    assert words.token_lists(pa.array([], pa.string()), runs, low).to_pylist() == []


def test_vocabulary_and_vectors_of_capitals(spark):
    """Counts and vectors do not depend on case, whichever side lower-cases."""
    from ragtide.operators.embed import embed
    from ragtide.operators.rerank import bm25_stats

    pairs = [("ÉTÉ Été été", "été été été"), ("ΟΔΟΣ Straße", "οδος straße"), ("İ K", "i\u0307 k"), (None, None)]
    both = [spark.createDataFrame([(i, p[side]) for i, p in enumerate(pairs)], "i int, t string") for side in (0, 1)]
    stats = [bm25_stats(d, "t") for d in both]
    vocab = [sorted(map(tuple, s.vocab.collect())) for s in stats]
    assert vocab[0] == vocab[1] and ("été", 1) in vocab[0] and ("οδος", 1) in vocab[0]
    assert [(s.n_docs, s.avgdl) for s in stats] == [(4.0, 7 / 3)] * 2
    vectors = [[r.embedding for r in embed(d, "t").orderBy("i").collect()] for d in both]
    assert vectors[0] == vectors[1]


def test_sums_leave_a_task_with_one_row_for_all_texts():
    """The numbers of texts and of tokens are not summed by token: they leave a task once, however often its store is full."""
    import pyarrow as pa

    from ragtide.operators import rerank

    lists = [[[f"t{b}-{i}"] for i in range(50)] + [None] for b in range(20)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.string()))], ["t"]) for x in lists]
    bound, rerank._SUMMED_BYTES = rerank._SUMMED_BYTES, 1000
    try:
        rows = [r for b in rerank._summed(rerank._batch_frequencies(iter(batches))) for r in b.to_pylist()]
    finally:
        rerank._SUMMED_BYTES = bound
    assert [r for r in rows if r["token"] is None] == [{"token": None, "df": 1020, "texts": 1000, "length": 1000}]
    assert sum(r["df"] for r in rows if r["token"]) == 1000


def test_lines_reach_python_as_texts(spark):
    """The vocabulary and the vectors of a table take texts to Python, not lists of tokens that an expression made."""
    from ragtide.operators.embed import embed
    from ragtide.operators.rerank import bm25_stats

    seen = []
    texts = spark.createDataFrame([("a b",), (None,)], "t string")
    frame = type(texts)
    real = frame.mapInArrow

    def watched(self, *a, **k):
        seen.append(self)
        return real(self, *a, **k)

    frame.mapInArrow = watched
    try:
        bm25_stats(texts, "t")
    finally:
        frame.mapInArrow = real
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in [*seen, embed(texts, "t")]]
    assert len(plans) == 2 and not any("regexp_extract_all" in p for p in plans)


def test_md5_by_arrays_is_that_of_hashlib():
    import hashlib

    import pyarrow as pa

    from ragtide.functions.digest import md5_heads

    words = ["w" * n for n in range(130)] + [f"điều{i}" for i in range(6000)] + ["𝒜", "ж" * 28]
    for col in (pa.array(words), pa.array(["x", *words]).slice(1), pa.array(words, pa.large_string())):
        assert md5_heads(col).tolist() == [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in words]
    assert len(md5_heads(pa.array([], pa.string()))) == 0


def test_frequencies_are_summed_within_a_task(monkeypatch):
    """A token of many batches leaves its task once, or once a full store; sums are those of all batches."""
    from collections import Counter

    import pyarrow as pa

    from ragtide.operators import rerank

    def summed():
        lists = [[f"t{i % 7}", "all"] for i in range(100)] + [None]
        batches = [pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], ["t"])] * 30
        rows, sums = 0, Counter()
        for b in rerank._summed(rerank._batch_frequencies(iter(batches))):
            for r in b.to_pylist():
                rows += 1
                sums += Counter({(r["token"], c): r[c] for c in ("df", "texts", "length")})
        return rows, sums

    rows, sums = summed()
    assert rows == 9 and sums["all", "df"] == 3000 and sums["t1", "df"] == 450
    assert [sums[None, c] for c in ("df", "texts", "length")] == [3030, 3000, 6000]
    monkeypatch.setattr(rerank, "_SUMMED_BYTES", 1000)
    assert summed()[1] == sums
    assert list(rerank._summed(iter([]))) == []


def test_lines_are_written_once_and_encoded_in_the_search(spark, own_checkpoints):
    """What is written holds a line once; its text is the template's, and no vector passes between processes."""
    import glob

    import pyarrow.parquet as pq

    from ragtide.catalog import articles, line_texts, questions
    from ragtide.operators.embed import embed, hashed_encoder
    from ragtide.operators.knn import knn_exact
    from ragtide.plans.index import passage_chunks
    from ragtide.plans.retrieve import _searched

    texts = line_texts(spark, SF_SMALL)
    for f in glob.glob(f"{own_checkpoints}/passages-*/*.parquet"):
        assert "passage_text" not in pq.read_schema(f).names
    told = passage_chunks(articles(spark, SF_SMALL), chunking="lines").select("passage_id", "passage_text")
    got = texts.select("passage_id", "passage_text")
    assert told.exceptAll(got).isEmpty() and got.exceptAll(told).isEmpty()

    qs = embed(questions(spark, SF_SMALL), "question", "query_vec").localCheckpoint()
    searched, encode = _searched(texts, hashed_encoder())
    with_column, none = _searched(embed(texts, "passage_text"), hashed_encoder())
    assert none is None
    find = lambda p, **k: sorted((r.question_id, r["rank"], r.passage_id, r.sim) for r in
                                 knn_exact(qs, p, 3, qid="question_id", **k).collect())
    want = find(with_column)
    assert len(want) == 120
    for few in (64 << 20, 0):
        assert find(searched, encode=encode, max_broadcast_bytes=few) == want
    plan = knn_exact(qs, searched, 3, qid="question_id", encode=encode)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
    plain = lambda c: hashed_encoder()(c)  # noqa: E731  an encoder that is a column function only
    by_column, none = _searched(texts, plain)
    assert none is None and "embedding" in by_column.columns
