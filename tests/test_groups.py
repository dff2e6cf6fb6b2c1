"""Many questions are retrieved and answered in groups, and what lies between two steps does not stay."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def served(spark):
    from ragtide.catalog import line_texts, models_for

    passages = line_texts(spark, SF_SMALL)
    return passages, models_for(passages)


def rows(df):
    return sorted(map(repr, df.collect()))


def in_groups(m, queries, together=2):
    from ragtide.operators import knn
    from ragtide.plans import retrieve

    m.setattr(retrieve, "SEARCHED_AT_ONCE", queries)
    m.setattr(retrieve, "_COUNTED_TOGETHER", together)
    m.setattr(knn, "_meet", lambda *a: pytest.fail("queries and passages were copied into a grid"))


@pytest.mark.parametrize("reranking", [True, False])
def test_groups_fuse_what_all_at_once_do(spark, served, monkeypatch, reranking):
    from ragtide.catalog import routed_questions
    from ragtide.config import RagOptions
    from ragtide.plans import retrieve

    some = routed_questions(spark, SF_SMALL).limit(30)
    odd = some.limit(1).withColumns({"question": F.lit(None).cast("string"), "question_id": F.lit(1 << 50)})
    odd = odd.unionByName(some.limit(1).withColumn("question_id", F.lit(None).cast("bigint")))
    questions = some.unionByName(some.limit(2)).unionByName(odd).localCheckpoint()
    options = RagOptions(use_reranking=reranking)
    want = rows(retrieve.retrieve_fuse(questions, *served, options))
    with monkeypatch.context() as m:
        in_groups(m, 16)
        assert len(retrieve._groups(retrieve.query_table(questions, options, served[1]))) > 5
        assert rows(retrieve.retrieve_fuse(questions, *served, options)) == want


def answered_in_groups(spark, answer, served, monkeypatch, folder):
    """What tables are left when requests are answered in groups; their answers are those of all at once."""
    from ragtide.catalog import requests
    from ragtide.sources import paths

    asked = requests(spark, SF_SMALL).limit(40).localCheckpoint()
    want = rows(answer(asked, *served))
    before = set(paths.names(spark, folder))
    with monkeypatch.context() as m:
        in_groups(m, 40)
        assert rows(answer(asked, *served)) == want
    return sorted(name.rpartition("-")[0] for name in set(paths.names(spark, folder)) - before)


def test_sessions_in_groups_are_answered_as_all_at_once(spark, served, monkeypatch, own_checkpoints):
    from ragtide.plans.answer import answer_sessions

    left = answered_in_groups(spark, answer_sessions, served, monkeypatch, own_checkpoints)
    assert left == ["fused", "queries", "routed", "settings"]  # not the groups' vectors, hits and texts


def test_requests_in_groups_are_answered_as_all_at_once(spark, served, monkeypatch, own_checkpoints):
    from ragtide.plans.answer import answer_requests

    left = answered_in_groups(spark, answer_requests, served, monkeypatch, own_checkpoints)
    assert left == ["fused", "queries", "routed", "settings"]  # requests are numbered and routed once


def test_groups_hold_all_queries_of_a_question(spark):
    from ragtide.plans import retrieve

    queries = spark.range(4 * 5000).withColumnRenamed("id", "query_key").where("query_key % 4 = 0 or query_key < 9000")
    groups = retrieve._groups(queries)
    assert groups == [(0, 4 * retrieve._COUNTED_TOGETHER * 20 - 1)]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(retrieve, "SEARCHED_AT_ONCE", 3000)
        groups = retrieve._groups(queries)
    assert all(a % 4 == 0 and z % 4 == 3 for a, z in groups) and groups[0][0] == 0 and groups[-1][1] >= 4 * 4999
    assert all(z + 1 == a for (_, z), (a, _) in zip(groups, groups[1:])) and len(groups) > 3
    sizes = [queries.where(F.col("query_key").between(*g)).count() for g in groups]
    assert max(sizes) <= 3000 and sum(sizes) == queries.count()


def test_a_written_table_leaves_no_shuffle(spark):
    from ragtide.operators.partitioning import _CLEANUP, materialise

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        found = manager.getAllFiles().iterator()
        names = set()
        while found.hasNext():
            names.add(found.next().getName())
        return {n for n in names if n.startswith("shuffle_")}

    df = spark.range(10_000).repartition(7, "id").groupBy((F.col("id") % 100).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    before, setting = shuffled(), spark.conf.get(_CLEANUP, None)
    out = materialise(df, "counted")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and spark.conf.get(_CLEANUP, None) == setting
    assert out.count() == df.count() == 100


def test_vectors_are_packed_as_they_are(spark):
    from ragtide.operators.knn import _packed, _unpacked

    for kind in ("float", "double"):
        data = [(i, [float(i), 0.1, 0.0] if i % 3 else []) for i in range(20)]
        q = spark.createDataFrame(data, f"query_id bigint, _qv array<{kind}>").repartition(5)
        ids, mat = _unpacked(_packed(q, "query_id"))
        want = {i: v or [0.0] * 3 for i, v in data}
        assert {int(i): v.tolist() for i, v in zip(ids, mat)} == {
            i: np.array(v, np.float32 if kind == "float" else np.float64).astype(mat.dtype).tolist() for i, v in want.items()}
    odd = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "query_id bigint, _qv array<float>").repartition(1)
    with pytest.raises(Exception, match="different lengths"):
        _packed(odd, "query_id")


def test_lines_are_shuffled_once_without_what_is_made_of_them(spark, own_checkpoints):
    import glob

    import pyarrow.parquet as pq

    from ragtide.catalog import articles, line_texts
    from ragtide.plans.index import passage_chunks

    chunks = passage_chunks(articles(spark, SF_SMALL), chunking="lines")
    bare = chunks.drop("passage_text", "content_key")
    plan = bare._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "sha2" not in plan
    texts = line_texts(spark, SF_SMALL)
    for f in glob.glob(f"{own_checkpoints}/passages-*/*.parquet"):
        assert "content_key" not in pq.read_schema(f).names
    keys = ["passage_id", "doc_key", "content_key", "metadata", "passage_text"]
    assert chunks.select(keys).exceptAll(texts.select(keys)).isEmpty() and texts.select(keys).exceptAll(chunks.select(keys)).isEmpty()
