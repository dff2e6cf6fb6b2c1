"""Driver contract: entry() runs; registered queries equal their DuckDB twins (sf0.001)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tools.check_oracle import TABLES, rows_of

CHECKED = ["knn_exact", "knn_filtered", "passage_text", "content_key", "anti_append", "hashed_embed",
           "format_rerank", "parse_rewrites", "route_requests", "retrieve_fuse", "extract_answer", "bleu_pairs",
           "rouge_n", "rouge_l", "context_concat", "session_context", "compare_modes", "metrics_by_model"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_twin_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["question_id", "ctx_rank", "query_ord", "rerank_pos", "passage_id", "score", "doc"]
    assert max(r.ctx_rank for r in rows) <= 4


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_twin(spark, con, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = con.execute(E.oracle_sql()[name]).fetchdf()
    gc, gr = rows_of(got)
    wc, wr = rows_of(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr
