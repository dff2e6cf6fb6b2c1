"""P1 + P2: chunk articles and flatten chunks with index and total.

The recursive chunker is sequential within a document, so it runs as an
Arrow-batched UDF (one Python call per batch, the per-document rule from
``functions.chunker``); documents are independent, so the work is spread
by a hash of the document key and needs no shuffle otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtide.config import CHUNK_OVERLAP, CHUNK_SEPARATORS, CHUNK_SIZE
from ragtide.functions.chunker import split_text


def chunk_udf(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: Sequence[str] = CHUNK_SEPARATORS):
    seps = tuple(separators)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def chunk_texts(texts: pa.Array) -> pa.Array:
        return pa.array([split_text(t, size, overlap, seps) for t in texts.to_pylist()],
                        type=pa.list_(pa.string()))

    return chunk_texts


def flatten_chunks(df: DataFrame, chunks_col: str = "chunks") -> DataFrame:
    """One row per chunk with 0-based ``chunk_index`` and ``total_chunks``.

    An article with no chunks (empty content) disappears. Written as an outer
    explode plus a filter on its output: an inner explode makes Catalyst infer
    ``size(chunks) > 0`` and push it below the spread exchange, which would run
    the chunk UDF twice (once in the unspread scan task).
    """
    return df.select(
        "*", F.size(chunks_col).alias("total_chunks"),
        F.posexplode_outer(chunks_col).alias("chunk_index", "chunk_content"),
    ).filter(F.col("chunk_content").isNotNull()).drop(chunks_col)


def chunk_articles(
    articles: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: Sequence[str] = CHUNK_SEPARATORS,
    content_col: str = "content",
) -> DataFrame:
    """P1 + P2 over an articles table."""
    udf = chunk_udf(size, overlap, separators)
    with_chunks = articles.withColumn("chunks", udf(F.col(content_col))).drop(content_col)
    return flatten_chunks(with_chunks)


def line_chunks(articles: DataFrame, content_col: str = "content") -> DataFrame:
    """SQL-expressible chunking: one chunk per line of the content (used where
    a DuckDB twin must follow every step)."""
    return flatten_chunks(articles.withColumn("chunks", F.split(F.col(content_col), "\n")).drop(content_col))


@F.udtf(returnType="chunk_index int, total_chunks int, chunk_content string", useArrow=True)
class ChunkText:
    """P1 + P2 for SQL users: ``SELECT ... FROM t, LATERAL chunk_text(content, 1000, 100)``."""

    def eval(self, text, size, overlap):
        chunks = split_text(text, int(size), int(overlap))
        for i, c in enumerate(chunks):
            yield i, len(chunks), c


def register_sql_functions(spark) -> None:
    """Register ``chunk_text`` (UDTF) for SQL."""
    spark.udtf.register("chunk_text", ChunkText)
