"""Articles -> chunks -> passage text -> vectors -> passage table.

One lazy DataFrame plan: scan -> (hash spread) -> chunk UDF -> explode ->
projections -> encoder UDF. Nothing is collected; the result is written by
the store (``sources.store``) or persisted by the caller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.config import CHUNK_OVERLAP, CHUNK_SEPARATORS, CHUNK_SIZE
from ragtide.operators.chunk import chunk_articles, line_chunks
from ragtide.operators.embed import Encoder, embed
from ragtide.operators.format import format_rerank, scorer_input
from ragtide.operators.partitioning import default_parallelism, spread
from ragtide.operators.passages import content_key, pack_metadata, passage_text, with_keys
from ragtide.operators.rerank import Bm25Stats, bm25_stats

PASSAGE_COLUMNS = ["passage_id", "content_key", "doc_key", "metadata", "passage_text", "embedding"]


def chunk_table(articles: DataFrame, chunking: str = "recursive", size: int = CHUNK_SIZE,
                overlap: int = CHUNK_OVERLAP, separators: Sequence[str] = CHUNK_SEPARATORS, spread_first: bool = True) -> DataFrame:
    """P1/P2 (+P3, P4, S6): one row per chunk with keys, passage text and metadata."""
    if spread_first:
        articles = spread(articles, "doc_key")
    if chunking == "recursive":
        chunks = chunk_articles(articles, size, overlap, separators)
    elif chunking == "lines":
        chunks = line_chunks(articles)
    else:
        raise ValueError("chunking must be 'recursive' or 'lines'")
    return pack_metadata(with_keys(passage_text(chunks)))


def passage_chunks(articles: DataFrame, chunking: str = "recursive", rebalance: bool = True, **chunk_opts) -> DataFrame:
    """C1 up to the encoder: the passage table without its vectors.

    The chunker is sequential per document, so one very long document gives
    all its chunks in one task. With ``rebalance`` the chunks are re-hashed by
    content key before the encoder (the costly step with a real model), so a hot
    document's chunks spread over all tasks. Lines are split where they are scanned, so their texts are shuffled once.
    """
    chunks = chunk_table(articles, chunking, spread_first=chunking != "lines" or not rebalance, **chunk_opts).select(
        "passage_id", "content_key", "doc_key", "metadata", "passage_text")
    if rebalance:
        spark = articles.sparkSession
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), default_parallelism(spark))
        # An explicit count: AQE would coalesce a small-but-CPU-heavy input into a few tasks.
        # What the content key is made of: the key itself moves only where it is read.
        chunks = chunks.repartition(n, F.xxhash64("doc_key", "metadata"))
    return chunks


def stored_text(chunks: DataFrame) -> DataFrame:
    """P3 and S6 from the stored metadata: ``passage_text`` and ``content_key`` of chunks that were written without them."""
    parts = chunks.select("*", "metadata.*").withColumn("content_key", content_key())
    return passage_text(parts).select(*chunks.columns, "content_key", "passage_text")


def with_vectors(chunks: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """The passage table of ``passage_chunks``. Vectors are computed by each job that reads them, and by no other."""
    return embed(chunks, "passage_text", "embedding", encoder).select(*PASSAGE_COLUMNS)


def build_passages(articles: DataFrame, chunking: str = "recursive", encoder: Encoder | None = None,
                   rebalance: bool = True, **chunk_opts) -> DataFrame:
    """C1 without the sink: the passage table (id, keys, metadata, text, embedding)."""
    return with_vectors(passage_chunks(articles, chunking, rebalance, **chunk_opts), encoder)


def passage_stats(passages: DataFrame) -> Bm25Stats:
    """BM25 corpus statistics over the scorer input of every stored passage."""
    return bm25_stats(passages.select(scorer_input(format_rerank()).alias("t")), "t")


__all__ = ["build_passages", "chunk_table", "passage_chunks", "passage_stats", "stored_text", "with_vectors", "PASSAGE_COLUMNS"]
