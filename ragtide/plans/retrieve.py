"""C2 retrieve-rerank-fuse and C4 retrieval-mode comparison, for a table of questions.

Flow (per question, all questions at once):
O1 expand (+U3) -> U1 embed queries -> J1 kNN depth 10 -> J3 pair with query
text -> J6 late metadata fetch -> P8 filter -> P7/P6 format -> U2 score
(P9 input) -> O4 rerank cut / O8 prefix -> O3 dedupe -> O5 fused order ->
O6 document limit.

Exchanges: the query matrix is broadcast into the passage scan (size
checked in ``knn_exact``); the hits (queries x depth rows of four numbers, so
a row bound is a byte bound) are broadcast into the late metadata fetch so the
passage table is never shuffled. Texts join afterwards, without a forced
broadcast; the rest is keyed by question. With many questions all of this is
done for one group of them after the other (``fused_by_group``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragtide.config import MAX_REWRITES, RagOptions
from ragtide.functions.text import rank_key
from ragtide.operators.answer import route_config
from ragtide.operators.embed import Encoder, embed, hashed_encoder
from ragtide.operators.format import drop_missing_metadata, format_plain, format_rerank, scorer_input
from ragtide.operators.fuse import fuse
from ragtide.operators.knn import knn_exact
from ragtide.operators.numbering import numbered
from ragtide.operators.partitioning import broadcast_if, materialise, materialise_parts, task_count
from ragtide.operators.rerank import Scorer, norerank_prefix, rerank_topk
from ragtide.operators.rewrite import Rewriter, expand_queries

# Hits are broadcast into the metadata fetch up to this many rows (of 32 bytes).
MAX_BROADCAST_HITS = 2_000_000
#: Queries that meet the passages at once. Questions with more are retrieved in groups, one after the other: a group's vectors are
#: held by each task of the passages' scan, and what lies between two steps is a group's, so no more disk is needed for more questions.
SEARCHED_AT_ONCE = 1 << 15
#: Vectors of a group (as doubles) up to which it is held by the scan; longer ones meet the passages in a grid.
GROUP_VECTOR_BYTES = 512 << 20
#: Questions whose queries are counted together to cut the groups.
_COUNTED_TOGETHER = 256


@dataclass
class Models:
    """Pluggable models; ``None`` selects the model-free default."""

    scorer: Scorer
    encoder: Encoder | None = None
    rewriter: Rewriter | None = None


def with_settings(questions: DataFrame, options: RagOptions, route: str | None = "route") -> DataFrame:
    """Attach ``top_k``, ``doc_limit``, ``model_kind`` per question: from the
    route configuration (J5) when a route column exists, else from options."""
    if route and route in questions.columns:
        cfg = F.broadcast(route_config(questions.sparkSession))
        # A question with an unknown route has no settings to be answered with.
        return questions.join(cfg, questions[route] == cfg["route"]).drop(cfg["route"])
    return questions.withColumns({
        "model_kind": F.lit(options.model_kind),
        "top_k": F.lit(options.top_k),
        "doc_limit": F.lit(options.resolved_doc_limit()),
    })


def query_table(questions: DataFrame, options: RagOptions, models: Models) -> DataFrame:
    """O1: (question_id, query_ord, query_text, query_key) with rewrites.

    Written once: a rewriter may be costly, or sample, and the vectors searched,
    the texts scored and the number of queries must come from the same rewrites. Questions are numbered, so
    that any question_id gives a key that fits."""
    asked = numbered(questions.select("question_id", "question"), ["question_id"], "_number")
    asked = asked.repartition(task_count(questions.sparkSession), "_number")  # rewritten and encoded on all tasks
    q = expand_queries(asked, models.rewriter, options.use_query_rewriting, keep=["_number"])
    key = F.col("_number") * F.lit(1 + MAX_REWRITES) + F.col("query_ord")
    return materialise(q.withColumn("query_key", key).drop("_number"), "queries")


def prepared(scorer: Scorer, queries: DataFrame, query_col: str, keys: list[str]) -> DataFrame:
    """``queries`` with what the scorer looks up once per query, if it does so."""
    return scorer.prepare(queries, query_col, keys) if hasattr(scorer, "prepare") else queries


def _searched(passages: DataFrame, encoder: Encoder):
    """(passage_id, embedding) and, if that is what vectors are still to be made from, the function that does so."""
    if "embedding" in passages.columns:
        return passages, None
    texts = passages.select("passage_id", "passage_text")
    if hasattr(encoder, "arrays"):
        return texts.select("passage_id", encoder.shipped(F.col("passage_text")).alias("embedding")), encoder.arrays()
    return embed(texts, "passage_text", "embedding", encoder), None


def _nearest(queries: DataFrame, passages: DataFrame, depth: int, encoder: Encoder | None, **limits: int) -> DataFrame:
    """U1 + J1: query_key, passage_id, rank, sim."""
    qv = embed(queries.select("query_key", "query_text"), "query_text", "query_vec", encoder)
    qv = materialise(qv, "query-vectors")  # counted, then searched
    searched, encode = _searched(passages, encoder or hashed_encoder())
    hits = knn_exact(qv, searched, depth, qid="query_key", qvec="query_vec", pid="passage_id", pvec="embedding", encode=encode, **limits)
    return hits.select("query_key", "passage_id", "rank", "sim")


def _fetched(hits: DataFrame, passages: DataFrame, n_hits: int) -> DataFrame:
    """J6 late fetch: hits (at most ``n_hits`` rows) go to the passage scan, not the reverse."""
    return drop_missing_metadata(broadcast_if(hits, n_hits, MAX_BROADCAST_HITS).join(
        passages.select("passage_id", "metadata"), "passage_id"))


def _query_texts(queries: DataFrame, scorer: Scorer | None) -> DataFrame:
    texts = queries.select("query_key", "question_id", "query_ord", "query_text")
    return texts if scorer is None else prepared(scorer, texts, "query_text", ["query_key"])


def retrieve_hits(queries: DataFrame, passages: DataFrame, depth: int, encoder: Encoder | None,
                  n_queries: int | None = None, scorer: Scorer | None = None) -> DataFrame:
    """U1 + J1 + J3 + J6: hits with query text and metadata, and what ``scorer`` prepares per query.

    Passages without ``embedding`` get it from their ``passage_text``, by the same encoder.
    Output: question_id, query_ord, query_text, rank, passage_id, sim, metadata.
    """
    hits = _nearest(queries, passages, depth, encoder)
    n = n_queries if n_queries is not None else queries.count()
    # One row per query joined to its hits.
    return _fetched(hits, passages, n * depth).join(_query_texts(queries, scorer), "query_key").drop("query_key")


def by_question(hits: DataFrame) -> DataFrame:
    """One partitioning for all that is keyed by question, on as many tasks as there are: scoring a hit costs more than its bytes say."""
    return hits.repartition(task_count(hits.sparkSession), "question_id")


def score_hits(hits: DataFrame, models: Models, query_col: str = "query_text") -> DataFrame:
    """P7 + P9 + U2: formatted rerank text (unless ``hits`` have it as ``doc``) and its score."""
    shown = hits if "doc" in hits.columns else hits.withColumn("doc", format_rerank()).drop("metadata")
    pairs = shown.withColumn("scorer_in", scorer_input("doc"))
    keys = ["question_id", "query_ord", "rank"]
    return models.scorer(pairs, query_col, "scorer_in", keys).drop("scorer_in")


def retrieve_fuse(questions: DataFrame, passages: DataFrame, models: Models,
                  options: RagOptions = RagOptions()) -> DataFrame:
    """Per question the fused, deduplicated, limited context documents.

    ``questions``: question_id BIGINT, question STRING [, route STRING].
    Output: question_id, ctx_rank, query_ord, rerank_pos, passage_id, score, doc
    (+ question, model_kind, top_k, doc_limit).
    """
    return fused_by_group(questions, passages, models, options, lambda docs: docs, ["question", "model_kind"])


def fused_by_group(questions: DataFrame, passages: DataFrame, models: Models, options: RagOptions,
                   finish: Callable[[DataFrame], DataFrame], keep: list[str]) -> DataFrame:
    """``finish`` of C2's documents, which have the settings ``keep`` of their question too.

    With more than ``SEARCHED_AT_ONCE`` queries, ``finish`` gets the documents of a group of questions at a time, all of a question's
    at once, and its results are written."""
    qs = with_settings(questions, options)
    queries = query_table(qs, options, models)
    n_queries = queries.count()
    settings = qs.select("question_id", *keep, "top_k", "doc_limit")
    if n_queries <= SEARCHED_AT_ONCE:
        hits = retrieve_hits(queries, passages, options.depth, models.encoder, n_queries,
                             models.scorer if options.use_reranking else None)
        return finish(_fused(hits.join(settings, "question_id"), models, options, keep))
    settings = materialise(settings, "settings")
    parts = [lambda g=g: finish(_fused(_group_hits(queries.where(F.col("query_key").between(*g)), settings, passages, models, options),
                                       models, options, keep)) for g in _groups(queries)]
    return materialise_parts(queries.sparkSession, parts, "fused")


def _groups(queries: DataFrame) -> list[tuple[int, int]]:
    """First and last query_key of groups of about ``SEARCHED_AT_ONCE`` queries or less, which hold all queries of their questions."""
    span = _COUNTED_TOGETHER * (1 + MAX_REWRITES)
    counts = queries.groupBy(F.floor(F.col("query_key") / span).alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()
    groups: list[list[int]] = []
    for at, n in sorted((r["at"], r["n"]) for r in counts):
        if groups and groups[-1][2] + n <= SEARCHED_AT_ONCE:
            groups[-1][1:] = [(at + 1) * span - 1, groups[-1][2] + n]
        else:
            groups.append([at * span, (at + 1) * span - 1, n])
    return [(first, last) for first, last, _ in groups]


def _group_hits(queries: DataFrame, settings: DataFrame, passages: DataFrame, models: Models, options: RagOptions) -> DataFrame:
    """The hits of a group's queries, as ``doc``, with their question's settings. Ids of hits, and queries with what the scorer prepares, are
    written, so that what it took to find them is gone when texts are fetched; texts are cut to what is shown before they move."""
    scorer, shown = (models.scorer, format_rerank()) if options.use_reranking else (None, format_plain())
    depth = options.depth
    hits = materialise(_nearest(queries, passages, depth, models.encoder, max_broadcast_bytes=GROUP_VECTOR_BYTES,
                                most_held=depth * SEARCHED_AT_ONCE), "hits")
    texts = materialise(_query_texts(queries, scorer).join(settings, "question_id"), "query-texts")
    docs = _fetched(hits, passages, depth * SEARCHED_AT_ONCE).withColumn("doc", shown).drop("metadata")
    return docs.join(texts, "query_key").drop("query_key")


def _fused(hits: DataFrame, models: Models, options: RagOptions, keep: list[str]) -> DataFrame:
    """C2 from hits with ``metadata`` or ``doc`` and their question's settings."""
    hits = by_question(hits)
    if options.use_reranking:
        ranked = rerank_topk(score_hits(hits, models), F.col("top_k"), ["question_id", "query_ord"])
    else:
        docs = hits if "doc" in hits.columns else hits.withColumn("doc", format_plain()).drop("metadata")
        ranked = norerank_prefix(docs, F.col("top_k"))
    fused = fuse(ranked, F.col("doc_limit"), keep=options.dedupe_keep)
    return fused.select("question_id", "ctx_rank", "query_ord", "rerank_pos", "passage_id", "score", "doc", *keep, "top_k", "doc_limit")


def _pooled_cut(scored: DataFrame, k: int) -> DataFrame:
    # Stable sort of the pool: ties keep arrival order (rewrite order, then hit rank).
    w = Window.partitionBy("question_id").orderBy(rank_key("score").desc(), F.col("query_ord").asc(),
                                                  F.col("rank").asc())
    return scored.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)


def _pooled_from_hits(hits: DataFrame, questions: DataFrame, models: Models, k: int) -> DataFrame:
    asked = prepared(models.scorer, questions.select("question_id", "question"), "question", ["question_id"])
    hits = by_question(hits.join(asked, "question_id"))
    return _pooled_cut(score_hits(hits, models, query_col="question"), k)


def compare_modes(questions: DataFrame, passages: DataFrame, models: Models, k: int = 5) -> DataFrame:
    """C4: plain top-``k`` retrieval vs rewrite + pooled rerank, side by side.

    One kNN pass serves both modes: the original question (query_ord 0) gives
    the plain list, its rewrites the pool. Output: question_id, method, pos,
    passage_id, score, doc, and the question's ``rewrites`` in order.
    """
    queries = query_table(questions, RagOptions(use_query_rewriting=True), models)
    n_queries = queries.count()
    hits = materialise(retrieve_hits(queries, passages, k, models.encoder, n_queries), "hits")  # read by both modes
    plain = hits.filter(F.col("query_ord") == 0).select(
        "question_id", F.lit("plain").alias("method"), F.col("rank").alias("pos"), "passage_id",
        F.col("sim").alias("score"), format_plain().alias("doc"))
    pooled = _pooled_from_hits(hits.filter(F.col("query_ord") > 0), questions, models, k).select(
        "question_id", F.lit("rewrite_rerank").alias("method"), "pos", "passage_id", "score", "doc")
    # a question has at most MAX_REWRITES of them
    said = F.array_sort(F.collect_list(F.when(F.col("query_ord") > 0, F.struct("query_ord", "query_text"))))
    rewrites = queries.groupBy("question_id").agg(F.transform(said, lambda s: s["query_text"]).alias("rewrites"))
    return plain.unionByName(pooled).join(rewrites, "question_id")
