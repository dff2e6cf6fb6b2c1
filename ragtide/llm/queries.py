"""One registered query per operator, over whole tables, and the pipeline's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragtide.llm import ann, codes, decontaminate, html, langid, mixing, periods, pieces, quality, quotes, simhash, suffix, toxicity
from ragtide.llm.common import fold, table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page after site template removal."""
    return html.extract(table(spark, sf_dir, "pages"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every document (4-word shingles) and its component over links of at most 4 bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), bits=4, shingle=4)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that remain when 50-byte strings of smaller doc_ids are removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.digest(suffix.removed_spans(docs, length=50))


def op4_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reproducible sampled segmentation of every document, and whether it decodes to the text."""
    docs = table(spark, sf_dir, "documents")
    return pieces.encode(docs, ["doc_id"], F.xxhash64("doc_id"))


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without quotes, linked to the message it answers, in reply order."""
    return quotes.link(table(spark, sf_dir, "conversations"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of documents in fold 0 of 5 are never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    model = toxicity.train(docs, labels.select("doc_id", "toxic"))
    out = toxicity.score(docs, model, ["doc_id"])
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document that bring each source to its share of all words."""
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), ["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of risk-controlled rules for every document."""
    out = quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"),
                                table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept")


def op9_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every query vector, through learned partitions."""
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id % 20 = 0", top=20)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; documents in fold 2 of 4 are never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(fold("doc_id", 4) != 2))
    out = langid.predict(docs, model, ["doc_id"])
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that 10-word windows of the benchmark cover, and the items they come from."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    return decontaminate.digest(found)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors over integer codebooks, their errors, and the codebooks' hash."""
    out, books = codes.compress(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, with the repetition that the contract plants."""
    docs = periods.planted(table(spark, sf_dir, "documents"))
    return periods.digest(periods.find_runs(docs, ["doc_id"]), ["doc_id"])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ``corpus_pipeline`` over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_html_extraction, op2_simhash_near_dedup, op3_suffix_array_dedup, op4_sentencepiece_sampling, op5_quotation_linking,
    op6_toxicity, op7_source_mixing, op8_quality_rules, op9_learned_partitions, op10_language_id,
    op11_benchmark_decontamination, op12_vector_codes, op13_periodic_runs, pipeline)}

#: DuckDB SQL where SQL can express the result. Bytes are pairs of hexadecimal digits.
ORACLE_SQL = {
    "op3_suffix_array_dedup": """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), p AS (
  SELECT doc_id, h, octet_length(unhex(h)) AS n_bytes FROM d
), s AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w
  FROM (SELECT doc_id, h, unnest(range(greatest(n_bytes - 49, 0))) AS i FROM p)
), f AS (
  SELECT w, min(doc_id) AS least FROM s GROUP BY w
), gone AS (
  SELECT s.doc_id, s.i FROM s JOIN f USING (w) WHERE f.least < s.doc_id
), r AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone
), g AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END)
         OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r
), spans AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY doc_id, run
), keep AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM spans
  UNION ALL
  SELECT doc_id, max(z) AS a, NULL AS z FROM spans GROUP BY doc_id
), kept AS (
  SELECT k.doc_id, string_agg(substr(p.h, CAST(2 * k.a + 1 AS BIGINT),
         CAST(2 * (coalesce(k.z, p.n_bytes) - k.a) AS BIGINT)), '' ORDER BY k.a) AS h
  FROM keep k JOIN p USING (doc_id) GROUP BY k.doc_id
), total AS (
  SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT p.doc_id, CAST(p.n_bytes AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, p.h))) AS kept_sha256
FROM p LEFT JOIN total USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op11_benchmark_decontamination": decontaminate.sql(n=10),
    "op12_vector_codes": codes.sql(),
}
