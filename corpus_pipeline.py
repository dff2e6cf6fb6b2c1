"""Corpus pipeline: from documents to sampled token ids, in five stages.

Each stage works on all documents that the stage before it kept and is written
as a table before the next one reads it. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragtide.llm import mixing, pieces, simhash, suffix, toxicity
from ragtide.llm.common import first_numbers, table, written

#: Rows of 20 bytes that are broadcast to the encoder; beyond that they are joined by shuffle.
MOST_LATER = 1_000_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, learned from ``labels``, does not reject.

    Null and empty texts are scored like others; repeated rows are judged alike; an empty table gives no rows; columns beyond
    those of documents are left out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs, model, COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: the smallest by doc_id (null last), then by the hash of the whole row.

    Rows are chosen, not ids: rows with a null doc_id or with one doc_id and unrelated texts are in different
    components, which each keep one.
    """
    # Hashes skip nulls, so which columns are null is hashed too. Equal rows share a key, and one of them is left.
    whole = [*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]]
    keyed = docs.select(*COLUMNS, F.xxhash64(*whole).alias("_k1"), F.xxhash64(F.lit(1), *whole).alias("_k2"))
    fps = written(simhash.fingerprints(keyed, ["doc_id", "_k1", "_k2"], shingle=4), "pipeline-fp")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_k1", "_k2")
    least = fps.groupBy("fp").agg(F.min(order).alias("least"))  # copies meet here, counted per task first
    first = (least.join(simhash.roots(fps, bits=4), "fp").groupBy("root").agg(F.min("least").alias("least"))
             .select("least._k1", "least._k2"))
    return keyed.join(first, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that 50-byte strings of earlier documents cover; those with nothing left go.

    A document that loses nothing stays, even if its text is null or empty."""
    removed = suffix.removed_spans(docs.select(*COLUMNS), length=50)
    removed = removed.withColumn("_cut", F.coalesce(F.size("spans") > 0, F.lit(False)))
    kept = suffix.kept_text(removed, [*COLUMNS, "_cut"])
    return kept.where(~F.col("_cut") | (F.length(F.trim("text")) > 0)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as its source's target asks for.

    A null source is a source; a null or empty text takes no words and comes at most once; equal rows share their copies out; an empty
    table gives no rows."""
    out = mixing.mix(docs, COLUMNS).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document, which decode to its text.

    The copies of a document get a segmentation each: the key of a row is its whole content and its number among equal rows. A null text
    has no pieces; an empty table gives no rows."""
    whole = [*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]]
    keyed = docs.select("doc_id", "source", "text", F.xxhash64(*whole).alias("_key"), F.spark_partition_id().alias("_from"))
    # The encoder numbers equal rows within its partition. Only rows whose equals lie in several partitions (copies across a
    # border) need to know how many came before; these are few, and the texts stay where they are.
    later = written(first_numbers(keyed.select("_key", "_from"), ["_key"], "_from").where("first > 0"), "pipeline-copies")
    later = F.broadcast(later) if later.count() <= MOST_LATER else later
    keyed = keyed.join(later, ["_key", "_from"], "left")
    return pieces.encode(keyed, ["doc_id", "source"], F.col("_key"), first=F.coalesce("first", F.lit(0)))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_passages),
    ("source_mixing", mix_sources),
    ("sentencepiece_sampling", encode_pieces),
]

#: Learned scores, hashes and sampled segmentations have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; each stage's table is written to the shared folder."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
