"""Corpus files -> articles table, write/read of the merged corpus.

An article has ``law, article, title, content`` (article numbers may be int
or string in the files; they are read as STRING) plus a ``doc_key``: for an
article of a file its full name, file and place, which the store maps to a number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragtide.sources.json_arrays import array_elements

ARTICLE_SCHEMA = "doc_key string, law string, article string, title string, content string"

# JSON keys of an article object in the corpus files.
FILE_KEYS = {"law": "luật", "article": "điều", "title": "tên_điều", "content": "nội_dung"}


def read_corpus_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Merge every ``*.json`` file (a JSON array of article objects) in ``folder``.

    A file that is not valid JSON, or whose root is not an array, contributes
    nothing and appears in the reject table ``(path, reason)``; so does an
    array element that is not an object. A file is read in ranges by as many tasks as it has splits
    (``json_arrays``).
    """
    elems, bad_files = array_elements(spark, folder)
    return _articles(elems, bad_files)


def parse_corpus_texts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, raw file text) rows -> (articles, rejects), for files that are at hand as texts."""
    # The root is split into its elements' JSON texts first: a variant is limited to 128 MiB, an element is far
    # smaller than a file.
    is_array = F.ltrim(F.col("raw"), F.lit(" \t\r\n\ufeff")).startswith("[")
    parsed = raw.select("path", is_array.alias("is_array"), F.when(is_array, F.from_json("raw", "array<string>")).alias("es"),
                        F.when(~is_array, F.expr("try_parse_json(raw)").isNotNull()).alias("valid"))
    bad_files = parsed.filter(F.col("es").isNull()).select(
        "path", F.when(F.col("valid"), F.lit("root is not an array")).otherwise(F.lit("malformed json")).alias("reason"))
    elems = parsed.filter(F.col("es").isNotNull()).select("path", F.posexplode("es").alias("pos", "text"))
    return _articles(elems, bad_files)


def _articles(elems: DataFrame, bad_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, pos, text of an element) and rejected files -> (articles, rejects)."""
    elems = elems.select("path", "pos", F.expr("try_parse_json(text)").alias("e"))
    elems = elems.withColumn("is_obj", F.coalesce(F.expr("schema_of_variant(e)").startswith("OBJECT"), F.lit(False)))
    bad_elems = elems.filter(~F.col("is_obj")).select(
        "path", F.concat(F.lit("element "), F.col("pos").cast("string"), F.lit(" is not an object")).alias("reason"))

    def field(name: str):
        return F.expr(f"try_variant_get(e, '$.{FILE_KEYS[name]}', 'string')")

    key = F.concat_ws("#", "path", "pos")
    articles = elems.filter("is_obj").select(
        key.alias("doc_key"), field("law").alias("law"), field("article").alias("article"),
        field("title").alias("title"), field("content").alias("content"))
    return articles, bad_files.unionByName(bad_elems)


def write_corpus(articles: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write the merged corpus, overwriting (partitioned output, not one file)."""
    articles.write.mode("overwrite").format(fmt).save(path)


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S3: read a merged corpus with the declared schema; Parquet files keep the type that their keys have."""
    reader = spark.read.format(fmt)
    return (reader if fmt == "parquet" else reader.schema(ARTICLE_SCHEMA)).load(path)


def articles_from_documents(documents: DataFrame) -> DataFrame:
    """Testdata mapping: law := source, article := doc_id, title := lang, content := text."""
    return documents.select(
        F.col("doc_id").alias("doc_key"),
        F.col("source").alias("law"),
        F.col("doc_id").cast("string").alias("article"),
        F.col("lang").alias("title"),
        F.col("text").alias("content"),
    )
