"""Corpus file stream -> passage store (incremental, idempotent).

New ``*.json`` corpus files are read whole (one row per file), parsed (S1),
chunked, embedded (C1) and loaded into the store (S10): a version per
micro-batch, statistics included. A replayed epoch finds its articles stored in the
same form and changes nothing. Rejected files are recorded per epoch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ragtide.operators.embed import Encoder
from ragtide.plans.index import build_passages
from ragtide.sources import store
from ragtide.sources.corpus import parse_corpus_texts


def start_index_stream(spark: SparkSession, source_dir: str, store_name: str, checkpoint: str,
                       rejects_dir: str | None = None, chunking: str = "recursive", encoder: Encoder | None = None,
                       available_now: bool = True, max_files_per_trigger: int | None = None,
                       every: str = "30 seconds") -> StreamingQuery:
    store.open_store(spark, store_name)
    reader = spark.readStream.option("pathGlobFilter", "*.json")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.text(source_dir, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("raw"))

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        batch = batch.persist()
        try:
            articles, rejects = parse_corpus_texts(batch)
            store.index_incremental(spark, build_passages(articles, chunking, encoder), store_name, documents=articles)
            if rejects_dir:
                rejects.write.mode("overwrite").parquet(f"{rejects_dir}/epoch={epoch_id}")
        finally:
            batch.unpersist()

    writer = raw.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()
