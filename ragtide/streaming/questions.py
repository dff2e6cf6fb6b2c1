"""Question stream -> answers (Structured Streaming).

Requests ``(request_id, choice, question)`` arrive as files. Each micro-batch
is routed (P14 + J5) and the accepted questions go through the batch answer
job (C3) against the passage store. Output is exactly-once: every epoch
overwrites its own ``epoch=<id>`` folder, so a replayed epoch rewrites the
same rows instead of appending twice.

With ``sessions``, requests also carry ``(session_id, turn)``: the generator gets what it
kept of the session after its earlier requests, and an ``exit`` closes the session for
all later turns. Each epoch writes its exits and the states of its sessions next to the
answers and reads those of earlier epochs, so a replay sees what the first run saw. Every
``WHOLE``-th epoch writes the states of all sessions, so that no epoch reads more than that many.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ragtide.config import RagOptions
from ragtide.operators.answer import SessionGenerator
from ragtide.operators.partitioning import materialise, temporary
from ragtide.plans.answer import answer_requests, answer_sessions
from ragtide.plans.retrieve import Models

REQUEST_SCHEMA = "request_id bigint, choice string, question string"
SESSION_SCHEMA = "session_id bigint, turn bigint"
STATE_SCHEMA = "session_id bigint, state array<string>"
#: Every so many epochs, the states of all sessions are written, not only of those that had requests.
WHOLE = 20


def answer_batch(requests: DataFrame, passages: DataFrame, models: Models, options: RagOptions,
                 earlier_exits: DataFrame | None = None, states: DataFrame | None = None,
                 generator: SessionGenerator | None = None) -> DataFrame:
    """One micro-batch: a row per request with its status and answer, written once. With ``session_id`` and ``turn`` columns,
    sessions have state and end with an exit; ``states`` and ``earlier_exits`` are those of earlier batches."""
    if "session_id" in requests.columns:
        out = answer_sessions(requests, passages, models, options, generator, states, earlier_exits)
    else:
        out = answer_requests(requests, passages, models, options)
    return materialise(out, "answered")


def _states_before(spark: SparkSession, folder: str, epoch: int) -> DataFrame:
    """The last state of every session as of the epochs before ``epoch``."""
    whole = max(0, (epoch - 1) // WHOLE * WHOLE)
    known = spark.read.schema(f"{STATE_SCHEMA}, epoch bigint").parquet(folder).where(
        (F.col("epoch") < epoch) & (F.col("epoch") >= whole))
    return known.groupBy("session_id").agg(F.max_by("state", "epoch").alias("state"))


def start_answer_stream(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str, load: Callable[[], tuple[DataFrame, Models]],
                        options: RagOptions = RagOptions(), available_now: bool = True,
                        max_files_per_trigger: int | None = None, sessions: bool = False,
                        generator: SessionGenerator | None = None) -> StreamingQuery:
    """``load`` gives the passages and models; it is called for every micro-batch, so that each one
    sees the passages and statistics committed before it."""
    reader = spark.readStream.schema(f"{REQUEST_SCHEMA}, {SESSION_SCHEMA}" if sessions else REQUEST_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    requests = reader.parquet(source_dir)

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        with temporary(spark):
            answer_epoch(batch, epoch_id)

    def answer_epoch(batch: DataFrame, epoch_id: int) -> None:
        earlier = states = None
        if sessions:
            # An empty part first, so that the folders can be read in epoch 0.
            for folder, schema in (("exits", SESSION_SCHEMA), ("states", STATE_SCHEMA)):
                spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out_dir}/{folder}/epoch=-1")
            earlier = spark.read.schema(f"{SESSION_SCHEMA}, epoch bigint").parquet(f"{out_dir}/exits").where(
                F.col("epoch") < epoch_id)
            states = _states_before(spark, f"{out_dir}/states", epoch_id)
        out, path = answer_batch(batch, *load(), options, earlier, states, generator), f"epoch={epoch_id}"
        if sessions:
            out.where("status = 'ended'").select("session_id", "turn").write.mode("overwrite").parquet(
                f"{out_dir}/exits/{path}")
            now = out.where("state is not null").select("session_id", "state")
            if epoch_id % WHOLE == 0:
                now = now.unionByName(states.join(now.select("session_id"), "session_id", "left_anti"))
            now.write.mode("overwrite").parquet(f"{out_dir}/states/{path}")
        answers = out.where("status = 'accepted'").select(F.col("request_id").alias("question_id"), "question", "model_kind",
                                                          "n_docs", "context", "prompt", "generated", "answer")
        answers.write.mode("overwrite").parquet(f"{out_dir}/answers/{path}")
        keys = ["session_id", "turn"] if sessions else []
        out.select("request_id", "choice", "status", *keys).write.mode("overwrite").parquet(f"{out_dir}/status/{path}")

    writer = requests.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
