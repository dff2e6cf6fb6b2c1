"""Partition helpers shared by the operators."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragtide.session import ensure_checkpoint_dir
from ragtide.sources import paths


def default_parallelism(spark: SparkSession) -> int:
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:  # Spark Connect
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Hash-spread rows before CPU-heavy per-row work, where a few large row groups would scan as a few tasks.

    Only the caller knows its input, so this always shuffles; asking the plan for
    its number of partitions would run upstream stages. The spread is keyed by a
    hash of a unique key, so it is the same on every attempt (unlike round-robin).
    """
    return df.repartition(partitions or default_parallelism(df.sparkSession), F.xxhash64(F.col(key)))


_SCOPES = threading.local()


def task_count(spark: SparkSession) -> int:
    """Partitions for work that is costly per row: an explicit count, as AQE would coalesce few bytes into a few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), default_parallelism(spark))


@contextmanager
def temporary(spark: SparkSession):
    """What is materialised within, in this thread, is deleted at the end: for jobs that write their results elsewhere."""
    outer, here = getattr(_SCOPES, "paths", None), []
    _SCOPES.paths = here
    try:
        yield
    finally:
        _SCOPES.paths = outer
        for path in here:
            paths.delete(spark, path)


#: Whether Spark deletes a query's shuffle files when it ends, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str, mode: str) -> None:
    """Write ``df``; what it shuffled goes when it is written, as nothing else reads that."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.mode(mode).parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def _new_path(spark: SparkSession, tag: str) -> str:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    if getattr(_SCOPES, "paths", None) is not None:
        _SCOPES.paths.append(path)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Evaluate ``df`` once: write it to the shared folder of ``spark.checkpoint.dir`` and read it back.

    The folder stays, unless a ``temporary`` block ends: what is returned is read when the caller runs it."""
    spark = df.sparkSession
    path = _new_path(spark, tag)
    _write(df, path, "errorifexists")
    return spark.read.schema(df.schema).parquet(path)


def materialise_parts(spark: SparkSession, parts: Iterable[Callable[[], DataFrame]], tag: str) -> DataFrame:
    """The tables that ``parts`` give (one at least, of one schema), written one after the other into one; what a part materialises
    is deleted before the next begins, so that disk is needed for one part at a time."""
    path, schema = _new_path(spark, tag), None
    for part in parts:
        with temporary(spark):
            df = part()
            _write(df, path, "append")
            schema = df.schema
    return spark.read.schema(schema).parquet(path)


# Row bound under which a lookup side is broadcast (rows are small keyed records).
MAX_BROADCAST_ROWS = 2_000_000


def broadcast_if(df: DataFrame, n_rows: int, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only when its row count (counted or bounded by the
    caller) is within ``max_rows``; otherwise leave the join to the planner
    (shuffle join, AQE may still switch at run time)."""
    return F.broadcast(df) if n_rows <= max_rows else df
