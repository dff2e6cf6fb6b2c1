"""Dense numbers for keys, without a single task that sees all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, keys: list[str], out: str, start: int = 0) -> DataFrame:
    """``rows`` with ``out``: ``start``, ``start`` + 1, ... by ``keys`` (equal keys share a number, null is a key).

    Keys are dealt to parts by their hash and ranked within their part; the driver learns one count a part
    and hands each part its offset. Numbers depend on the keys alone, so reruns and retries agree, if ``rows``
    themselves do."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    w = Window.partitionBy("_part").orderBy(*keys)
    ranked = rows.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).withColumn(
        "_rank", F.dense_rank().over(w))
    sizes = {r["_part"]: r["n"] for r in ranked.groupBy("_part").agg(F.max("_rank").alias("n")).collect()}
    offsets, total = [], start - 1
    for part in sorted(sizes):
        offsets.append((part, total))
        total += sizes[part]
    table = spark.createDataFrame(offsets, "_part int, _offset bigint")
    return ranked.join(F.broadcast(table), "_part").withColumn(out, F.col("_offset") + F.col("_rank")).drop(
        "_part", "_rank", "_offset")
