"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ragtide.session import ensure_checkpoint_dir, ship_package

#: Bytes that separate words: ``[^\x20\x09-\x0D]+`` is a word.
SPACES = " \t\n\r\x0b\x0c"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table, by a path that only Spark's readers need to open."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder of ``spark.checkpoint.dir`` and read it back."""
    return scratch(df, tag)[0]


def scratch(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """As ``written``, with the folder, for tables that ``paths.delete`` removes when their last reader has ended."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path


def copy_numbers(rows: DataFrame, key: list[str], out: str, origin: str) -> DataFrame:
    """``rows`` with ``out``, a number from 0 among the rows of equal ``key`` columns, in no particular order.

    A key may hold a third of all rows: they are numbered within each value of ``origin`` (the partition that a row
    came from when ``rows`` were written), with an offset for each, so no key is gathered in one task."""
    names = [f"_{out}_{i}" for i in range(len(key) + 2)]
    here = first_numbers(rows, key, origin)
    here = here.select(*[F.col(c).alias(n) for c, n in zip([*key, origin, "first"], names)])
    same = F.lit(True)
    for c, n in zip([*key, origin], names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    number = F.row_number().over(Window.partitionBy(*key, origin).orderBy(F.lit(0))) - 1
    numbered = rows.withColumn(out, number).join(here, same)
    return numbered.withColumn(out, F.col(out) + F.col(names[-1])).drop(*names)


def first_numbers(rows: DataFrame, key: list[str], origin: str) -> DataFrame:
    """``key``, ``origin`` and ``first``: how many rows of the key come from smaller origins. A row for each key and origin."""
    here = rows.groupBy(*key, origin).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*key).orderBy(origin).rowsBetween(Window.unboundedPreceding, -1)
    return here.select(*key, origin, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))


def fold(col: Column | str, parts: int) -> Column:
    """crc32 of the id as text modulo ``parts`` (a null id counts as the empty text)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % parts


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width; explicit repartitions follow it and so the cluster's sizing."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sampled(df: DataFrame, key: Column, by: list[str], at_most: int) -> DataFrame:
    """About ``at_most`` rows of each value of ``by``, chosen by the hash of ``key``: the same rows on
    every run and on every partitioning. Only the counts per value (few classes) come to the driver."""
    sizes = df.groupBy(*by).count().collect()
    width = 1 << 30
    unit = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(width))
    keep = F.lit(False)
    for row in sizes:
        here = F.lit(True)
        for name in by:
            here = here & F.col(name).eqNullSafe(F.lit(row[name]))
        keep = keep | (here & (unit < F.lit(min(width, max(1, int(at_most / max(1, row["count"]) * width))))))
    return df.where(keep)


def schema_of(df: DataFrame, keep: list[str], more: str) -> StructType:
    """Schema of the ``keep`` columns of ``df``, followed by the columns of the DDL text ``more``."""
    return StructType([*df.select(*keep).schema.fields, *StructType.fromDDL(more).fields])
