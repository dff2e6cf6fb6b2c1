"""Files and folders of whatever store a path names, through Hadoop's file systems, from the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    _, fs, p = _at(spark, path)
    return bool(fs.exists(p))


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder, sorted; none if it does not exist."""
    _, fs, p = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def modified(spark: SparkSession, folder: str) -> dict[str, int]:
    """When what lies in a folder was last modified, in milliseconds since 1970, by name; from one listing."""
    _, fs, p = _at(spark, folder)
    return {s.getPath().getName(): int(s.getModificationTime()) for s in fs.listStatus(p)} if fs.exists(p) else {}


def make(spark: SparkSession, folder: str) -> None:
    _, fs, p = _at(spark, folder)
    fs.mkdirs(p)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a file or a whole folder."""
    _, fs, p = _at(spark, path)
    return bool(fs.delete(p, True))


def read_text(spark: SparkSession, path: str) -> str:
    jvm, fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new small file under its final name in one step: written under another name first, then renamed.

    False if the name is taken, as a rename never replaces a file."""
    import uuid

    jvm, fs, p = _at(spark, path)
    if fs.exists(p):
        return False
    folder, _, name = path.rpartition("/")
    part = jvm.org.apache.hadoop.fs.Path(f"{folder}/.{name}.{uuid.uuid4().hex}")
    stream = fs.create(part)
    try:
        stream.write(text.encode("utf-8"))
    finally:
        stream.close()
    done = bool(fs.rename(part, p))
    if not done:
        fs.delete(part, False)
    return done
