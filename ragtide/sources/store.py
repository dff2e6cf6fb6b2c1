"""The passage store, in versions.

A store is a folder (``versions``) and a catalog view over its last version.

* S4 ``open_store``: register the store's view, with a new empty folder if there is none.
* S5: a load writes its passages as one new segment; Spark decides on the files.
* S6: a document gets a dense number (``ids``) the first time it is stored, by its full key; a passage's id is that number and the
  chunk's. Documents of more than 2^20 chunks take a number for each 2^20.
* S7 ``count``, S8 ``drop``, S9 ``load`` / ``snapshot``: the last version as a whole, passages and statistics together.
* S10 ``index_incremental``: a load compares each document's passages with what the last version has of it (three
  numbers per document), stores the documents that are new or changed, and removes what they consisted of before by a row in ``removed``. Stored
  segments are not written again; ``compact`` does that, and a load calls it when too much is dead.
* BM25 statistics are sums over loads: a load adds the document frequencies of the passages it
  brings and subtracts those of the passages it removes.

``incremental_rows`` / ``replaced_rows`` are the same comparison per passage, for tables without a store.
"""

from __future__ import annotations

import dataclasses
import uuid
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragtide.functions.text import tokens
from ragtide.operators.format import format_rerank, scorer_input
from ragtide.operators.numbering import numbered
from ragtide.operators.partitioning import broadcast_if
from ragtide.operators.passages import CHUNK_ID_BITS
from ragtide.operators.rerank import Bm25Stats
from ragtide.session import ensure_checkpoint_dir
from ragtide.sources import paths, versions
from ragtide.sources.versions import Version

METADATA = ("STRUCT<law: STRING, article: STRING, title: STRING, chunk_index: INT, total_chunks: INT, "
            "chunk_content: STRING>")
STORED = ["passage_id", "content_key", "doc_key", "metadata", "passage_text", "embedding"]
#: Segments of small kinds are merged when there would be more than this many.
MERGE_AT = 16
#: A load compacts the store when this share of the stored rows is dead.
COMPACT_SHARE = 0.5
#: Superseded versions, and segments without a version, stay this long for readers and running loads.
KEEP_MS = 24 * 3600 * 1000
#: Loads between two looks for what can be deleted, as that reads the versions of a day.
VACUUM_EVERY = 32


def passage_schema(key_type: str) -> str:
    return (f"passage_id BIGINT, content_key STRING, doc_key {key_type}, metadata {METADATA}, passage_text STRING, "
            "embedding ARRAY<FLOAT>")


def _schema(kind: str, key_type: str) -> str:
    return {
        "passages": f"{passage_schema(key_type)}, load BIGINT",
        "removed": f"doc_key {key_type}, gone BIGINT",
        "documents": f"doc_key {key_type}, n BIGINT, s DECIMAL(38,0), x BIGINT, load BIGINT",
        "ids": f"doc_key {key_type}, block BIGINT, number BIGINT",
        "terms": "token STRING, df BIGINT, length BIGINT",
    }[kind]


# --- folder and view ---------------------------------------------------------------------------------------------------


def _root(spark: SparkSession, name: str, path: str | None = None) -> str:
    """The store's folder: as registered, else ``path``, else beside the database's tables."""
    if spark.catalog.tableExists(name):
        found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
        if "ragtide.root" not in found:
            raise ValueError(f"{name} is not a passage store")
        return found["ragtide.root"]
    if path:
        return path.rstrip("/")
    database, _, short = name.rpartition(".")
    home = spark.catalog.getDatabase(database or spark.catalog.currentDatabase()).locationUri
    return f"{home.rstrip('/')}/{short}.store"


def _segments(spark: SparkSession, root: str, v: Version, kind: str) -> DataFrame:
    schema, at = _schema(kind, v.key_type), getattr(v, kind)
    if not at:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{s}" for s in at])


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _live(spark: SparkSession, root: str, v: Version) -> DataFrame:
    """Passages of a version, with the load they came with."""
    rows = _segments(spark, root, v, "passages")
    if v.removed:
        gone = _segments(spark, root, v, "removed").withColumnRenamed("doc_key", "_gone_key")
        rows = rows.join(gone, _same(F.col("doc_key"), F.col("_gone_key")) & (F.col("load") < F.col("gone")), "left_anti")
    return rows


def _register(spark: SparkSession, name: str, root: str, v: Version) -> None:
    """The view of a version, for SQL; replaced as one step of the catalog."""
    def union(kind: str) -> str:
        return " UNION ALL ".join(f"SELECT * FROM parquet.`{root}/{s}`" for s in getattr(v, kind))

    cols = ", ".join(STORED)
    if not v.passages:
        nulls = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}"
                          for f in spark.createDataFrame([], passage_schema(v.key_type)).schema)
        body = f"SELECT {nulls} WHERE false"
    else:
        body = f"SELECT {cols} FROM ({union('passages')}) p"
        if v.removed:
            body += f" LEFT ANTI JOIN ({union('removed')}) r ON p.doc_key <=> r.doc_key AND p.load < r.gone"
    spark.sql(f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('ragtide.root' = '{root}') AS {body}")


def open_store(spark: SparkSession, name: str, path: str | None = None) -> str:
    """Register the store, and create it empty if its folder (``path``, or one beside the database's tables) is new."""
    if not spark.catalog.tableExists(name):
        root = _root(spark, name, path)
        if not versions.numbers(spark, root):
            versions.commit(spark, root, Version(number=1))
        _register(spark, name, root, versions.latest(spark, root))
    return name


def snapshot(spark: SparkSession, name: str) -> tuple[DataFrame, Bm25Stats]:
    """Passages and BM25 statistics of one version, the last that was committed."""
    root = _root(spark, name)
    v = versions.latest(spark, root)
    return _live(spark, root, v).select(*STORED), _stats(spark, root, v)


def load(spark: SparkSession, name: str) -> DataFrame:
    """The committed passages (every earlier load is visible, whoever made it)."""
    root = _root(spark, name)
    return _live(spark, root, versions.latest(spark, root)).select(*STORED)


def load_stats(spark: SparkSession, name: str) -> Bm25Stats:
    """BM25 statistics of the last version."""
    return snapshot(spark, name)[1]


def count(spark: SparkSession, name: str) -> int:
    """Number of stored passages."""
    return versions.latest(spark, _root(spark, name)).n_passages


def drop(spark: SparkSession, name: str) -> None:
    """Drop the store with all its versions."""
    root = _root(spark, name)
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    paths.delete(spark, root)


# --- the comparison without a store ------------------------------------------------------------------------------------


def incremental_rows(incoming: DataFrame, existing: DataFrame, key: str = "content_key") -> DataFrame:
    """Incoming rows whose key is not stored, one per key (smallest passage_id).

    The anti join shuffles both sides by key; nothing is collected. Only the
    key column of the store is read (column pruning on the parquet scan).
    """
    w = Window.partitionBy(key).orderBy(F.col("passage_id").asc())
    fresh = incoming.join(existing.select(key), key, "left_anti")
    return fresh.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") == 1).drop("_k")


def replaced_rows(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Stored rows of incoming documents (``doc_key``) that the incoming batch no longer has."""
    again = existing.join(incoming.select("doc_key").distinct(), "doc_key", "left_semi")
    return again.join(incoming.select("content_key"), "content_key", "left_anti")


# --- loads -------------------------------------------------------------------------------------------------------------


class _Load:
    """Folders of one load: its segments go if it fails, what it needs in between goes in any case."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.root = spark, name, _root(spark, name)
        self.before = versions.latest(spark, self.root)
        self.number = self.before.number + 1
        self._segments: list[str] = []
        self._between: list[str] = []

    def __enter__(self) -> _Load:
        return self

    def __exit__(self, kind, *_) -> None:
        for path in self._between + (self._segments if kind else []):
            paths.delete(self.spark, path)

    def kept(self, rows: DataFrame, tag: str) -> DataFrame:
        """Evaluate ``rows`` once, in the shared folder."""
        path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
        self._between.append(path)
        schema = rows.schema
        rows.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def segment(self, kind: str, rows: DataFrame) -> tuple[str, DataFrame]:
        """Write a segment; its name, and its rows as read back."""
        name = f"{kind}/{self.number:08d}-{uuid.uuid4().hex}"
        schema = self.spark.createDataFrame([], _schema(kind, self.key_type)).schema
        self._segments.append(f"{self.root}/{name}")
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(f"{self.root}/{name}")
        return name, self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    key_type = "bigint"

    def commit(self, **changes) -> Version:
        v = dataclasses.replace(self.before, number=self.number, key_type=self.key_type, **changes)
        v = versions.commit(self.spark, self.root, v)
        _register(self.spark, self.name, self.root, v)
        return v


def _fingerprints(passages: DataFrame) -> DataFrame:
    """n, s, x of each document: how many passages it has, and two sums of their hashes. Sums of partial sums, so that a
    document with most of all passages is not gathered anywhere."""
    each = passages.select("doc_key", "content_key").distinct()
    return each.groupBy("doc_key").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("content_key").cast("decimal(38,0)")).alias("s"),
        F.bit_xor(F.xxhash64(F.lit(1), "content_key")).alias("x"))


def _known(documents: DataFrame) -> DataFrame:
    """The last state of each document that has passages."""
    last = documents.groupBy("doc_key").agg(F.max_by(F.struct("n", "s", "x"), "load").alias("last"))
    return last.where("last.n > 0").select("doc_key", "last")


def _terms(rows: DataFrame, sign: int) -> DataFrame:
    """(token, df, length) of passages; token null has their number and total length."""
    t = rows.select(tokens(scorer_input(format_rerank())).alias("t"))
    own = F.array(F.struct(F.lit(None).cast("string").alias("token"), F.size("t").cast("bigint").alias("length")))
    each = F.transform(F.array_distinct("t"), lambda w: F.struct(w.alias("token"), F.lit(0).cast("bigint").alias("length")))
    return t.select(F.explode(F.concat(own, each)).alias("e")).select(
        "e.token", F.lit(sign).cast("bigint").alias("df"), (F.col("e.length") * sign).alias("length"))


def _summed(terms: DataFrame) -> DataFrame:
    """Partial sums per task come first, so a token of most passages costs a row per task."""
    return terms.groupBy("token").agg(F.sum("df").alias("df"), F.sum("length").alias("length")).where(
        "df <> 0 or token is null")


def _stats(spark: SparkSession, root: str, v: Version) -> Bm25Stats:
    vocab = _segments(spark, root, v, "terms").where("token is not null").groupBy("token").agg(F.sum("df").alias("df"))
    mean = v.total_length / v.n_passages if v.n_passages else 0.0
    return Bm25Stats(vocab.where("df > 0"), float(v.n_passages), mean)


def _merged(load: _Load, kind: str, new: list[str]) -> tuple[str, ...]:
    """The segments of a kind after this load, merged into one if they have become many."""
    names = (*getattr(load.before, kind), *new)
    if len(names) <= MERGE_AT:
        return names
    v = dataclasses.replace(load.before, key_type=load.key_type, **{kind: names})
    rows = _segments(load.spark, load.root, v, kind)
    if kind == "terms":
        rows = _summed(rows)
    elif kind == "removed":
        rows = rows.groupBy("doc_key").agg(F.max("gone").alias("gone"))
    elif kind == "documents":
        rows = rows.groupBy("doc_key").agg(F.max_by(F.struct("n", "s", "x"), "load").alias("last"),
                                           F.max("load").alias("load")).select("doc_key", "last.*", "load")
    return (load.segment(kind, rows)[0],)


def index_incremental(spark: SparkSession, passages: DataFrame, name: str, mode: str = "dedupe",
                      documents: DataFrame | None = None, full: bool = False, removed: DataFrame | None = None) -> int:
    """C1 sink with S4 + S5 + S6 + S10: a new version of the store; returns the number of passages it brings.

    ``dedupe`` expects all passages of each document it brings. Documents that the store has in the same form are left
    alone, new ones are stored, changed ones stored in the place of their earlier form. ``documents`` (doc_key) are the documents of the load:
    those without passages (their content is empty now) leave the store. With ``full`` the load is the whole
    corpus, and documents that it does not bring leave the store; ``removed`` (doc_key) leave it in any case.
    ``append`` stores everything again. A load that changes nothing makes no version. One that fails, or that another load
    overtakes (``VersionTaken``), leaves the last version as it was, and no folder.
    """
    if mode not in ("dedupe", "append"):
        raise ValueError("mode must be 'dedupe' or 'append'")
    open_store(spark, name)
    with _Load(spark, name) as run:
        v, root = run.before, run.root
        key_type = passages.schema["doc_key"].dataType.simpleString()
        if v.documents and key_type != v.key_type:
            raise ValueError(f"{name} has documents with keys of type {v.key_type}, the load has {key_type}")
        run.key_type = key_type
        v = dataclasses.replace(v, key_type=key_type)
        incoming = run.kept(passages, "incoming")  # chunked and encoded once for the uses below
        brought = _fingerprints(incoming)
        if documents is not None:
            every = documents.select(F.col("doc_key").alias("_doc")).distinct()
            brought = every.join(brought, _same(F.col("_doc"), F.col("doc_key")), "left").select(
                F.col("_doc").alias("doc_key"), F.coalesce("n", F.lit(0)).alias("n"), "s", "x")
        brought = run.kept(brought, "brought")
        state = _segments(spark, root, v, "documents")
        known = brought.select(F.col("doc_key").alias("_doc"))
        # only what the load brings is looked up, unless the load is the whole corpus
        same_doc = _same(F.col("doc_key"), F.col("_doc"))
        stored = _known(state if full else state.join(known, same_doc, "left_semi")).withColumnRenamed("doc_key", "_doc")
        both = brought.join(stored, same_doc, "full_outer" if full else "left").select(
            F.coalesce("doc_key", "_doc").alias("doc_key"), F.coalesce("n", F.lit(0)).alias("n"), "s", "x", "last")
        equal = (F.col("n") == F.col("last.n")) & _same(F.col("s"), F.col("last.s")) & _same(F.col("x"), F.col("last.x"))
        if mode == "append":  # a document stored in two forms equals neither, so that the next load replaces both
            mixed = F.col("last").isNotNull() & ~F.coalesce(equal, F.lit(False))
            both = both.where("n > 0").select("doc_key", F.when(mixed, F.col("n") + F.col("last.n")).otherwise(F.col("n"))
                                              .alias("n"), F.when(~mixed, F.col("s")).alias("s"), "x",
                                              F.lit(False).alias("replaces"))
        else:
            both = both.where(~F.coalesce(equal, F.lit(False)) & ((F.col("n") > 0) | F.col("last").isNotNull()))
            both = both.select("doc_key", "n", "s", "x", F.col("last").isNotNull().alias("replaces"))
            if removed is not None:
                named = removed.select(F.col("doc_key").alias("_doc")).distinct()
                both = both.join(named, same_doc, "left_anti").unionByName(
                    _known(state.join(named, same_doc, "left_semi")).select(
                        "doc_key", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("decimal(38,0)").alias("s"),
                        F.lit(None).cast("bigint").alias("x"), F.lit(True).alias("replaces")))
        changes = run.kept(both, "changes")
        size = changes.agg(F.count(F.lit(1)), F.count(F.when(F.col("replaces"), 1))).first()
        if not size[0]:
            return 0
        new = {kind: [] for kind in versions.KINDS}
        new["documents"].append(run.segment("documents", changes.withColumn("load", F.lit(run.number)))[0])

        stored_docs = changes.where("n > 0").select(F.col("doc_key").alias("_doc"))
        fresh = incoming.withColumn("block", F.shiftright(F.col("metadata.chunk_index"), CHUNK_ID_BITS).cast("bigint"))
        blocks = fresh.select("doc_key", "block").distinct().join(stored_docs, same_doc, "left_semi")
        # whole passages are sorted out by key only if a load repeats some
        if mode == "dedupe" and incoming.count() != brought.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]:
            fresh = fresh.dropDuplicates(["doc_key", "content_key"])
        ids = _segments(spark, root, v, "ids")
        same_block = same_doc & (F.col("block") == F.col("_block"))
        have = ids.select(F.col("doc_key").alias("_doc"), F.col("block").alias("_block"))
        first_time = run.kept(blocks.join(have, same_block, "left_anti"), "new-ids")
        n_new = first_time.count()
        if n_new:
            name_, rows = run.segment("ids", numbered(first_time, ["doc_key", "block"], "number", v.next_id))
            new["ids"].append(name_)
            ids = ids.unionByName(rows)
        # The numbers of the documents to be stored: they choose the passages, and go to them where they lie, if they are few.
        ids = ids.join(stored_docs, same_doc, "left_semi").select(F.col("doc_key").alias("_doc"), F.col("block").alias("_block"), "number")
        ids = run.kept(ids, "numbers")
        ids = broadcast_if(ids, ids.count())
        low = F.col("metadata.chunk_index").bitwiseAND(F.lit((1 << CHUNK_ID_BITS) - 1))
        fresh = fresh.join(ids, same_block).withColumn(
            "passage_id", F.col("number") * F.lit(1 << CHUNK_ID_BITS) + low).withColumn("load", F.lit(run.number))
        name_, fresh = run.segment("passages", fresh)
        n_fresh = fresh.count()
        if n_fresh:
            new["passages"].append(name_)
        change, n_old = _terms(fresh, 1), 0
        if size[1]:
            gone = changes.where("replaces").select("doc_key", F.lit(run.number).alias("gone"))
            name_, gone = run.segment("removed", gone)
            new["removed"].append(name_)
            old = _live(spark, root, v).join(gone.select(F.col("doc_key").alias("_doc")), same_doc, "left_semi")
            change = change.unionByName(_terms(old, -1))
        name_, change = run.segment("terms", _summed(change))
        new["terms"].append(name_)
        own = change.where("token is null").first()
        delta = (own["df"], own["length"]) if own else (0, 0)
        n_old = n_fresh - delta[0]
        after = run.commit(next_id=v.next_id + n_new, n_passages=v.n_passages + delta[0], n_dead=v.n_dead + n_old,
                           total_length=v.total_length + delta[1],
                           **{kind: _merged(run, kind, new[kind]) if kind != "passages" else (*v.passages, *new[kind])
                              for kind in versions.KINDS})
    if after.n_dead > COMPACT_SHARE * max(1, after.n_passages + after.n_dead):
        with suppress(versions.VersionTaken):  # the load is done; a later one compacts
            compact(spark, name)
    if after.number % VACUUM_EVERY == 0:
        vacuum(spark, name)
    return n_fresh


def write_stats(spark: SparkSession, name: str) -> Bm25Stats:
    """Count the BM25 statistics anew over the whole store, as a new version. Loads keep them up to date by themselves."""
    with _Load(spark, name) as run:
        run.key_type = run.before.key_type
        name_, terms = run.segment("terms", _summed(_terms(_live(spark, run.root, run.before), 1)))
        own = terms.where("token is null").first()
        v = run.commit(terms=(name_,), n_passages=own["df"] if own else 0, total_length=own["length"] if own else 0)
    return _stats(spark, _root(spark, name), v)


def compact(spark: SparkSession, name: str) -> Version:
    """A version with the same rows and no dead ones, one segment of each kind."""
    with _Load(spark, name) as run:
        v, root = run.before, run.root
        run.key_type = v.key_type
        passages = run.segment("passages", _live(spark, root, v))[0]
        known = _known(_segments(spark, root, v, "documents")).select("doc_key", "last.*", F.lit(run.number).alias("load"))
        parts = {"documents": known, "ids": _segments(spark, root, v, "ids"),
                 "terms": _summed(_segments(spark, root, v, "terms"))}
        return run.commit(passages=(passages,), removed=(), n_dead=0,
                          **{kind: (run.segment(kind, rows)[0],) for kind, rows in parts.items()})


def vacuum(spark: SparkSession, name: str, keep_ms: int = KEEP_MS) -> list[str]:
    """Delete versions superseded more than ``keep_ms`` ago and the segments only they used, and what killed loads left."""
    return versions.vacuum(spark, _root(spark, name), keep_ms)
