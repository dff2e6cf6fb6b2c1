"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``bits`` bits differ in at most
``bits`` of their 8 bytes, so they share at least ``8 - bits`` positional bytes:
the guaranteed minimum of the count filter. A posting of the index is keyed by
that many positions and their byte values, so that sharing one posting proves
that a pair's tally reaches the minimum (single-byte postings would each hold a
256th of all fingerprints, and their pairs would grow with the square of the
corpus). A pair is taken from the posting of its *first* shared positions only,
once, and then verified by its bit distance.

Copies do not meet each other: the index holds each fingerprint once. A posting
with more than ``HOT`` fingerprints (a crowd of near copies) is not paired
either. Its fingerprints are linked through the values at up to bits / 2 bits
from them: two fingerprints within ``bits`` have such a value in common, and the
few fingerprints around one value link to the smallest of them (see ``_crowd_links``). That is linear in the crowd and loses no
component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.llm.common import schema_of, written
from ragtide.llm.components import components

SEED = 42
HOT = 256


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of the lower-cased (A-Z) words' shingles, repeats included; 0 without words."""
    if not text:
        return 0
    words = text.encode("utf-8", "replace").lower().split()
    n = len(words)
    if n == 0:
        return 0
    buf = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(buf, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, n) - 1)[: n - shingle + 1].tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    m = len(starts)
    counts = np.zeros(64, np.int64)
    for a in range(0, m, 4096):  # bounded work space for very long texts
        h = np.array([digest(buf[i:j], SEED) for i, j in zip(starts[a: a + 4096], stops[a: a + 4096])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > m, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = 4, text: str = "text") -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed 64-bit number."""
    schema = schema_of(docs, keep, "fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(len(keep)).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(keep))), pa.array(fp.view(np.int64))], names=[*keep, "fp"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, bits: int = 4, hot: int = HOT) -> DataFrame:
    """(a, b) with a < b: enough verified links to connect every two fingerprints within ``bits`` bits.

    ``fps`` has one column, distinct ``fp``. Pairs from ordinary postings are all
    the pairs within ``bits``; crowds give the links of ``_crowd_links``.
    """
    minimum = 8 - bits
    masks = [_signed(sum(0xFF << (8 * p) for p in pos)) for pos in combinations(range(8), minimum)]
    posting = F.array(*[F.struct(F.lit(i).cast("byte").alias("id"), F.col("fp").bitwiseAND(F.lit(m)).alias("value"))
                        for i, m in enumerate(masks)])
    index = fps.select("fp", F.explode(posting).alias("p")).select("fp", "p.id", "p.value")
    sets = [frozenset(pos) for pos in combinations(range(8), minimum)]
    number = {s: i for i, s in enumerate(sets)}
    # owner[bit set of shared positions]: the only posting that reports the pair
    owner = np.full(256, -1, np.int64)
    for shared in range(256):
        pos = [p for p in range(8) if shared >> p & 1]
        if len(pos) >= minimum:
            owner[shared] = number[frozenset(pos[:minimum])]

    def verified(posting: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Tally of shared bytes and bit distance, for the differences ``x`` of pairs met in ``posting``."""
        same = np.packbits(x.view(np.uint8).reshape(-1, 8) == 0, axis=1, bitorder="little")[:, 0]
        return (owner[same] == posting) & (np.bitwise_count(x) <= bits)

    def out(a: np.ndarray, b: np.ndarray, crowd: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), crowd))],
            names=["a", "b", "crowd"])

    def postings(fp: np.ndarray, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        two = starts[sizes == 2]
        a, b = [fp[two]], [fp[two + 1]]
        post = [ids[two]]
        for s, n in zip(starts[(sizes > 2) & (sizes <= hot)], sizes[(sizes > 2) & (sizes <= hot)]):
            i, j = np.triu_indices(n, 1)
            a.append(fp[s + i])
            b.append(fp[s + j])
            post.append(np.full(len(i), ids[s]))
            if sum(map(len, a)) > 1_000_000:
                a, b, post = [np.concatenate(a)], [np.concatenate(b)], [np.concatenate(post)]
                ok = verified(post[0], (a[0] ^ b[0]).view(np.uint64))
                yield out(a[0][ok], b[0][ok], False)
                a, b, post = [], [], []
        if a:
            a, b, post = np.concatenate(a), np.concatenate(b), np.concatenate(post)
            ok = verified(post, (a ^ b).view(np.uint64))
            yield out(a[ok], b[ok], False)
        for s, n in zip(starts[sizes > hot], sizes[sizes > hot]):
            yield out(fp[s: s + n], fp[s: s + n], True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int64)]
        for batch in batches:
            fp, ids, value = (np.concatenate([rest[i], batch.column(i).to_numpy()]) for i in range(3))
            if len(fp) == 0:
                continue
            starts = np.concatenate([[0], np.flatnonzero((np.diff(ids) != 0) | (np.diff(value) != 0)) + 1])
            sizes = np.diff(np.concatenate([starts, [len(fp)]]))
            yield from postings(fp, ids, starts[:-1], sizes[:-1])
            last = starts[-1]  # this posting may go on in the next batch
            if sizes[-1] > hot:  # a crowd for certain: pass it on, keep enough of it to know the rest as a crowd
                yield out(fp[last:], fp[last:], True)
                fp, ids, value = (x[: last + hot + 1] for x in (fp, ids, value))
            rest = [x[last:].copy() for x in (fp, ids, value)]
        if len(rest[0]):
            yield from postings(rest[0], rest[1], np.array([0]), np.array([len(rest[0])]))

    found = written(index.repartition("id", "value").sortWithinPartitions("id", "value").select("fp", "id", "value")
                    .mapInArrow(run, "a long, b long, crowd boolean"), "simhash-links")
    crowd = found.where("crowd").select(F.col("a").alias("fp")).distinct()
    return found.where("not crowd").select("a", "b").union(_crowd_links(crowd, bits))


def _crowd_links(crowd: DataFrame, bits: int) -> DataFrame:
    """Links that connect every two fingerprints of a crowd within ``bits`` bits, linear in the crowd.

    Two such fingerprints have a value in common within (bits + 1) // 2 bits of
    both. At most 2081 fingerprints (for 4 bits) lie that near to one value, so no
    group is large. For an even bound any two of them are within ``bits`` of each
    other, so the smallest links to all; for an odd bound the pairs around a value are verified.
    """
    flips = [_signed(sum(1 << p for p in pos)) for r in range((bits + 1) // 2 + 1) for pos in combinations(range(64), r)]
    near = crowd.select("fp", F.explode(F.transform(F.lit(flips), lambda x: F.col("fp").bitwiseXOR(x))).alias("near"))
    if bits % 2 == 0:
        hub = near.groupBy("near").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1")
        pairs = near.join(hub.select("near", "hub"), "near").where("hub < fp")
        return pairs.select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()
    other = near.select(F.col("fp").alias("b"), "near")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    return (near.select(F.col("fp").alias("a"), "near").join(other, "near").where(F.col("a") < F.col("b")).where(close)
            .select("a", "b").distinct())


def roots(fps: DataFrame, bits: int = 4) -> DataFrame:
    """(fp, root) of every distinct fingerprint ``fp``; root is the smallest fingerprint of its component."""
    distinct = fps.select("fp").distinct()
    root = components(links(distinct, bits), "simhash-cc")
    # Fingerprints without a link are their own component.
    return (distinct.join(root.withColumnRenamed("node", "fp"), "fp", "left")
            .select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, bits: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    Rows whose fingerprints differ in at most ``bits`` bits are linked;
    component_id is the smallest doc_id reachable over links. Null, empty and
    word-free texts have fingerprint zero and link like any other. Repeated rows
    each get their row. A null doc_id never names a component unless the
    component has no other id.
    """
    fps = written(fingerprints(docs, ["doc_id"], shingle), "simhash-fp")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    root = components(links(distinct.select("fp"), bits), "simhash-cc")
    # Fingerprints without a link are their own component, without a join of the copies' rows by root.
    named = distinct.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = written(named.join(ids, "root").select("fp", "component_id"), "simhash-ids")
    return fps.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
