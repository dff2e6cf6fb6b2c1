"""Vector code compression: integer codebooks per part of a vector, learned over a trie of distinct parts.

Every component x becomes floor(4096 * x), and a vector is cut into equal
consecutive parts. Equal parts at one position are one leaf with a weight. The
leaves are range-partitioned and sorted by (position, components), so each task
holds one range of a lexicographic trie in depth-first order, and the table is
written once for all rounds. ``Walk`` traverses it: a node is a prefix of
components, and its vector of squared distances to all codebook entries so far is
computed once, for all leaves below, from its parent's. Only the vectors along
the current path are carried from one block of leaves to the next, so memory does not
grow with the range. Leaves take the smallest entry and add their weighted components
to it. What comes to the driver per round is one sum per codebook component.

Codes of the vectors themselves come from the same walk, over the trie of the
parts of each batch, so that vectors are not shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.llm.common import partitions, schema_of, scratch, written
from ragtide.sources import paths

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Leaves of the trie that are walked at once.
BLOCK = 4096
MOST = (1 << 63) - 1
#: Components below this fit int64 arithmetic throughout; beyond it, Python's integers are used.
WIDE = 1 << 24

Codebooks = np.ndarray  # [part, entry, position within the part], Python integers


class Walk:
    """Depth-first traversal of the trie of parts at one position, block by block, in any number of calls."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # [entry, component]
        self.path: np.ndarray | None = None  # the last leaf's components
        self.acc: list[np.ndarray] = []  # and the distance vectors along its path

    def __call__(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry (ties: the first) and squared distance of each leaf. Sorted leaves share most."""
        leaves, entries = _typed(leaves, self.entries)
        out = [self._block(leaves[a : a + BLOCK], entries) for a in range(0, len(leaves), BLOCK)]
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])

    def _block(self, leaves: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, dims = leaves.shape
        if dims == 0:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        differs = np.ones((n, dims), bool)
        differs[1:] = leaves[1:] != leaves[:-1]
        if self.path is not None:
            differs[0] = leaves[0] != self.path
        below = np.logical_or.accumulate(differs, axis=1)  # [leaf, depth]: the leaf's node at this depth is a new one
        zero = np.zeros((1, len(entries)), leaves.dtype)
        before, at, acc = zero, np.zeros(n, np.int64), []
        for d in range(dims):
            new = below[:, d]
            gap = leaves[new, d][:, None] - entries[None, :, d]
            nodes = before[at[new]] + gap * gap  # the parent's vector and one more component
            nodes = np.concatenate([self.acc[d][None] if self.path is not None else zero, nodes])
            at = np.cumsum(new)  # row of the leaf's node in ``nodes``; row 0 is the path so far
            acc.append(nodes[-1])
            before = nodes
        self.path, self.acc = leaves[-1], acc
        nearest = np.argmin(before, axis=1).astype(np.int64)
        least = before[np.arange(len(before)), nearest]
        return nearest[at], least[at]


def _typed(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as int64 where distances are sure to fit, else as Python integers."""
    small = all(x.size == 0 or (int(x.max()) < WIDE and int(x.min()) > -WIDE) for x in (parts, entries))
    kind = np.int64 if small else object
    return parts.astype(kind), entries.astype(kind)


def _matrix(column: pa.ListArray) -> np.ndarray:
    """A column of equally long integer lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _trie(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, the place of each row among them, and how often each occurs."""
    n, dims = parts.shape
    order = np.lexsort(parts.T[::-1]) if dims else np.arange(n)
    ranked = parts[order]
    new = np.ones(n, bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ranked[new], inverse, np.bincount(inverse, minlength=int(new.sum()))


def integers(vectors: DataFrame, keep: list[str], vector: str) -> DataFrame:
    """``keep`` columns and ``_v``, floor(4096 * x) of every component x (beyond a long: the nearest long), without the
    rows whose vector is null or holds null or non-finite components."""
    x = F.col("_x")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    out = vectors.select(*keep, F.col(vector).cast("array<double>").alias("_x")).where(x.isNotNull() & ~bad)
    return out.select(*keep, F.transform(x, lambda c: F.floor(c * SCALE).cast("long")).alias("_v"))


def _lists(matrix: np.ndarray) -> pa.ListArray:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()),
                                    pa.array(matrix.reshape(-1), pa.int64()))


def leaves(vectors: DataFrame, parts: int, width: int) -> DataFrame:
    """Distinct parts with their weights: pos, part, weight; sorted within range partitions.

    Equal parts of a batch are added up before the shuffle, so a part that a third of all vectors hold is a row per
    batch, not per vector. The grouping follows the ranges and shuffles nothing more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(0)) if b.num_rows else np.zeros((0, parts * width), np.int64)
            for pos in range(parts):
                distinct, _, weight = _trie(v[:, pos * width : (pos + 1) * width])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(distinct), pos), pa.int32()), _lists(distinct), pa.array(weight, pa.int64())],
                    names=["pos", "part", "weight"])

    found = vectors.select("_v").mapInArrow(run, "pos int, part array<long>, weight long")
    ranged = found.repartitionByRange(partitions(vectors.sparkSession), "pos", "part")
    return (ranged.groupBy("pos", "part").agg(F.sum("weight").alias("weight"))
            .sortWithinPartitions("pos", "part"))


def _totals(trie: DataFrame, books: Codebooks) -> DataFrame:
    """Weight (dim = -1) and weighted component sums of every entry that some part is nearest to."""
    schema = "pos int, entry int, dim int, total decimal(38,0)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = [Walk(entries) for entries in books]
        totals: dict[tuple[int, int, int], int] = {}
        for b in batches:
            if not b.num_rows:
                continue
            at, all_parts, all_weights = b.column(0).to_numpy(), _matrix(b.column(1)), b.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for lo, hi in zip(cuts, cuts[1:]):
                pos, part, weight = int(at[lo]), all_parts[lo:hi], all_weights[lo:hi]
                nearest, _ = walks[pos](part)
                if int(np.abs(part).max(initial=0)) * int(weight.sum()) >= 1 << 62 or int(part.min(initial=0)) == -MOST - 1:
                    part, weight = part.astype(object), weight.astype(object)
                for e in np.unique(nearest).tolist():
                    here = nearest == e
                    w = weight[here]
                    sums = [int(w.sum()), *(part[here] * w[:, None]).sum(axis=0).tolist()]
                    for d, x in enumerate(sums, -1):
                        totals[pos, e, d] = totals.get((pos, e, d), 0) + int(x)
        keys = list(totals)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k[i] for k in keys], pa.int32()) for i in range(3)),
             pa.array([Decimal(totals[k]) for k in keys], pa.decimal128(38, 0))], names=["pos", "entry", "dim", "total"])

    return trie.mapInArrow(run, schema).groupBy("pos", "entry", "dim").agg(F.sum("total").alias("total"))


def learn(vectors: DataFrame, key: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after ``rounds`` rounds, from ``key`` and ``_v`` of ``integers`` with vectors of one length.

    They start as the parts of the ``entries`` smallest ids (null last; repeated ids by their vectors). With fewer
    vectors there are fewer entries, and none without vectors. Only the codebooks and parts * entries * (width + 1) sums a round are on the driver."""
    start = vectors.orderBy(F.col(key).asc_nulls_last(), "_v").limit(entries).collect()
    if not start:
        return np.zeros((parts, 0, 0), object)
    first = np.array([r["_v"] for r in start], object).reshape(len(start), -1)
    width = first.shape[1] // parts
    books = np.stack([first[:, p * width : (p + 1) * width] for p in range(parts)])
    trie, path = scratch(leaves(vectors, parts, width), "codes-trie")
    for _ in range(rounds):
        totals = {(r.pos, r.entry, r.dim): int(r.total) for r in _totals(trie, books).collect()}
        for (pos, e, d), x in totals.items():
            if d >= 0:
                books[pos, e, d] = x // totals[pos, e, -1]
    paths.delete(vectors.sparkSession, path)
    return books


def digest(books: Codebooks) -> str:
    """sha256 of all entries' components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for x in books.reshape(-1).tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, keep: list[str], books: Codebooks) -> DataFrame:
    """``keep`` columns, ``code`` (two hex digits a part) and ``error`` (squared distances added up, at most the largest long)."""
    parts, _, width = books.shape
    schema = schema_of(vectors, keep, "code string, error long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column(len(keep)))
            code, error = np.empty((len(v), parts), np.uint8), np.zeros(len(v), object)
            for p in range(parts):
                distinct, of, _ = _trie(v[:, p * width : (p + 1) * width])
                nearest, distance = Walk(books[p])(distinct)
                code[:, p] = nearest[of]
                error = error + distance[of].astype(object)
            text = code.tobytes().hex()
            cols = [b.column(i) for i in range(len(keep))]
            cols.append(pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()))
            cols.append(pa.array([min(int(x), MOST) for x in error], pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return vectors.select(*keep, "_v").mapInArrow(run, schema)


def compress(vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """Codes of all vectors, and the codebooks that decode them.

    Rows: the ``key`` and ``label`` columns, code, error, and label_error (errors of equal labels added up,
    nulls together, at most the largest long). Every kept row has its row: null and repeated ids too. Null vectors, and
    vectors with null or non-finite components, go. All vectors must be as long as that of the smallest kept id: others go too.
    A length that ``parts`` does not divide is filled up with zeros. Other columns of the table are not read, so their
    names do not matter. An empty table gives no rows and empty codebooks. ``entries`` is at most 256, two hex digits."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so there can be 1 to 256 entries")
    # the given columns take names of this function's own, whatever else the table holds
    ints = integers(vectors.select(F.col(key).alias("_id"), F.col(label).alias("_label"), F.col(vector).alias("_vec")),
                    ["_id", "_label"], "_vec")
    least = ints.orderBy(F.col("_id").asc_nulls_last(), "_v").limit(1).collect()
    size = len(least[0]["_v"]) if least else 0
    fill = F.array_repeat(F.lit(0).cast("long"), -size % parts)
    same = ints.where(F.size("_v") == size).withColumn("_v", F.concat("_v", fill))
    books = learn(same, "_id", parts, entries, rounds)
    coded = written(encode(same, ["_id", "_label"], books), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(MOST))).cast("long")
    # a written table of known size: Catalyst broadcasts it if it is small, and joins by shuffle, split where skewed, if not
    sums = written(coded.groupBy(F.col("_label").alias("_l")).agg(total.alias("label_error")), "codes-labels")
    out = coded.join(sums, F.col("_label").eqNullSafe(F.col("_l")), "left")
    return out.select(F.col("_id").alias(key), F.col("_label").alias(label), "code", "error", "label_error"), books


def sql(table: str = "embeddings", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for the same rows: one block of common table expressions a round."""
    out = [f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding AS v FROM {table}
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT r, (i - 1) // (len(v) // {parts}) AS p, (i - 1) % (len(v) // {parts}) AS d,
         CAST(floor(4096 * CAST(v[i] AS DOUBLE)) AS BIGINT) AS c
  FROM (SELECT r, v, unnest(range(1, len(v) + 1)) AS i FROM k)
), b0 AS MATERIALIZED (
  SELECT p, r - 1 AS e, d, c FROM x WHERE r <= {entries}
)"""]
    for n in range(rounds + 1):
        out.append(f"""a{n} AS MATERIALIZED (
  SELECT r, p, min(struct_pack(s := s, e := e)) AS best
  FROM (SELECT x.r, x.p, b.e, sum((x.c - b.c) * (x.c - b.c)) AS s FROM x JOIN b{n} b ON x.p = b.p AND x.d = b.d
        GROUP BY x.r, x.p, b.e)
  GROUP BY r, p
)""")
        if n < rounds:
            out.append(f"""b{n + 1} AS MATERIALIZED (
  SELECT b.p, b.e, b.d, coalesce(t.c, b.c) AS c
  FROM b{n} b LEFT JOIN (
    SELECT x.p, a.best.e AS e, x.d, CAST((sum(x.c) - ((sum(x.c) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS c
    FROM x JOIN a{n} a ON x.r = a.r AND x.p = a.p GROUP BY x.p, a.best.e, x.d
  ) t ON b.p = t.p AND b.e = t.e AND b.d = t.d
)""")
    last = f"""
, codes AS (
  SELECT r, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, CAST(sum(best.s) AS BIGINT) AS error FROM a{rounds} GROUP BY r
), labelled AS (
  SELECT k.vec_id, k.label, codes.code, codes.error FROM k JOIN codes ON k.r = codes.r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, d)) FROM b{rounds}) AS codebooks_sha256
FROM labelled
"""
    return ",\n".join(out) + last
