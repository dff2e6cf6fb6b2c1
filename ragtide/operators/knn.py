"""J1 exact and J2 approximate cosine k-nearest-neighbour joins.

Both return ``(query_id, passage_id, sim DOUBLE, rank INT)`` with the ``k``
best passages per query, ranked by cosine rounded to ``RANK_DECIMALS``
descending, then passage id ascending. Zero vectors never match.

Exact join, few queries: their vectors ship to every task with the function (``max_broadcast_bytes`` of them at most, which the
driver holds once), and passages are scanned in place. Many queries: chunks of passages and groups of queries meet
in the cells of a grid, in one job; a task holds one chunk and streams the queries past it, a block at a time, so its memory
depends on neither table. Passages are shuffled once a group, queries once a chunk.

In a task, blocks of passages are multiplied with queries in single precision. Its error is bounded by the vectors' length, so
what may be among a query's k best is known; only that gets its cosine, in double precision. A running top-k is kept per query
(all rows tying with the k-th are kept). A block of passages has a centroid and a radius, which bound its cosines with each
query from above; queries whose k-th best so far is beyond the bound skip the block. Of equal vectors only the first by id that
can be among k are compared.

The global cut is a ``row_number() <= k`` window, which Spark
plans as a partial ``WindowGroupLimit`` before the exchange.

Approximate join: random-hyperplane signatures (Charikar 2002) in ``tables``
hash tables of ``bits`` bits, with multi-probe (Lv et al. 2007): a query also looks into the buckets
that differ in the bits it is least sure of, by the sum of its margins to those hyperplanes. Queries and passages meet as ids, by an
equi-join on ``(table, signature)``; large buckets are split on both sides, by a
bucket histogram (bounded by ``tables * 2**bits`` rows). Distinct pairs fetch their vectors once and get exact cosines.
Where buckets are so large that their pairs weigh more than the vectors that would be copied into them, the vectors meet in the
buckets, as cells of the grid, and each gives its k best per query: the k best of all are among them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtide.config import RANK_DECIMALS
from ragtide.functions.text import rank_key
from ragtide.operators.partitioning import default_parallelism, materialise

# Candidates within this distance of a local k-th score are kept, so rows
# that tie after rounding to RANK_DECIMALS reach the cut in the global order.
TIE_MARGIN = 1e-8
DEFAULT_BROADCAST_BYTES = 64 << 20
#: Candidates that a scan task holds at most (``k`` a query); more queries meet the passages in a grid.
MOST_HELD = 1 << 18
#: For more candidates than these, the scan has few tasks a core.
_FEW_HELD, _SCANS_PER_CORE = 1 << 16, 3
#: Bytes of passages that a task of the grid holds (as doubles), and of queries that it streams past them (as floats).
CHUNK_BYTES, GROUP_BYTES = 64 << 20, 512 << 20
_CELLS_PER_BLOCK = 1 << 21  # score-matrix cells per numpy block (8 MB)
_PASSAGES_PER_BLOCK = 2048
_UNIT_ERROR = 2.0 ** -22  # of the length of vectors that are taken as they are; the bound of a product's error has room for it
_EXACT_AT_ONCE = 1 << 20  # components of vectors whose cosines are computed at once (8 MB a side)


# ---------------------------------------------------------------------------
# numpy kernels
# ---------------------------------------------------------------------------


def _as_matrix(arr: pa.Array) -> np.ndarray:
    """Arrow list<float> column -> (n, d) float64 matrix (zero rows for nulls)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return np.zeros((0, 0))
    lens = pc.list_value_length(arr).fill_null(0).to_numpy(zero_copy_only=False)
    d = int(lens.max()) if n else 0
    if (lens != d).any():
        if ((lens != d) & (lens != 0)).any():
            raise ValueError("vectors of different lengths in one column")
        m = np.zeros((n, d))
        flat = pc.list_flatten(arr).to_numpy(zero_copy_only=False).astype(np.float64)
        m[lens == d] = flat.reshape(-1, d)
        return m
    return pc.list_flatten(arr).to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, d)


def _own_matrix(arr: pa.Array) -> np.ndarray:
    """As ``_as_matrix``; vectors of floats stay floats."""
    if pa.types.is_float32(arr.type.value_type) and not arr.null_count and len(arr):
        lens = pc.list_value_length(arr).to_numpy(zero_copy_only=False)
        if (lens == lens[0]).all():
            return pc.list_flatten(arr).to_numpy(zero_copy_only=False).reshape(len(arr), int(lens[0]))
    return _as_matrix(arr)


class Vectors:
    """Vectors that have a direction, by id: in single precision and of length 1 for products, and as they are for cosines."""

    def __init__(self, ids: np.ndarray, mat: np.ndarray):
        norms = np.empty(len(mat))
        for a in range(0, len(mat), _PASSAGES_PER_BLOCK):
            part = mat[a: a + _PASSAGES_PER_BLOCK].astype(np.float64)
            norms[a: a + _PASSAGES_PER_BLOCK] = np.sqrt(np.einsum("ij,ij->i", part, part))
        ok = norms > 0
        if np.isinf(norms).any():  # an infinite component has no direction, nor has a sum beyond all doubles
            ok &= np.isfinite(norms)
        if not ok.all():
            ids, mat, norms = ids[ok], mat[ok], norms[ok]
        self.ids, self.mat, self.norms = ids, mat, norms
        if mat.dtype == np.float32 and (np.abs(norms - 1) < _UNIT_ERROR).all():
            self.unit = mat
            return
        self.unit = np.empty(mat.shape, np.float32)
        for a in range(0, len(mat), _PASSAGES_PER_BLOCK):
            z = a + _PASSAGES_PER_BLOCK
            self.unit[a:z] = mat[a:z] / norms[a:z, None]

    def __len__(self) -> int:
        return len(self.ids)

    @property
    def error(self) -> float:
        """A bound of the error of a product of two ``unit`` vectors."""
        return (self.unit.shape[1] + 8) * 2.0 ** -23

    def cosines(self, i: np.ndarray, other: Vectors, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        step = max(1, _EXACT_AT_ONCE // max(1, self.mat.shape[1]))
        for a in range(0, len(i), step):
            x, y = i[a: a + step], j[a: a + step]
            dots = np.einsum("ij,ij->i", self.mat[x].astype(np.float64), other.mat[y].astype(np.float64))
            out[a: a + step] = dots / self.norms[x] / other.norms[y]
        return out


def _first_copies(ids: np.ndarray, mat: np.ndarray, k: int, exclude_self: bool) -> np.ndarray:
    """Rows that can be among the ``k`` best of a query: of equal vectors, those with the smallest ids (and as many more as have the
    id of one query, which excludes them)."""
    if len(ids) <= k + 1 or mat.shape[1] == 0:
        return np.arange(len(ids))
    mat = np.ascontiguousarray(mat)
    # Equal vectors have equal sums of their bits, which are cheaper to sort: mostly there are too few of any sum.
    bits = mat.view(np.uint32 if mat.itemsize % 8 else np.uint64)
    sums = bits @ np.random.default_rng(29).integers(1, 1 << 32, bits.shape[1], bits.dtype)
    if np.unique(sums, return_counts=True)[1].max() <= k:
        return np.arange(len(ids))
    rows = mat.view(np.dtype((np.void, mat.shape[1] * mat.itemsize))).ravel()
    _, group = np.unique(rows, return_inverse=True)
    sizes = np.bincount(group)
    if sizes.max() <= k:
        return np.arange(len(ids))
    order = np.lexsort((ids, group))
    at = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = np.unique(ids, return_counts=True)[1].max() if exclude_self else 0
    return np.sort(order[at < k + own])


def _upper_bounds(pn: np.ndarray, qn: np.ndarray, error: float = 0.0) -> np.ndarray:
    """An upper bound of each query's cosines with a block of unit vectors, from the block's centroid and radius:
    the angle to a vector is at least the angle to the centroid less the radius. Products are known up to ``error``."""
    centre = pn.mean(axis=0)
    norm = np.sqrt((centre * centre).sum())
    if norm < max(1e-12, error):
        return np.ones(len(qn))
    centre /= norm
    radius = np.arccos(np.clip((pn @ centre).min() - error, -1.0, 1.0))
    angle = np.arccos(np.clip(qn @ centre + error, -1.0, 1.0))
    return np.cos(np.maximum(0.0, angle - radius)) + 1e-6 * bool(error) + 1e-9


def _compact(q, p, s, k, nq):
    """Keep per query its first ``k`` candidates in the global order (rounded cosine,
    then passage id); return the survivors and the per-query threshold."""
    thr = np.full(nq, -np.inf)
    if len(q) == 0:
        return q, p, s, thr
    order = np.lexsort((p, -np.round(s, RANK_DECIMALS), q))
    q, p, s = q[order], p[order], s[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    sizes = np.diff(np.r_[starts, len(q)])
    keep = np.arange(len(q)) - np.repeat(starts, sizes) < k
    full = sizes >= k
    thr[q[starts[full]]] = s[starts[full] + k - 1]
    return q[keep], p[keep], s[keep], thr


class TopKAccumulator:
    """Running local top-k of every query over streamed passage blocks, cut in the global order.

    Memory is bounded by ``_CELLS_PER_BLOCK`` score cells plus about ``k``
    held candidates per query; a per-query running threshold prunes later
    blocks.
    """

    def __init__(self, qids: np.ndarray, qmat: np.ndarray, k: int, exclude_self: bool = False):
        self.queries = Vectors(qids, qmat)
        self.k = k
        self.exclude_self = exclude_self
        self.nq = len(self.queries)
        self.thr = np.full(self.nq, -np.inf)
        self.rows = max(k + 1, _PASSAGES_PER_BLOCK)
        self.q, self.p, self.s = [], [], []
        self.held = 0
        self.skipped = 0  # cosines that bounds made needless

    def add(self, pids: np.ndarray, pmat: np.ndarray) -> None:
        if self.nq and len(pids):
            some = _first_copies(pids, pmat, self.k, self.exclude_self)
            self.add_vectors(Vectors(pids[some], pmat[some]) if len(some) < len(pids) else Vectors(pids, pmat))

    def add_vectors(self, passages: Vectors) -> None:
        for start in range(0, len(passages) if self.nq else 0, self.rows):
            stop = min(start + self.rows, len(passages))
            unit, error = passages.unit[start:stop], passages.error
            may = np.arange(self.nq)
            if (self.thr > -np.inf).any():
                may = np.flatnonzero(_upper_bounds(unit, self.queries.unit, error) >= self.thr - TIE_MARGIN)
                self.skipped += (self.nq - len(may)) * (stop - start)
            step = max(1, _CELLS_PER_BLOCK // (stop - start))
            for a in range(0, len(may), step):
                self._add_tile(passages, start, stop, may[a: a + step], 2 * error + TIE_MARGIN)
            if self.held > 3 * self.k * self.nq + 100 or (self.held and not np.isfinite(self.thr).any()):
                self._compact()

    def _add_tile(self, passages: Vectors, start: int, stop: int, asked: np.ndarray, margin: float) -> None:
        """Candidates of some queries from the passages ``start`` to ``stop``."""
        first, last = asked[0], asked[-1] + 1
        of = slice(first, last) if last - first == len(asked) else asked
        s = self.queries.unit[of] @ passages.unit[start:stop].T
        if self.exclude_self:
            ids = passages.ids[start:stop]
            order = np.argsort(ids, kind="stable")
            low, high = (np.searchsorted(ids, self.queries.ids[of], side, sorter=order) for side in ("left", "right"))
            n = high - low
            own = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            s[np.repeat(np.arange(len(asked)), n), order[own]] = -np.inf
        cut = self.thr[of] - margin
        new = np.flatnonzero(cut == -np.inf)
        if len(new) and s.shape[1] > self.k:
            at = s.shape[1] - self.k
            cut[new] = np.partition(s if len(new) == len(s) else s[new], at, axis=1)[:, at].astype(np.float64) - margin
        cut = np.nextafter(cut.astype(np.float32), np.float32(-np.inf))
        qi, pi = np.divmod(np.flatnonzero(s >= cut[:, None]), s.shape[1])
        if self.exclude_self:
            other = s[qi, pi] > -np.inf
            qi, pi = qi[other], pi[other]
        qi, pi = asked[qi], pi + start
        self.q.append(qi)
        self.p.append(passages.ids[pi])
        self.s.append(self.queries.cosines(qi, passages, pi))
        self.held += len(qi)

    def _compact(self) -> None:
        q, p, s, self.thr = _compact(np.concatenate(self.q), np.concatenate(self.p), np.concatenate(self.s),
                                     self.k, self.nq)
        self.q, self.p, self.s, self.held = [q], [p], [s], len(q)

    def result(self):
        if not self.q:
            e = np.zeros(0, dtype=np.int64)
            return e, e, np.zeros(0)
        self._compact()
        return self.queries.ids[self.q[0]], self.p[0], self.s[0]


def topk_pairs(qids: np.ndarray, qmat: np.ndarray, pids: np.ndarray, pmat: np.ndarray, k: int,
               exclude_self: bool = False):
    """Local top-k of every query over one set of passages, equal cosines by passage id:
    arrays (query id, passage id, cosine)."""
    acc = TopKAccumulator(qids, qmat, k, exclude_self)
    acc.add(pids, pmat)
    return acc.result()


# ---------------------------------------------------------------------------
# Spark plans
# ---------------------------------------------------------------------------


def _final_cut(cand: DataFrame, qid: str, pid: str, k: int, *within: str) -> DataFrame:
    w = Window.partitionBy(qid, *within).orderBy(rank_key("sim").desc(), F.col(pid).asc())
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _empty_result(spark, qid: str, pid: str) -> DataFrame:
    schema = T.StructType([T.StructField(qid, T.LongType()), T.StructField(pid, T.LongType()),
                           T.StructField("sim", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    return spark.createDataFrame([], schema)


def _vector_dim(df: DataFrame, vec: str) -> int:
    row = df.select(F.size(vec).alias("d")).filter(F.col("d") > 0).first()
    return int(row["d"]) if row else 0


def knn_exact(
    queries: DataFrame,
    passages: DataFrame,
    k: int,
    *,
    qid: str = "query_id",
    qvec: str = "query_vec",
    pid: str = "passage_id",
    pvec: str = "embedding",
    exclude_self: bool = False,
    max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
    grid_query_rows: int = 8192,
    grid_passage_rows: int = 65536,
    encode: Callable[[pa.Array], pa.Array] | None = None,
    most_held: int | None = None,
) -> DataFrame:
    """Exact cosine top-``k`` passages per query (J1, O7). Ids must be BIGINT.

    ``max_broadcast_bytes`` bounds the queries that are broadcast, and a block of them in a task of the grid (0: ``grid_query_rows`` of
    them), ``grid_passage_rows`` the passages multiplied with it at once; ``most_held`` the candidates of a scan task (``MOST_HELD``). With ``encode``, ``pvec`` is what it makes the passages'
    vectors from, a batch at a time: where queries are broadcast, in the scan itself, and no vector passes between processes."""
    q = queries.select(F.col(qid).cast("bigint").alias(qid), F.col(qvec).alias("_qv")).filter(
        F.col(qid).isNotNull() & F.col("_qv").isNotNull())
    # Null vectors drop out with the zero ones: a filter on a vector would make Spark run the encoder twice, to test it and to give it.
    p = passages.select(F.col(pid).cast("bigint").alias(pid), F.col(pvec).alias("_pv")).filter(F.col(pid).isNotNull())
    # One small action: query count and vector width decide how the two meet.
    probe = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_qv")).alias("d")).first()
    nq, d = int(probe["n"]), int(probe["d"] or 0)
    if nq == 0 or d <= 0:
        return _empty_result(queries.sparkSession, qid, pid)
    rows = max_broadcast_bytes // (8 * d) or (1 if max_broadcast_bytes else grid_query_rows)
    if nq <= rows and nq * k <= max(MOST_HELD if most_held is None else most_held, k):
        if nq * k > _FEW_HELD:  # each task gives k candidates a query
            p = p.coalesce(_SCANS_PER_CORE * default_parallelism(q.sparkSession))
        return _final_cut(_scan(q, p, k, qid, pid, exclude_self, grid_passage_rows, encode), qid, pid, k)
    if encode is not None:
        p = p.withColumn("_pv", _encoder_udf(encode)("_pv"))
    n_passages = passages.where(F.col(pid).isNotNull()).count()
    chunks = max(1, math.ceil(1.1 * n_passages * 8 * d / CHUNK_BYTES))  # hashed chunks differ a little in size
    groups = max(math.ceil(2 * default_parallelism(q.sparkSession) / chunks), math.ceil(nq * 4 * d / GROUP_BYTES))
    part = lambda id_, n: F.pmod(F.xxhash64(id_), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    p = p.select("*", part(pid, chunks).alias("_chunk"), every(groups).alias("_group"))
    q = q.select("*", part(qid, groups).alias("_group"), every(chunks).alias("_chunk"))
    cell = (F.col("_group") * F.lit(chunks) + F.col("_chunk")).cast("bigint").alias("_cell")
    sides = _sides(q.select(qid, "_qv", cell, F.lit(0).cast("bigint").alias("_sub")), p.select(
        pid, "_pv", cell, F.lit(0).cast("bigint").alias("_sub")), qid, pid)
    dealt = sides.repartitionById(chunks * groups, F.col("_cell").cast("int"))
    return _final_cut(_meet(dealt, k, qid, pid, exclude_self, rows, grid_passage_rows), qid, pid, k)


def _encoder_udf(encode: Callable[[pa.Array], pa.Array]):
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def passage_vectors(source: pa.Array) -> pa.Array:
        return encode(source)

    return passage_vectors


def _packed(q: DataFrame, qid: str) -> list[tuple[bytes, bytes, str, int]]:
    """Ids and vectors of all queries, a batch at a time and compressed: the driver and the shipped function never hold
    them as they are, of which hashed ones are mostly zeros. (ids, vectors, type, dimensions)."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows:
                mat = _own_matrix(rb.column(1))
                row = [rb.column(0).to_numpy().tobytes(), zlib.compress(np.ascontiguousarray(mat), 1), mat.dtype.str, mat.shape[1]]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["ids", "vecs", "type", "dim"])

    tbl = q.select(qid, "_qv").mapInArrow(pack, "ids binary, vecs binary, type string, dim bigint").toArrow()
    packed = [tuple(r[c] for c in ("ids", "vecs", "type", "dim")) for r in tbl.to_pylist()]
    if len({dim for *_, dim in packed if dim}) > 1:
        raise ValueError("vectors of different lengths in one column")
    return packed


def _unpacked(packed: list[tuple[bytes, bytes, str, int]]) -> tuple[np.ndarray, np.ndarray]:
    d = max(dim for *_, dim in packed)
    ids = [np.frombuffer(r[0], np.int64) for r in packed]
    # batches without any vector are zero rows
    kinds = [np.dtype(kind) for _, _, kind, dim in packed if dim]
    mat = np.zeros((sum(map(len, ids)), d), np.result_type(*kinds) if kinds else np.float64)
    at = 0
    for own, (_, vecs, kind, dim) in zip(ids, packed):
        if dim:
            mat[at: at + len(own)] = np.frombuffer(zlib.decompress(vecs), kind).reshape(len(own), dim)
        at += len(own)
    return np.concatenate(ids), mat


def _scan(q: DataFrame, p: DataFrame, k: int, qid: str, pid: str, exclude_self: bool, passage_rows: int,
          encode: Callable[[pa.Array], pa.Array] | None = None) -> DataFrame:
    """About ``k`` candidates of each query from every task of the passages' scan. The caller checks the queries' size."""
    packed = _packed(q, qid)
    out_schema = f"{qid} long, {pid} long, sim double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = TopKAccumulator(*_unpacked(packed), k, exclude_self)
        acc.rows = min(acc.rows, max(k + 1, passage_rows))
        for rb in batches:
            if rb.num_rows:
                vecs = rb.column("_pv")
                acc.add(rb.column(pid).to_numpy(), _own_matrix(vecs if encode is None else encode(vecs)))
        qi, pi, s = acc.result()
        yield pa.RecordBatch.from_arrays([pa.array(qi, pa.int64()), pa.array(pi, pa.int64()),
                                          pa.array(s, pa.float64())], names=[qid, pid, "sim"])

    return p.mapInArrow(scan, out_schema)


def _sides(q: DataFrame, p: DataFrame, qid: str, pid: str) -> DataFrame:
    """Passages and queries with the cells they meet in (``_cell``, ``_sub``), as one table."""
    return p.select("_cell", "_sub", F.lit(0).alias("_side"), F.col(pid).alias("_id"), F.col("_pv").alias("_vec")).unionByName(
        q.select("_cell", "_sub", F.lit(1).alias("_side"), F.col(qid).alias("_id"), F.col("_qv").alias("_vec")))


def _meet(dealt: DataFrame, k: int, qid: str, pid: str, exclude_self: bool, query_rows: int, passage_rows: int) -> DataFrame:
    """The ``k`` best passages of each query in each cell. Rows of a cell are in one partition; its passages come first and are held,
    its queries are streamed past them. The caller bounds the passages of a cell."""
    block = max(1, min(query_rows, _CELLS_PER_BLOCK // _PASSAGES_PER_BLOCK))
    names = [qid, pid, "sim"]

    def batch(out: list) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*out)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, passages = None, [], None  # a cell, its passages as they come, and all of them
        out, waiting = [], 0
        for rb in batches:
            if rb.num_rows == 0:
                continue
            cell, sub, side, ids = (rb.column(i).to_numpy() for i in range(4))
            new = (cell[1:] != cell[:-1]) | (sub[1:] != sub[:-1]) | (side[1:] != side[:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), rb.num_rows]
            for a, z in zip(edges, edges[1:]):
                if here != (cell[a], sub[a]):
                    here, held, passages = (cell[a], sub[a]), [], None
                mat = _own_matrix(rb.column(4).slice(a, z - a))
                if side[a] == 0:
                    if mat.shape[1]:
                        held.append((ids[a:z], mat))
                    continue
                if passages is None:
                    if not held:
                        continue
                    every, mats = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    held = []
                    some = _first_copies(every, mats, k, exclude_self)
                    passages = Vectors(every[some], mats[some]) if len(some) < len(every) else Vectors(every, mats)
                    del every, mats
                for b in range(a, z if mat.shape[1] else a, block):
                    acc = TopKAccumulator(ids[b: min(b + block, z)], mat[b - a: b - a + block], k, exclude_self)
                    acc.rows = min(acc.rows, max(k + 1, passage_rows))
                    acc.add_vectors(passages)
                    out.append(acc.result())
                    waiting += len(out[-1][0])
                    if waiting >= 1 << 16:
                        yield batch(out)
                        out, waiting = [], 0
        if out:
            yield batch(out)

    placed = dealt.sortWithinPartitions("_cell", "_sub", "_side")
    return placed.mapInArrow(meet, f"{qid} long, {pid} long, sim double")


# ---------------------------------------------------------------------------
# Approximate join by random-hyperplane hashing
# ---------------------------------------------------------------------------


def hyperplanes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables * bits, dim))


def probe_order(margins: np.ndarray, probes: int) -> np.ndarray:
    """(n, probes) masks of the bits to flip, from the margins (n, bits) to their hyperplanes: none first, then the sets of bits
    with the smallest sum of margins.

    All subsets of a set come before it, and so do the sets with a smaller bit in the place of its largest: the first ``probes`` sets
    have at most log2(probes) bits, all among the ``probes`` smallest."""
    bits = margins.shape[1]
    considered, most = min(bits, probes), probes.bit_length()
    least = np.argsort(margins, axis=1, kind="stable")[:, :considered]
    small = np.take_along_axis(margins, least, axis=1)
    chosen = [c for size in range(min(most, considered + 1)) for c in combinations(range(considered), size)]
    sets = np.zeros((len(chosen), considered))
    for i, c in enumerate(chosen):
        sets[i, list(c)] = 1
    order = np.argsort(small @ sets.T, axis=1, kind="stable")[:, :probes]
    return (sets[order].astype(np.int64) * (1 << least)[:, None, :]).sum(axis=2)


def _bucket_udf(planes: np.ndarray, tables: int, bits: int, probes: int):
    """The buckets of a vector: for each table its signature, and for ``probes`` > 1 those of the next likely ones."""
    weights = (1 << np.arange(bits)).astype(np.int64)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def buckets(vecs: pa.Array) -> pa.Array:
        m = _as_matrix(vecs)
        n = m.shape[0]
        if n == 0:
            return pa.array([], type=pa.list_(pa.int32()))
        if m.shape[1] == 0:
            m = np.zeros((n, planes.shape[1]))
        dots = (m @ planes.T).reshape(n * tables, bits)
        sig = ((dots > 0).astype(np.int64) * weights).sum(axis=1)
        if probes > 1:
            sig = (sig[:, None] ^ probe_order(np.abs(dots), probes)).reshape(n, -1)
        flat = sig.astype(np.int32).reshape(n, -1)
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * flat.shape[1])
        return pa.ListArray.from_arrays(offsets, pa.array(flat.ravel(), type=pa.int32()))

    return buckets


def _buckets(q: DataFrame, p: DataFrame, qid: str, pid: str, dim: int, tables: int, bits: int, probes: int, seed: int,
             max_group_rows: int) -> tuple[DataFrame, DataFrame]:
    """(id, tbl, sig) of passages and of queries with the bucket's ``p_splits``, ``q_splits`` and rows ``n_p``, ``n_q``; only
    buckets with rows of both sides."""
    planes = hyperplanes(dim, tables, bits, seed)
    probes = min(probes, 1 << bits)

    def bucketed(df: DataFrame, id_: str, vec: str, each: int) -> DataFrame:
        rows = df.select(id_, F.posexplode(_bucket_udf(planes, tables, bits, each)(F.col(vec))).alias("i", "sig"))
        return materialise(rows.select(id_, F.floor(F.col("i") / each).cast("int").alias("tbl"), "sig"), "lsh-buckets")

    pk, qk = bucketed(p, pid, "_pv", 1), bucketed(q, qid, "_qv", probes)

    def splits(rows: DataFrame, out: str, n: str) -> DataFrame:
        # At most tables * 2**bits rows, so broadcasting it is bounded.
        return F.broadcast(rows.groupBy("tbl", "sig").agg(F.greatest(F.lit(1), F.ceil(
            F.count(F.lit(1)) / F.lit(max_group_rows))).cast("int").alias(out), F.count(F.lit(1)).alias(n)))

    parts, asks = splits(pk, "p_splits", "n_p"), splits(qk, "q_splits", "n_q")
    keys = ["tbl", "sig"]
    return tuple(x.join(parts, keys).join(asks, keys) for x in (pk, qk))


def _split(pk: DataFrame, qk: DataFrame, qid: str, pid: str) -> tuple[DataFrame, DataFrame]:
    """Rows of both sides with the parts of their buckets: (tbl, sig, ps, qs, id)."""
    own = lambda id_, n: F.pmod(F.xxhash64(id_), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    return (pk.select("tbl", "sig", pid, own(pid, "p_splits").alias("ps"), every("q_splits").alias("qs")),
            qk.select("tbl", "sig", qid, own(qid, "q_splits").alias("qs"), every("p_splits").alias("ps")))


def lsh_pairs(q: DataFrame, p: DataFrame, qid: str, pid: str, dim: int, tables: int, bits: int, probes: int, seed: int,
              max_group_rows: int) -> DataFrame:
    """Distinct (qid, pid) that share a bucket, as ids only."""
    return _id_pairs(*_buckets(q, p, qid, pid, dim, tables, bits, probes, seed, max_group_rows), qid, pid)


def _id_pairs(pk: DataFrame, qk: DataFrame, qid: str, pid: str) -> DataFrame:
    pk, qk = _split(pk, qk, qid, pid)
    return pk.join(qk, ["tbl", "sig", "ps", "qs"]).select(qid, pid).distinct()


def _best_in_buckets(pk: DataFrame, qk: DataFrame, q: DataFrame, p: DataFrame, k: int, qid: str, pid: str, dim: int,
                     exclude_self: bool) -> DataFrame:
    """The ``k`` best passages of each query in each of its buckets, each pair once. Ids are unique."""
    cell = (F.shiftleft(F.col("tbl").cast("bigint"), 32) + F.col("sig")).alias("_cell")
    sub = (F.shiftleft(F.col("ps").cast("bigint"), 32) + F.col("qs")).alias("_sub")
    pk, qk = _split(pk, qk, qid, pid)
    sides = _sides(qk.select(qid, cell, sub).join(q, qid), pk.select(pid, cell, sub).join(p, pid), qid, pid)
    spark = q.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * default_parallelism(spark))
    found = _meet(sides.repartition(n, "_cell", "_sub"), k, qid, pid, exclude_self, 1 << 30, _PASSAGES_PER_BLOCK)
    return found.groupBy(qid, pid).agg(F.max("sim").alias("sim"))


def _pairs_by_passage(pairs: DataFrame, q: DataFrame, p: DataFrame, qid: str, pid: str, schema: str) -> DataFrame:
    """Cosines of pairs with the queries' vectors at hand (their size is checked): a passage's vector moves once, with the ids of
    its queries, of which there are at most as many as were broadcast."""
    tbl = q.toArrow().sort_by(qid)
    qids, qn = tbl.column(qid).to_numpy(), _as_matrix(tbl.column("_qv"))
    norms = np.sqrt((qn * qn).sum(axis=1))
    each = pairs.groupBy(pid).agg(F.collect_list(qid).alias("_ids")).join(p, pid).select(pid, "_ids", "_pv")

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows == 0:
                continue
            m, ids = _as_matrix(rb.column(2)), rb.column(1)
            of = np.repeat(np.arange(rb.num_rows), pc.list_value_length(ids).to_numpy(zero_copy_only=False))
            asked = pc.list_flatten(ids).to_numpy(zero_copy_only=False)
            at, length = np.searchsorted(qids, asked), np.sqrt((m * m).sum(axis=1))
            sim = np.empty(len(of))
            for a in range(0, len(of), 1 << 16):
                i, j = of[a: a + (1 << 16)], at[a: a + (1 << 16)]
                with np.errstate(divide="ignore", invalid="ignore"):
                    sim[a: a + (1 << 16)] = (m[i] * qn[j]).sum(axis=1) / (length[i] * norms[j])
            ok = (length[of] > 0) & (norms[at] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(asked[ok]), rb.column(0).take(pa.array(of[ok])), pa.array(sim[ok])],
                                             names=[qid, pid, "sim"])

    return each.mapInArrow(cosines, schema)


def _vectors_weigh_less(pk: DataFrame, qk: DataFrame, dim: int, k: int) -> bool:
    """Whether vectors copied into all parts of their buckets, and what is found there, weigh less than the ids of the pairs that share
    a bucket."""
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0))
    passages = pk.agg(total("q_splits").alias("copies"), total("n_q").alias("pairs")).first()
    queries = qk.agg(total("p_splits").alias("copies")).first()
    return (passages["copies"] + queries["copies"]) * (4 * dim + 32) + queries["copies"] * k * 24 < 16 * passages["pairs"]


def _unique(rows: DataFrame, id_: str) -> bool:
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(id_).alias("ids")).first()
    return got["n"] == got["ids"]


def knn_lsh(
    queries: DataFrame,
    passages: DataFrame,
    k: int,
    *,
    qid: str = "query_id",
    qvec: str = "query_vec",
    pid: str = "passage_id",
    pvec: str = "embedding",
    tables: int = 16,
    bits: int = 6,
    seed: int = 17,
    max_group_rows: int = 20000,
    exclude_self: bool = False,
    probes: int = 1,
) -> DataFrame:
    """Approximate cosine top-``k`` (J2): only pairs sharing a bucket in some
    table are scored (exactly). Recall grows with ``tables`` and ``probes``, the buckets a query looks into per table, and falls with
    ``bits``; fewer tables with more probes keep fewer ids of the passages."""
    q = queries.select(F.col(qid).cast("bigint").alias(qid), F.col(qvec).alias("_qv")).filter(
        F.col(qid).isNotNull() & F.col("_qv").isNotNull())
    p = passages.select(F.col(pid).cast("bigint").alias(pid), F.col(pvec).alias("_pv")).filter(
        F.col(pid).isNotNull() & F.col("_pv").isNotNull())
    d = _vector_dim(p, "_pv")
    if d == 0:
        return _empty_result(queries.sparkSession, qid, pid)
    pk, qk = _buckets(q, p, qid, pid, d, tables, bits, probes, seed, max_group_rows)
    # copies of a row would be found anew in each bucket
    if _vectors_weigh_less(pk, qk, d, k) and _unique(q, qid) and _unique(p, pid):
        return _final_cut(_best_in_buckets(pk, qk, q, p, k, qid, pid, d, exclude_self), qid, pid, k)
    pairs = _id_pairs(pk, qk, qid, pid)
    if exclude_self:
        pairs = pairs.where(F.col(qid) != F.col(pid))
    schema = f"{qid} long, {pid} long, sim double"
    size = q.agg(F.count(F.lit(1)).alias("n")).first()["n"] * d * 8
    if size <= DEFAULT_BROADCAST_BYTES:
        return _final_cut(_pairs_by_passage(pairs, q, p, qid, pid, schema), qid, pid, k)
    # Vectors join the distinct pairs, so each pair has them once, not once a table.
    met = pairs.join(p, pid).join(q, qid)

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows == 0:
                continue
            a, b = _as_matrix(rb.column(2)), _as_matrix(rb.column(3))
            norm = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
            ok = norm > 0
            yield pa.RecordBatch.from_arrays(
                [rb.column(0).filter(pa.array(ok)), rb.column(1).filter(pa.array(ok)),
                 pa.array((a[ok] * b[ok]).sum(axis=1) / norm[ok])], names=[qid, pid, "sim"])

    found = met.select(qid, pid, "_qv", "_pv").mapInArrow(cosines, schema)
    return _final_cut(found, qid, pid, k)
