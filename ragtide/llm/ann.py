"""Approximate nearest neighbours with learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts (recursive
bisection of the graph with swaps), a small neural classifier learns the parts
of a vector's neighbours, and the whole table is indexed by the classifier's most
probable part. Parts that turn out large are partitioned again, each by the same method from a bounded sample of its own
rows, so that the parts' number grows with the table; a part of the second level has the product of both
classifiers' probabilities. A query is routed to its most probable parts, as many as the
sample's own exact neighbours needed, and is compared there with every row in
double precision. A query that finds fewer rows there than were asked for, though
there are more, goes on to twice as many parts, until it has them.

Parts are split into blocks of bounded size by the hash of the id, and so are
the queries that visit a part, so no task gets an unbounded group.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragtide.llm.common import sampled, written

BLOCK = 4096
#: Parts that a part can have.
SUB = 64
#: Queries that are multiplied with a block of rows at once.
AT_ONCE = 256


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) without vectors that are null, zero, or hold a null or non-finite
    component, and without null ids. Vectors of another length than the most frequent one (ties: the
    shortest) take no part either."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = vectors.select("vec_id", e.alias("embedding")).where("vec_id is not null")
    v = v.where(finite & F.exists("embedding", lambda x: x != 0))
    width = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.where(F.size("embedding") == (width["d"] if width else 0))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """[n, k] exact nearest others by inner product."""
    n = len(x)
    out = np.empty((n, k), np.int64)
    for a in range(0, n, 1024):
        s = x[a: a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a: a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, levels: int) -> np.ndarray:
    """Part of each sample row: 2**levels parts of equal size (to one row), few graph edges between them."""
    n, k = graph.shape
    src = np.concatenate([np.repeat(np.arange(n), k), graph.ravel()])
    dst = np.concatenate([graph.ravel(), np.repeat(np.arange(n), k)])
    part = np.zeros(n, np.int64)
    for _ in range(levels):
        inner = part[src] == part[dst]
        s, d = src[inner], dst[inner]
        degree = np.maximum(1, np.bincount(s, minlength=n))
        side = np.zeros(n, np.int64)
        value = np.zeros(n)
        for p in np.unique(part):
            rows = np.flatnonzero(part == p)
            y = x[rows] - x[rows].mean(0)
            value[rows] = y @ np.linalg.svd(y, full_matrices=False)[2][0] if len(rows) > 1 else 0.0
        for _ in range(15):  # smooth along the graph
            value = 0.5 * value + 0.5 * np.bincount(s, value[d], n) / degree
        for p in np.unique(part):
            rows = np.flatnonzero(part == p)
            order = rows[np.argsort(value[rows], kind="stable")]
            side[order[len(order) // 2:]] = 1
        for _ in range(8):  # swap rows whose edges cross the cut, in equal numbers both ways
            cross = np.bincount(s, side[d] != side[s], n)
            gain = 2 * cross - np.bincount(s, minlength=n)
            moved = False
            for p in np.unique(part):
                rows = np.flatnonzero(part == p)
                a, b = rows[side[rows] == 0], rows[side[rows] == 1]
                a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
                m = min(len(a), len(b))
                better = int((gain[a[:m]] + gain[b[:m]] > 0).sum()) // 2
                if better:
                    side[a[:better]], side[b[:better]], moved = 1, 0, True
            if not moved:
                break
        part = part * 2 + side
    return part


class Router:
    """One hidden layer; softmax over parts."""

    def __init__(self, inputs: int, parts: int, hidden: int = 128, seed: int = 5):
        r = np.random.default_rng(seed)
        self.w = [r.normal(0, np.sqrt(2 / inputs), (inputs, hidden)), np.zeros(hidden),
                  r.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
        self.scale = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, (x * self.scale) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 3e-3) -> None:
        """``y``: [n, parts] shares of the neighbours' parts."""
        self.scale = 1 / max(1e-30, float(np.sqrt((x * x).mean())))
        r = np.random.default_rng(11)
        m, v, t = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w], 0
        for epoch in range(epochs):
            order = r.permutation(len(x))
            for a in range(0, len(x), batch):
                rows = order[a: a + batch]
                xb = x[rows] * self.scale
                h = np.maximum(0, xb @ self.w[0] + self.w[1])
                z = h @ self.w[2] + self.w[3]
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                dz = (p - y[rows]) / len(rows)
                dh = dz @ self.w[2].T * (h > 0)
                t += 1
                step = rate * (1 - epoch / epochs) + 1e-4
                for i, g in enumerate((xb.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] -= step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, most probable first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")


def fit_router(x: np.ndarray, k: int, part_rows: int, recall: float, hidden: int = 128) -> tuple[Router, int, int]:
    """(router, parts, probes) from the sample ``x``. ``probes`` is the least number of parts in which the
    router finds the share ``recall`` of the exact neighbours of sample rows held out of its training."""
    n = len(x)
    k = min(k, n - 1)
    levels = max(0, int(np.log2(max(1, n // part_rows))))
    if levels == 0 or k < 1:
        return Router(x.shape[1], 1), 1, 1
    graph = neighbour_graph(x, k)
    part = balanced_parts(x, graph, levels)
    parts = 1 << levels
    share = np.zeros((n, parts))
    np.add.at(share, (np.repeat(np.arange(n), k), part[graph].ravel()), 1.0 / (k + 1))
    share[np.arange(n), part] += 1.0 / (k + 1)
    held = np.arange(n) % 10 == 0
    router = Router(x.shape[1], parts, hidden)
    router.fit(x[~held], share[~held])
    # Rows are indexed by the router's own choice, so the probes are counted against that.
    assigned = router.ranked(x)[:, 0]
    order = router.ranked(x[held])
    place = np.argsort(order, axis=1)  # rank of each part
    need = np.take_along_axis(place, assigned[graph[held]], axis=1).ravel()
    probes = int(np.quantile(need, recall, method="higher")) + 1
    return router, parts, probes


class Index:
    """Both levels of routers. A leaf is part * SUB + the part's own part, if it has several."""

    def __init__(self, router: Router, parts: int):
        self.router, self.parts, self.subs = router, parts, {}

    def add(self, part: int, router: Router, parts: int) -> None:
        if parts > 1:
            self.subs[part] = (router, parts)

    def leaves(self) -> list[int]:
        return [p * SUB + s for p in range(self.parts) for s in range(self.subs[p][1] if p in self.subs else 1)]

    def ranked(self, x: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` most probable leaves of each row, most probable first."""
        first = _log_softmax(self.router.logits(x)) if self.parts > 1 else np.zeros((len(x), 1))
        of, out = [], []
        for p in range(self.parts):
            if p in self.subs:
                router, n = self.subs[p]
                out.append(first[:, p, None] + _log_softmax(router.logits(x)))
            else:
                n = 1
                out.append(first[:, p, None])
            of += [p * SUB + s for s in range(n)]
        return np.array(of)[np.argsort(-np.concatenate(out, axis=1), axis=1, kind="stable")[:, :count]]

    def part_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that a row is indexed in: the most probable part, and there the most probable one again."""
        part = self.router.logits(x).argmax(1) if self.parts > 1 else np.zeros(len(x), np.int64)
        leaf = part * SUB
        for p, (router, _) in self.subs.items():
            rows = np.flatnonzero(part == p)
            if len(rows):
                leaf[rows] += router.logits(x[rows]).argmax(1)
        return leaf


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def fit_second(indexed: DataFrame, sizes: dict[int, int], rows: int, sample: int) -> list[tuple[int, Router, int]]:
    """(part, router, its parts) for each part of more than ``rows`` rows, fitted in a task each, from about ``sample`` rows."""
    large = {p: n for p, n in sizes.items() if n > rows}
    if not large:
        return []
    some = sampled(indexed.where(F.col("part").isin(list(large))), F.col("vec_id"), ["part"], sample)

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        part = group["part"][0].as_py()
        x = np.stack(group["embedding"].to_numpy())
        wanted = 1 << min(int(np.log2(SUB)), int(np.ceil(np.log2(large[part] / rows))))
        router, parts, _ = fit_router(x, 20, max(16, len(x) // wanted), 0.97, hidden=64)
        return pa.table({"part": [part], "router": [pickle.dumps((router, parts))]},
                        schema=pa.schema([("part", pa.int32()), ("router", pa.binary())]))

    got = some.groupBy("part").applyInArrow(fit, "part int, router binary").collect()  # at most one router a part
    return [(r["part"], *pickle.loads(r["router"])) for r in sorted(got)]


def probes_of(index: Index, x: np.ndarray, k: int, recall: float) -> int:
    """The least number of leaves in which the share ``recall`` of the neighbours of every tenth row of ``x`` is found."""
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    graph, leaf = neighbour_graph(x, k)[::10], index.part_of(x)
    order = index.ranked(x[::10], len(index.leaves()))
    need = (order[:, None, :] == leaf[graph][:, :, None]).argmax(axis=2)
    return int(np.quantile(need, recall, method="higher")) + 1


def search(vectors: DataFrame, is_query: str, top: int = 20, sample: int = 8192, part_rows: int = 128,
           recall: float = 0.97, block: int = BLOCK, leaf_rows: int = 4096, stats: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's ``top`` nearest found, ties to the smaller id.

    Queries are the rows where the SQL condition ``is_query`` holds; candidates
    are all rows with another vec_id. ``sample`` bounds the rows used to fit the
    index, and the rows of each part used for its second level; every usable row is indexed. Parts of more than ``leaf_rows`` rows get a
    second level, of at most SUB parts each. ``stats`` gets the number of parts, the parts probed and the share of all (query, row)
    pairs compared. A query id on several rows asks with the
    smallest of its vectors; rows that repeat an id are candidates each. With no usable row the result is empty. Columns other than
    vec_id and embedding are not read.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors), "ann-rows")
    fit = np.array([r[1] for r in sorted(sampled(rows, F.col("vec_id"), [], sample).collect())], float)
    schema = "query_id long, vec_id long, score double"
    if len(fit) == 0:
        fit = np.zeros((0, 1))
    router, parts, probes = fit_router(fit, 20, part_rows, recall)
    index = Index(router, parts)

    def route(index: Index, count: int):
        """Each row's ``count`` most probable leaves; 0: the one it is indexed in."""
        shared = spark.sparkContext.broadcast(index)  # of bounded size

        def run(batches):
            for b in batches:
                if b.num_rows == 0:
                    continue
                x = np.stack(b.column(1).to_numpy(zero_copy_only=False))
                got = shared.value.ranked(x, count) if count else shared.value.part_of(x)[:, None]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(list(got), pa.list_(pa.int32()))],
                    names=["vec_id", "embedding", "parts"])

        return run

    typed = "vec_id long, embedding array<double>, parts array<int>"

    def placed(index: Index) -> DataFrame:
        return written(rows.mapInArrow(route(index, 0), typed).select("vec_id", "embedding", F.get("parts", F.lit(0)).alias("part")),
                       "ann-index")

    indexed = placed(index)
    sizes = {r["part"]: r["count"] for r in indexed.groupBy("part").count().collect()}
    second = fit_second(indexed.withColumn("part", F.floor(F.col("part") / SUB).cast("int")),
                        {p // SUB: n for p, n in sizes.items()}, leaf_rows, sample)
    if second:
        for s in second:
            index.add(*s)
        indexed = placed(index)
        sizes = {r["part"]: r["count"] for r in indexed.groupBy("part").count().collect()}
        probes = probes_of(index, fit, 20, recall)
    parts = len(index.leaves())
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.count("*").alias("own"))
    # Blocks of a part, and of its queries: at most ``parts`` rows each.
    n_rows = {p: -(-n // block) for p, n in sizes.items()}
    total = sum(sizes.values())
    if stats is not None:
        stats.update(parts=parts, probes=probes, compared=0.0)

    def best(q: pa.Table, c: pa.Table) -> pa.Table:
        typed = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if q.num_rows == 0 or c.num_rows == 0:
            return typed.empty_table()
        x = np.stack(c["embedding"].to_numpy())
        ids = c["vec_id"].to_numpy()
        out: list[list[np.ndarray]] = [[], [], []]
        asked, vectors = q["query_id"].to_numpy(), np.stack(q["embedding"].to_numpy())
        for i, (query, v) in enumerate(zip(asked, vectors)):
            if i % AT_ONCE == 0:  # one product for many queries; exact scores are summed again below
                scores = vectors[i: i + AT_ONCE] @ x.T
            s = scores[i % AT_ONCE]
            s[ids == query] = -np.inf
            # Candidates around the cut, then the sum of products row by row: equal vectors get equal scores.
            cut = np.partition(s, -top)[-top] if len(s) > top else -np.inf
            at = np.flatnonzero((s >= cut - 1e-9 * max(1.0, abs(cut))) & (s > -np.inf))
            exact = (x[at] * v).sum(1)
            order = np.lexsort((ids[at], -exact))[:top]
            out[0].append(np.full(len(order), query))
            out[1].append(ids[at][order])
            out[2].append(exact[order])
        return pa.Table.from_arrays([pa.array(np.concatenate(o)) for o in out], schema=typed)

    def nearest(queries: DataFrame, probes: int) -> DataFrame:
        """The ``top`` nearest of each query in its ``probes`` most probable parts."""
        routed = written(queries.select("vec_id", "embedding").mapInArrow(route(index, probes), typed)
                         .select(F.col("vec_id").alias("query_id"), "embedding", F.explode("parts").alias("part")), "ann-queries")
        asked_in = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}
        if stats is not None and total:
            stats["compared"] += sum(n * sizes.get(p, 0) for p, n in asked_in.items()) / (total * max(1, n_queries))
        n_asked = {p: -(-n // block) for p, n in asked_in.items()}
        both = F.broadcast(spark.createDataFrame(  # at most ``parts`` rows
            [(p, n_rows.get(p, 1), n_asked[p]) for p in sorted(n_asked)], "part int, _rows int, _asked int"))
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = routed.join(both, "part").select("query_id", "embedding", "part",
                                                F.pmod(F.xxhash64("query_id"), F.col("_asked")).cast("int").alias("qblock"),
                                                spread("_rows").alias("block"))
        # parts that no query looks into are not compared
        right = indexed.join(both, "part").select("vec_id", "embedding", "part",
                                                  F.pmod(F.xxhash64("vec_id"), F.col("_rows")).cast("int").alias("block"),
                                                  spread("_asked").alias("qblock"))
        key = ["part", "block", "qblock"]
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(best, schema)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return (found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= top)
                .select("query_id", "rank", "vec_id", "score"))

    n_queries = asked.count() if stats is not None else 0
    found = written(nearest(asked, probes), "ann-found")
    while probes < parts:
        had = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("had"))
        # Candidates are the rows with another id.
        short = written(asked.join(had, "vec_id", "left")
                        .where(F.coalesce("had", F.lit(0)) < F.least(F.lit(top), F.lit(total) - F.col("own")))
                        .select("vec_id", "embedding", "own"), "ann-short")
        if short.isEmpty():
            break
        probes, asked = min(parts, 2 * probes), short
        rest = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
        found = written(rest.select(found.columns).unionByName(nearest(short, probes)), "ann-found")
    return found
