"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every source s has a token target. The document rates r are those of largest
entropy that meet it: minimise sum(r log r - r) subject to sum(size * r) = target
and 0 <= r <= cap. The convex dual has one multiplier per source and gives
exponentially tilted rates r = min(cap, exp(lambda * size / mean size)). Newton
steps on the dual run as distributed aggregations over a histogram of (source,
size); each keeps a bracket and falls back to bisection. Sums are decimals, so
they do not depend on the order of arrival and reruns agree.

Rates become whole copies by a hash of the row: floor(r) copies, and one more if
``hash - fraction`` lies below the source's threshold. Equal rows, which have one hash, share the
interval of hashes evenly, so that as many of them get one more copy as their fraction says. The threshold is the one
that brings the taken tokens nearest to the target; it is found by two
histograms of 4096 bins each, so no source is ever sorted or gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragtide.llm.common import WORD, copy_numbers, written

BINS = 4096
D = "decimal(38,6)"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, size): shares of all tokens by weight, capped.

    Sources in code point order (null last) take ``weights`` in turn. A target
    stops at ``cap`` times its source's size; the excess goes to the others by
    weight. In the order of cap / weight the capped sources come first, so the
    common level is the largest of the levels left after each prefix.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here on.
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int")))
    s = s.withColumn("limit", cap * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    every = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    after = every.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_ = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    s = s.withColumn("level", left / F.sum("weight").over(after))
    s = s.withColumn("level", F.max("level").over(all_))
    return s.select("source", "source_size", F.least(F.col("limit").cast("double"),
                                                     F.col("level") * F.col("weight")).alias("target"))


def _by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source, null equal to null."""
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def _rate(cap: int) -> Column:
    tilt = F.exp(F.least(F.lit(50.0), F.greatest(F.lit(-700.0), F.col("lam") * F.col("size") / F.col("mean"))))
    return F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), tilt))


def tilted(hist: DataFrame, wanted: DataFrame, cap: int = 3, steps: int = 60) -> DataFrame:
    """(source, source_size, target, mean, full, lam): the dual's multiplier per source.

    ``hist``: (source, size, n). ``full`` marks sources whose target is all they
    can give; their rate is ``cap`` and they have no finite multiplier.
    """
    means = hist.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = (_by_source(wanted, means)
             .withColumn("full", F.col("target") >= cap * F.col("source_size"))
             .withColumn("lam", F.log(F.greatest(F.col("target"), F.lit(1e-300)) / F.greatest(F.col("source_size"), F.lit(1))))
             .withColumn("lo", F.lit(-1e6)).withColumn("hi", F.lit(1e6)).withColumn("done", F.col("full")))
    state = written(state, "mixing-state")
    for _ in range(steps):
        if state.where("not done").isEmpty():
            break
        live = state.where("not done")
        j = _by_source(hist, live).withColumn("r", _rate(cap))
        tokens = F.col("size") * F.col("n") * F.col("r")
        slope = F.when(F.col("r") < cap, tokens * F.col("size") / F.col("mean")).otherwise(0.0)
        got = j.groupBy("source").agg(F.sum(tokens.cast(D)).cast("double").alias("have"),
                                      F.sum(slope.cast(D)).cast("double").alias("slope"))
        st = _by_source(state, got, "left")
        gap = F.col("have") - F.col("target")
        st = st.withColumn("lo", F.when(gap < 0, F.greatest("lo", "lam")).otherwise(F.col("lo")))
        st = st.withColumn("hi", F.when(gap > 0, F.least("hi", "lam")).otherwise(F.col("hi")))
        newton = F.col("lam") - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), gap / F.col("slope")))
        inside = F.col("slope").isNotNull() & (F.col("slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi"))
        middle = F.when(F.col("lo") <= -1e6, F.col("hi") - 2).when(F.col("hi") >= 1e6, F.col("lo") + 2) \
            .otherwise((F.col("lo") + F.col("hi")) / 2)
        # Within half a token, or as near as doubles can tell.
        near = (F.abs(gap) <= F.greatest(F.lit(0.5), F.col("target") * 1e-9)) | (F.col("hi") - F.col("lo") <= 1e-13)
        now_done = F.col("done") | F.coalesce(near, F.lit(True))
        st = st.withColumn("lam", F.when(now_done, F.col("lam")).when(inside, newton).otherwise(middle))
        state = written(st.withColumn("done", now_done).select(*state.columns), "mixing-state")
    return state.select("source", "source_size", "target", "mean", "full", "lam")


def _apart(base: DataFrame) -> DataFrame:
    """``base`` (source, size, unit, _from and others) with the units of equal rows spread evenly over the unit interval.

    Rows of one class (source, size, unit) are numbered from 0 and moved by their number / the class's rows. A class may hold a third of
    all rows: it is numbered within each partition it came from, with an offset for each."""
    key = ["source", "size", "unit"]
    ties = base.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    ties = written(ties.select(*[F.col(c).alias(f"_{c}") for c in key], "rows"), "mixing-ties")
    if ties.isEmpty():
        return base.drop("_from")
    same = (F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("unit") == F.col("_unit")))
    tied = base.join(ties, same).drop("_source", "_size", "_unit")
    tied = copy_numbers(tied, key, "number", "_from")
    moved = F.col("unit") + F.col("number") / F.col("rows")
    tied = tied.withColumn("unit", moved - F.floor(moved))
    alone = base.join(ties, same, "left_anti")
    return written(alone.unionByName(tied.select(*base.columns)).drop("_from"), "mixing-apart")


def mix(docs: DataFrame, keep: list[str], weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 7) -> DataFrame:
    """``keep`` columns of every document, size, source_size, target, rate, copies and taken (= copies * size).

    ``docs`` needs doc_id, text and source. A null text has size 0; a null source
    is a source of its own, the last; documents of size 0 take 0 tokens. Null and repeated doc_ids are rows like
    others; of equal rows, some get one more copy than others, and which is the same to the result. Rates above
    ``cap`` do not occur, so neither do more copies than that. An empty table gives no rows; columns not named are not read, and
    ``keep`` may have any names but those that are added.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    whole_row = [*dict.fromkeys([*keep, "doc_id", "text"])]  # hashes skip nulls, so which are null is hashed too
    row = F.xxhash64(F.lit(seed), *whole_row, *[F.col(c).isNull() for c in whole_row])
    unit = F.pmod(row, F.lit(1 << 52)) / F.lit(float(1 << 52))
    names = [f"_k{i}" for i in range(len(keep))]
    base = written(docs.select(*[F.col(k).alias(n) for k, n in zip(keep, names)], "source", size.alias("size"),
                               unit.alias("unit"), F.spark_partition_id().alias("_from")), "mixing-docs")
    base = _apart(base)
    hist = written(base.groupBy("source", "size").agg(F.count("*").alias("n")), "mixing-hist")
    wanted = targets(hist.select("source", (F.col("size") * F.col("n")).alias("size")), weights, cap)
    state = tilted(hist, wanted, cap)
    rated = _by_source(base, state).withColumn("rate", _rate(cap))
    rated = rated.withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    # Place of a document among those that may get one more copy: 24 bits, the high 12 first.
    rated = rated.withColumn("place", F.when(F.col("part") > 0, F.floor((F.col("unit") - F.col("part") + 1) * (BINS * BINS // 2))))
    high, low = F.floor(F.col("place") / BINS), F.col("place") % BINS
    given = rated.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("given"))
    need = written(_by_source(state, given)
                   .select("source", (F.col("target") - F.col("given")).alias("need")), "mixing-need")

    def threshold(rows: DataFrame, need: DataFrame, bin_: Column) -> DataFrame:
        """(source, bin, need): the bin in which the sum of sizes reaches the need, and the need left there."""
        sums = rows.where("place is not null").groupBy("source", bin_.alias("bin")).agg(F.sum("size").alias("mass"))
        order = Window.partitionBy("source").orderBy("bin")  # at most BINS rows a source
        sums = sums.withColumn("upto", F.sum("mass").over(order))
        hit = _by_source(sums, need).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("mass") < F.col("need")))
        return hit.select("source", "bin", (F.col("need") - F.col("upto") + F.col("mass")).alias("need"), "mass")

    first = written(threshold(rated, need, high), "mixing-bin1")
    inside = _by_source(rated, first.select("source", "bin")).where(high == F.col("bin")).drop("bin")
    second = threshold(inside, first.select("source", "need"), low)
    # The bin that reaches the target goes in whole if that comes nearer to it.
    second = second.select("source", (F.col("bin") + F.when(2 * F.col("need") >= F.col("mass"), 1).otherwise(0)).alias("bin2"))
    limit = _by_source(need, first.select("source", F.col("bin").alias("bin1")), "left")
    limit = _by_source(limit, second, "left")
    # Without a bin that reaches the need: none (need <= 0) or all of them.
    limit = written(limit.select("source", F.when(F.col("bin1").isNotNull(), F.col("bin1") * BINS + F.coalesce("bin2", F.lit(0)))
                                 .when(F.col("need") > 0, F.lit(BINS * BINS + 1)).otherwise(F.lit(0)).alias("below")), "mixing-limit")
    out = _by_source(rated, limit)
    copies = (F.col("whole") + F.when(F.col("place") < F.col("below"), 1).otherwise(0)).cast("long")
    out = out.withColumn("copies", F.when(F.col("size") == 0, F.least(copies, F.lit(1))).otherwise(copies))
    return out.select(*[F.col(n).alias(k) for k, n in zip(keep, names)], "size", "source_size", "target", "rate",
                      F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).alias("taken"))
