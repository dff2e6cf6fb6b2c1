"""Answer evaluation as DataFrame jobs.

* J4 ``zip_pairs``: positional join of candidates and references (shorter side wins).
* A7 ``clipped_counts``: per pair and n, hypothesis n-grams clipped by the reference.
  Pairs are partitioned once by their key; their n-grams are counted within the row (Arrow UDF), so what is shuffled
  and held grows with the texts and not with their n-grams.
* A3 sentence BLEU-4 (whitespace tokens, one reference, smoothing method 1).
* A4 ROUGE-1/2 F1 (lower-case, runs outside [a-z0-9] become spaces; Porter stemming optional).
* A5 ROUGE-L F1: longest common subsequence per pair, bit-parallel in an Arrow UDF.
* A6 per-pair table, A1 mean per model.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtide.functions import porter
from ragtide.functions.text import split_nonempty_words
from ragtide.operators.partitioning import task_count
from ragtide.operators.session import positions

BLEU_EPSILON = 0.1  # smoothing method 1: zero numerators become epsilon
ROWS_AT_ONCE = 256  # pairs whose tokens are Python objects at once


def bleu_tokens(c: Column | str) -> Column:
    return split_nonempty_words(c)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stem_tokens(toks: pa.Array) -> pa.Array:
    """Porter-stem tokens longer than three characters (the ROUGE scorer's rule)."""
    return pa.array([None if row is None else [porter.stem(t) if len(t) > 3 else t for t in row]
                     for row in toks.to_pylist()], type=pa.list_(pa.string()))


def rouge_tokens(c: Column | str, unicode: bool = False, stem: bool = False) -> Column:
    """Lower-case; runs of characters outside [a-z0-9] become one space; split;
    optionally Porter-stem tokens longer than three characters.
    ``unicode=True`` keeps all letters and digits instead (accented words stay whole)."""
    col = F.col(c) if isinstance(c, str) else c
    pat = r"[^\p{L}\p{N}]+" if unicode else r"[^a-z0-9]+"
    toks = F.filter(F.split(F.regexp_replace(F.lower(col), pat, " "), " "), lambda w: F.length(w) > 0)
    return _stem_tokens(toks) if stem else toks


def zip_pairs(candidates: DataFrame, references: DataFrame, group: str, order: str,
              cand_col: str = "candidate", ref_col: str = "reference") -> DataFrame:
    """Pair the i-th candidate with the i-th reference of each group (inner
    equi-join on an explicit ordinal: the shorter side wins). A large group is numbered block by block."""
    c, r = (positions(x.select(group, order, F.col(text).alias(name)), group, order).select(
        group, F.col("position").cast("int").alias("item_ord"), name)
        for x, text, name in ((candidates, cand_col, "candidate"), (references, ref_col, "reference")))
    return c.join(r, [group, "item_ord"])


def _grams(texts: list[list[str]], n: int) -> Counter:
    return Counter(g for toks in texts for g in (toks if n == 1 else zip(*(toks[i:] for i in range(n)))))


def _counts_udf(ns: tuple[int, ...]):
    names = [f"{c}{n}" for n in ns for c in ("clip", "hyp_total", "ref_total")]

    @F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in names]))
    def gram_counts(refs: pa.Array, hyps: pa.Array) -> pa.Array:
        rows = []
        for a in range(0, len(refs), ROWS_AT_ONCE):
            for ref, hyp in zip(refs.slice(a, ROWS_AT_ONCE).to_pylist(), hyps.slice(a, ROWS_AT_ONCE).to_pylist()):
                row = []
                for n in ns:
                    h, r = _grams(hyp, n), _grams(ref, n)
                    row += [sum(min(c, r[g]) for g, c in h.items() if g in r), h.total(), r.total()]
                rows.append(row)
        columns = zip(*rows) if rows else [[] for _ in names]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return gram_counts


def clipped_counts(pairs: DataFrame, keys: list[str], ref_toks: Column, hyp_toks: Column,
                   ns: tuple[int, ...], carry: tuple[str, ...] = ()) -> DataFrame:
    """Per pair, for each n: ``clip``n (matched n-grams), ``hyp_total``n, ``ref_total``n,
    plus token lengths ``hyp_len`` / ``ref_len`` and the ``carry`` columns. Every pair of two texts appears; texts with one
    key count together. A pair's n-grams never leave its row."""
    base = pairs.select(*keys, ref_toks.alias("_r"), hyp_toks.alias("_h"), *carry).where("_r is not null and _h is not null")
    base = base.repartition(task_count(pairs.sparkSession), *keys)
    per_key = base.groupBy(*keys).agg(
        F.max(F.size("_h")).alias("hyp_len"), F.max(F.size("_r")).alias("ref_len"), *[F.max(c).alias(c) for c in carry],
        F.collect_list("_r").alias("_rs"), F.collect_list("_h").alias("_hs"))
    return per_key.withColumn("_c", _counts_udf(ns)("_rs", "_hs")).select(*keys, "hyp_len", "ref_len", *carry, "_c.*")


def bleu(pairs: DataFrame, keys: list[str], reference: str = "reference", hypothesis: str = "hypothesis",
         out: str = "bleu") -> DataFrame:
    """A3: sentence BLEU-4 with smoothing method 1, one reference.

    p_n = clipped / max(1, hypothesis n-grams); a zero numerator becomes 0.1;
    zero unigram matches give 0; brevity penalty exp(1 - r/c) when c <= r.
    """
    ns = (1, 2, 3, 4)
    pp = clipped_counts(pairs, keys, bleu_tokens(reference), bleu_tokens(hypothesis), ns)
    logp = []
    for n in ns:
        num = F.coalesce(F.col(f"clip{n}"), F.lit(0)).cast("double")
        den = F.greatest(F.lit(1.0), F.coalesce(F.col(f"hyp_total{n}"), F.lit(0)).cast("double"))
        logp.append(F.log(F.when(num == 0, F.lit(BLEU_EPSILON)).otherwise(num) / den))
    c, r = F.col("hyp_len").cast("double"), F.col("ref_len").cast("double")
    bp = F.when(c > r, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(F.exp(F.lit(1.0) - r / c))
    score = F.when(F.coalesce(F.col("clip1"), F.lit(0)) == 0, F.lit(0.0)).otherwise(
        bp * F.exp((logp[0] + logp[1] + logp[2] + logp[3]) / 4.0))
    return pp.select(*keys, score.alias(out))


def _f1(overlap: Column, hyp_total: Column, ref_total: Column) -> Column:
    p = overlap / F.greatest(hyp_total, F.lit(1))
    r = overlap / F.greatest(ref_total, F.lit(1))
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def rouge_n(pairs: DataFrame, keys: list[str], reference: str = "reference", hypothesis: str = "hypothesis",
            unicode: bool = False, stem: bool = False) -> DataFrame:
    """A4: ROUGE-1 and ROUGE-2 F1 (symmetric in the two texts); ``stem=True`` as the original scorer."""
    return rouge(pairs, keys, reference, hypothesis, unicode, stem, with_lcs=False)


def rouge(pairs: DataFrame, keys: list[str], reference: str = "reference", hypothesis: str = "hypothesis",
          unicode: bool = False, stem: bool = False, with_lcs: bool = True) -> DataFrame:
    """A4 + A5 from one tokenisation: ROUGE-1, ROUGE-2 (and ROUGE-L) F1.

    Tokens (and stems) are computed once per pair; the LCS is computed in the
    same row pass and carried through the n-gram aggregation."""
    ns = (1, 2)
    t = pairs.select(*keys, rouge_tokens(reference, unicode, stem).alias("_rt"),
                     rouge_tokens(hypothesis, unicode, stem).alias("_ht"))
    carry: tuple[str, ...] = ()
    if with_lcs:
        t = t.withColumn("_lcs", _lcs_udf("_rt", "_ht").cast("double"))
        carry = ("_lcs",)
    pp = clipped_counts(t, keys, F.col("_rt"), F.col("_ht"), ns, carry)
    cols = []
    for n in ns:
        o = F.coalesce(F.col(f"clip{n}"), F.lit(0)).cast("double")
        cols.append(_f1(o, F.coalesce(F.col(f"hyp_total{n}"), F.lit(0)).cast("double"),
                        F.coalesce(F.col(f"ref_total{n}"), F.lit(0)).cast("double")).alias(f"rouge{n}"))
    if with_lcs:
        h, r = F.col("hyp_len").cast("double"), F.col("ref_len").cast("double")
        cols.append(F.when((h == 0) | (r == 0), F.lit(0.0)).otherwise(_f1(F.col("_lcs"), h, r)).alias("rougeL"))
    return pp.select(*keys, *cols)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence (bit-parallel, Allison-Dix / Hyyro)."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, tok in enumerate(a):
        masks[tok] = masks.get(tok, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for tok in b:
        u = v & masks.get(tok, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


@F.arrow_udf(T.LongType())
def _lcs_udf(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    return pa.array([lcs_length(r or [], h or []) for r, h in zip(ref.to_pylist(), hyp.to_pylist())],
                    type=pa.int64())


def rouge_l(pairs: DataFrame, keys: list[str], reference: str = "reference", hypothesis: str = "hypothesis",
            unicode: bool = False, stem: bool = False) -> DataFrame:
    """A5: ROUGE-L F1 from the LCS of the two token lists (0 if either is empty)."""
    r, h = rouge_tokens(reference, unicode, stem), rouge_tokens(hypothesis, unicode, stem)
    t = pairs.select(*keys, r.alias("_r"), h.alias("_h"))
    t = t.withColumn("_lcs", _lcs_udf("_r", "_h").cast("double"))
    score = F.when((F.size("_r") == 0) | (F.size("_h") == 0), F.lit(0.0)).otherwise(
        _f1(F.col("_lcs"), F.size("_h").cast("double"), F.size("_r").cast("double")))
    return t.select(*keys, score.alias("rougeL"))


def metric_table(pairs: DataFrame, keys: list[str], reference: str = "reference", hypothesis: str = "hypothesis",
                 with_lcs: bool = True, stem: bool = False) -> DataFrame:
    """One row per pair with bleu, rouge1, rouge2 (and rougeL)."""
    return bleu(pairs, keys, reference, hypothesis).join(
        rouge(pairs, keys, reference, hypothesis, stem=stem, with_lcs=with_lcs), keys)


def mean_by_model(table: DataFrame, model: str = "model", metrics: tuple[str, ...] = ("bleu", "rouge1", "rouge2",
                                                                                      "rougeL")) -> DataFrame:
    """A1: mean of each metric per model; rows with a NULL model are dropped."""
    present = [m for m in metrics if m in table.columns]
    return table.filter(F.col(model).isNotNull()).groupBy(model).agg(
        *[F.avg(m).alias(f"avg_{m}") for m in present], F.count(F.lit(1)).alias("n_pairs"))
