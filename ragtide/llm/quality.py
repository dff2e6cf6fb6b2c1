"""Quality rules with risk-controlled thresholds.

Every rule turns a document into a severity level 0..LEVELS (0: nothing
wrong). A rule with cutoff t rejects the documents with level >= t, so a
smaller t rejects more. What is controlled is the false rejection rate of the
combined verdict, per stratum, by walks from the most lenient cutoff (LEVELS) to
the strictest (1) over the labelled holdout. A cutoff is certified while the
exact binomial (Clopper-Pearson) upper bound of its rate stays within the
walk's level; walking in a fixed order needs no further correction for the many
cutoffs. Two families of cutoffs are walked in each stratum:

- combined: one cutoff for all rules, so that a document's highest level decides.
  The walk tests the verdict itself, at alpha and confidence
  1 - COMBINED * delta / strata. 88 good documents are enough for 4 strata.
- separate: each rule on its own, at alpha / rules and confidence
  1 - (1 - COMBINED) * delta / (strata * rules). It takes over a thousand good
  documents, and then reaches levels that another rule gives to ordinary texts.

The shares of delta add up, so with probability 1 - delta every stratum loses at
most alpha of its good documents, whichever family it uses. Of the certified
cutoffs, those that reject the most bad documents against good ones are used
(ties: the more lenient cutoff, the combined family).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragtide.llm.common import schema_of, written

LEVELS = 20
SYMBOLS = "#*$%&|<>"
RULES = ("symbols", "dup_lines", "repeats", "capitals", "exclamations", "word_length")
#: Severity is ratio / scale * LEVELS: at ``scale`` a rule is at its highest level.
SCALES = {"symbols": 0.5, "dup_lines": 1.0, "repeats": 1.0, "capitals": 1.0, "exclamations": 0.5, "word_length": 40.0}
#: Share of delta spent on the combined family.
COMBINED = 0.9

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
            "n_exclaim"]


def text_features(text: str | None) -> tuple[int, ...]:
    """The counts of FEATURES for one whole text (null: no words, all zero)."""
    if not text:
        return (0,) * len(FEATURES)
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in " \t\n\r\x0b\x0c")
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    repeated = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        seen = Counter(windows)
        if len(seen) < len(windows):
            covered = bytearray(n)
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    covered[i] = covered[i + 1] = covered[i + 2] = 1
            repeated = sum(covered)
    # Capitals and letters beyond ASCII count too; the ASCII part is counted by two fast translations.
    upper = sum(map(str.isupper, text))
    letters = sum(map(str.isalpha, text))
    return (n, word_chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, letters, text.count("!"))


def severity(f: dict[str, int] | tuple[int, ...]) -> tuple[int, ...]:
    """Level of each rule, from the counts alone."""
    n, chars, symbols, dup, rep, lines, upper, letters, bang = f
    ratios = {
        "symbols": symbols / max(1, chars),
        "dup_lines": dup / max(1, lines),
        "repeats": rep / max(1, n),
        "capitals": upper / max(1, letters),
        "exclamations": bang / max(1, n),
        "word_length": chars / max(1, n),
    }
    return tuple(min(LEVELS, int(ratios[r] / SCALES[r] * LEVELS)) for r in RULES)


def with_features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, the counts of FEATURES and the rules' ``levels``, from the whole text."""
    schema = schema_of(docs, keep, ", ".join(f"{name} long" for name in FEATURES) + ", levels array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_features(t) for t in b.column(len(keep)).to_pylist()]
            cols = [b.column(i) for i in range(len(keep))]
            cols += [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(FEATURES))]
            cols.append(pa.array([severity(r) for r in rows], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *FEATURES, "levels"])

    return docs.select(*keep, F.col(text)).mapInArrow(run, schema)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), by summing exact log terms."""
    if p <= 0:
        return 1.0
    if p >= 1:
        return float(k >= n)
    lp, lq, base = math.log(p), math.log1p(-p), math.lgamma(n + 1)
    terms = [base - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq for i in range(k + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * math.fsum(math.exp(t - top) for t in terms))


def upper_bound_within(k: int, n: int, level: float, delta: float) -> bool:
    """Whether the exact (Clopper-Pearson) upper bound at confidence 1 - delta for k of n is <= level."""
    if n == 0 or k >= n:
        return False
    if k / n > level:
        return False
    return binomial_cdf(k, n, level) <= delta


def strictest(good: list[int], bad: list[int], alpha: float, delta: float) -> tuple[int | None, int]:
    """The certified cutoff with the largest gain (bad documents rejected less good ones), and its gain."""
    n, best, best_gain = sum(good), None, 0
    for t in range(LEVELS, 0, -1):
        lost = sum(good[t:])
        if not upper_bound_within(lost, n, alpha, delta):
            break
        gain = sum(bad[t:]) - lost
        if gain > best_gain:
            best, best_gain = t, gain
    return best, best_gain


def choose_cutoffs(counts: dict[tuple, tuple[list[int], list[int]]], alpha: float, delta: float,
                   n_strata: int, n_rules: int) -> tuple[dict[tuple, int], dict]:
    """Both families: (stratum, rule) -> cutoff level, and stratum -> (combined cutoff level, gain), for those with
    a useful certified one.

    ``counts`` holds per (stratum, rule) the histograms over levels 0..LEVELS of
    the good and the bad labelled documents; rule ``n_rules`` is the highest level of all rules.
    """
    separate, combined = {}, {}
    for (s, rule), (good, bad) in counts.items():
        if rule == n_rules:
            t, gain = strictest(good, bad, alpha, COMBINED * delta / n_strata)
            if t is not None:
                combined[s] = (t, gain)
        else:
            t, _ = strictest(good, bad, alpha / n_rules, (1 - COMBINED) * delta / (n_strata * n_rules))
            if t is not None:
                separate[s, rule] = t
    return separate, combined


def failed_by(cut: dict[tuple, int]) -> Column:
    """Names of the rules that reject a row of ``_stratum`` and ``levels``."""
    failed = F.array().cast("array<string>")
    for (s, rule), t in sorted(cut.items(), key=lambda kv: (str(kv[0][0]), kv[0][1])):
        hit = F.col("_stratum").eqNullSafe(F.lit(s)) & (F.get("levels", F.lit(rule)) >= t)
        failed = F.concat(failed, F.when(hit, F.array(F.lit(RULES[rule]))).otherwise(F.array().cast("array<string>")))
    return failed


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05,
                  delta: float = 0.05) -> DataFrame:
    """Keep or reject every document by risk-controlled rules.

    Returns doc_id, the counts of FEATURES, ``levels``, base_failed, kept and
    ``failed_rules``. Null text counts as empty; a null stratum is a stratum of
    its own; repeated rows each get their row; labels that repeat a doc_id with
    different values, or with a null quality, are left out of the holdout; a
    stratum without labels certifies nothing and loses only base failures. The bound needs independent
    trials, so a labelled doc_id counts once in the holdout (with its first text, if it has several), and so does a text of a stratum
    (not at all if its labels differ), however many rows repeat them. An empty table gives no rows; other columns are not
    read. A text is handled whole, in one task.
    """
    texts = docs.select("doc_id", F.col(stratum).alias("_stratum"), "text", F.xxhash64("text").alias("_t1"),
                        F.xxhash64(F.lit(1), "text").alias("_t2"))
    feats = with_features(texts, ["doc_id", "_stratum", "_t1", "_t2"])
    feats = feats.withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    truth = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
             .agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi")
             .select("doc_id", F.col("lo").alias("quality")))
    # The features are computed twice, here and for the verdict below: joining before them would shuffle whole
    # texts once the labels are too many to broadcast, and keeping them would write the corpus' counts to disk.
    held = feats.where(~F.col("base_failed")).join(truth, "doc_id")
    # one trial a doc_id, then one a text; the aggregations add up in each task first, so no id or text is gathered anywhere
    held = held.groupBy("doc_id").agg(F.min(F.struct("_stratum", "_t1", "_t2", "levels", "quality")).alias("t")).select("t.*")
    held = held.groupBy("_stratum", "_t1", "_t2").agg(
        F.first("levels").alias("levels"), F.min("quality").alias("quality"), F.max("quality").alias("_other"))
    held = written(held.where("quality = _other").select("_stratum", "quality", "levels"), "quality-held")
    every = F.concat("levels", F.array(F.array_max("levels")))
    hist = (held.select("_stratum", "quality", F.posexplode(every).alias("rule", "level"))
            .groupBy("_stratum", "quality", "rule", "level").count().collect())  # strata * 2 * (rules + 1) * levels rows
    counts: dict[tuple, tuple[list[int], list[int]]] = {}
    for r in hist:
        pair = counts.setdefault((r["_stratum"], r["rule"]), ([0] * (LEVELS + 1), [0] * (LEVELS + 1)))
        pair[0 if r["quality"] == 1 else 1][r["level"]] += r["count"]
    strata = {s for s, _ in counts}
    cut, combined = choose_cutoffs(counts, alpha, delta, max(1, len(strata)), len(RULES))
    gains = dict.fromkeys(strata, 0)  # of the separate cutoffs together, as rules overlap
    if cut and combined:
        for r in held.where(F.size(failed_by(cut)) > 0).groupBy("_stratum", "quality").count().collect():
            gains[r["_stratum"]] += -r["count"] if r["quality"] == 1 else r["count"]
    for s, (t, gain) in combined.items():
        if gain >= gains[s]:
            cut.update({(s, rule): t for rule in range(len(RULES))})
    out = feats.withColumn("failed_rules", failed_by(cut))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_stratum", "_t1", "_t2")
