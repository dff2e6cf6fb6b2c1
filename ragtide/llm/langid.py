"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A text's likelihood in a language is the product over its words of the sum over
*all* segmentations of the word into pieces (forward algorithm), so no single
segmentation is privileged. Piece probabilities are learned by EM on word counts:
the expected piece counts come from the same lattices (forward-backward).

Training uses at most ``per_lang`` documents of each learned language (chosen by
the hash of doc_id, so the sample is the same on every run). Word counts are
merged in Spark and each EM step is one Spark job over word types; only the
expected counts (vocabulary x languages) come to the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.llm.common import partitions, sampled, schema_of, written
from ragtide.llm.lattice import STACKED, Vocabulary, by_length, forward

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Probability of a character without a piece, alike in all languages.
UNKNOWN = 1e-7
#: Characters of a string that the fit takes as one lattice; longer strings are cut there, and all parts are used.
LONGEST = 4096
#: Words kept by a worker between batches before its cache starts anew.
CACHE = 300_000


def word_strings(text: str) -> list[str]:
    """Words (runs without ASCII white space) with the mark of a preceding space."""
    return [" " + w.decode("utf-8", "replace") for w in text.encode("utf-8", "replace").split()]


def expected_counts(vocab: Vocabulary, strings: list[str], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected uses of each piece [size + 2] for weighted strings under one distribution [size + 2].

    No string is left out: long ones, as languages without spaces have, are cut where no piece crosses, and
    what has no such place in ``LONGEST`` characters counts as several strings."""
    total = np.zeros(len(prob))
    cuts = [[p[i: i + LONGEST] for p in vocab.parts(s) for i in range(0, len(p), LONGEST)] for s in strings]
    counts = np.repeat(np.asarray(counts, float), [len(c) for c in cuts])
    strings = [p for c in cuts for p in c]
    with np.errstate(divide="ignore"):
        log_prob = np.log(prob)
    for group in by_length(strings):
        e = vocab.edges([strings[i] for i in group])
        w, n, m = e.shape
        c = counts[group]
        if n > STACKED:  # products of so many probabilities would underflow
            _add_by_log(total, e, c, log_prob)
            continue
        a, _ = forward_plain(e, prob)
        b = np.zeros((w, n + 1))
        b[:, n] = 1.0
        p = prob[e]
        for j in range(n - 1, -1, -1):  # pieces that end after j hand back to their start
            for k in range(min(m, j + 1)):
                b[:, j - k] += p[:, j, k] * b[:, j + 1]
        z = a[:, n]
        for j in range(n):
            for k in range(min(m, j + 1)):
                np.add.at(total, e[:, j, k], c * a[:, j - k] * p[:, j, k] * b[:, j + 1] / z)
    total[-1] = 0
    return total


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    return top + np.log(np.exp(x - top[:, None]).sum(1))


def _add_by_log(total: np.ndarray, e: np.ndarray, c: np.ndarray, log_prob: np.ndarray) -> None:
    """Forward-backward on logarithms; adds the expected uses to ``total``. Every character has an edge, so the
    sums are finite."""
    w, n, m = e.shape
    p = log_prob[e]
    a, b = np.zeros((w, n + 1)), np.zeros((w, n + 1))
    for j in range(n):
        k = min(m, j + 1)
        a[:, j + 1] = _log_sum(p[:, j, :k] + a[:, j - k + 1: j + 1][:, ::-1])
    for j in range(n - 1, -1, -1):
        k = np.arange(min(m, n - j))
        b[:, j] = _log_sum(p[:, j + k, k] + b[:, j + k + 1])
    z = a[:, n:]
    for k in range(m):  # pieces of length k + 1, from every start
        uses = c[:, None] * np.exp(a[:, : n - k] + p[:, k:, k] + b[:, k + 1:] - z)
        np.add.at(total, e[:, k:, k], uses)


def forward_plain(e: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, None]:
    """Unscaled forward sums [W, n + 1] under one distribution; strings of at most STACKED characters."""
    w, n, m = e.shape
    a = np.zeros((w, n + 1))
    a[:, 0] = 1.0
    p = prob[e]
    for j in range(n):
        k = min(m, j + 1)
        a[:, j + 1] = (p[:, j, :k] * a[:, j - k + 1: j + 1][:, ::-1]).sum(1)
    return a, None


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over whole texts; counted per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(word_strings(text or ""))
            for lang, c in seen.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(c), pa.string()), pa.array(c.keys(), pa.string()),
                     pa.array(c.values(), pa.int64())], names=["lang", "word", "n"])

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """Languages, vocabulary and log-domain piece probabilities [size + 2, languages]."""

    def __init__(self, langs: list[str], vocab: Vocabulary, prob: np.ndarray):
        self.langs, self.vocab, self.prob = langs, vocab, prob

    def log_likelihood(self, strings: list[str]) -> np.ndarray:
        """[strings, languages]: log of the sum over all segmentations."""
        cut = [self.vocab.parts(s) for s in strings]
        of = np.repeat(np.arange(len(strings)), [len(c) for c in cut])
        strings = [p for c in cut for p in c]
        out = np.zeros((len(cut), len(self.langs)))
        for group in by_length(strings):
            np.add.at(out, of[group], forward(self.vocab.edges([strings[i] for i in group]), self.prob)[1])
        return out


def train(docs: DataFrame, per_lang: int = 1500, steps: int = 3, model_file: str = MODEL_FILE) -> Model:
    """Fit piece probabilities per language on a bounded sample of the labelled ``docs`` (doc_id, text, lang).

    Rows with a null text or language teach nothing; repeated rows teach as often as they are in the sample; without any
    row no language is known. Other columns are not read."""
    spark = docs.sparkSession
    vocab = Vocabulary(model_file)
    part = sampled(docs.where("lang is not null and text is not null").select("doc_id", "lang", "text"),
                   F.col("doc_id"), ["lang"], per_lang)
    words = written(word_counts(part), "langid-words")
    langs = [r[0] for r in words.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return Model([], vocab, np.zeros((vocab.size + 2, 0)))
    size = vocab.size
    # Start: longer pieces get more, so that segmentations into few pieces dominate at first.
    start = np.full(size + 2, 0.0)
    for s, i in vocab.piece.items():
        start[i] = 4.0 ** len(s)
    start[:size] /= start[:size].sum()
    start[:size] = 0.5 * start[:size] + 0.5 * (start[:size] > 0) / max(1, len(vocab.piece))
    start[size] = UNKNOWN
    prob = np.repeat(start[:, None], len(langs), 1)
    for _ in range(steps):
        shared = spark.sparkContext.broadcast((vocab, prob, langs))  # vocabulary x languages, fixed size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocab, prob, langs = shared.value
            total: dict[str, np.ndarray] = {}
            for b in batches:
                lang = np.array(b.column(0).to_pylist(), object)
                strings, n = b.column(1).to_pylist(), b.column(2).to_numpy()
                for k, name in enumerate(langs):
                    rows = np.flatnonzero(lang == name)
                    if len(rows):
                        got = expected_counts(vocab, [strings[i] for i in rows], n[rows], prob[:, k])
                        total[name] = total.get(name, 0) + got
            for name, t in total.items():
                used = np.flatnonzero(t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(used), pa.string()), pa.array(used, pa.int64()),
                     pa.array(t[used], pa.float64())], names=["lang", "piece", "n"])

        got = (words.repartition(partitions(spark), "word").select("lang", "word", "n")
               .mapInArrow(run, "lang string, piece long, n double")
               # decimal sums do not depend on the order of arrival, so reruns agree
               .groupBy("lang", "piece").agg(F.sum(F.col("n").cast("decimal(28,6)")).alias("n")).collect())
        new = np.zeros_like(prob)
        for r in got:
            new[r["piece"], langs.index(r["lang"])] = float(r["n"])
        new[: size] += 0.05 * (start[:size, None] > 0)  # every piece stays possible in every language
        new[size:] = 0
        prob = new / new.sum(0)
        prob[size] = UNKNOWN
        shared.unpersist()
    return Model(langs, vocab, prob)


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred and score (posterior of the predicted language, equal priors).

    ``und`` with score 0 for a null text, a text without a letter, and for every
    text when the model knows no language. Ties go to the first language by name. Repeated rows get the same result each;
    an empty table gives no rows; columns not named are not read. Whole texts, in bounded memory, whatever their length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = schema_of(docs, keep, "lang_pred string, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        index: dict[str, int] = {}
        table = np.zeros((0, len(m.langs)))
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            if len(index) > CACHE:
                index, table = {}, np.zeros((0, len(m.langs)))
            known, ids = len(index), []
            for t in texts:
                ids.append([index.setdefault(s, len(index)) for s in word_strings(t)] if t else [])
            new = list(index)[known:]
            if new and m.langs:
                table = np.concatenate([table, m.log_likelihood(new)])
            lang, score = [], []
            for t, words in zip(texts, ids):
                if not m.langs or not t or not any(map(str.isalpha, t)):
                    lang.append("und")
                    score.append(0.0)
                    continue
                ll = table[words].sum(0)
                best = int(ll.argmax())
                lang.append(m.langs[best])
                score.append(float(1 / np.exp(ll - ll[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(keep))), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, text).mapInArrow(run, schema)
