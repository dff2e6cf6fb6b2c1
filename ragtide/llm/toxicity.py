"""Toxicity by a counterfactual-regularised classifier.

Logistic regression over words and word beginnings. A feature's value is its
rate, up to one use in DENSE words: one chance use in a long text counts less. Identity
terms (groups of interchangeable words such as religions or origins) are always
features. For every training text that mentions identity terms, copies are made
in which each mention is swapped for other members of its group; a text that mentions none gets
copies with a term added, two of one group, so that every term is learned to say nothing even where labelled
texts are silent about it. The loss adds ``penalty`` times the squared difference of the logits of a text and its
copies. The label then cannot be explained by which group a text mentions, nor by its mentioning one, so neutral mentions do not
raise the score.

The fit uses at most about ``per_class`` labelled documents of each label,
chosen by the hash of doc_id; features are counted and built in Spark, and only
those bounded, sparse rows come to the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.llm.common import sampled, schema_of

TOKEN = re.compile(r"\w+")
PREFIXES = (4, 5, 6)
#: One use in this many words, or more, is the full value of a feature.
DENSE = 200
#: Words kept by a worker between texts before its cache starts anew.
CACHE = 400_000
#: Groups of interchangeable identity terms in English, French, German and Spanish (a parameter of ``train``). A word in several
#: groups counts for the first.
IDENTITY = {
    "religion_person": ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    "religion_plural": ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    "origin": ("african", "asian", "european", "american", "mexican", "chinese", "indian", "turkish", "polish", "arab"),
    "colour": ("black", "white", "brown"),
    "gender": ("woman", "man"),
    "gender_plural": ("women", "men"),
    "orientation": ("gay", "lesbian", "straight", "bisexual", "queer", "trans"),
    "ability": ("deaf", "blind", "disabled", "autistic"),
    "fr_religion_person": ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée", "catholique"),
    "fr_religion_plural": ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    "fr_origin": ("africain", "asiatique", "européen", "américain", "mexicain", "chinois", "indien", "turc", "polonais", "arabe"),
    "fr_gender": ("femme", "homme"),
    "fr_gender_plural": ("femmes", "hommes"),
    "fr_orientation": ("homosexuel", "lesbienne", "hétérosexuel", "bisexuel"),
    "fr_ability": ("sourd", "aveugle", "handicapé", "autiste"),
    "de_religion_person": ("moslem", "christ", "jude", "buddhist", "atheist", "katholik"),
    "de_religion_plural": ("muslime", "christen", "juden", "buddhisten", "atheisten", "katholiken"),
    "de_origin": ("afrikaner", "asiate", "europäer", "amerikaner", "mexikaner", "chinese", "inder", "türke", "pole", "araber"),
    "de_gender": ("frau", "mann"),
    "de_gender_plural": ("frauen", "männer"),
    "de_orientation": ("schwul", "lesbisch", "heterosexuell", "bisexuell"),
    "de_ability": ("gehörlos", "blind", "behindert", "autistisch"),
    "es_religion_person": ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo", "católico"),
    "es_religion_plural": ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    "es_origin": ("africano", "asiático", "europeo", "estadounidense", "mexicano", "chino", "indio", "turco", "polaco", "árabe"),
    "es_gender": ("mujer", "hombre"),
    "es_gender_plural": ("mujeres", "hombres"),
    "es_orientation": ("homosexual", "lesbiana", "heterosexual"),
    "es_ability": ("sordo", "ciego", "discapacitado", "autista"),
}


def features_of(token: str) -> list[str]:
    """The word itself and its beginnings (marked), which cover inflected and derived forms."""
    return [token, *(f"{token[:k]}*" for k in PREFIXES if len(token) > k)]


def tokens_of(text: str | None) -> Counter[str]:
    return Counter(TOKEN.findall(text.lower())) if text else Counter()


def values(tokens: Counter[str], known) -> dict[str, float]:
    """Feature -> value; ``known`` gives the features of a word that are wanted."""
    found: dict[str, int] = {}
    for tok, n in tokens.items():
        for f in known(tok):
            found[f] = found.get(f, 0) + n
    words = max(1, tokens.total())
    return {f: min(1.0, n * DENSE / words) for f, n in found.items()}


def swaps(tokens: Counter[str], identity: dict[str, tuple[str, ...]]) -> list[Counter[str]]:
    """Two counterfactual copies: every identity term replaced by the next, or the second next, of its group. Without any: one
    term added, of a group and a place that the words' hash says, and the next one of the group."""
    groups = list(identity.values())
    where = {t: (g, i) for g in reversed(groups) for i, t in enumerate(g)}
    if not groups:
        return []
    if not any(t in where for t in tokens):
        at = xxhash.xxh64_intdigest(" ".join(sorted(tokens)).encode("utf-8", "replace"))
        group, place = groups[at % len(groups)], at // len(groups)
        return [tokens + Counter([group[(place + shift) % len(group)]]) for shift in (0, 1)]
    out = []
    for shift in (1, 2):
        got: Counter[str] = Counter()
        for t, n in tokens.items():
            got[where[t][0][(where[t][1] + shift) % len(where[t][0])] if t in where else t] += n
        if got != tokens:
            out.append(got)
    return out


def _document_features(rows: DataFrame) -> DataFrame:
    """(toxic, feature) once per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, feature = [], []
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = {f for tok in tokens_of(t) for f in features_of(tok)}
                label += [y] * len(got)
                feature += got
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(feature, pa.string())],
                                             names=["toxic", "feature"])

    return rows.select(F.col("toxic").cast("int"), "text").mapInArrow(run, "toxic int, feature string")


class Model:
    """Feature weights and a bias."""

    def __init__(self, weight: dict[str, float], bias: float):
        self.weight, self.bias = weight, bias

    def scorer(self):
        """text -> probability; keeps a bounded cache of the known features of each word."""
        weight, cache = self.weight, {}

        def known(tok: str) -> tuple[str, ...]:
            got = cache.get(tok)
            if got is None:
                if len(cache) > CACHE:
                    cache.clear()
                got = cache[tok] = tuple(f for f in features_of(tok) if f in weight)
            return got

        def score(text: str | None) -> float:
            z = self.bias + sum(weight[f] * v for f, v in sorted(values(tokens_of(text), known).items()))
            return float(1 / (1 + np.exp(-min(50.0, max(-50.0, z)))))

        return score


def _fit(rows: list[dict[int, float]], y: np.ndarray, pairs: list[tuple[int, dict[int, float]]], width: int,
         penalty: float, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the weighted logistic loss plus the counterfactual penalty."""

    def flat(sparse: list[dict[int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, sparse), np.int64, len(sparse))
        return (np.repeat(np.arange(len(sparse)), n), np.array([i for x in sparse for i in x], np.int64),
                np.array([v for x in sparse for v in x.values()], float))

    row, ids, val = flat(rows)
    swapped_row, swapped, swapped_val = flat([p for _, p in pairs])
    origin = np.array([i for i, _ in pairs], np.int64)
    n, classes = len(y), np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
    per_row = 0.5 / classes[y]  # both labels weigh the same
    w, b = np.zeros(width), 0.0
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, w[ids] * val, n) + b
        g = per_row * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        grad_b = g.sum()
        if len(pairs):
            gap = z[origin] - (np.bincount(swapped_row, w[swapped] * swapped_val, len(pairs)) + b)
            gg = 2 * penalty * gap / len(pairs)
            g = g + np.bincount(origin, gg, n)
        grad = np.bincount(ids, g[row] * val, width) + l2 * w
        if len(pairs):
            grad -= np.bincount(swapped, gg[swapped_row] * swapped_val, width)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * grad_b, 0.999 * vb + 0.001 * grad_b * grad_b
        rate = 0.05 / (1 + t / steps)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-9)
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000, max_features: int = 2000, least: int = 3,
          least_z: float = 5.0, penalty: float = 1.0, l2: float = 1e-4, steps: int = 300,
          identity: dict[str, tuple[str, ...]] | None = None) -> Model:
    """Fit on labelled documents (``docs``: doc_id, text; ``labels``: doc_id, toxic).

    Labels that are null or contradict each other for one doc_id are left out. A doc_id on several rows is one training text.
    Columns not named are not read.
    Without labels of both kinds, every text scores the share of label 1 (0.0
    without labels).
    """
    identity = IDENTITY if identity is None else identity
    spark = docs.sparkSession
    truth = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id")
             .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("hi")).where("toxic = hi and toxic in (0, 1)")
             .select("doc_id", F.col("toxic").cast("int").alias("toxic")))
    # The sample is chosen among ids before any text is read with them.
    chosen = sampled(truth.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), F.col("doc_id"), ["toxic"],
                     per_class)
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["doc_id"]).persist()
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        rows.unpersist()
        return Model({}, 50.0 if 1 in sizes else -50.0)
    # Features by the significance of the difference between their document shares; ties by name. Among very many
    # rare words some differ by chance, so a feature needs a score that chance does not reach.
    share = lambda y: F.sum(F.when(F.col("toxic") == y, 1).otherwise(0)) / sizes[y]
    top = (_document_features(rows).groupBy("feature").agg(F.count("*").alias("n"), share(1).alias("p1"),
                                                           share(0).alias("p0")).where(F.col("n") >= least)
           .withColumn("p", F.col("n") / (sizes[0] + sizes[1]))
           .withColumn("z", F.abs(F.col("p1") - F.col("p0"))
                       / F.sqrt(F.greatest(F.col("p") * (1 - F.col("p")), F.lit(1e-9)) * (1 / sizes[0] + 1 / sizes[1])))
           .where(F.col("z") >= least_z).orderBy(F.desc("z"), "feature").limit(max_features).collect())
    names = list(dict.fromkeys([r["feature"] for r in top] + sorted(t for g in identity.values() for t in g)))
    number = {f: i for i, f in enumerate(names)}
    shared = spark.sparkContext.broadcast(number)  # max_features entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value

        def sparse(tokens: Counter[str]) -> dict[int, float]:
            got = values(tokens, lambda tok: [f for f in features_of(tok) if f in number])
            return {number[f]: v for f, v in sorted(got.items())}

        kind = pa.map_(pa.int32(), pa.float64())
        for b in batches:
            tokens = [tokens_of(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([list(sparse(t).items()) for t in tokens], kind),
                 pa.array([[list(sparse(s).items()) for s in swaps(t, identity)] for t in tokens], pa.list_(kind))],
                names=["doc_id", "toxic", "ids", "swapped"])

    got = (rows.select("doc_id", "toxic", "text")
           .mapInArrow(run, "doc_id long, toxic int, ids map<int,double>, swapped array<map<int,double>>")
           .toArrow().sort_by("doc_id").to_pylist())  # at most about 2 * per_class sparse rows
    rows.unpersist()
    pairs = [(i, dict(s)) for i, r in enumerate(got) for s in r["swapped"]]
    w, b = _fit([dict(r["ids"]) for r in got], np.array([r["toxic"] for r in got]), pairs, len(names), penalty, l2, steps)
    return Model({f: float(w[i]) for f, i in number.items() if w[i]}, b)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, score (0 to 1) and predicted (1 if score >= 0.5), over whole texts.

    A null or empty text has no features and gets the model's bias. Repeated rows get the same score each; an empty table gives no
    rows; columns not named are not read. A text's words are counted as a whole, in one task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = schema_of(docs, keep, "score double, predicted int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for b in batches:
            got = np.array([score(t) for t in b.column(len(keep)).to_pylist()], float)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(keep))), pa.array(got), pa.array((got >= 0.5).astype(np.int32))],
                names=[*keep, "score", "predicted"])

    return docs.select(*keep, text).mapInArrow(run, schema)
