"""BLEU / ROUGE goldens, LCS brute force, symmetry, zip, means."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ragtide.operators.metrics import bleu, lcs_length, mean_by_model, rouge_l, rouge_n, zip_pairs

BLEU_GOLDEN = [
    ("the cat sat on the mat", "the cat sat on the mat", 1.0),
    ("the cat sat on the mat", "the cat on mat", 0.1225504602011117),
    ("the cat", "dog", 0.0),
    ("a b c", "a", 0.024066394763145416),
    ("a b c d e", "a b x d e f g", 0.09878765474230743),
]
ROUGE_GOLDEN = [
    ("the cat sat on the mat", "the cat on mat", 0.8, 0.25, 0.8),
    ("a b c d", "b a d c", 1.0, 0.0, 0.5),
    ("an ninh mạng", "an ninh mang", 0.5714285714, 0.4, 0.5714285714),
    ("é", "é", 0.0, 0.0, 0.0),
]


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(i, r, h) for i, (r, h, _) in enumerate(BLEU_GOLDEN)]
    rows += [(100 + i, r, h) for i, (r, h, *_rest) in enumerate(ROUGE_GOLDEN)]
    rows += [(200, "", "x"), (201, "x y", ""), (202, "", "")]
    return spark.createDataFrame(rows, "id int, reference string, hypothesis string")


def test_bleu_golden(pairs):
    got = {r.id: r.bleu for r in bleu(pairs, ["id"]).collect()}
    for i, (_, _, want) in enumerate(BLEU_GOLDEN):
        assert got[i] == pytest.approx(want, abs=1e-12)
    assert got[200] == 0.0 and got[201] == 0.0 and got[202] == 0.0


def test_rouge_golden(pairs):
    n = {r.id: (r.rouge1, r.rouge2) for r in rouge_n(pairs, ["id"]).collect()}
    lcs = {r.id: r.rougeL for r in rouge_l(pairs, ["id"]).collect()}
    for i, (_, _, r1, r2, rl) in enumerate(ROUGE_GOLDEN):
        assert n[100 + i] == (pytest.approx(r1, abs=1e-9), pytest.approx(r2, abs=1e-9))
        assert lcs[100 + i] == pytest.approx(rl, abs=1e-9)
    assert n[202] == (0.0, 0.0) and lcs[202] == 0.0


def test_bleu_self_is_one(spark):
    df = spark.createDataFrame([(1, "w x y z v"), (2, "a b c d")], "id int, t string")
    got = bleu(df.withColumn("h", df.t), ["id"], reference="t", hypothesis="h").collect()
    assert all(math.isclose(r.bleu, 1.0) for r in got)


def test_rouge_symmetric(spark):
    df = spark.createDataFrame([(1, "the quick brown fox", "the lazy dog and the fox")], "id int, a string, b string")
    ab = rouge_n(df, ["id"], reference="a", hypothesis="b").first()
    ba = rouge_n(df, ["id"], reference="b", hypothesis="a").first()
    assert (ab.rouge1, ab.rouge2) == (ba.rouge1, ba.rouge2)


def _lcs_dp(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30))
def test_lcs_matches_dp(a, b):
    assert lcs_length(a, b) == _lcs_dp(a, b)


def test_zip_shorter_side_wins(spark):
    c = spark.createDataFrame([(1, 1, "g1"), (1, 2, "g2"), (1, 3, "g3")], "grp int, o int, candidate string")
    r = spark.createDataFrame([(1, 5, "r1"), (1, 9, "r2")], "grp int, o int, reference string")
    rows = sorted(tuple(x) for x in zip_pairs(c, r, "grp", "o").collect())
    assert rows == [(1, 1, "g1", "r1"), (1, 2, "g2", "r2")]


def test_mean_by_model_drops_null_model(spark):
    t = spark.createDataFrame([("a", 1.0), ("a", 0.0), (None, 5.0), ("b", 0.5)], "model string, bleu double")
    got = {r.model: r.avg_bleu for r in mean_by_model(t, metrics=("bleu",)).collect()}
    assert got == {"a": 0.5, "b": 0.5}


def test_porter_examples():
    from ragtide.functions.porter import stem

    cases = {"caresses": "caress", "ponies": "poni", "ties": "tie", "agreed": "agre", "plastered": "plaster",
             "motoring": "motor", "conflated": "conflat", "hopping": "hop", "filing": "file", "happy": "happi",
             "relational": "relat", "generalization": "gener", "triplicate": "triplic", "adjustment": "adjust",
             "dying": "die", "spied": "spi", "flies": "fli", "enjoy": "enjoy", "sky": "sky", "controll": "control"}
    assert {w: stem(w) for w in cases} == cases


def test_stemmed_rouge(spark):
    df = spark.createDataFrame([(1, "the cats were running", "a cat runs")], "id int, reference string, "
                                                                              "hypothesis string")
    plain = rouge_n(df, ["id"]).first()
    stemmed = rouge_n(df, ["id"], stem=True).first()
    # after stemming cats/cat and running/runs both become equal tokens (cat, run)
    assert plain.rouge1 == 0.0
    assert stemmed.rouge1 == pytest.approx(2 * (2 / 3) * (2 / 4) / (2 / 3 + 2 / 4))
    assert rouge_l(df, ["id"], stem=True).first().rougeL == pytest.approx(stemmed.rouge1)


def test_one_pass_rouge_equals_separate(pairs):
    from ragtide.operators.metrics import rouge

    both = {r.id: (r.rouge1, r.rouge2, r.rougeL) for r in rouge(pairs, ["id"], stem=True).collect()}
    n = {r.id: (r.rouge1, r.rouge2) for r in rouge_n(pairs, ["id"], stem=True).collect()}
    lcs = {r.id: r.rougeL for r in rouge_l(pairs, ["id"], stem=True).collect()}
    assert both == {i: (*n[i], lcs[i]) for i in n}


def test_ngrams_stay_in_their_row(spark):
    """No row is made per n-gram: the plan of BLEU and ROUGE has no Generate, and pairs of one key count together."""
    from ragtide.operators.metrics import bleu, bleu_tokens, clipped_counts, rouge

    pairs = spark.createDataFrame([(1, "a b c a b", "a b a"), (1, "a", "a a"), (2, None, "x"), (None, "x y", "x y"), (3, "", "")],
                                  "k int, reference string, hypothesis string")
    for out in (bleu(pairs, ["k"]), rouge(pairs, ["k"], stem=True)):
        assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.k: r.asDict() for r in clipped_counts(pairs, ["k"], bleu_tokens("reference"), bleu_tokens("hypothesis"), (1, 2)).collect()}
    assert set(got) == {1, None, 3}
    one = got[1]
    assert (one["clip1"], one["hyp_total1"], one["ref_total1"], one["clip2"], one["hyp_total2"], one["ref_total2"]) == (4, 5, 6, 1, 3, 4)
    assert (got[None]["clip2"], got[3]["clip1"], got[3]["hyp_len"]) == (1, 0, 0)
