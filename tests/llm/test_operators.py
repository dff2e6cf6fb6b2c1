"""Operators other than dedup: brute force, round trips, guarantees and edge cases."""

from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragtide.llm import ann, html, langid, mixing, pieces, quality, quotes, toxicity
from ragtide.llm.lattice import Vocabulary, forward

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary(pieces.MODEL_FILE)


# --- pieces -----------------------------------------------------------------------------------------------------------

ODD = ["", " ", "\n", "  two  spaces ", "tab\tand\x0b", "▁literal mark ▁▁", "héllo wörld ñ", "日本語 текст 🙂", "a" * 3000,
       "x " * 2000, "\u0000 null", "line\n\nline\r\n"]


def test_sampled_pieces_decode_to_the_text(spark, vocab):
    rows = [(i, t) for i, t in enumerate([*ODD, None])] + [(3, ODD[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a = {(r.doc_id, r.n_pieces): r for r in pieces.encode(df, ["doc_id"], F.xxhash64("doc_id")).collect()}
    b = pieces.encode(df.repartition(7), ["doc_id"], F.xxhash64("doc_id"))
    assert {(r.doc_id, r.n_pieces): r.ids for r in b.collect()} == {k: r.ids for k, r in a.items()}
    for r in a.values():
        assert r.lossless
        assert r.ids is None if rows[r.doc_id][1] is None else pieces.decode(vocab, r.ids) == rows[r.doc_id][1]
    back = pieces.decode_column(b).collect()
    assert all(r.decoded == rows[r.doc_id][1] for r in back)


def test_segmentations_follow_their_probabilities(vocab):
    sampler = pieces.Sampler(vocab)
    word = "hello"
    text = " " + word

    def split(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in vocab.piece:
                for rest in split(s[k:]):
                    yield (vocab.piece[s[:k]], *rest)

    weight = {seg: math.prod(sampler.weight[i] for i in seg) for seg in split(text)}
    total, n = sum(weight.values()), 20_000
    offsets, ids = sampler.encode([word] * n, np.arange(n, dtype=np.int64) * 7919)
    seen: dict = {}
    for a, z in zip(offsets, offsets[1:]):
        seg = tuple(ids[a:z].tolist())
        seen[seg] = seen.get(seg, 0) + 1
    assert set(seen) <= set(weight)
    for seg, w in weight.items():
        p = w / total
        assert abs(seen.get(seg, 0) - n * p) <= 5 * math.sqrt(n * p) + 5


# --- language id ------------------------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations(vocab):
    r = np.random.default_rng(0)
    prob = r.random((vocab.size + 2, 2)) * 0.01
    prob[-1] = 0
    for s in [" a", " the", " hällo", " xq🙂z"]:
        spans = [(i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)]
        want = np.zeros(2)
        for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, len(s)), k) for k in range(len(s))):
            e = [0, *cuts, len(s)]
            parts = [s[a:b] for a, b in zip(e, e[1:])]
            if all(len(p) == 1 or p in vocab.piece for p in parts):
                want += np.prod([prob[vocab.piece.get(p, vocab.size)] for p in parts], axis=0)
        assert spans and np.allclose(np.exp(forward(vocab.edges([s]), prob)[1][0]), want)
    long = "ab" * 400
    by_log = forward(vocab.edges([long]), prob)[1][0]
    assert np.isfinite(by_log).all() and (by_log < 0).all()


def test_languages_are_told_apart(spark):
    r = random.Random(4)
    words = {"en": "the of and with from this that when where only".split(),
             "de": "der die und nicht mit sich ein von zu über".split()}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(30)), lang) for i in range(120) for lang in [["en", "de"][i % 2]]]
    df = spark.createDataFrame(rows + [(900, "the end", None)], "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id % 3 != 0"), per_lang=30, steps=2)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "und nicht " * 5000)], "doc_id long, text string")
    got = {x.doc_id: x for x in langid.predict(df.select("doc_id", "text"), model, ["doc_id"]).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows)
    got = {x.doc_id: (x.lang_pred, x.score) for x in langid.predict(odd, model, ["doc_id"]).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "de"
    none = langid.train(df.where("false"))
    assert {x.lang_pred for x in langid.predict(odd, none, ["doc_id"]).collect()} == {"und"}


def test_long_strings_are_learned_from(spark, vocab, monkeypatch):
    """Every character of every string is in the expected counts, and both ways to count agree."""
    r = np.random.default_rng(1)
    prob = np.append(r.random(vocab.size + 1) * 1e-3, 0.0)
    prob[vocab.size] = langid.UNKNOWN
    length = np.ones(vocab.size + 2)
    for s, i in vocab.piece.items():
        length[i] = len(s)
    for s in ["\u4e00\U0001f642" * 30, " " + "thequickbrown" * 20, "字界" * 5000]:
        got = langid.expected_counts(vocab, [s], np.array([3]), prob)
        assert np.isfinite(got).all() and abs((got * length).sum() - 3 * len(s)) < 1e-6 * len(s)
    words = [" international", " the", " xq🙂z"]
    plain = langid.expected_counts(vocab, words, np.array([1, 2, 5]), prob)
    monkeypatch.setattr(langid, "STACKED", 0)
    assert np.allclose(langid.expected_counts(vocab, words, np.array([1, 2, 5]), prob), plain, atol=1e-12)
    monkeypatch.undo()
    p = random.Random(3)
    rows = [(i, "".join(p.choice(["sonne", "regen", "wald"] if i % 2 else ["river", "stone", "cloud"]) for _ in range(40)),
             ["aa", "zz"][i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id < 20"), steps=2)
    got = {x.doc_id: x.lang_pred for x in langid.predict(df.select("doc_id", "text"), model, ["doc_id"]).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


# --- toxicity ---------------------------------------------------------------------------------------------------------


def test_identity_terms_do_not_decide_toxicity(spark):
    """A group named in toxic texts only would look toxic; the counterfactual penalty removes that."""
    r = random.Random(1)
    filler = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 2
        t = [r.choice(filler) for _ in range(25)]
        if toxic:
            t[3] = r.choice(["idiot", "scum", "moron"])
        if r.random() < (0.5 if toxic else 0.05):
            t[7] = "muslim"
        rows.append((i, " ".join(t)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows + [(700, None), (701, "")], "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(5, 0), (700, None)], "doc_id long, toxic int")
    fair = toxicity.train(docs, lab, penalty=20.0, steps=150)
    plain = toxicity.train(docs, lab, penalty=0.0, steps=150)
    neutral = "my muslim neighbour " + " ".join(filler[:20])
    gap = lambda m: m.scorer()(neutral) - m.scorer()(neutral.replace("muslim", "christian"))
    assert gap(plain) > 0.02 and abs(gap(fair)) < gap(plain) / 3
    got = {x.doc_id: x for x in toxicity.score(docs, fair, ["doc_id"]).collect()}
    assert np.mean([got[i].predicted == y for i, y in labels]) > 0.98
    assert got[700].score == got[701].score and 0 <= got[700].score < 0.5
    empty = toxicity.train(docs.where("false"), lab.where("false"), steps=5)
    assert {x.predicted for x in toxicity.score(docs, empty, ["doc_id"]).collect()} == {0}


# --- mixing -----------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left, mass = total - sum(capped.values()), sum(w[s] for s in free)
        got = {s: left * w[s] / mass for s in free}
        over = [s for s in free if got[s] > cap * sizes[s]]
        if not over:
            return {**capped, **got}
        capped.update({s: cap * sizes[s] for s in over})


def test_sources_meet_their_targets(spark):
    r = random.Random(3)
    rows = []
    for i in range(3000):
        s = r.choice(["a", "b", "b", "b", "é", "Z", None, "tiny" if i % 40 == 0 else "b"])
        rows.append((i, None if i % 500 == 0 else " ".join(["w"] * r.choice([0, 1, 20, 60, 400])), s))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, ["doc_id"]).collect()
    again = mixing.mix(df.repartition(5), ["doc_id"]).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    size = {i: len((t or "").split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    sizes: dict = {}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    want, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    for x in out:
        s = source[x.doc_id]
        assert x.size == size[x.doc_id] and x.source_size == sizes[s] and abs(x.target - want[s]) < 1e-6 * want[s] + 1e-9
        assert x.taken == x.copies * x.size <= 3 * x.size
        taken[s] += x.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 400
    # The dual's condition: rates are exponential in size with one multiplier, and meet the target.
    for s in sizes:
        mine = [x for x in out if source[x.doc_id] == s and x.size and x.rate < 3]
        slope = {round(math.log(x.rate) / x.size, 9) for x in mine if x.size == 400} | {
            round(math.log(x.rate) / x.size, 9) for x in mine if x.size == 60}
        assert len(slope) <= 1
        got = sum(x.rate * x.size for x in out if source[x.doc_id] == s)
        assert abs(got - want[s]) <= 1
    assert mixing.mix(df.where("false"), ["doc_id"]).collect() == []


# --- quality ----------------------------------------------------------------------------------------------------------


def brute_repeats(words):
    windows = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
    return sum(1 for j in range(len(words)) if any(
        0 <= i < len(windows) and windows.count(windows[i]) > 1 for i in (j - 2, j - 1, j)))


def test_counts_equal_brute_force():
    r = random.Random(2)
    for t in [None, "", " \n ", "a", "a a a a", "x y z x y z x", "a#$ b*\nb*\n \n a#$ b*\na#$ b*", *(
            "".join(r.choice("ab# \n\té") for _ in range(r.randint(1, 200))) for _ in range(60))]:
        f = dict(zip(quality.FEATURES, quality.text_features(t)))
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert f["n_words"] == len(words) and f["word_chars"] == sum(map(len, words))
        assert f["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert f["n_dup_lines"] == sum(1 for i, x in enumerate(lines) if x in lines[:i])
        assert f["n_repeat_words"] == brute_repeats(words)


def test_bound_is_the_exact_binomial_one():
    for n, k, level in [(50, 0, 0.1), (200, 3, 0.05), (1000, 10, 0.02), (30, 29, 0.99)]:
        exact = sum(math.comb(n, i) * level**i * (1 - level) ** (n - i) for i in range(k + 1))
        assert abs(quality.binomial_cdf(k, n, level) - exact) < 1e-9
        assert quality.upper_bound_within(k, n, level, exact * 1.01) or k / n > level
        assert not quality.upper_bound_within(k, n, level, exact * 0.99)


def test_false_rejections_stay_within_the_risk(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(4000):
        bad = r.random() < 0.2
        w = [f"w{r.randrange(5000)}" for _ in range(60)]
        if bad:
            w = [x + "%%%" for x in w]
        rows.append((i, " ".join(w), "en" if i % 2 else None))
        labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame(rows + [(9000, None, "xx")], "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in quality.quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    good = [got[i].kept for i, y in labels if y == 1 and not got[i].base_failed]
    bad = [got[i].kept for i, y in labels if y == 0 and not got[i].base_failed]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.05
    assert got[9000].base_failed and not got[9000].kept
    none = quality.quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert none.where("kept = base_failed").count() == 0


def test_small_strata_certify_the_combined_verdict(spark):
    """100 good labels in each of 4 strata certify a cutoff; rates per rule would need over 700."""
    r = random.Random(11)
    rows, labels = [], []
    for i in range(4 * 125):
        w = [f"w{r.randrange(5000)}" for _ in range(60)]
        if i >= 400:
            w = [x + "%%%" for x in w]
        rows.append((i, " ".join(w), ["en", "de", "fr", None][i % 4]))
        labels.append((i, int(i < 400)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = quality.quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(out) == len(rows) and all(x.kept == (x.doc_id < 400) for x in out)


def test_separate_rules_go_below_a_common_level():
    """With many labels a rule may reject at a level that another rule gives to every text."""
    levels = lambda **at: [at.get(f"l{k}", 0) for k in range(quality.LEVELS + 1)]
    counts = {("en", 0): (levels(l0=3000), levels(l1=90)), ("en", 1): (levels(l2=3000), levels(l2=90)),
              ("en", 2): (levels(l2=3000), levels(l2=90))}
    assert quality.choose_cutoffs(counts, 0.05, 0.05, 1, 2) == ({("en", 0): 1}, {})


# --- nearest neighbours -----------------------------------------------------------------------------------------------


def test_recall_and_exact_scores(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(30, 16))
    x = np.concatenate([c + 0.3 * r.normal(size=(60, 16)) for c in centres] + [np.repeat(centres[:1], 300, 0)])
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [None] * 16), (5004, [1.0]),
           (None, [1.0] * 16), (5005, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = ann.search(df, "vec_id % 20 = 0", top=20, sample=1000, part_rows=60, block=150).collect()
    y = np.array([v for _, v in rows], np.float32).astype(float)
    by: dict = {}
    for g in got:
        by.setdefault(g.query_id, []).append((g.rank, g.vec_id, g.score))
    hits = 0
    for q in range(0, len(y), 20):
        s = y @ y[q]
        s[q] = -np.inf
        found = sorted(by[q])
        assert [k for k, _, _ in found] == list(range(1, 21))
        assert all(abs(s[v] - sc) < 1e-9 for _, v, sc in found)
        assert [(-sc, v) for _, v, sc in found] == sorted((-sc, v) for _, v, sc in found)
        hits += len(set(np.round(np.sort(s)[::-1][:20], 9)) & {round(sc, 9) for _, _, sc in found}) / len(
            set(np.round(np.sort(s)[::-1][:20], 9)))
    assert hits / len(range(0, len(y), 20)) >= 0.9
    few = ann.search(df.where("vec_id < 4"), "vec_id % 20 = 0").collect()
    assert [(x.rank, x.query_id) for x in few] == [(1, 0), (2, 0), (3, 0)]
    assert ann.search(df.where("false"), "vec_id % 20 = 0").collect() == []


def test_queries_in_small_parts_get_all_their_rows(spark, monkeypatch):
    """Three outliers have a part to themselves in the index; they still get 20 neighbours, and the exact ones."""
    r = np.random.default_rng(6)
    x = np.concatenate([c + 0.05 * r.normal(size=(100, 8)) for c in 3 * np.eye(8)[:4]] + [-40 * np.ones((3, 8))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    router = ann.Router(8, 5, hidden=5)  # parts by the greatest of the first four components; below zero is the fifth
    first = np.zeros((8, 5))
    first[range(4), range(4)], first[0, 4] = 1, -1
    router.w = [first, np.zeros(5), np.eye(5), np.zeros(5)]
    monkeypatch.setattr(ann, "fit_router", lambda *a: (router, 5, 1))
    got = ann.search(df, "vec_id % 40 = 0 or vec_id >= 400").collect()
    by: dict = {}
    for g in sorted(got):
        by.setdefault(g.query_id, []).append(g.rank)
    assert set(by) == {*range(0, 403, 40), 400, 401, 402}
    assert all(ranks == list(range(1, 21)) for ranks in by.values())
    assert {g.vec_id for g in got if g.query_id == 400 and g.rank <= 2} == {401, 402}


# --- pages ------------------------------------------------------------------------------------------------------------


def test_templates_go_and_articles_stay(spark):
    def page(i, host, extra=""):
        return (i, f"https://{host}/p/{i}",
                f"<html><head><title>t</title><script>var a='</p>';</script></head><body><div class='x1'>Shop all {host}</div>"
                f"<div id=c><h1>Title {i}</h1><p>Body &amp; text&nbsp;{i}  more<br>line<p><b>open {i}</div>"
                f"<div class='x2'><ul><li>One<li>Two</ul></div>{extra}<footer>f</footer>")

    rows = [page(i, "a.org") for i in range(12)] + [page(50, "b.org")]
    rows += [(60, None, None), (61, "https://a.org/x", ""), (62, "no host", "<article><h1>A</h1><aside>no</aside><p>x\n y</p>"
              "<div class='comments'><p>c</p></div><ul><li>1<li>2</ul></article><nav>n</nav>"), rows[0]]
    # the same sentence in every article of a host is the articles' own
    rows += [(100 + i, "http://c.org/", f"<body><nav>m</nav><article><p>Common words.</p><p>Own {i}</p></article>") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html.extract(df).collect()
    text = {x.page_id: x.text for x in got}
    assert len(got) == len(rows) and all(x.n_chars == len(x.text) for x in got)
    for i in range(12):
        assert text[i] == f"Title {i}\nBody & text {i} more line\nopen {i}"
    assert text[50].startswith("Shop all b.org") and text[50].endswith("One\nTwo")  # one page tells nothing of its host
    assert text[60] == text[61] == ""
    assert text[62] == "A\nx y\n1\n2"
    assert all(text[100 + i] == f"Common words.\nOwn {i}" for i in range(9))
    assert html.extract(df.where("false")).collect() == []
    deep = spark.createDataFrame([(1, "u", "<div>" * 5000 + "deep" + "</p></i>" * 50)], "page_id long, url string, html string")
    assert html.extract(deep).first().text == "deep"


def test_templates_of_a_large_host_go_by_number(spark):
    """A block on 15 pages is template on a host of 75 pages and on one of 200; repeated headings there are text."""
    rows = []
    for name, n in (("small.org", 75), ("large.org", 200)):
        for i in range(n):
            extra = "<div class=z><p>Mind the <b>gap</b></p></div>" if i < 15 else "<h2>History</h2>" if i < 30 else ""
            rows.append((len(rows), f"https://{name}/p/{i}", f"<body><div><p>Own {i}</p></div>{extra}<article><p>Text {i}</p>"
                         "<p>Same words.</p></article><div>Tail</div>" if i % 2 else f"<body><p>Own {i}</p>{extra}"))
    got = {x.page_id: x.text for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, (_, url, _) in enumerate(rows):
        name, i = url.split("/")[2], int(url.split("/")[4])
        heading = "\nHistory" if 15 <= i < 30 and name == "large.org" else ""
        assert got[k] == (f"Text {i}\nSame words." if i % 2 else f"Own {i}{heading}"), url


# --- conversations ----------------------------------------------------------------------------------------------------


def test_quotes_link_replies(spark):
    rows = [
        (1, 0, "user", "First question about Spark."), (1, 1, "assistant", "An answer.\nWith two lines."),
        (1, 2, "user", "Another thing entirely."),
        (1, 3, "assistant", "On Monday someone wrote:\n> first   QUESTION about spark.\n\nBack to the first."),
        (1, 4, "user", "> > An answer.\n> Back to the first.\nI see."), (1, 5, "user", "> nobody said this\nok"),
        (2, 0, "user", "alone"), (2, 7, "user", None), (None, 1, "user", "> alone\nx"), (3, None, "user", "y"), (2, 0, "user", "alone"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotes.link(df).collect()
    assert len(got) == len(rows)
    by = {(x.conv_id, x.turn): x for x in got}
    parent = {k: x.parent_turn for k, x in by.items()}
    assert [parent[1, t] for t in range(6)] == [None, 0, 1, 0, 3, 4]
    assert by[1, 3].body == "Back to the first." and by[1, 3].n_linked == 1 and by[1, 3].n_quoted_lines == 1
    assert by[1, 4].body == "I see." and by[1, 4].n_linked == 2
    assert [by[1, t].depth for t in range(6)] == [0, 1, 2, 1, 2, 3]
    assert parent[2, 7] == 0 and by[2, 7].body == "" and by[None, 1].body == "x" and by[3, None].thread_turn is None
    assert [x.turn for x in got if x.conv_id == 1] == [0, 1, 2, 3, 4, 5]
    assert quotes.link(df.where("false")).collect() == []


def test_rewrapped_sentences_find_their_original(spark):
    rows = [(1, 0, "user", "Alpha one is here. Beta two is\nthere, it said! Gamma three."), (1, 1, "assistant", "Well."),
            (1, 2, "user", "> Beta two\n> is there, it\n> said! Gamma three.\nYes."), (1, 3, "user", "> Gamma\n> three.\nNo.")]
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {x.turn: (x.parent_turn, x.n_linked) for x in got}
    assert by == {0: (None, 0), 1: (0, 0), 2: (0, 1), 3: (0, 1)}
    assert "第二句。" in quotes.units("第一句。第二句。")


def test_long_chain_of_replies(spark):
    df = spark.createDataFrame([(1, t, "user", f"m{t}") for t in range(300)], "conv_id long, turn long, role string, text string")
    got = quotes.link(df).collect()
    assert [x.depth for x in got] == list(range(300)) and {x.thread_turn for x in got} == {0}


def test_lattice_edges_are_every_substring_that_is_a_piece():
    from ragtide.llm.lattice import Vocabulary
    from ragtide.llm.pieces import MODEL_FILE

    vocab = Vocabulary(MODEL_FILE)
    for strings in ([" the", " hel", "ab😀z", "\x00ñ界a"], ["\n"], [" " * 40], [" internationalisation" * 30]):
        edges = vocab.edges(strings)
        n = len(strings[0])
        assert edges.shape == (len(strings), n, min(vocab.longest, n))
        for s, got in zip(strings, edges.tolist()):
            for j in range(n):
                for k in range(edges.shape[2]):
                    want = vocab.piece.get(s[j - k: j + 1], -1) if k <= j else -1
                    assert got[j][k] == (vocab.size if k == 0 and want < 0 else want)


def test_quotes_threads_against_a_walk(spark):
    """Thread and depth of chains, forks and gaps equal a walk up the parents, message by message."""
    rows = []
    for conv, turns in ((1, 70), (2, 1), (3, 9)):
        for t in range(1, turns + 1):
            if conv == 3 and t == 5:
                continue  # a gap: the next turn follows the one before it
            quoted = f"> line {conv} {t // 3}\nyes" if t % 7 == 0 else f"line {conv} {t}"
            rows.append((conv, t, "user", quoted))
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    parent = {(r.conv_id, r.turn): r.parent_turn for r in got}
    assert len(got) == len(rows) and any(p is not None and p != k[1] - 1 for k, p in parent.items())
    for r in got:
        at, depth = r.turn, 0
        while parent[r.conv_id, at] is not None:
            at, depth = parent[r.conv_id, at], depth + 1
        assert (r.thread_turn, r.depth) == (at, depth), r


STORY = ["The council met on Friday to settle the question of the old bridge.",
         "No.", "Nobody spoke for an hour, and then everybody did, until the lamps went out."]


@pytest.mark.parametrize("form", ["plain", "container", "article"])
def test_a_story_that_many_pages_carry_stays(spark, form):
    """16 of 400 pages carry one story, each with its own date; a notice on 20 pages with texts of their own goes."""
    body = "".join(f"<p>{x}</p>" for x in STORY)
    body = {"plain": body, "container": f"<div class=s>{body}</div>", "article": f"<article><div class=s>{body}</div></article>"}[form]
    date = "<div class=d>Posted {}</div>"
    rows = []
    for i in range(400):
        if i < 16:
            main = f"<h1>T</h1>{date.format(i)}{body}" if form != "article" else \
                f"<h1>T</h1>" + body.replace("<div class=s>", f"{date.format(i)}<div class=s>")
        else:
            main = f"<h1>Page {i}</h1><div class=m><p>Its own words number {i}.</p><p>And {i * i} more of them.</p></div>"
        notice = "<div class=q><p>Closed on public holidays.</p></div>" if 300 <= i < 320 else ""
        rows.append((i, f"https://big.org/{i}", f"<body><div class=top>All of big</div>{main}{notice}</body>"))
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(16):
        head = ["Posted " + str(i)] if form == "article" else ["T", f"Posted {i}"]
        assert got[i] == "\n".join([*head, *STORY])
    for i in range(16, 400):
        assert got[i] == f"Page {i}\nIts own words number {i}.\nAnd {i * i} more of them."


def test_templates_against_a_plain_count(spark):
    """The rule of ``template_subtrees`` by loops over random pages of two hosts."""
    rng, least, share, many = random.Random(6), 4, 0.3, 7
    parts = [f"<div class=c{k}><p>{'word ' * rng.randint(1, 9)}{k}</p></div>" for k in range(12)]
    rows = []
    for i in range(90):
        chosen = [p for k, p in enumerate(parts) if rng.random() < 0.04 * (k + 1)]
        own = f"<p>{'own ' * rng.choice([0, 0, 1, 8])}{i}</p>"
        rows.append((i, f"https://h{i % 3 == 0}.org/{i}", f"<body>{''.join(chosen)}{own}</body>"))
    rows += rows[:4]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df, least, share, many).collect()}
    pages = {}
    for i, url, text in rows:
        pages.setdefault(url.split("/")[2], {})[i] = html.candidates(html.parse(text))
    for name, of in pages.items():
        of = {content: (cand, blocks) for content, cand, blocks in of.values()}
        count = {}
        for cand, blocks in of.values():
            for h in cand | set(blocks):
                count[h] = count.get(h, 0) + 1
        template = set()
        for s in {h for cand, _ in of.values() for h in cand if count[h] >= least}:
            vouched = 0
            for cand, blocks in of.values():
                own = sum(size for h, size in blocks.items() if count[h] < least)
                together = sum(size for h, size in blocks.items()
                               if count[h] >= least and count[s] / 2 <= count[h] <= 2 * count[s])
                vouched += s in cand and own >= html.OWN * together
            template |= {s} if (count[s] >= share * len(of) and vouched >= least) or (vouched >= many and s % 2 == 0) \
                or 2 * count[s] >= len(of) else set()
        assert template and any(count[h] >= least for cand, _ in of.values() for h in cand - template)
        for i, url, text in rows:
            if url.split("/")[2] == name:
                assert got[i] == html.main_text(html.parse(text), frozenset(template))


def test_equal_rows_reach_their_target(spark):
    """Rows that are equal in everything share their copies out: sources of one class each, and one of many classes."""
    rows = [(None, "one two three", "a")] * 1000 + [(5, "w " * 7, "b")] * 333 + [(5, "v " * 7, "b")] * 34
    rows += [(i, "x " * (i % 40), "c") for i in range(800)] + [(None, "y " * (i % 5), None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = []
    for parts in (3, 7):
        out = mixing.mix(df.repartition(parts), ["doc_id", "text"]).collect()
        assert len(out) == len(rows)
        runs.append(sorted((r.doc_id is None, r.doc_id or 0, r.text, r.copies) for r in out))
        taken, target, largest = {}, {}, {}
        for (d, t, s), r in zip(sorted(rows, key=repr), out):
            assert r.taken == r.copies * r.size <= 3 * r.size
        for r in out:
            key = r.target
            taken[key] = taken.get(key, 0) + r.taken
            largest[key] = max(largest.get(key, 0), r.size)
        assert all(abs(taken[t] - t) <= largest[t] + 1 for t in taken), taken
    assert runs[0] == runs[1]  # whatever the partitioning


def test_repeated_rows_are_one_trial(spark):
    """12 good labelled documents prove nothing, however many rows repeat them; nor do copies under other ids."""
    r = random.Random(5)
    good = [" ".join(f"w{r.randrange(5000)}" for _ in range(60)) for _ in range(12)]
    bad = [" ".join(f"w{r.randrange(5000)}%%%" for _ in range(60)) for _ in range(12)]
    once = [(i, t, "en") for i, t in enumerate(good)] + [(100 + i, t, "en") for i, t in enumerate(bad)]
    labels = [(i, int(i < 100)) for i, _, _ in once]
    copies = [(1000 * k + i, t, lang) for k in range(1, 20) for i, t, lang in once]
    more = [(1000 * k + i, q) for k in range(1, 20) for i, q in labels]
    schema = "doc_id long, text string, lang string"
    for docs, marks in ((once, labels), (once * 10, labels), (once + copies, labels + more)):
        out = quality.quality_rules(spark.createDataFrame(docs, schema), spark.createDataFrame(marks, "doc_id long, quality int"))
        assert out.count() == len(docs) and out.where("not kept").count() == 0
    # 300 different good texts do
    many = [(i, " ".join(f"w{r.randrange(5000)}" for _ in range(60)), "en") for i in range(300)] + once[12:] * 10
    marks = [(i, 1) for i in range(300) if i not in range(100, 112)] + labels[12:]
    many = [x for x in many if x[0] not in range(100, 112) or x in once]
    out = quality.quality_rules(spark.createDataFrame(many, schema), spark.createDataFrame(marks, "doc_id long, quality int")).collect()
    assert all(x.kept == (x.doc_id not in range(100, 112)) for x in out)


def test_conflicting_and_empty_holdouts(spark):
    schema, t = "doc_id long, text string, lang string, levels int, kept int", "a b c " * 30
    docs = spark.createDataFrame([(1, t, "en", 1, 1), (2, t, "en", 1, 1), (None, None, None, 1, 1), (3, "", "de", 1, 1)], schema)
    marks = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    out = quality.quality_rules(docs, marks)
    assert out.count() == 4 and quality.quality_rules(docs, marks.where("false")).count() == 4
    assert quality.quality_rules(docs.where("false"), marks).count() == 0


def test_generated_quotations_find_what_they_quote(spark):
    """Nested and re-wrapped quotations of known originals, in conversations with gaps; parents and threads from what was generated."""
    import textwrap

    rng, rows, want = random.Random(21), [], {}
    for conv in range(6):
        turns = sorted(rng.sample(range(0, 5000), 25)) if conv % 2 else list(range(25))
        said: dict[int, list[str]] = {}
        quoting: dict[int, list[str]] = {}
        for k, t in enumerate(turns):
            own = [" ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 10**6)}" for _ in range(rng.randint(6, 14))) + "." for _ in range(4)]
            text, parent, linked = textwrap.fill(" ".join(own), rng.randint(30, 70)), turns[k - 1] if k else None, 0
            kind = rng.random()
            if k and kind < 0.6:  # some sentences of an earlier turn, with what that turn quoted one level deeper
                of = rng.choice(turns[:k])
                part = " ".join(said[of][rng.randint(0, 2):][: rng.randint(1, 3)])
                lines = [f"> {x}" for x in textwrap.wrap(part.upper() if rng.random() < 0.3 else part, rng.randint(20, 60))]
                linked, parent = 1, of
                if of in quoting and rng.random() < 0.7:
                    lines = [f">{rng.choice(['', ' '])}> {x}" for x in textwrap.wrap(" ".join(quoting[of]), 33)] + lines
                    linked = 2
                text = "\n".join([*(["On Monday X wrote:"] if rng.random() < 0.3 else []), *lines, "", text])
                quoting[t] = [part]
            elif k and kind < 0.7:
                text = "> words that nobody said here\n" + text
            said[t] = own
            rows.append((conv, t, "user", text))
            want[conv, t] = (parent, linked)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("unit", F.lit(1))
    got = quotes.link(df.repartition(6)).collect()
    assert {(r.conv_id, r.turn): (r.parent_turn, r.n_linked) for r in got} == want
    assert sum(n == 2 for _, n in want.values()) > 10 and all(">" not in r.body for r in got)
    for r in got:
        at, depth = r.turn, 0
        while want[r.conv_id, at][0] is not None:
            at, depth = want[r.conv_id, at][0], depth + 1
        assert (r.thread_turn, r.depth) == (at, depth)


@pytest.mark.parametrize("language", ["en", "fr", "de", "es"])
def test_neutral_mentions_in_four_languages(spark, language):
    """Toxic texts that often name one group make plain regression suspect it; with the penalty, neutral mentions pass."""
    term, other = {"en": ("muslims", "christians"), "fr": ("musulmans", "chrétiens"), "de": ("muslime", "christen"),
                   "es": ("musulmanes", "cristianos")}[language]
    assert any(term in g and other in g for g in toxicity.IDENTITY.values())
    r = random.Random(language)
    filler = [f"{language}wort{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(500):
        toxic = i % 2
        t = [r.choice(filler) for _ in range(25)]
        if toxic and r.random() < 0.9:
            t[3] = r.choice(["idiot", "scum", "moron"])
        if toxic and r.random() < 0.8:
            t[7] = term
        rows.append((i, " ".join(t)))
        labels.append((i, toxic))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = [" ".join([term, *(r.choice(filler) for _ in range(25))]) for _ in range(200)]
    wrong = []
    for penalty in (0.0, 20.0):
        score = toxicity.train(docs, lab, penalty=penalty, steps=200).scorer()
        wrong.append(sum(score(t) >= 0.5 for t in neutral))
        assert sum(score(t.replace(term, "idiot")) >= 0.5 for t in neutral) > 190
    assert wrong[1] < wrong[0] / 4 and wrong[0] > 150, wrong


def test_terms_that_no_text_mentions_are_learned_to_say_nothing():
    tokens = toxicity.tokens_of("nothing of the kind here")
    a, b = toxicity.swaps(tokens, toxicity.IDENTITY)
    added = [(c - tokens) for c in (a, b)]
    assert all(sum(x.values()) == 1 for x in added) and added[0] != added[1]
    assert any({*added[0], *added[1]} <= set(g) for g in toxicity.IDENTITY.values())
    assert toxicity.swaps(tokens, {}) == [] and toxicity.swaps(tokens, toxicity.IDENTITY)[0] == a


def test_toxicity_on_repeated_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, score string, toxic string, ids int"
    rows = [(i, f"idiot scum {i}" if i % 2 else f"garden flower {i}", "x", "y", 1) for i in range(40)] * 3 + [(None, None, "x", "y", 1)] * 2
    df = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, toxic int")
    once, thrice = (toxicity.train(d, labels) for d in (df.dropDuplicates(["doc_id"]), df))
    assert once.weight == thrice.weight and once.bias == thrice.bias  # a repeated row is one training text
    out = toxicity.score(df, thrice, ["doc_id"]).collect()
    assert len(out) == len(rows) and len({(r.doc_id, r.score) for r in out}) == 41
    assert toxicity.score(df.where("false"), thrice, ["doc_id"]).collect() == []
    empty = toxicity.train(df.where("false"), labels.where("false"))
    assert toxicity.score(df, empty, ["doc_id"]).where("score > 0.5").count() == 0


def test_long_strings_are_cut_where_no_piece_crosses(vocab, monkeypatch):
    from ragtide.llm import lattice

    monkeypatch.setattr(lattice, "LOOKED_AT", 50)  # several blocks
    r = random.Random(3)
    some = ["".join(r.choice("ABCDEFGHIJabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n)) for n in (33, 400, 2000)]
    some += ["".join(r.choice("日本語中文字漢方") for _ in range(300)), "a" * 200, " " * 90 + "x", "the" * 70, "é🙂" * 60]
    prob = np.random.default_rng(1).random((vocab.size + 2, 3))
    prob /= prob.sum(0)
    prob[-1] = 0
    for s in some:
        parts = vocab.parts(s)
        assert "".join(parts) == s and all(parts)
        at = 0
        for p in parts[:-1]:
            at += len(p)
            assert not any(s[i:j] in vocab.piece for i in range(max(0, at - vocab.longest), at)
                           for j in range(at + 1, min(len(s), at + vocab.longest) + 1))
        whole = forward(vocab.edges([s]), prob)[1][0]
        assert np.allclose(whole, sum(forward(vocab.edges([p]), prob)[1][0] for p in parts))
    assert max(map(len, vocab.parts(some[2]))) <= 60 and vocab.parts("a" * 32) == ["a" * 32]
    sampler = pieces.Sampler(vocab)
    ends, ids = sampler.encode(some, np.arange(len(some)))
    assert [pieces.decode(vocab, ids[a:z]) for a, z in zip(ends, ends[1:])] == some


def test_an_unbroken_text_takes_no_more_than_others(vocab):
    """A million characters without a space, in 50 languages: time and memory as for ordinary text."""
    import time
    import tracemalloc

    r = random.Random(4)
    text = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1_000_000))
    sampler = pieces.Sampler(vocab)
    model = langid.Model([f"l{i:02d}" for i in range(50)], vocab, np.full((vocab.size + 2, 50), 1e-4))
    tracemalloc.start()
    t = time.time()
    ends, ids = sampler.encode([text], np.array([1]))
    model.log_likelihood([text])
    took, (_, peak) = time.time() - t, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert pieces.decode(vocab, ids) == text
    assert peak < 1 << 30 and took < 60, (peak, took)


def test_parts_grow_with_the_table_and_queries_compare_few_rows(spark):
    """Clustered vectors in two levels of parts: recall of at least 0.9 from less than a third of the pairs."""
    r = np.random.default_rng(8)
    centres = r.normal(size=(150, 24))
    x = np.concatenate([c + 0.35 * r.normal(size=(80, 24)) for c in centres]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    stats: dict = {}
    got = ann.search(df, "vec_id % 20 = 0", sample=2048, part_rows=128, leaf_rows=400, block=300, stats=stats).collect()
    y = x.astype(float)
    by: dict = {}
    for g in got:
        by.setdefault(g.query_id, []).append((g.rank, g.vec_id, g.score))
    hits = 0
    for q in range(0, len(y), 20):
        s = y @ y[q]
        s[q] = -np.inf
        found = sorted(by[q])
        assert [k for k, _, _ in found] == list(range(1, 21))
        assert all(abs(s[v] - score) < 1e-9 for _, v, score in found)
        hits += len({v for _, v, _ in found} & set(np.argsort(-s, kind="stable")[:20].tolist()))
    recall = hits / (20 * len(by))
    print(recall, stats)
    assert recall >= 0.9 and stats["compared"] < 1 / 3 and stats["parts"] > 24, (recall, stats)


def test_languages_of_repeated_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, lang_pred string, score string, words int"
    rows = [(i, ("the house and the garden " if i % 2 else "le jardin et la maison ") * 5, "en" if i % 2 else "fr", "x", "y", 1)
            for i in range(20)] * 2 + [(None, None, None, "x", "y", 1), (None, "", "en", "x", "y", 1), (50, "12 34", "fr", "x", "y", 1)] * 2
    df = spark.createDataFrame(rows, schema)
    model = langid.train(df, steps=1)
    out = langid.predict(df, model, ["doc_id"]).collect()
    assert len(out) == len(rows)
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "fr") for r in out if r.doc_id is not None and r.doc_id < 20)
    assert {(r.lang_pred, r.score) for r in out if r.doc_id is None or r.doc_id == 50} == {("und", 0.0)}
    assert langid.predict(df.where("false"), model, ["doc_id"]).collect() == []
    nothing = langid.train(df.where("false"), steps=1)
    assert {r.lang_pred for r in langid.predict(df, nothing, ["doc_id"]).collect()} == {"und"}


def test_neighbours_of_repeated_ids_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, query_id string, rank string, part int"
    rows = [(i, [float(i % 7), 1.0, float(i % 3)], "x", "y", 1) for i in range(60)] * 2 + [(20, [9.0, 0.0, 0.0], "x", "y", 1)]
    df = spark.createDataFrame(rows, schema)
    got = ann.search(df, "vec_id % 20 = 0").collect()
    assert {(r.query_id, r["rank"]) for r in got} == {(q, k) for q in (0, 20, 40) for k in range(1, 21)}
    least = {q: min(v for i, v, *_ in rows if i == q) for q in (0, 20, 40)}
    for q in least:
        s = sorted((-sum(a * b for a, b in zip(least[q], v)), i) for i, v, *_ in rows if i != q)
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == s[:20]
    assert ann.search(df.where("false"), "true").collect() == []


def test_pieces_take_a_bounded_part_of_a_batch(spark, monkeypatch):
    """Only some characters of a batch are texts and draws at once; the pieces are the same however the batch is cut."""
    from ragtide.llm import pieces

    assert pieces.AT_ONCE <= 1_000_000
    sampler = pieces.Sampler(pieces.Vocabulary(pieces.MODEL_FILE))
    texts = ["one two three\nfour", "", "drei vier fünf " * 9, "x"]
    keys = np.arange(4, dtype=np.int64)
    ends, ids = sampler.encode(texts, keys)
    alone = [sampler.encode([t], keys[i:i + 1])[1].tolist() for i, t in enumerate(texts)]
    assert [ids[a:z].tolist() for a, z in zip(ends, ends[1:])] == alone
