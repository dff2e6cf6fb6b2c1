"""The corpus pipeline's stages on rows with nulls, repeated ids and copies."""

from __future__ import annotations

import random

import corpus_pipeline as cp
from ragtide.llm import mixing, pieces, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], DOCS)


def test_near_duplicates_keep_one_row_of_each_component(spark):
    a, b, c, d, e = (words(k) for k in range(5))
    rows = [(None, a, "en", "s"), (None, b, "en", "s"), (None, a, "en", "s"), (4, c, "en", "s"), (4, d, "de", "s"),
            (2, d, "en", "s"), (None, d, "en", "s"), (9, e, None, "x"), (9, e, "x", None), (7, None, "en", "s"), (8, "", "en", "s")]
    want = [(None, a), (None, b), (2, d), (4, c), (7, None), (9, e)]
    order = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    left = set()
    for parts in (1, 5):
        got = cp.drop_near_duplicates(spark, frame(spark, rows).repartition(parts), "").collect()
        assert got[0].__fields__ == cp.COLUMNS
        assert sorted(((x.doc_id, x.text) for x in got), key=order) == sorted(want, key=order)
        left.add(tuple(sorted(map(str, got))))
    assert len(left) == 1  # whatever the order of arrival
    assert cp.drop_near_duplicates(spark, frame(spark, rows).where("false"), "").collect() == []


def test_passage_dedup_drops_only_what_it_emptied(spark):
    a, b = words(1), words(2)
    rows = [(1, a, "en", "s"), (2, a, "en", "s"), (3, None, "en", "s"), (4, "", "en", "s"), (5, "  ", "en", "s"),
            (6, a + "tail", "en", "s"), (None, b, "en", "s")]
    got = {x.doc_id: x for x in cp.drop_repeated_passages(spark, frame(spark, rows), "").collect()}
    assert {i: x.text for i, x in got.items()} == {1: a, 3: None, 4: "", 5: "  ", 6: "tail", None: b}
    assert got[6].n_chars == 4 and got[3].n_chars is None and got[1].__fields__ == cp.COLUMNS


def close(a, b):
    return bin(simhash.fingerprint(a) ^ simhash.fingerprint(b)).count("1") <= 4


def plain_near_duplicates(rows):
    """Rows as (doc_id, text, lang, source): the smallest id of each component (null last)."""
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if close(rows[i][1], rows[j][1]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    order = lambda r: (r[0] is None, r[0] or 0)
    return [min((r for r, g in zip(rows, group) if g == k), key=order) for k in sorted(set(group))]


def plain_passages(rows, length=50):
    """Texts without the bytes of strings of smaller ids; a null id is the largest."""
    number = lambda i: 1 << 63 if i is None else i
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k: k + length]
            first[s] = min(first.get(s, 1 << 64), number(i))
    out = []
    for i, t, *rest in rows:
        b = (t or "").encode()
        gone = {j for k in range(len(b) - length + 1) if first[b[k: k + length]] < number(i) for j in range(k, k + length)}
        left = bytes(x for j, x in enumerate(b) if j not in gone).decode("utf-8", "ignore") if gone else t
        if not gone or left.strip(" "):
            out.append((i, left, *rest))
    return out


def test_stages_and_run_equal_plain_python(spark, tmp_path):
    passage = words(100, 12)
    rows = [(i, words(i) + (" " + passage if i % 5 == 0 else ""), ["en", None][i % 2], "abc"[i % 3]) for i in range(30)]
    rows += [(None, words(50), "en", "a"), (None, words(51), "de", None), (3, words(52), "en", "b"), (40, words(7), "en", "c"),
             (None, words(8), "en", "a"), (41, None, "en", "a"), (42, "", "en", "b"), (43, words(4) + " more", "en", "a"),
             (44, passage, "en", "a")]
    labels = []
    for i in range(60, 100):  # what the classifier learns from
        toxic = i % 2
        rows.append((i, words(i) + (" idiot scum moron" * 6 if toxic else " lovely garden flowers" * 6), "en", "b"))
        labels.append((i, 1, toxic))
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    order = lambda r: tuple((x is None, "" if x is None else str(x)) for x in r)
    same = lambda df, want: sorted(map(tuple, df.select("doc_id", "text", "lang", "source").collect()), key=order) == sorted(
        want, key=order)
    fn = dict(cp.STAGES)
    assert list(fn) == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "source_mixing", "sentencepiece_sampling"]
    docs = frame(spark, rows)

    # toxicity: a subset of the rows, by the label where there is one
    clean = cp.written(fn["toxicity"](spark, docs, str(tmp_path)), "t")
    got = clean.collect()
    assert clean.columns == cp.COLUMNS and {x.doc_id for x in got} >= {i for i, _, toxic in labels if not toxic}
    assert not {x.doc_id for x in got} & {i for i, _, toxic in labels if toxic}
    kept = [tuple(x)[:4] for x in got]
    assert len(set(kept)) == len(kept) and set(kept) <= set(rows)

    near = cp.written(fn["simhash_near_dedup"](spark, clean, ""), "t")
    kept = plain_near_duplicates(kept)
    assert near.columns == cp.COLUMNS and same(near, kept)
    cut = cp.written(fn["suffix_array_dedup"](spark, near, ""), "t")
    kept = plain_passages(kept)
    assert cut.columns == cp.COLUMNS and same(cut, kept)
    assert all(x.n_chars == (None if x.text is None else len(x.text)) for x in cut.collect())

    # copies: those of the operator, which has its own brute force
    copies = [(tuple(x)[:4], x.copies) for x in mixing.mix(cut, ["doc_id", "text", "lang", "source"]).select(
        "doc_id", "text", "lang", "source", "copies").collect()]
    kept = [r for r, n in copies for _ in range(n)]
    mixed = cp.written(fn["source_mixing"](spark, cut, ""), "t")
    assert mixed.columns == cp.COLUMNS and same(mixed, kept) and max(n for _, n in copies) <= 3
    pieced = fn["sentencepiece_sampling"](spark, mixed, "")
    ids = sorted((str(x.doc_id), str(x.ids)) for x in pieced.collect())
    texts = [x.decoded for x in pieces.decode_column(pieced).collect()]
    assert sorted(map(str, texts)) == sorted(str(r[1]) for r in kept)
    assert sorted((str(x.doc_id), str(x.ids)) for x in cp.run(spark, str(tmp_path)).collect()) == ids


def test_stages_on_an_empty_table(spark, tmp_path):
    frame(spark, [(1, "a", "en", "s")]).where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_copies_are_segmented_each_for_itself(spark):
    """Equal rows get different draws, the same ones however the rows lie; texts are whole in each."""
    texts = [words(k, 30) for k in range(6)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts) for _ in range(3)] + [(None, texts[0], "en", None)] * 5 + [(9, None, "en", "s")] * 2
    runs = []
    for parts in (1, 4, 9):
        out = pieces.decode_column(cp.encode_pieces(spark, frame(spark, rows).repartition(parts), "")).collect()
        assert sorted(str(x.decoded) for x in out) == sorted(str(r[1]) for r in rows)
        runs.append(sorted((str(x.doc_id), str(x.ids)) for x in out))
    assert runs[0] == runs[1] == runs[2]
    by = {}
    for i, ids in runs[0]:
        by.setdefault(i, []).append(ids)
    assert all(len(set(v)) == len(v) for i, v in by.items() if i != "9")
