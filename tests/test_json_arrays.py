"""Array files read in ranges of any size, against Python's parser."""

import json
import os
import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragtide.sources import json_arrays
from ragtide.sources.json_arrays import array_elements, fragments

ODD = ['a"b', "x\\y", "}{", "],[", '",', "\\", "é ñ 🙂", "line\nbreak", "", "{\"a\": [1, 2]}", "\ttab", "\\\"}"]


def value(rng, depth=0):
    kind = rng.random()
    if kind < 0.35 or depth > 3:
        return rng.choice([*ODD, "plain words, and more", 1, -2.5e3, True, None])
    if kind < 0.55:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice(["k", "q}", "z,"]) + str(i): value(rng, depth + 1) for i in range(rng.randint(0, 4))}


def files(rng):
    out = {}
    for i in range(12):
        doc = [value(rng) for _ in range(rng.choice([0, 1, 2, 9, 40]))]
        text = json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
        out[f"ok{i}.json"] = rng.choice(["", " \n", "\ufeff"]) + text + rng.choice(["", "\n  "])
    good = json.dumps([{"a": "b}"}, "c,]", [1, {"d": 2}]])
    for i in range(1, len(good), 3):
        out[f"cut{i}.json"] = good[:i]
    out |= {"two.json": "[1],[2]", "comma.json": "[1,]", "hole.json": "[1,,2]", "lead.json": "[,1]", "after.json": "[1] x",
            "before.json": "x [1]", "wrong.json": "[1}", "bare.json": "[{\"a\": 1} {\"b\": 2}]", "word.json": "[nope]", "object.json": '{"a": [1, "}"]}',
            "number.json": "12", "string.json": '"[1]"', "empty.json": "", "space.json": " \n", "end.json": '{"a": {}', "curly.json": "{[1]}",
            "more.json": "[1]]", "braces.json": "[{}, {\"a\": {}}, {}]", "open.json": "[\"a"}
    return out


def expected(text):
    """Texts of elements as values, or the reason."""
    try:
        doc = json.loads(text.lstrip("\ufeff"))
    except ValueError:
        return "malformed json"
    return doc if isinstance(doc, list) else "root is not an array"


def cut(text, size):
    """The elements of one text read in ranges of ``size`` bytes, by the functions that the tasks run; None if it is no array."""
    rows, at = [], 0
    parts = text.encode().split(b"}")
    if parts[-1] == b"":
        parts.pop()  # as the reader of lines leaves out an empty last line
    for p in parts:
        # a range has the fragments that begin in it, or right at its end
        rows.append({"path": "f", "start": max(0, (at - 1) // size) * size, "size": len(text.encode()), "bytes": len(p),
                     "value": p.decode()})
        at += len(p) + 1
    batches = lambda rows: [pa.RecordBatch.from_pylist(rows[a : a + 3]) for a in range(0, len(rows), 3)]
    measured = pd.concat([b.to_pandas() for b in json_arrays._measure(iter(batches(rows)))])
    if measured.sort_values("start")["first"].dropna().tolist()[:1] != ["["]:
        return None
    begin = {r.start: r for r in json_arrays._begin(measured).itertuples()}
    if not all(r.closed for r in begin.values()):
        return None
    placed = [{**r, **{c: getattr(begin[r["start"]], c) for c in ("in_string", "depth", "place", "last_open")}} for r in rows]
    got = [r for b in json_arrays._elements(iter(batches(placed))) for r in b.to_pylist()]
    if any(r["bad"] for r in got):
        return None
    texts = {}
    for r in got:
        texts[r["place"]] = texts.get(r["place"], "") + r["text"]
    assert sum(r["begins"] and r["ends"] for r in got) <= len(texts)
    if list(texts) == [0] and not texts[0].strip():
        return []
    try:
        return [json.loads(texts[i]) for i in range(len(texts))]
    except ValueError:
        return None


def test_ranges_of_any_size():
    for seed in range(4):
        for name, text in files(random.Random(seed)).items():
            want = expected(text)
            for size in (1, 2, 5, 13, 40, 10_000):
                if text:
                    assert cut(text, size) == (want if isinstance(want, list) else None), (name, size, text)


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_files_in_ranges(spark, scratch_dir, size):
    rng = random.Random(size)
    made = {k: t for i, (k, t) in enumerate(files(rng).items()) if not k.startswith("cut") or i % 5 == 0}
    for name, text in made.items():
        with open(os.path.join(scratch_dir, name), "w", encoding="utf-8") as f:
            f.write(text)
    with open(os.path.join(scratch_dir, "not.txt"), "w") as f:
        f.write("[1]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        ranges = fragments(spark, scratch_dir).select("path", "start").distinct().count()
        elements, rejects = array_elements(spark, scratch_dir)
        got = {}
        for r in elements.collect():
            got.setdefault(os.path.basename(r.path), {})[r.pos] = r.text
        reasons = {os.path.basename(r.path): r.reason for r in rejects.collect()}
        assert rejects.count() == len(reasons)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    if size < 1000:
        assert ranges > len(made)
    for name, text in made.items():
        want = expected(text)
        if not text:  # Spark's file sources do not show files without a byte
            assert name not in reasons and name not in got
        elif isinstance(want, str):
            assert reasons.get(name) == want and name not in got, (name, text)
        else:
            have = got.get(name, {})
            assert name not in reasons and sorted(have) == list(range(len(want))), (name, text, reasons.get(name), have)
            assert [json.loads(have[i]) for i in range(len(want))] == want


def test_one_file_spans_tasks(spark, scratch_dir):
    """A file of one line, 24 MB, in ranges of 4 MB: its elements come from several tasks."""
    from ragtide.sources.corpus import read_corpus_files

    with open(os.path.join(scratch_dir, "big.json"), "w", encoding="utf-8") as f:
        json.dump([{"luật": "L", "điều": i, "tên_điều": "T}", "nội_dung": f"{i} " * 200} for i in range(16_000)], f)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(4 << 20))
    try:
        tasks = fragments(spark, scratch_dir).select("start", F.spark_partition_id().alias("task")).distinct().collect()
        articles, rejects = read_corpus_files(spark, scratch_dir)
        assert rejects.count() == 0
        got = articles.select(F.count(F.lit(1)), F.countDistinct("doc_key"), F.countDistinct("article"), F.min("title")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({t.task for t in tasks}) > 3 and tuple(got) == (16_000, 16_000, 16_000, "T}")
