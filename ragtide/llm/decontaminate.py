"""Benchmark decontamination by a broadcast hash set of normalised word n-grams. DataFrame functions only.

A text becomes words (A-Z lower-cased, then runs of letters and digits of ASCII and of anything beyond ASCII).
The windows of a benchmark item are its ``n`` consecutive words at every place, or the whole item if it has
fewer. Their hashes are the set. A document is cut into blocks of ``BLOCK`` words (each with the words that
its last window needs beyond it), every window of a block is hashed, and the hashes are looked up in the
set by a broadcast join, within one stage and without a shuffle of texts or windows. A row of the set has 64 bytes of
digest and a few numbers whatever the item's words are, so its size is known from its count: beyond ``MOST`` windows the set is
split by hash into several sets of that size, and the documents are scanned once for each. A hit
is verified by the SHA-256 of its words (computed for hash matches only), so equal hashes of
different windows are no hits.

Only hits leave the scan, and one row a document, with a 128-bit key of the row; equal
rows share a key and a row with their count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragtide.llm.common import written

#: What separates words, once A-Z are lower-cased. Fixed by the contract.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are lower-cased.
ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a document whose windows are looked up together.
BLOCK = 512
#: Windows in one broadcast set: about 150 bytes each in the join's hash table.
MOST = 500_000


def words(text: Column | str) -> Column:
    """The normalised words of a text; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    # lower() folds all of Unicode, which is the same as A-Z only in ASCII texts
    ascii_only = F.octet_length(text) == F.char_length(text)
    folded = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.filter(F.split(folded, BETWEEN), lambda w: w != ""), F.array().cast("array<string>"))


def _hash(hashes: Column, start: Column, length: Column) -> Column:
    return F.xxhash64(F.slice(hashes, start, length))


def _digest(found: Column, start: Column, length: Column) -> Column:
    return F.sha2(F.array_join(F.slice(found, start, length), " "), 256)


def item_windows(items: DataFrame, n: int) -> DataFrame:
    """Distinct windows of the items with the items that hold them: h, digest, len, item (the id as text; null: empty)."""
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    w = items.select(item, words("text").alias("w")).where(F.size("w") > 0)
    w = w.withColumn("hashes", F.transform("w", lambda x: F.xxhash64(x))).withColumn("len", F.least(F.size("w"), F.lit(n)))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("at")
    w = w.select("item", "w", "hashes", "len", at)
    return w.select(_hash(F.col("hashes"), F.col("at"), F.col("len")).alias("h"),
                    _digest(F.col("w"), F.col("at"), F.col("len")).alias("digest"), "len", "item").distinct()


def _blocks(docs: DataFrame, n: int) -> DataFrame:
    """Rows of at most BLOCK + n - 1 words: key columns, n_words, base (words before the block), w, hashes."""
    out = docs.withColumn("w", words("text")).withColumn("n_words", F.size("w"))
    # a document without words has one block too, for its own row
    base = F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_words") - 1, F.lit(0)), F.lit(BLOCK))).alias("base")
    out = out.select("doc_id", "k1", "k2", "n_words", "w", base)
    out = out.select("doc_id", "k1", "k2", "n_words", "base",
                     F.slice("w", F.col("base") + 1, F.lit(BLOCK + n - 1)).alias("w"))
    return out.withColumn("hashes", F.transform("w", lambda x: F.xxhash64(x)))


def scan(docs: DataFrame, windows: DataFrame, lengths: list[int], n: int, own_row: bool) -> DataFrame:
    """One pass over the documents: their hits in ``windows`` (h, digest, len; broadcast), and with ``own_row`` a row at 0 for
    each document. Returns doc_id, k1, k2, n_words, at (from 1), len, digest."""
    blocks = _blocks(docs, n)
    size, length = F.size("w"), F.col("len")
    blocks = blocks.select("*", F.explode(F.array(*[F.lit(x) for x in lengths])).alias("len"))
    last = F.least(F.lit(BLOCK), size - length + 1)  # windows that start in this block
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    if own_row:
        own = (F.col("base") == 0) & (length == lengths[0])
        places = F.when(own, F.concat(F.array(F.lit(0)), places)).otherwise(places)
        # its counterpart in the set: no window has 0 words
        set_ = windows.select("h", "digest", F.col("len").alias("set_len")).unionByName(
            docs.sparkSession.range(1).selectExpr("0L as h", "'' as digest", "0 as set_len"))
    else:
        set_ = windows.select("h", "digest", F.col("len").alias("set_len"))
    at = blocks.select("*", F.explode(places).alias("place"))
    at = at.withColumn("key", F.when(F.col("place") == 0, F.lit(0).cast("long"))
                       .otherwise(_hash(F.col("hashes"), F.col("place"), length)))
    # startswith rather than equality, which would become a second join key and be computed for every window
    true_hit = (F.col("set_len") == length) & F.startswith(_digest(F.col("w"), F.col("place"), length), F.col("digest"))
    hit = F.when(F.col("place") == 0, F.col("set_len") == 0).otherwise((F.col("set_len") > 0) & true_hit)
    found = at.join(F.broadcast(set_), (F.col("key") == F.col("h")) & hit)
    return found.select("doc_id", "k1", "k2", "n_words",
                        F.when(F.col("place") > 0, F.col("base") + F.col("place")).otherwise(0).alias("at"), "len", "digest")


def _keys() -> tuple[Column, Column]:
    """128 bits that tell rows apart by doc_id and text."""
    is_null = F.col("doc_id").isNull()
    return F.xxhash64("doc_id", is_null, "text"), F.xxhash64(F.lit(1), "text", "doc_id", is_null)


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, most: int = MOST) -> DataFrame:
    """What of the ``items`` (item_id, text) occurs in each of the ``docs`` (doc_id, text).

    Returns per document doc_id, n_words, n_hit (words in a hit window), n_items, ``items`` (ids as text, sorted) and
    ``spans`` (maximal stretches of hit words: first word from 0, number of words), and the row's key k1, k2. Every row has its result:
    null and empty texts have no words; a null doc_id is a row like any other; repeated rows each come back. Items without words, null
    texts among them, have no windows; repeated items count once, by id; a null id is the empty text. Empty
    tables give no rows, or documents without hits. Other columns are not read. A text's words are in one task's memory as an
    array (about 60 bytes a word); nothing else grows with a text's length but its own hits."""
    docs = docs.select("doc_id", "text")
    k1, k2 = _keys()
    docs = docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))
    windows = written(item_windows(items.select("item_id", "text"), n), "windows")
    unique = windows.select("h", "digest", "len").distinct()
    stats = unique.groupBy("len").count().collect()  # n rows at most
    lengths = sorted(r["len"] for r in stats) or [n]
    sets = max(1, -(-sum(r["count"] for r in stats) // most))
    found = None
    for s in range(sets):
        part = unique if sets == 1 else unique.where(F.pmod(F.xxhash64("h"), F.lit(sets)) == s)
        rows = scan(docs, part, lengths, n, own_row=s == 0)
        found = rows if found is None else found.unionByName(rows)
    found = written(found, "hits")
    key = ["k1", "k2"]
    own, hit = F.col("at") == 0, F.col("at") > 0
    # groups are the hits of one row's text; equal rows are added up in each task first
    places = F.collect_set(F.when(hit, F.struct("at", "len")))
    per_doc = found.groupBy(*key).agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
                                      F.sum(own.cast("long")).alias("times"), places.alias("places"))
    held = found.where(hit).select(*key, "digest", "len").distinct()
    by_item = (held.join(windows.select("digest", "len", "item"), ["digest", "len"]).groupBy(*key)
               .agg(F.sort_array(F.collect_set("item")).alias("items")))
    out = per_doc.join(by_item, key, "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    covered = F.transform("places", lambda p: F.sequence(p["at"] - 1, p["at"] + p["len"] - 2))
    out = out.withColumn("hit_words", F.array_distinct(F.flatten(covered)))
    out = out.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"),
                      F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      "items", _stretches("hit_words").alias("spans"), *key)


def _stretches(places: str) -> Column:
    """Maximal stretches (start, length) of consecutive numbers, in order."""
    starts = F.sort_array(F.array_except(places, F.transform(places, lambda x: x + 1)))
    lasts = F.sort_array(F.array_except(places, F.transform(places, lambda x: x - 1)))
    return F.zip_with(starts, lasts, lambda a, z: F.struct(a.alias("start"), (z - a + 1).alias("length")))


def remove(docs: DataFrame, found: DataFrame, whole: bool = False) -> DataFrame:
    """The documents without what ``contamination`` found in them: without the hit words and what separates each from the
    next word, or with ``whole`` without the contaminated documents. All columns stay; texts without a hit are as they were."""
    dirty = (found.where("n_hit > 0").groupBy(F.col("k1").alias("_c1"), F.col("k2").alias("_c2"))
             .agg(F.first("spans").alias("_spans")))
    k1, k2 = _keys()
    same = (k1 == F.col("_c1")) & (k2 == F.col("_c2"))
    if whole:
        return docs.join(dirty, same, "left_anti")
    out = docs.join(dirty, same, "left")
    # units: a word and what separates it from the next; the text is what stands before the first, then all units
    cut = F.col("_spans").isNotNull()
    out = out.withColumn("_words", F.when(cut, F.filter(F.split("text", ANY_CASE), lambda w: w != "")))
    out = out.withColumn("_gaps", F.when(cut, F.split("text", ANY_CASE.replace("[", "[^", 1))))
    n = F.size("_words")
    out = out.withColumn("_units", F.zip_with("_words", F.slice("_gaps", F.lit(2), n), lambda w, g: F.concat(w, g)))
    after = F.transform("_spans", lambda s: s["start"] + s["length"])
    out = out.withColumn("_from", F.concat(F.array(F.lit(0)), after))
    out = out.withColumn("_to", F.concat(F.transform("_spans", lambda s: s["start"]), F.array(n)))
    out = out.withColumn("_left", F.zip_with(
        "_from", "_to", lambda a, z: F.array_join(F.slice(F.col("_units"), a + 1, z - a), "")))
    text = F.when(cut, F.concat(F.get("_gaps", F.lit(0)), F.array_join("_left", ""))).otherwise(F.col("text"))
    return out.withColumn("text", text).select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """The result's ids as a hash, and whether a document is contaminated."""
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def sql(n: int = 10) -> str:
    """DuckDB SQL for the same rows."""
    words = (f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), "
             "lambda w: w <> '')")
    return f"""
WITH items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), {n}) AS size, array_to_string(w[i:i + least(len(w), {n}) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {n}) + 2)) AS i FROM items WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents
), grams AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
), hits AS (
  SELECT r, i, size, item FROM grams JOIN windows USING (size, gram)
), covered AS (
  SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS word FROM hits) GROUP BY r
), held AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN held USING (r)
"""
