"""Elements of JSON array files, files read in ranges: one file spans as many tasks as it has splits.

Spark's text reader takes ``}`` for the end of a line, so a file without line breaks splits, too. A range does not know whether it
begins inside a string, nor how deep. So it is read twice:

1. ``_measure``: each range, for both cases (in a string or not), gives what it does to them: the state at its
   end, the change of depth, and the commas at each depth. A few numbers a range; the ranges of a file are put together in order (``_begin``), which
   gives each range's true beginning.
2. ``_elements``: each range cuts its text at the commas of the outer array. An element within a range is a row; one
   that reaches over a border comes in pieces, which are joined by file and place.

A file counts only as a whole: it must be one array, closed at its end, of valid elements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragtide.operators.partitioning import materialise

#: A string, or a character that structures; the rest is text of numbers and names.
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|["\[\]{},]', re.S)
#: What is left of a string, with its end.
REST = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
SPACE = " \t\r\n"
#: Bytes of a mark at the beginning of a file, which the reader leaves out.
MARK = 3
#: Files without an array at the root are parsed whole up to this size, to say what is wrong with them.
WHOLE = 1 << 20

MEASURES = ("path string, start long, bytes long, size long, first string, "
            "end0 boolean, depth0 int, commas0 map<int,long>, end1 boolean, depth1 int, commas1 map<int,long>")
BEGINNINGS = "path string, start long, in_string boolean, depth int, place long, last_open boolean, closed boolean"


def fragments(spark: SparkSession, folder: str) -> DataFrame:
    """path, start (of the range), size (of the file), bytes and text between ``}``, in file order within each range."""
    rows = spark.read.option("lineSep", "}").option("pathGlobFilter", "*.json").text(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                       F.col("_metadata.file_size").alias("size"), F.octet_length("value").cast("long").alias("bytes"), "value")


class _Scan:
    """State after the text so far: in a string or not, depth, and commas by depth."""

    __slots__ = ("inside", "depth", "commas")

    def __init__(self, inside: bool):
        self.inside, self.depth, self.commas = inside, 0, {}

    def add(self, text: str) -> None:
        at = 0
        if self.inside:
            m = REST.match(text)
            if m is None:
                return
            at, self.inside = m.end(), False
        for m in TOKEN.finditer(text, at):
            c = text[m.start()]
            if c == '"':
                if m.end() - m.start() == 1:  # a string that does not end here; what follows is in it
                    self.inside = True
                    return
            elif c == ",":
                self.commas[self.depth] = self.commas.get(self.depth, 0) + 1
            else:
                self.depth += 1 if c in "[{" else -1

    def close(self) -> None:
        """The ``}`` that ends a fragment."""
        if not self.inside:
            self.depth -= 1


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[dict]]]:
    """Rows of one range at a time and batch, in order."""
    for b in batches:
        here, key = [], None
        for row in b.to_pylist():
            k = (row["path"], row["start"])
            if k != key and here:
                yield key, here
                here = []
            key = k
            here.append(row)
        if here:
            yield key, here


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state = None, None

    def row() -> pa.RecordBatch:
        a, b = state["scans"]
        cols = {"path": [key[0]], "start": [key[1]], "bytes": [state["bytes"]], "size": [state["size"]], "first": [state["first"]],
                "end0": [a.inside], "depth0": [a.depth], "commas0": [list(a.commas.items())],
                "end1": [b.inside], "depth1": [b.depth], "commas1": [list(b.commas.items())]}
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.map_(pa.int32(), pa.int64()),
                 pa.bool_(), pa.int32(), pa.map_(pa.int32(), pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), kinds)], names=list(cols))

    for k, rows in _ranges(batches):
        if k != key:
            if key is not None:
                yield row()
            key, state = k, {"scans": (_Scan(False), _Scan(True)), "bytes": 0, "size": rows[0]["size"], "first": None}
            new = True
        for r in rows:
            for scan in state["scans"]:
                if not new:
                    scan.close()  # of the fragment before; the range's last is closed by whoever knows that it was
                scan.add(r["value"])
            new = False
            state["bytes"] += r["bytes"] + 1
            if state["first"] is None:
                text = r["value"].lstrip(SPACE + "\ufeff")
                state["first"] = text[0] if text else None
    if key is not None:
        yield row()


def _begin(ranges: pd.DataFrame) -> pd.DataFrame:
    """The beginning of each range of one file, and whether the file is closed at its end."""
    ranges = ranges.sort_values("start")
    # every fragment was counted with a closing brace: one byte too many, unless the file ends with it
    last_open = int(ranges["bytes"].sum()) - int(ranges["size"].iloc[0]) in (1, 1 - MARK)
    inside, depth, place, out = False, 0, 0, []
    n = len(ranges)
    for i, r in enumerate(ranges.to_dict("records")):
        out.append([r["path"], r["start"], inside, depth, place, last_open and i == n - 1])
        which = "1" if inside else "0"
        place += dict(r[f"commas{which}"] or {}).get(1 - depth, 0)
        depth += int(r[f"depth{which}"])
        inside = bool(r[f"end{which}"])
        if not inside and not (last_open and i == n - 1):
            depth -= 1
    closed = not inside and depth == 0
    return pd.DataFrame([[*x, closed] for x in out],
                        columns=["path", "start", "in_string", "depth", "place", "last_open", "closed"])


class _Cutter:
    """Cuts text at the commas of the outer array: (place, piece, begins, ends) of the elements; ``bad`` if there is more than the array."""

    def __init__(self, inside: bool, depth: int, place: int):
        self.inside, self.depth, self.place = inside, depth, place
        self.text: list[str] = []
        self.begins = self.opened = False
        self.bad = False
        self.out: list[tuple[int, str, bool, bool]] = []

    def _end(self, text: str, ends: bool) -> None:
        self.out.append((self.place, "".join([*self.text, text]), self.begins, ends))
        self.text = []

    def _outside(self, text: str) -> None:
        if text.strip(SPACE + "\ufeff"):
            self.bad = True

    def add(self, text: str) -> None:
        at = begin = 0
        if self.inside:
            m = REST.match(text)
            if m is None:
                self.text.append(text)
                return
            at, self.inside = m.end(), False
        for m in TOKEN.finditer(text, at):
            c, i = text[m.start()], m.start()
            if c == '"':
                if m.end() - i == 1:
                    self.inside = True
                    break
            elif c == "," and self.depth == 1:
                self._end(text[begin:i], True)
                self.place, begin, self.begins = self.place + 1, i + 1, True
            elif c in "[{":
                if self.depth == 0:
                    self._outside(text[begin:i])
                    self.bad = self.bad or self.opened or c == "{"
                    self.opened, begin, self.begins = True, i + 1, True
                self.depth += 1
            elif c in "]}":
                if self.depth == 1:
                    self.bad = self.bad or c == "}"
                    self._end(text[begin:i], True)
                    begin = i + 1
                self.depth -= 1
        if self.depth > 0 or self.inside:
            self.text.append(text[begin:])
        else:
            self._outside(text[begin:])

    def close(self) -> None:
        self.add("}")

    def flush(self) -> None:
        """The range ends inside an element."""
        if self.depth > 0 or self.inside:
            self._end("", False)
            self.begins = False


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, cutter = None, None
    names = ["path", "start", "place", "text", "begins", "ends", "bad"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]

    def found() -> pa.RecordBatch:
        rows = [(*key, *x, False) for x in cutter.out]
        if cutter.bad:
            rows.append((*key, -1, None, True, True, True))
        cutter.out, cutter.bad = [], False
        cols = list(zip(*rows)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    def end(last_open: bool) -> None:
        if not last_open:
            cutter.close()
        cutter.flush()

    last_open = False
    for k, rows in _ranges(batches):
        if k != key:
            if key is not None:
                end(last_open)
                yield found()
            r = rows[0]
            key, cutter, last_open, new = k, _Cutter(r["in_string"], r["depth"], r["place"]), r["last_open"], True
            # only the first range of a file may open the array
            cutter.opened = r["depth"] > 0 or r["in_string"] or r["start"] > 0
        for r in rows:
            if not new:
                cutter.close()
            cutter.add(r["value"])
            new = False
        yield found()
    if key is not None:
        end(last_open)
        yield found()


def array_elements(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(path, pos, text) of the elements of every ``*.json`` file in ``folder`` that is an array of valid elements, and (path,
    reason) of the other files.

    A file without a byte is in neither, as Spark's file sources leave it out. Memory a task: a batch of fragments, and the element at hand."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select(
        F.col("_metadata.file_path").alias("path"), "length")
    rows = fragments(spark, folder)
    measured = materialise(rows.mapInArrow(_measure, MEASURES), "json-ranges")
    first = measured.groupBy("path").agg(F.min_by("first", F.when(F.col("first").isNotNull(), F.col("start"))).alias("first"))
    arrays = first.where("first = '['").select("path")
    begin = materialise(measured.join(arrays, "path", "left_semi").groupBy("path").applyInPandas(_begin, BEGINNINGS), "json-begin")
    # a row for each range of a file (some 100 MB): less than a millionth of the files
    placed = rows.join(F.broadcast(begin.where("closed").drop("closed")), ["path", "start"])
    cut = materialise(placed.select("path", "start", "in_string", "depth", "place", "last_open", "value").mapInArrow(
        _elements, "path string, start long, place long, text string, begins boolean, ends boolean, bad boolean"), "json-elements")
    piece = F.struct(F.col("start").alias("start"), F.col("text").alias("text"))
    joined = cut.where("not bad and not (begins and ends)").groupBy("path", F.col("place").alias("pos")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["text"]), "").alias("text"))  # of one element
    elements = cut.where("not bad and begins and ends").select("path", F.col("place").alias("pos"), "text").unionByName(joined)

    blank = F.trim(F.translate("text", "\t\r\n", "   ")) == ""
    # in brackets, as the parser does not look beyond a first value
    valid = F.expr("try_parse_json('[' || text || ']')").isNotNull() & ~blank
    verdict = elements.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(valid, 1)).alias("n_valid"),
                                           F.count(F.when(blank, 1)).alias("n_blank"))
    wrong = verdict.where("n <> n_valid and not (n = 1 and n_blank = 1)").select("path")  # one blank element: an empty array
    malformed = materialise(begin.where("not closed").select("path").unionByName(cut.where("bad").select("path")).unionByName(wrong)
                            .distinct(), "json-malformed")
    elements = elements.where(~blank).join(malformed, "path", "left_anti")

    small = rows.where(F.col("size") <= WHOLE).join(first.where("first <> '['").select("path"), "path", "left_semi")
    at = F.struct("start", F.monotonically_increasing_id().alias("i"), F.col("value").alias("text"))
    text = small.select("path", "size", "bytes", at.alias("at")).groupBy("path").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("at")), lambda x: x["text"]), "}").alias("text"),  # at most WHOLE bytes
        F.first("size").alias("size"), F.sum(F.col("bytes") + 1).alias("bytes"))
    text = text.select("path", F.concat("text", F.when((F.col("size") - F.col("bytes")).isin(0, MARK), "}").otherwise("")).alias("text"))
    is_json = (F.col("length") > WHOLE) | F.expr("try_parse_json('[' || text || ']')").isNotNull() & (F.trim("text") != "")
    other = files.join(arrays, "path", "left_anti").join(text, "path", "left").select(
        "path", F.when(is_json, "root is not an array").otherwise("malformed json").alias("reason"))
    return elements, malformed.select("path", F.lit("malformed json").alias("reason")).unionByName(other)
