"""Quotation linking: reply-ordered conversations without quotes.

A line's quote level is the number of '>' marks it begins with. Consecutive
lines of one level >= 1 form a quoted passage. Passages, their single lines and sentences
are normalised (marks off, lower case, white space squeezed) and hashed, and so
are messages' own unquoted bodies, paragraphs, lines and sentences (whatever the
lines they are wrapped in). A quotation is joined
to its original: the earliest turn of the same conversation that wrote the
passage itself. A message replies to the original of its level-1 quotations
with the most matching characters (ties: the latest turn); without such a match, to
the turn before it, the greatest smaller one, whatever gaps the numbering has. Threads follow the replies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragtide.llm.common import schema_of, written

MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
#: The line that introduces a quotation; it goes with the quotation.
INTRODUCTION = re.compile(r"^\s*(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$", re.I)

#: Between the sentences of a normalised paragraph; also where no space follows, as after ideographic stops.
SENTENCE_END = re.compile(r"(?<=[.!?…]) |(?<=[.!?…][\"')\]”’»]) |(?<=[。！？]) ?")


def _norm(text: str) -> str:
    return " ".join(text.lower().split())


def _hash(norm: str) -> int:
    h = xxhash.xxh64_intdigest(norm.encode("utf-8", "replace"))
    return h - (1 << 64) if h >= 1 << 63 else h


def parse(text: str | None) -> tuple[str, list[tuple[int, str]], int]:
    """(body without quotes, passages as (level, raw text), quoted lines) of one message."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    quoted, last = 0, 0
    for line in (text or "").split("\n"):
        m = MARKS.match(line)
        level = m.group(1).count(">") if m else 0
        if level:
            quoted += 1
            if last == 0:
                while own and not own[-1].strip():
                    own.pop()
                if own and INTRODUCTION.match(own[-1]):
                    own.pop()
            if level != last:
                passages.append((level, []))
            passages[-1][1].append(line[m.end():])
        else:
            own.append(line)
        last = level
    body = "\n".join(own)
    return (body if quoted == 0 else body.strip()), [(n, "\n".join(p)) for n, p in passages], quoted


def units(text: str) -> set[str]:
    """Normalised whole text, paragraphs, lines and sentences of paragraphs; empty ones are none."""
    paragraphs = [_norm(p) for p in re.split(r"\n\s*\n", text)]
    got = {_norm(text), *paragraphs, *map(_norm, text.split("\n"))}
    got.update(s for p in paragraphs for s in SENTENCE_END.split(p))
    return got - {""}


#: Turn numbers that are looked through together for the turn before.
BLOCK = 1024


def _before(turns: DataFrame) -> DataFrame:
    """conv_id, turn, before: the greatest smaller turn of distinct (conv_id, turn), null at the first.

    Within blocks of turn numbers, and for a block's first turn from the block before it, so that a conversation with a third of all messages
    lies on many tasks."""
    block = F.floor(F.col("turn") / BLOCK)
    t = turns.withColumn("block", block)
    ends = t.groupBy("conv_id", "block").agg(F.max("turn").alias("last"))
    last = F.lag("last").over(Window.partitionBy("conv_id").orderBy("block"))  # a row a block
    ends = ends.select("conv_id", "block", last.alias("earlier"))
    inside = F.lag("turn").over(Window.partitionBy("conv_id", "block").orderBy("turn"))
    t = t.withColumn("inside", inside).join(ends, ["conv_id", "block"])
    return t.select("conv_id", "turn", F.coalesce("inside", "earlier").alias("before"))


def link(messages: DataFrame, rounds: int = 64) -> DataFrame:
    """Every message with its reply links, without quotes, ordered by conversation, thread and turn.

    Columns: conv_id, turn, role, parent_turn, thread_turn (the first message of
    the thread), depth, n_quoted_lines, n_linked (quoted passages found at their
    original), body, formatted (role mark and body).

    Null conversations or turns link to nothing and are threads of their own; an
    empty or null text has an empty body. Several rows of one (conv_id, turn) each
    keep their row; other messages reply to the turn, whose own parent is the
    smallest of its rows' parents. Other columns are not read; an empty table gives no rows; a message is parsed whole.
    """
    rows = messages.select("conv_id", "turn", "role", "text").withColumn("row", F.xxhash64("conv_id", "turn", "role", "text"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            conv, turn, unit = [], [], []
            for c, t, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                got = units(parse(text)[0])
                conv += [c] * len(got)
                turn += [t] * len(got)
                unit += sorted(map(_hash, got))
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(turn, pa.int64()),
                                              pa.array(unit, pa.int64())], names=["conv_id", "turn", "unit"])

    def quoted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for c, t, r, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                for number, (level, passage) in enumerate(parse(text)[1]):
                    for u in sorted(units(passage)):
                        for col, v in zip(out, (c, t, r, number, level, len(u), _hash(u))):
                            col.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)],
                                             names=["conv_id", "turn", "row", "passage", "level", "chars", "unit"])

    known = rows.where("conv_id is not null and turn is not null")
    # One original per conversation and unit: a phrase that thousands of messages repeat stays one row.
    original = (known.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "text")
                .mapInArrow(own, "conv_id long, turn long, unit long")
                .groupBy("conv_id", "unit").agg(F.min("turn").alias("original")))
    quotes = (known.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "row", "text")
              .where(F.col("text").contains(">"))
              .mapInArrow(quoted, "conv_id long, turn long, row long, passage int, level int, chars int, unit long"))
    met = quotes.join(original, ["conv_id", "unit"]).where("original < turn")
    # The longest matching unit stands for its passage.
    best = met.groupBy("conv_id", "turn", "row", "passage", "level").agg(
        F.max(F.struct("chars", "original")).alias("m"))
    per_target = best.groupBy("conv_id", "turn", "row", F.col("m.original").alias("target")).agg(
        F.sum(F.when(F.col("level") == 1, F.col("m.chars")).otherwise(0)).alias("chars"), F.count("*").alias("n"))
    reply = per_target.groupBy("conv_id", "turn", "row").agg(
        F.max(F.when(F.col("chars") > 0, F.struct("chars", "target"))).alias("m"), F.sum("n").alias("n_linked")).select(
        "row", F.col("m.target").alias("quoted_turn"), "n_linked")
    turns = known.select("conv_id", "turn").distinct()
    before = _before(turns)
    linked = (rows.join(reply, "row", "left").join(before, ["conv_id", "turn"], "left")
              .withColumn("parent_turn", F.coalesce("quoted_turn", "before")))
    linked = written(linked.select("conv_id", "turn", "role", "text", "parent_turn",
                                   F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked")), "quotes-linked")
    # Pointer doubling: after round k every open turn knows its ancestor 2**k replies up. A turn whose pointer has
    # reached the thread's first is finished and is joined no more; others may still look it up.
    up = linked.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(
        F.min("parent_turn").alias("parent"))
    up = written(up.select("conv_id", "turn", F.coalesce("parent", "turn").cast("long").alias("up"),
                           F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"),
                           F.col("parent").isNull().alias("done")), "quotes-up")
    finished, open_turns = up.where("done"), up.where("not done")
    for _ in range(rounds):
        if open_turns.isEmpty():
            break
        above = finished.unionByName(open_turns).select(
            "conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), "done")
        step = written(open_turns.drop("done").join(above, ["conv_id", "up"]).select(
            "conv_id", "turn", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), "done"), "quotes-up")
        finished, open_turns = finished.unionByName(step.where("done")), step.where("not done")
    up = finished.unionByName(open_turns)

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 7
        for b in batches:
            got = [parse(t) for t in b.column(n).to_pylist()]
            roles = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(6)), pa.array([g[2] for g in got], pa.int64()), b.column(6),
                 pa.array([g[0] for g in got], pa.string()),
                 pa.array([f"<|{r or 'unknown'}|>\n{g[0]}" for r, g in zip(roles, got)], pa.string())],
                names=["conv_id", "turn", "role", "parent_turn", "thread_turn", "depth", "n_quoted_lines", "n_linked", "body",
                       "formatted"])

    threads = up.select("conv_id", "turn", F.col("up").alias("thread_turn"), "depth")
    out = linked.join(threads, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", F.col("parent_turn").cast("long").alias("parent_turn"),
        F.coalesce("thread_turn", F.col("turn").cast("long")).alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"), "n_linked", "text")
    schema = schema_of(out, ["conv_id", "turn", "role", "parent_turn", "thread_turn", "depth"],
                       "n_quoted_lines long, n_linked long, body string, formatted string")
    return out.mapInArrow(bodies, schema).orderBy("conv_id", "thread_turn", "turn")
