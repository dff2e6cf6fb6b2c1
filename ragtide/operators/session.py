"""T1 (batch): per-session context carried from turn to turn.

Each turn sees the turns before it in its own session (the original keeps
one context per process; here it is keyed by session). All earlier turns are
carried, as the original does; ``history`` limits them for a caller that wants
that, and bounds the window frame. The streaming twin is ``streaming.sessions``.

The history of every turn is quadratic in a session's length. ``session_history`` builds it for the turns
that are to be answered only, from segments of ``SEGMENT`` turns that are joined to text once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Values of the order column that are numbered together.
BLOCK = 1024
#: Turns that are joined to one text before histories are put together from them.
SEGMENT = 64


def positions(rows: DataFrame, group: str, order: str, out: str = "position") -> DataFrame:
    """``rows`` with ``out``, their number from 1 within their group by ``order`` (an integer; null first).

    Rows are numbered within blocks of ``BLOCK`` order values, and a block's offset is the count of the blocks before it, so a
    group with a third of all rows is spread over as many tasks as it has blocks. Orders of other types are one block."""
    whole = isinstance(rows.schema[order].dataType, IntegralType)
    block = F.floor(F.col(order) / BLOCK) if whole else F.lit(0)
    rows = rows.withColumn("_block", block.cast("long"))
    sizes = rows.groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    sizes = sizes.select(F.col(group).alias("_group"), F.col("_block").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(group, "_block").orderBy(order))
    same = F.col(group).eqNullSafe(F.col("_group")) & F.col("_block").eqNullSafe(F.col("_of"))
    numbered = rows.withColumn("_within", within).join(sizes, same)
    return numbered.withColumn(out, F.col("_before") + F.col("_within")).drop("_block", "_group", "_of", "_before", "_within")


def turn_entry(role: str = "role", text: str = "text"):
    return F.concat(F.coalesce(F.col(role), F.lit("")), F.lit(": "), F.coalesce(F.col(text), F.lit("")))


def session_context(turns: DataFrame, session: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text", history: int | None = None) -> DataFrame:
    """Adds ``n_history`` and ``history`` (previous turns as ``role: text`` lines, oldest first) to every turn."""
    w = Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding if history is None else -history, -1)
    hist = F.collect_list(turn_entry(role, text)).over(w)
    return turns.withColumn("_h", hist).withColumn("n_history", F.size("_h")).withColumn(
        "history", F.array_join("_h", "\n")).drop("_h")


def session_history(turns: DataFrame, wanted: str, session: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text") -> DataFrame:
    """The turns where the SQL condition ``wanted`` holds, with ``n_history`` and ``history`` as ``session_context`` gives them.

    Segments of ``SEGMENT`` turns become a text each, on whichever tasks they fall; a wanted turn joins the texts of the whole segments before its own
    and the turns before it in its own. What grows with a session's length is only the histories asked for."""
    at = positions(turns, session, turn, "_at").withColumn("_segment", F.floor((F.col("_at") - 1) / SEGMENT))
    at = at.withColumn("_entry", turn_entry(role, text))
    names = [c for c in turns.columns]
    one = F.struct(F.col("_at").alias("at"), F.col("_entry").alias("entry"))
    segments = at.groupBy(F.col(session).alias("_s"), F.col("_segment").alias("_g")).agg(F.sort_array(F.collect_list(one)).alias("_rows"))
    segments = segments.select("_s", "_g", F.array_join(F.transform("_rows", lambda r: r["entry"]), "\n").alias("_text"), "_rows")
    asked = at.where(wanted).select(*names, "_at", "_segment")
    own = F.col(session).eqNullSafe(F.col("_s")) & (F.col("_segment") == F.col("_g"))
    inside = F.array_join(F.transform(F.slice("_rows", F.lit(1), (F.col("_at") - 1 - F.col("_segment") * SEGMENT).cast("int")),
                                      lambda r: r["entry"]), "\n")
    asked = asked.join(segments, own).select(*names, "_at", "_segment", inside.alias("_inside"))
    # one row for each whole segment before a wanted turn, which finds its text by (session, segment)
    earlier = F.explode_outer(F.when(F.col("_segment") > 0, F.sequence(F.lit(0).cast("long"), F.col("_segment") - 1)))
    reach = asked.select(F.col(session).alias("_sess"), "_at", "_segment", earlier.alias("_want")).where("_want is not null")
    texts = reach.join(segments.select("_s", "_g", "_text"), F.col("_sess").eqNullSafe(F.col("_s")) & (F.col("_want") == F.col("_g")))
    part = F.struct(F.col("_g").alias("g"), F.col("_text").alias("text"))
    texts = texts.groupBy("_sess", F.col("_at").alias("_of")).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(part)), lambda p: p["text"]), "\n").alias("_before"))
    out = asked.join(texts, F.col(session).eqNullSafe(F.col("_sess")) & (F.col("_at") == F.col("_of")), "left")
    # an empty part is left out of the joining only if no turn stands behind it
    has_inside = F.col("_at") - 1 > F.col("_segment") * SEGMENT
    history = F.when(F.col("_segment") == 0, F.col("_inside")).when(has_inside, F.concat("_before", F.lit("\n"), "_inside")).otherwise(F.col("_before"))
    return out.select(*names, (F.col("_at") - 1).cast("int").alias("n_history"), history.alias("history"))
