"""Hit formatters, metadata filter, scorer input cut, score display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragtide.config import (
    CONTENT_LABEL,
    PLAIN_ARTICLE_LABEL,
    PLAIN_LAW_LABEL,
    RERANK_CONTENT_KEEP,
    RERANK_CONTENT_MAX,
    RERANK_ELLIPSIS,
    SCORER_INPUT_MAX,
)


def _none(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def _blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def format_plain(meta: str = "metadata") -> Column:
    """P6 (plain path): labelled law line, ``article: title`` line, full content."""
    m = F.col(meta)
    return F.concat(
        F.lit(PLAIN_LAW_LABEL), _none(m["law"]), F.lit("\n"),
        F.lit(PLAIN_ARTICLE_LABEL), _none(m["article"]), F.lit(": "), _none(m["title"]), F.lit("\n"),
        F.lit(CONTENT_LABEL), _blank(m["chunk_content"]),
    )


def cut_content(c: Column) -> Column:
    """Content over 800 characters -> first 797 + '...'."""
    return F.when(F.length(c) > RERANK_CONTENT_MAX,
                  F.concat(F.substring(c, 1, RERANK_CONTENT_KEEP), F.lit(RERANK_ELLIPSIS))).otherwise(c)


def format_rerank(meta: str = "metadata") -> Column:
    """P7 (rerank path): unlabelled law line, ``article: title`` line, cut content."""
    m = F.col(meta)
    return F.concat(
        _none(m["law"]), F.lit("\n"),
        _blank(m["article"]), F.lit(": "), _blank(m["title"]), F.lit("\n"),
        F.lit(CONTENT_LABEL), cut_content(_blank(m["chunk_content"])),
    )


def drop_missing_metadata(df: DataFrame, meta: str = "metadata") -> DataFrame:
    """Hits without metadata are skipped (on both paths)."""
    return df.filter(F.col(meta).isNotNull())


def scorer_input(doc: Column | str) -> Column:
    """The scorer sees the first 800 characters; the document itself is kept."""
    c = F.col(doc) if isinstance(doc, str) else doc
    return F.substring(c, 1, SCORER_INPUT_MAX)


def _ten_thousandths(c: Column) -> Column:
    """|c| in units of 0.0001, the exact binary value rounded half to even (as C and Python print it).

    The fraction is split at 2**-27, so that both products with 10000 are exact.
    """
    a = F.abs(c)
    whole = F.floor(a).cast("double")
    f = a - whole
    head = F.floor(f * F.lit(float(1 << 27))).cast("double") / F.lit(float(1 << 27))
    high, low = head * 10000.0, (f - head) * 10000.0
    units = F.floor(high).cast("double")
    to_half = F.lit(0.5) - (high - units)
    up = F.when(low > to_half, 1.0).when(low == to_half, units % 2).otherwise(0.0)
    return whole * 10000.0 + units + up


def _exact(c: Column) -> Column:
    """Whether units of 0.0001 of ``c`` are whole numbers that a double holds; not for NaN and infinity."""
    return F.abs(c) < F.lit(2.0**53 / 10000)


def score4(score: Column | str) -> Column:
    """P10: score as ordered after its 4-decimal display."""
    c = (F.col(score) if isinstance(score, str) else score).cast("double")
    return F.when(_exact(c), F.signum(c) * _ten_thousandths(c) / 10000.0).otherwise(c)


def score_display(score: Column | str) -> Column:
    """P10: the 4-decimal display string."""
    c = (F.col(score) if isinstance(score, str) else score).cast("double")
    units = _ten_thousandths(c).cast("bigint")
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    text = F.concat(sign, F.floor(units / 10000).cast("string"), F.lit("."),
                    F.lpad((units % 10000).cast("string"), 4, "0"))
    return F.when(_exact(c), text).otherwise(F.format_string("%.4f", c))
