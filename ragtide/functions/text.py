"""Column-expression helpers for text (all JVM-side, codegen-friendly).

Each helper has a DuckDB twin used by the oracle SQL in ``__spark_entry__``;
they are written to agree on the test data (Unicode letters/digits tokens,
code-point lengths).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragtide.config import RANK_DECIMALS, TOKEN_PATTERN

# The characters Python's str.isspace() accepts (what str.strip()/str.split()
# remove), written out so Java regex and RE2 (the DuckDB twins) agree.
WS_CLASS = r"[\t\n\x0b\x0c\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP_RE = rf"^{WS_CLASS}+|{WS_CLASS}+$"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """Python ``str.strip()`` on a string column."""
    return F.regexp_replace(col_(c), _STRIP_RE, "")


def tokens(c: Column | str) -> Column:
    """Lower-cased maximal runs of Unicode letters/digits, as array<string>."""
    return F.regexp_extract_all(F.lower(col_(c)), F.lit(TOKEN_PATTERN), 0)


def rank_key(c: Column | str, decimals: int = RANK_DECIMALS) -> Column:
    """Ordering key for similarity/score: rounded to drop summation-order noise."""
    return F.round(col_(c).cast("double"), decimals)


def split_nonempty_words(c: Column | str) -> Column:
    """Whitespace tokens (Python ``str.split()`` without arguments)."""
    return F.filter(F.split(col_(c), f"{WS_CLASS}+"), lambda w: F.length(w) > 0)


def quote_regex(s: str) -> str:
    """Literal pattern for Spark's regex-based ``split``."""
    return r"\Q" + s.replace(r"\E", r"\E\\E\Q") + r"\E"
