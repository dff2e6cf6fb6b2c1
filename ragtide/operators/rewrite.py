"""Query rewriting and expansion.

The rewriter is pluggable: any ``Column(question) -> Column(generated text)``.
Its text is parsed by P11: the part after the marker, per line stripped,
lines starting ``1.``, ``2.`` or ``3.`` kept, everything through the first dot
dropped, stripped, first three kept.

The default rewriter is model free and deterministic; it writes the same
numbered format a generator would:
1. the words longer than three characters, 2. the first half of the words,
3. the second half of the words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragtide.config import MAX_REWRITES, REWRITE_MARKER, REWRITE_NUMBERS, REWRITE_PROMPT_TEMPLATE
from ragtide.functions.text import py_strip, quote_regex, split_nonempty_words
from ragtide.operators.passages import render

Rewriter = Callable[[Column], Column]


def rewrite_prompt(question: Column) -> Column:
    return render(REWRITE_PROMPT_TEMPLATE, query=question)


def default_rewriter(question: Column) -> Column:
    """Deterministic stand-in for the rewrite model: prompt + numbered variants."""
    words = split_nonempty_words(question)
    n = F.size(words)
    half = F.floor(n / 2).cast("int")
    v1 = F.array_join(F.filter(words, lambda w: F.length(w) > 3), " ")
    v2 = F.array_join(F.slice(words, 1, F.greatest(half, F.lit(1))), " ")
    v3 = F.array_join(F.slice(words, half + 1, n), " ")
    return F.concat(rewrite_prompt(question), F.lit("\n1. "), v1, F.lit("\n2. "), v2, F.lit("\n3. "), v3)


def parse_rewrites(generated: Column, marker: str = REWRITE_MARKER, limit: int = MAX_REWRITES) -> Column:
    """P11 + O9: numbered rewrites -> array<string> (at most ``limit``).

    Text without the marker yields NULL (the original raises there); callers
    treat NULL as no rewrites.
    """
    after = F.try_element_at(F.split(generated, quote_regex(marker)), F.lit(2))
    lines = F.transform(F.split(py_strip(after), "\n"), py_strip)
    numbered = F.filter(lines, _starts_numbered)
    return F.slice(F.transform(numbered, lambda ln: py_strip(_after_first_dot(ln))), 1, limit)


def _starts_numbered(ln: Column) -> Column:
    cond = F.lit(False)
    for n in REWRITE_NUMBERS:
        cond = cond | ln.startswith(f"{n}.")
    return (F.length(ln) > 0) & cond


def _after_first_dot(ln: Column) -> Column:
    return F.substring(ln, F.instr(ln, ".") + 1, 1 << 30)


def expand_queries(questions: DataFrame, rewriter: Rewriter | None = None, use_rewriting: bool = True,
                   qid: str = "question_id", text: str = "question", keep: list[str] | None = None) -> DataFrame:
    """O1 (+U3): ``(question_id, [keep,] query_ord, query_text)``; the original is ord 0,
    rewrites follow in order."""
    ids = [qid, *(keep or [])]
    if not use_rewriting:
        return questions.select(*ids, F.lit(0).alias("query_ord"), F.col(text).alias("query_text"))
    gen = (rewriter or default_rewriter)(F.col(text))
    rewrites = F.coalesce(parse_rewrites(gen), F.array().cast("array<string>"))
    return questions.select(*ids, F.posexplode(F.concat(F.array(F.col(text)), rewrites)).alias(
        "query_ord", "query_text"))
