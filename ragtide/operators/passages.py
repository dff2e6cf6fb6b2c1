"""Passage text, metadata struct, field access, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ragtide.config import PASSAGE_TEMPLATE

# A passage id is a document's number * 2**20 + chunk_index, as far as both fit.
CHUNK_ID_BITS = 20

METADATA_FIELDS = ("law", "article", "title", "chunk_index", "total_chunks", "chunk_content")


def _template_parts(template: str) -> list[str | tuple[str]]:
    """Split a ``{name}`` template into literal strings and (name,) fields."""
    out: list[str | tuple[str]] = []
    rest = template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if pre:
            out.append(pre)
        out.append((name,))
    if rest:
        out.append(rest)
    return out


def render(template: str, **fields: Column) -> Column:
    """Fill a ``{name}`` template with columns; a NULL field prints as ``None``
    (as Python f-strings do)."""
    cols = []
    for part in _template_parts(template):
        if isinstance(part, tuple):
            cols.append(F.coalesce(fields[part[0]].cast("string"), F.lit("None")))
        else:
            cols.append(F.lit(part))
    return F.concat(*cols)


def passage_text(df: DataFrame, template: str = PASSAGE_TEMPLATE, out: str = "passage_text") -> DataFrame:
    """Contextual text embedded for each chunk (1-based part number)."""
    return df.withColumn(out, render(
        template, law=F.col("law"), article=F.col("article"), title=F.col("title"),
        part=F.col("chunk_index") + 1, total=F.col("total_chunks"), chunk=F.col("chunk_content")))


def pack_metadata(df: DataFrame, out: str = "metadata") -> DataFrame:
    """The six metadata fields as one struct column."""
    return df.withColumn(out, F.struct(*[F.col(c) for c in METADATA_FIELDS]))


def metadata_field(name: str, meta: str = "metadata") -> Column:
    """P5: nested field access (Catalyst prunes the other struct fields)."""
    return F.col(f"{meta}.{name}")


KEY_FIELDS = ("doc_key", "law", "article", "title", "chunk_index", "total_chunks", "chunk_content")


def key_material() -> Column:
    """All that a passage stores, with a mark for null, so that null and empty fields differ."""
    return F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in KEY_FIELDS])


def content_key() -> Column:
    return F.sha2(key_material(), 256)


def with_keys(df: DataFrame) -> DataFrame:
    """``content_key`` (sha-256 of the document key and the whole passage content,
    the idempotence key of re-indexing) and ``passage_id``.

    With a numeric ``doc_key`` the id is doc_key * 2**20 + chunk_index, so distinct passages have distinct ids. Where that does not
    fit (a chunk from 2**20 on, a key beyond 43 bits) and for keys of other types, the id is null: a store gives it one,
    from a number that it assigns to the document (``sources.store``). Both are pure functions of the row, so
    they are stable under task retry (unlike ``monotonically_increasing_id``)."""
    key, chunk = F.col("doc_key"), F.col("chunk_index")
    if isinstance(df.schema["doc_key"].dataType, IntegralType):
        top = 1 << (63 - CHUNK_ID_BITS)
        fits = key.between(F.lit(-top), F.lit(top - 1)) & (chunk < F.lit(1 << CHUNK_ID_BITS))
        # the product is computed for keys that fit only
        passage_id = F.when(fits, F.when(fits, key).cast("bigint") * F.lit(1 << CHUNK_ID_BITS) + chunk)
    else:
        passage_id = F.lit(None).cast("bigint")
    return df.withColumn("content_key", content_key()).withColumn("passage_id", passage_id)
