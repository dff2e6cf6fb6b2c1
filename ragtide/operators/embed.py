"""Embedding of passages and questions with one pluggable encoder.

The default encoder is model free: feature hashing of token counts
(Weinberger et al. 2009) into ``EMBED_DIM`` buckets, L2-normalised, stored as
float32. An Arrow UDF lower-cases a batch of texts and splits it into tokens,
hashes its distinct tokens (the first 8 hex digits of md5, mod the buckets) and counts
over the whole batch (numpy bincount, no per-row Python).

A real sentence encoder plugs in as any ``Column -> Column`` function, e.g. a
``pyspark.ml.functions.predict_batch_udf`` that loads the model once per
Python worker.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtide.config import EMBED_DIM
from ragtide.functions.digest import md5_heads
from ragtide.functions.text import col_
from ragtide.functions.words import lowers, shipped, token_lists, token_runs

Encoder = Callable[[Column], Column]

#: Texts counted together, so that their counts stay in the processor's cache.
_ROWS_AT_ONCE = 512


def _unit_vectors(toks: pa.Array, dim: int) -> pa.Array:
    if isinstance(toks, pa.ChunkedArray):
        toks = toks.combine_chunks()
    n = len(toks)
    words = pc.list_flatten(toks).dictionary_encode()
    bucket = (md5_heads(words.dictionary) % np.uint32(dim)).astype(np.int64)[words.indices.to_numpy(zero_copy_only=False)]
    row = pc.list_parent_indices(toks).to_numpy(zero_copy_only=False)
    vecs = np.empty((n, dim), np.float32)
    for a in range(0, n, _ROWS_AT_ONCE):
        z = min(n, a + _ROWS_AT_ONCE)
        of = slice(*np.searchsorted(row, (a, z)))
        counts = np.bincount((row[of] - a) * dim + bucket[of], minlength=(z - a) * dim).reshape(-1, dim).astype(np.float64)
        norms = np.sqrt(np.einsum("ij,ij->i", counts, counts))
        norms[norms == 0] = 1.0
        np.divide(counts, norms[:, None], out=vecs[a:z], casting="same_kind")
    offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(vecs.ravel(), type=pa.float32()))


def _make_hash_udf(dim: int):
    runs, low = token_runs(), lowers()

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def hashed_unit_vectors(texts: pa.Array) -> pa.Array:
        return _unit_vectors(token_lists(texts, runs, low), dim)

    return hashed_unit_vectors


_HASH_UDFS: dict[int, object] = {}


@dataclass(frozen=True)
class HashedEncoder:
    """Text column -> array<float> unit vector (zeros for no tokens).

    An encoder may have ``shipped``, the column that goes to Python, and ``arrays``, its vectors as a function of that column's
    batches: whatever reads the vectors in Python then computes them there."""

    dim: int = EMBED_DIM

    def __call__(self, text: Column) -> Column:
        if self.dim not in _HASH_UDFS:
            _HASH_UDFS[self.dim] = _make_hash_udf(self.dim)
        return _HASH_UDFS[self.dim](self.shipped(text))

    def shipped(self, text: Column) -> Column:
        return shipped(text)

    def arrays(self) -> Callable[[pa.Array], pa.Array]:
        runs, low, dim = token_runs(), lowers(), self.dim
        return lambda texts: _unit_vectors(token_lists(texts, runs, low), dim)


def hashed_encoder(dim: int = EMBED_DIM) -> Encoder:
    """Default encoder."""
    return HashedEncoder(dim)


def embed(df: DataFrame, text_col: str, out_col: str = "embedding", encoder: Encoder | None = None) -> DataFrame:
    """Add ``out_col`` = encoder(text). Select the needed columns before calling:
    the UDF is an optimisation barrier for column pruning."""
    enc = encoder or hashed_encoder()
    return df.withColumn(out_col, enc(col_(text_col)))
