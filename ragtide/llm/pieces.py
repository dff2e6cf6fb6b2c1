"""SentencePiece encoding by sampling, and lossless decoding.

Encoding draws one segmentation of each text from the piece lattice with
probability proportional to the product of its pieces' probabilities
(sharpened by ``alpha``): forward filtering sums the weights of all prefixes,
backward sampling draws the last piece, then the one before, and so on. The
draws are hashes of (row key, chunk number, step), so the same row always gets
the same segmentation, on any machine and any partitioning.

The vocabulary is a merge list without probabilities; a piece of rank r gets a
weight proportional to 1 / (r + 10). A character without a piece is written as
the byte pieces of its UTF-8 form, so decoding gives back every text exactly.
Nothing is normalised; one space is put before the text and taken off again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragtide.llm.common import schema_of
from ragtide.llm.lattice import CHUNK, STACKED, Vocabulary, by_length

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of text that are encoded at once.
AT_ONCE = 1_000_000
#: Weight of writing one character as bytes.
BYTES_WEIGHT = 1e-9


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: a well-spread hash of 64-bit counters."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Samples segmentations of whole texts; holds only the vocabulary."""

    def __init__(self, vocab: Vocabulary, alpha: float = 1.0):
        self.vocab = vocab
        weight = np.zeros(vocab.size + 2)
        for i in vocab.piece.values():
            weight[i] = 1.0 / (i + 10)
        weight /= weight.sum()
        weight[vocab.size] = BYTES_WEIGHT
        self.weight = weight ** alpha
        self.weight[-1] = 0.0

    def lattice(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids [W, n, M] and, for backward sampling, the cumulative probabilities of the piece that
        ends after each character. A space mark that is part of the text is a character without a piece."""
        e = self.vocab.edges(strings)
        w, n, m = e.shape
        p = self.weight[e]
        a = np.zeros((w, n + 1))
        a[:, 0] = 1.0
        cum = np.empty((w, n, m))
        for j in range(n):
            k = min(m, j + 1)
            sums = np.cumsum(p[:, j, :k] * a[:, j - k + 1: j + 1][:, ::-1], 1)
            total = sums[:, -1]
            # exactly 1 from the last possible piece on; a draw is below 1, so it lands on a possible piece
            cum[:, j, :k] = sums / total[:, None]
            cum[:, j, k:] = 1.0
            a[:, j + 1] = total
            lo = max(0, j + 2 - m)
            a[:, lo: j + 2] /= total[:, None]  # only ratios matter from here on
        return e, cum

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts; ``keys`` are 64-bit row keys."""
        size = self.vocab.size
        chunks: list[str] = []
        number: list[np.ndarray] = []
        per_text = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            got = CHUNK.findall(" " + t)
            if len(t) >= STACKED and max(map(len, got)) > STACKED:
                got = [p for c in got for p in (self.vocab.parts(c) if len(c) > STACKED else (c,))]
            chunks += got
            per_text[i] = len(got)
            number.append(np.arange(len(got), dtype=np.uint64))
        index: dict[str, int] = {}
        which = np.fromiter((index.setdefault(c, len(index)) for c in chunks), np.int64, len(chunks))
        strings = list(index)
        with np.errstate(over="ignore"):
            seed = np.repeat(keys.view(np.uint64), per_text)
            if len(chunks):
                seed = _mix(seed ^ _mix(np.concatenate(number) + np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(which, kind="stable")
        first = np.searchsorted(which[order], np.arange(len(strings) + 1))
        counts = np.zeros(len(chunks), np.int64)
        drawn: list[tuple[np.ndarray, int, np.ndarray]] = []
        for group in by_length(strings):
            e, cum = self.lattice([strings[i] for i in group])
            occ = np.concatenate([order[first[i]: first[i + 1]] for i in group])
            row = np.repeat(np.arange(len(group)), first[group + 1] - first[group])
            if e.shape[2] and (unknown := (e[:, :, 0] == size)).any():
                # the id of an unknown character is its code point, marked by the sign
                code = np.array([[ord(c) for c in strings[i]] for i in group], np.int32)
                e[:, :, 0] = np.where(unknown, -1 - code, e[:, :, 0])
            pos = np.full(len(occ), e.shape[1] - 1)
            s, step = seed[occ], 0
            while len(occ):
                with np.errstate(over="ignore"):
                    h = _mix(s + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
                u = (h >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
                k = (cum[row, pos] <= u[:, None]).sum(1)
                drawn.append((occ, step, e[row, pos, k]))
                counts[occ] += 1
                pos = pos - k - 1
                live = pos >= 0
                occ, row, pos, s, step = occ[live], row[live], pos[live], s[live], step + 1
        ends = np.cumsum(counts)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for occ, step, piece in drawn:  # backward: step 0 is the last piece of its chunk
            ids[ends[occ] - 1 - step] = piece
        text_ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        if (ids < 0).any():
            ids, text_ends = self._as_bytes(ids, text_ends)
        return text_ends, ids

    def _as_bytes(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = -1 - ids
        width = np.where(ids >= 0, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        stop = np.cumsum(width)
        out = np.repeat(ids, width)
        for c in np.unique(ids[ids < 0]):
            at = np.flatnonzero(ids == c)
            for k, byte in enumerate(chr(-1 - c).encode()):
                out[stop[at] - width[at] + k] = self.vocab.byte_ids[byte]
        return out, np.concatenate([[0], stop])[ends]


def decode(vocab: Vocabulary, ids: list[int] | np.ndarray) -> str:
    """The text of piece ids: exact inverse of encoding, whichever segmentation was drawn."""
    return b"".join(map(vocab.surface.__getitem__, ids))[1:].decode()


#: Numbers of equal keys change them by this much.
APART = 0x9E3779B97F4A7C15


def _numbered(keys: np.ndarray, offsets: np.ndarray, seen: dict[int, int]) -> np.ndarray:
    """Keys moved by their number: the offset, and how often the key was ``seen`` before."""
    number = offsets.astype(np.uint64)
    for i, k in enumerate(keys.tolist()):
        n = seen.get(k, 0)
        if n:
            number[i] += np.uint64(n)
        seen[k] = n + 1
    with np.errstate(over="ignore"):
        return (keys.view(np.uint64) + number * np.uint64(APART)).view(np.int64)


def encode(docs: DataFrame, keep: list[str], key: Column, text: str = "text", alpha: float = 1.0,
           model_file: str = MODEL_FILE, first: Column | None = None) -> DataFrame:
    """``keep`` columns, ids (sampled pieces), n_pieces and lossless (the decoded ids equal the text).

    A null text has null ids, 0 pieces and is lossless; an empty text is one
    piece or a few for the leading space. Repeated rows with one key get the same
    segmentation, unless ``first`` is given, the number that a partition's first row of a key has: then
    the rows of a key in a partition are numbered on from it, and each draws for itself. A null key is a key like any other.
    Other columns are not read; ``keep`` may have any names but those added. An empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Sampler(Vocabulary(model_file), alpha))  # a fixed vocabulary
    schema = schema_of(docs, keep, "ids array<int>, n_pieces long, lossless boolean")

    apart = first is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = shared.value
        vocab = sampler.vocab
        seen: dict[int, int] = {}
        for b in batches:
            column = b.column(len(keep) + 1)
            chars = pc.utf8_length(column).fill_null(0).to_numpy(zero_copy_only=False).tolist()
            keys = b.column(len(keep)).to_numpy()
            if apart:
                keys = _numbered(np.ascontiguousarray(keys), b.column(len(keep) + 2).to_numpy(), seen)
            at = 0
            while at < len(chars):  # a MB of text at a time bounds the texts, chunks and draws held at once
                end, n_chars = at, 0
                while end < len(chars) and (end == at or n_chars + chars[end] <= AT_ONCE):
                    n_chars += chars[end]
                    end += 1
                part = column.slice(at, end - at).to_pylist()
                offsets, ids = sampler.encode([t or "" for t in part], np.ascontiguousarray(keys[at:end]))
                ok = [t is None or decode(vocab, ids[a:z].tolist()) == t for t, a, z in zip(part, offsets, offsets[1:])]
                null = pa.array([t is None for t in part])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                n = np.where([t is None for t in part], 0, np.diff(offsets))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).slice(at, end - at) for i in range(len(keep))),
                     pc.if_else(null, pa.scalar(None, pa.list_(pa.int32())), lists),
                     pa.array(n, pa.int64()), pa.array(ok, pa.bool_())],
                    names=[*keep, "ids", "n_pieces", "lossless"])
                at = end

    more = [] if first is None else [first.cast("long").alias("_first")]
    return docs.select(*keep, key.alias("_key"), F.col(text), *more).mapInArrow(run, schema)


def decode_column(encoded: DataFrame, ids: str = "ids", model_file: str = MODEL_FILE) -> DataFrame:
    """Add ``decoded``, the text of each row's ids (null ids: null)."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model_file))
    names = encoded.columns
    schema = schema_of(encoded, names, "decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for b in batches:
            got = [None if x is None else decode(vocab, x) for x in b.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=[*names, "decoded"])

    return encoded.mapInArrow(run, schema)
