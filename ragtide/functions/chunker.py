"""Recursive overlapping character chunker (per-document helper).

Rule (lengths in code points):
1. Pick the first separator that occurs in the text (the empty separator
   always occurs); the separators after it are used for recursion.
2. Cut the text so every piece after the first begins with the separator;
   the empty separator cuts into single characters; empty pieces vanish.
3. Pieces shorter than ``size`` are collected; a piece of ``size`` or more
   flushes the collected pieces through the merge step, then is split again
   with the remaining separators (or kept whole when none remain).
4. Merge keeps a sliding window of pieces: before adding a piece that would
   push the window over ``size`` the window is emitted, then pieces leave
   from the left while the window is longer than ``overlap`` (or the new
   piece still does not fit).
5. Emitted text is the concatenation of the window, stripped; empty results
   are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from ragtide.config import CHUNK_OVERLAP, CHUNK_SEPARATORS, CHUNK_SIZE


def _cut(text: str, sep: str) -> list[str]:
    if sep == "":
        return list(text)
    parts = text.split(sep)
    pieces = [parts[0]] + [sep + p for p in parts[1:]]
    return [p for p in pieces if p]


def _emit(window: list[str], out: list[str]) -> None:
    s = "".join(window).strip()
    if s:
        out.append(s)


def _merge(pieces: list[str], size: int, overlap: int, out: list[str]) -> None:
    window: list[str] = []
    lengths: list[int] = []
    total = 0
    head = 0  # window is window[head:], kept as a list with a moving head
    for piece in pieces:
        n = len(piece)
        if total + n > size and head < len(window):
            _emit(window[head:], out)
            while head < len(window) and (total > overlap or total + n > size):
                total -= lengths[head]
                head += 1
        window.append(piece)
        lengths.append(n)
        total += n
    if head < len(window):
        _emit(window[head:], out)


def _split(text: str, seps: Sequence[str], size: int, overlap: int, out: list[str]) -> None:
    sep = seps[-1]
    rest: Sequence[str] = ()
    for i, s in enumerate(seps):
        if s == "" or s in text:
            sep = s
            rest = seps[i + 1:] if s != "" else ()
            break
    good: list[str] = []
    for piece in _cut(text, sep):
        if len(piece) < size:
            good.append(piece)
            continue
        if good:
            _merge(good, size, overlap, out)
            good = []
        if rest:
            _split(piece, rest, size, overlap, out)
        else:
            out.append(piece)
    if good:
        _merge(good, size, overlap, out)


def split_text(
    text: str | None,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: Sequence[str] = CHUNK_SEPARATORS,
) -> list[str]:
    """Chunks of one text; ``None`` or blank text gives no chunks."""
    if not text:
        return []
    out: list[str] = []
    _split(text, tuple(separators), size, overlap, out)
    return out
