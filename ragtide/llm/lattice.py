"""Piece lattices over a fixed public vocabulary, computed for many strings at once.

A string of n characters has one lattice: an edge for every substring that is a
piece. Strings of equal length are stacked, so the dynamic programs run as
array operations. No piece crosses a boundary between two chunks (see
``chunks``), so the lattice of a text is the sequence of its chunks' lattices
and per-chunk results combine exactly.
"""

from __future__ import annotations

import re

import numpy as np

SPACE = "▁"
#: Spaces go with the word after them; a line feed stands alone.
CHUNK = re.compile(r" *[^ \n]+|\n| +")
#: Longer strings are cut where no piece crosses; what has no such place is handled one by one with per-position scaling.
STACKED = 32
#: Characters of a long string whose pieces are looked up at once, and positions whose probabilities are.
LOOKED_AT = 1 << 18


class Vocabulary:
    """Surface -> id of a SentencePiece model's ordinary pieces, and the byte pieces.

    Pieces with a space mark after another character, and pieces with a line
    feed, are left out, because they could cross a chunk boundary.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = sp.get_piece_size()
        self.piece: dict[str, int] = {}
        self.byte_ids = np.full(256, -1, np.int64)
        self.surface: list[bytes] = [b""] * self.size
        for i in range(self.size):
            s = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(s[3:5], 16)] = i
                self.surface[i] = bytes([int(s[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.surface[i] = s.replace(SPACE, " ").encode()
                if SPACE not in s.lstrip(SPACE) and "\n" not in s:
                    self.piece[s.replace(SPACE, " ")] = i
        self.longest = max(map(len, self.piece))
        self._trie()

    def _trie(self) -> None:
        """Prefix tree of the pieces as sorted arrays: (state, code point) -> next state, and each state's piece."""
        state, keys, piece = {"": 0}, [], [-1]
        for s in sorted(self.piece):
            for i in range(1, len(s) + 1):
                if s[:i] not in state:
                    keys.append(state[s[: i - 1]] << 21 | ord(s[i - 1]))
                    state[s[:i]] = len(state)
                    piece.append(-1)
            piece[state[s]] = self.piece[s]
        order = np.argsort(np.array(keys, np.int64))
        self.step_keys = np.array(keys, np.int64)[order]
        self.step_to = order + 1  # states are numbered in the order of their keys, from 1
        self.state_piece = np.array(piece, np.int32)

    def parts(self, string: str) -> list[str]:
        """The string cut where no piece crosses, into parts of at most STACKED characters if there are such places.

        The lattice of the string is the sequence of its parts' lattices, so sums and draws over parts are those over the
        string. Characters are looked at a block at a time."""
        n = len(string)
        if n <= STACKED:
            return [string]
        reach = np.arange(1, n + 1)  # where the longest piece from each character on ends
        for a in range(0, n, LOOKED_AT):
            code = np.frombuffer(string[a: a + LOOKED_AT + self.longest].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            start = np.arange(min(LOOKED_AT, n - a))
            state = np.zeros(len(start), np.int64)
            for k in range(self.longest):
                inside = start + k < len(code)
                start, state = start[inside], state[inside]
                key = state << 21 | code[start + k]
                at = np.minimum(np.searchsorted(self.step_keys, key), len(self.step_keys) - 1)
                live = self.step_keys[at] == key
                start, state = start[live], self.step_to[at[live]]
                if len(start) == 0:
                    break
                whole = start[self.state_piece[state] >= 0]
                reach[a + whole] = a + whole + k + 1
        far = np.maximum.accumulate(reach)
        cuts = np.append(np.flatnonzero(far[:-1] == np.arange(1, n)) + 1, n)
        out, begin = [], 0
        while begin < n:
            i = int(np.searchsorted(cuts, begin + STACKED, side="right")) - 1
            end = int(cuts[i])
            if i < 0 or end <= begin:
                end = int(cuts[i + 1])  # no place for a cut soon enough
            out.append(string[begin:end])
            begin = end
        return out

    def edges(self, strings: list[str]) -> np.ndarray:
        """[W, n, M] ids for W strings of n characters: at [w, j, k] the piece of length k + 1 that ends
        after character j, -1 if there is none. Every single character gets an edge: ``size`` if no piece."""
        w, n = len(strings), len(strings[0])
        m = min(self.longest, n)
        code = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        out = np.full((w * n, m), -1, np.int32)
        # All starts walk down the prefix tree together; those without a longer piece leave.
        end = np.arange(w * n)
        left = np.tile(np.arange(n, 0, -1), w)  # characters from the start to the end of its string
        state = np.zeros(w * n, np.int64)
        for k in range(m):
            key = state << 21 | code[end]
            at = np.minimum(np.searchsorted(self.step_keys, key), len(self.step_keys) - 1)
            live = self.step_keys[at] == key
            end, left, state = end[live], left[live] - 1, self.step_to[at[live]]
            out[end, k] = self.state_piece[state]
            more = left > 0
            end, left, state = end[more] + 1, left[more], state[more]
            if len(end) == 0:
                break
        single = out[:, 0]
        single[single < 0] = self.size
        return out.reshape(w, n, m)


def forward(edges: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum over all segmentations, for L piece distributions at once.

    ``prob`` is [size + 2, L]; row ``size`` is the unknown character and the last
    row (index -1, no piece) is zero. Returns alpha [W, n + 1, L], scaled at each
    position of long strings, and the log of the total [W, L].
    """
    w, n, m = edges.shape
    alpha = np.zeros((w, n + 1, prob.shape[1]))
    alpha[:, 0] = 1.0
    log_scale = np.zeros((w, prob.shape[1]))
    step = n if n <= STACKED else 1024  # a long string's probabilities for all languages at once would be large
    for j in range(n):
        if j % step == 0:
            p = prob[edges[:, j: j + step]]
        k = min(m, j + 1)
        # pieces of length 1..k that end after j start at j, j-1, ..., j-k+1
        alpha[:, j + 1] = np.einsum("wkl,wkl->wl", p[:, j % step, :k], alpha[:, j - k + 1: j + 1][:, ::-1])
        if n > STACKED:  # keep the window of live alphas near 1
            top = alpha[:, j + 1].copy()
            top[top == 0] = 1.0
            lo = max(0, j + 2 - m)
            alpha[:, lo: j + 2] /= top[:, None]
            log_scale += np.log(top)
    return alpha, np.log(alpha[:, n]) + log_scale


def by_length(strings: list[str], stacked: int = 20_000) -> list[np.ndarray]:
    """Index groups of strings with equal length, each small enough to stack."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    out = []
    for group in np.split(order, cuts):
        if len(group) == 0:
            continue
        n = int(lengths[group[0]])
        step = 1 if n > STACKED else max(1, min(stacked, 2_000_000 // (n * min(n, 16))))
        out += [group[a: a + step] for a in range(0, len(group), step)]
    return out
