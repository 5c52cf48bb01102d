"""Vectorised word hashing, window hashes and minimiser anchors over a batch of documents.

Words are hashed by a polynomial over random byte values, sequences of words by a polynomial
over the mixed word hashes, both from prefix sums modulo 2**64, so the hash of any run of
words costs a few array operations. All functions are pure functions of the words, equal in
every task.
"""

from __future__ import annotations

import numpy as np

_BLOCK = 1 << 20  # bytes of text whose word hashes are computed at a time


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64 finaliser)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_GOLDEN = 0x9E3779B97F4A7C15
_BYTE_VALUE = mix((np.arange(1, 257, dtype=np.uint64)) * np.uint64(_GOLDEN))
_BYTE_STEP = 0xD1342543DE82EF95
_WORD_STEP = 0xF1357AEA2E62A9C5
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class _Powers:
    """Powers of an odd step and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, step: int):
        self.step, self.inverse = step, pow(step, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int):
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)

            def grow(step):
                a = np.full(size, step, dtype=np.uint64)
                a[0] = 1
                return np.multiply.accumulate(a)
            self.up, self.down = grow(self.step), grow(self.inverse)
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BYTE_STEP), _Powers(_WORD_STEP)


class Runs:
    """Hashes of runs of consecutive values: ``of(i, n)`` for arrays of starts and lengths."""

    def __init__(self, values: np.ndarray, powers: _Powers):
        n = len(values)
        up, self.down = powers.upto(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def of(self, start, length):
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start]
                   + np.asarray(length).astype(np.uint64) * np.uint64(_GOLDEN))


class Words:
    """Words of a batch of texts: ``doc`` (position in the batch) and ``hash`` of every word,
    ``first[d]`` the position of document d's first word (``first[-1]``: number of words)."""

    def __init__(self, texts: list):
        buf = b"\n".join(t or b"" for t in texts) + b"\n"
        raw = np.frombuffer(buf, dtype=np.uint8)
        sizes = np.array([len(t or b"") + 1 for t in texts], dtype=np.int64)
        space = _IS_SPACE[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(raw) and not space[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[0::2], edge[1::2]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(starts, bounds)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = np.empty(len(starts), dtype=np.uint64)
        a = 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + _BLOCK)))
            lo = starts[a]
            run = Runs(_BYTE_VALUE[raw[lo:ends[b - 1]]], _BYTES)
            self.hash[a:b] = run.of(starts[a:b] - lo, ends[a:b] - starts[a:b])
            a = b
        self.runs = Runs(self.hash, _WORDS)

    def __len__(self):
        return len(self.hash)


class Anchors:
    """Minimiser anchors of all windows of ``size`` words (never across documents).

    The anchor of a window is its k-gram of smallest hash, leftmost on ties: equal windows
    have equal anchors at equal offsets. Windows with one anchor are neighbours, so an anchor
    ``at`` owns the windows starting at ``low..high``; ``gram`` is the hash of its k-gram, and
    ``context`` of all words its windows span together with the anchor's place in them."""

    def __init__(self, words: Words, size: int, k: int):
        n = len(words) - size + 1
        none = np.empty(0, dtype=np.int64)
        self.at = self.low = self.high = none
        self.gram = self.context = none.astype(np.uint64)
        self.doc = none
        if n <= 0:
            return
        ok = np.flatnonzero(words.doc[:n] == words.doc[size - 1:])
        if not len(ok):
            return
        grams = words.runs.of(np.arange(len(words) - k + 1), np.int64(k))
        view = np.lib.stride_tricks.sliding_window_view(grams, size - k + 1)
        at = np.empty(len(ok), dtype=np.int64)
        for a in range(0, len(ok), 1 << 16):
            part = ok[a:a + (1 << 16)]
            at[a:a + (1 << 16)] = part + view[part].argmin(axis=1)
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        self.at = at[new]
        self.low = ok[new]
        self.high = ok[np.concatenate([new[1:], [len(at)]]) - 1]
        self.doc = words.doc[self.at]
        self.gram = grams[self.at]
        place = (self.at - self.low).astype(np.uint64) << np.uint64(20) | (self.high - self.low).astype(np.uint64)
        self.context = mix(words.runs.of(self.low, self.high - self.low + size) ^ mix(place + np.uint64(1)))

    def first_in_doc(self) -> np.ndarray:
        """Per anchor: position (in these arrays) of the first anchor of the same document with
        the same gram and context -- itself where it is the first."""
        if not len(self.at):
            return np.empty(0, dtype=np.int64)
        order = np.lexsort((self.at, self.context, self.gram, self.doc))
        d, g, c = self.doc[order], self.gram[order], self.context[order]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        out = np.empty(len(order), dtype=np.int64)
        out[order] = order[lead]
        return out


def covered(n_words: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Mask of the words that windows at ``starts`` cover."""
    step = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + size, n_words), -1)
    return np.cumsum(step[:-1]) > 0
