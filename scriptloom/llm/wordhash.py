"""Words of many texts at once, as numpy arrays: places, 64-bit hashes and rolling k-gram hashes.

A batch of texts is one byte buffer, a zero byte after each text. A word is a longest run of bytes of one class, so
its hash is a difference of prefix sums; nothing here loops over words in Python. Buffers are worked on in pieces of
``PIECE`` bytes, so memory doesn't depend on the length of a text beyond a few bytes for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_powers: dict[str, np.ndarray] = {}

#: [0-9a-z] and every byte from 0x80; after A-Z have been lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = max(n, PIECE + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


class Words:
    """Words of a chunk of texts. ``start``/``end``: byte places in ``buffer``; ``first[d]``: index of text d's first word."""

    def __init__(self, texts: list[bytes], kind: np.ndarray = ALNUM):
        lowered = [t.lower() for t in texts]  # bytes.lower touches A-Z alone
        self.buffer = np.frombuffer(b"\0".join(lowered) + b"\0", np.uint8)
        inside = kind[self.buffer]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edges = np.concatenate(([0], edges))
        self.start, self.end = edges[0::2], edges[1::2]
        begins = np.cumsum([0, *(len(t) + 1 for t in lowered)])
        self.first = np.searchsorted(self.start, begins)
        self.counts = np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return self._hashed(self.start, self.end)

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of each word of more than ``size`` bytes, and the hash of its first ``size`` bytes, apart from words' own."""
        at = np.flatnonzero(self.end - self.start > size)
        return at, mix(self._hashed(self.start[at], self.start[at] + size) + np.uint64(size))

    def _hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), np.uint64)
        i = 0
        while i < len(out):
            at = int(start[i])
            j = max(i + 1, int(np.searchsorted(end, at + PIECE, "right")))
            size = int(end[j - 1]) - at
            up, down = _power_tables(size + 1)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum((self.buffer[at : at + size].astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
            s, e = start[i:j] - at, end[i:j] - at
            out[i:j] = (sums[e] - sums[s]) * down[s]
            i = j
        return mix(out ^ (end - start).astype(np.uint64))

    def grams(self, k: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of each k-gram inside one text, in order."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h = hashes[:n].copy()
        for j in range(1, k):
            h = mix(h) + hashes[j : j + n] * np.uint64(2 * j + 1)
        doc = self.doc
        at = np.flatnonzero(doc[:n] == doc[k - 1 :])
        return at, mix(h[at])

    def spans(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """The words first..last, one space between, of each pair of word indices, as an Arrow string array."""
        tight = self.end - self.start + 1
        offsets = np.concatenate(([0], np.cumsum(tight)))
        flat = np.full(int(offsets[-1]), 0x20, np.uint8)  # all words, a space after each
        inside = np.ones(len(flat), bool)
        inside[offsets[1:] - 1] = False
        within = np.zeros(len(self.buffer) + 1, np.int8)
        within[self.start] += 1
        within[self.end] -= 1
        flat[inside] = self.buffer[np.cumsum(within[:-1], dtype=np.int8).astype(bool)]
        begin, size = offsets[first], offsets[last + 1] - 1 - offsets[first]
        out = np.concatenate(([0], np.cumsum(size)))
        take = np.arange(int(out[-1]), dtype=np.int64) + np.repeat(begin - out[:-1], size)
        data = flat[take]
        if out[-1] < 2**31:
            return pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(out.astype(np.int32)), pa.py_buffer(data)])
        return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(out), pa.py_buffer(data)]).cast(pa.string())


def chunks(column: pa.Array | pa.ChunkedArray, size: int = PIECE) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first row, UTF-8 texts) for runs of rows of about ``size`` bytes; null reads as empty."""
    begin, texts, total = 0, [], 0
    for i, value in enumerate(column.cast(pa.binary())):
        text = value.as_py() or b""
        texts.append(text)
        total += len(text)
        if total >= size:
            yield begin, texts
            begin, texts, total = i + 1, [], 0
    if texts:
        yield begin, texts
