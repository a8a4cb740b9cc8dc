"""Shared helpers for text operators: byte-bounded batches, word finding and
rolling hashes over many documents at once (numpy, inside Spark tasks)."""

from __future__ import annotations

import numpy as np

# FIXED VALUES: the ASCII separators of a word, [\x20\x09-\x0D].
SEPARATORS = bytes((0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D))

_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[list(SEPARATORS)] = True

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (bijective): spreads every input bit over the word."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


BYTE_CODE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


class Rolling:
    """Polynomial hashes modulo 2**64 of any slice of a sequence of codes.

    ``slice_hash(a, b)`` of two slices is equal when the slices are equal.
    """

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, codes: np.ndarray, base: int):
        n = len(codes)
        up, self.down = self._powers(base, n + 1)
        self.prefix = np.zeros(n + 1, dtype=_U)
        np.cumsum(codes * up[:n], out=self.prefix[1:])

    @classmethod
    def _powers(cls, base: int, n: int):
        have = cls._tables.get(base)
        if have is None or len(have[0]) < n:
            size = max(n, 1 << 20)
            inverse = pow(base, -1, 1 << 64)
            tables = []
            for b in (base, inverse):
                p = np.full(size, _U(b))
                p[0] = 1
                tables.append(np.cumprod(p, dtype=_U))
            have = cls._tables[base] = tuple(tables)
        return have

    def slice_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[end] - self.prefix[start]) * self.down[start])


def byte_batches(texts, limit: int):
    """Split a sequence of ``bytes`` into runs ``(first, last)`` of about
    ``limit`` bytes (one longer text is a run of its own)."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def encode(text) -> bytes:
    return text.encode("utf-8") if text is not None else b""


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of several texts laid end to end.

    ``start`` / ``end`` are byte positions in ``data``; ``first[d]`` is the
    index of the first word of text ``d`` (``first[-1]`` the word count).
    """

    def __init__(self, texts: list[bytes]):
        joined = b" ".join(texts) + b" "
        self.data = np.frombuffer(joined, dtype=np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.offset = np.concatenate(([0], np.cumsum(sizes)))
        self.inside = ~_IS_SEP[self.data]
        edge = np.diff(self.inside.astype(np.int8), prepend=np.int8(0))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, self.offset)

    def codes(self, base: int = 0x9E3779B97F4A7C15 | 1) -> np.ndarray:
        """A 64-bit hash of every word."""
        return Rolling(BYTE_CODE[self.data], base).slice_hash(self.start, self.end)
