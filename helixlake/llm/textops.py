"""Vectorised word hashing over blocks of documents (NumPy; shared by several operators).

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Documents are laid end to end in a
block of about ``BLOCK`` bytes, so that the NumPy call overhead is paid per block, not per document;
one document longer than that is a block of its own. All hashes are 64-bit and depend on the bytes
of the words alone, so equal word sequences get equal hashes in any document and on any executor.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 18
_U = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03  # odd, so invertible modulo 2**64

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=_U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK + (1 << 16))
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, dtype=_U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=_U))
            if size > 8 * BLOCK:  # a giant document: do not keep its tables
                up, down, self.up, self.down = self.up, self.down, self.up[:BLOCK].copy(), self.down[:BLOCK].copy()
                return up[:n], down[:n]
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


class Block:
    """Words of several documents: byte spans, hashes, and the range of words of each document."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.data, dtype=np.uint8)
        self.raw = raw
        space = IS_SPACE[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(raw) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]  # the block ends in a space, so edges pair up
        size = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.text_at = np.concatenate(([0], np.cumsum(size)))
        self.first = np.searchsorted(self.start, self.text_at)  # words of document i: first[i]..first[i+1]

    def word_hashes(self) -> np.ndarray:
        up, down = _BYTES.get(len(self.raw))
        total = np.zeros(len(self.raw) + 1, dtype=_U)
        np.cumsum((self.raw.astype(_U) + _U(1)) * up, out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        return mix(h + (self.end - self.start).astype(_U))

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on (positions with fewer words left have none)."""
    if len(words) < n:
        return np.zeros(0, dtype=_U)
    up, down = _WORDS.get(len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=_U)
    np.cumsum(words * up[:-1], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(words) - n + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for each i, in O(n log width)."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def in_blocks(sizes: list[int], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes sum to about ``limit``."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n + 1
    if begin < len(sizes):
        yield begin, len(sizes)


def text_blocks(column, limit: int = BLOCK) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, row after the last, UTF-8 texts) of about ``limit`` bytes each, so that a batch is never held as Python objects whole."""
    import pyarrow.compute as pc

    for lo, hi in in_blocks(pc.fill_null(pc.binary_length(column), 0).to_pylist(), limit):
        yield lo, hi, encoded(column.slice(lo, hi - lo))


def trimmed(run):
    """A partition function that gives freed memory back at its end: workers live on, and an executor's memory is shared by them and the JVM."""

    def call(batches):
        yield from run(batches)
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps its free lists
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return call


def encoded(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, empty for null."""
    import pyarrow as pa

    as_bytes = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.binary())
    return [x if x is not None else b"" for x in as_bytes.to_pylist()]
