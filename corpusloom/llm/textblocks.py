"""Vectorised words and hashes over Arrow text batches.

A batch's texts are taken in blocks of bounded bytes; within a block every step is one numpy pass over
the bytes or the words, so the cost per word is tens of nanoseconds and the memory is a small multiple of
the block. A text longer than a block is a block of its own: texts are always whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        base = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix(base + np.uint64(seed * 0x632BE59BD9B4E019 & (2**64 - 1))) | np.uint64(1)


_BYTE = stream(11, 256)
_POS = stream(12, 1 << 12)


def _positions(n: int) -> np.ndarray:
    global _POS
    if n > len(_POS):
        _POS = stream(12, 1 << (n - 1).bit_length())
    return _POS


def byte_class(pattern: bytes) -> np.ndarray:
    """A 256-entry mask, true for the bytes listed."""
    out = np.zeros(256, bool)
    out[np.frombuffer(pattern, np.uint8)] = True
    return out


#: Words as runs of anything but space and the controls tab to carriage return.
NOT_SPACE = ~byte_class(bytes([0x20, *range(0x09, 0x0E)]))
#: Words as runs of ASCII letters, digits and all non-ASCII bytes.
ALNUM = byte_class(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Block:
    """Texts ``lo`` to ``hi`` of a batch: their bytes end to end, and where each begins (one more at the end)."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks of at most ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield Block(lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """Words of a block: byte ranges, 64-bit hashes, and where each text's words begin (one more at the end)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words(block: Block, is_word: np.ndarray, lower: bool) -> Words:
    """Maximal runs of word bytes that stay inside one text, hashed after optional A-Z folding."""
    data, off = block.data, block.offsets
    n = len(data)
    empty = np.zeros(0, np.int64)
    if not n:
        return Words(empty, empty, np.zeros(0, np.uint64), np.zeros(len(off), np.int64))
    inside = is_word[data]
    brk = np.zeros(n + 1, bool)
    brk[off] = True
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~prev | brk[:-1]))
    nxt = np.empty(n, bool)
    nxt[-1] = False
    nxt[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~nxt | brk[1:])) + 1
    if not len(start):
        return Words(start, end, np.zeros(0, np.uint64), np.zeros(len(off), np.int64))
    body = data[inside]
    if lower:
        body = LOWER[body]
    size = end - start
    at = np.concatenate(([0], np.cumsum(size)[:-1]))
    pos = np.arange(len(body)) - np.repeat(at, size)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_BYTE[body] * _positions(int(size.max()))[pos], at)
        h = mix(h + size.astype(np.uint64))
    return Words(start, end, h, np.searchsorted(start, off))


def gram_hash(h: np.ndarray, n: int, seed: int = 21) -> np.ndarray:
    """Hashes of each ``n`` consecutive entries (shorter input: empty)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    coeff = stream(seed, n)
    m = len(h) - n + 1
    with np.errstate(over="ignore"):
        out = np.full(m, np.uint64(n))
        for j in range(n):
            out += (h[j : j + m] ^ (h[j : j + m] >> np.uint64(29))) * coeff[j]
        return mix(out)


def long_list(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """A list<int64> array from flat 64-bit values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64)))
