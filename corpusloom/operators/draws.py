"""The draws of ``text.uniform`` for whole grids of (resample, place), as arrays: the first 32 bits of an MD5 each."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

# The constants of RFC 1321: sines, rotations, the word that each step adds, the state to begin with.
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_WORDS = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Steps after which the first word of the last block's state is final.
_FIRST_WORD = 61
#: Cells hashed at once: six arrays of them stay in a core's cache.
CELLS = 1 << 14


def _steps(state: list[np.ndarray], words: list[int | np.ndarray], n: int, turned: np.ndarray, free: np.ndarray) -> list[np.ndarray]:
    """The state after ``n`` steps over one block, in the arrays of ``state`` and ``free`` themselves.

    ``words``: the block's 16, each a number where all cells share it, a column where a row does, else a grid.
    """
    a, b, c, d = state
    t = free
    for i in range(n):
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            np.bitwise_and(t, b, out=t)
            np.bitwise_xor(t, d, out=t)
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_and(t, d, out=t)
            np.bitwise_xor(t, c, out=t)
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_xor(t, d, out=t)
        else:
            np.invert(d, out=t)
            np.bitwise_or(t, b, out=t)
            np.bitwise_xor(t, c, out=t)
        np.add(t, a, out=t)
        word, sine = words[_WORDS[i]], _SINES[i]
        if isinstance(word, int):
            np.add(t, np.uint32(word + sine & 0xFFFFFFFF), out=t)
        elif word.shape == t.shape:
            np.add(t, word, out=t)
            np.add(t, np.uint32(sine), out=t)
        else:
            np.add(t, word + np.uint32(sine), out=t)
        np.left_shift(t, np.uint32(_TURNS[i]), out=turned)
        np.right_shift(t, np.uint32(32 - _TURNS[i]), out=t)
        np.bitwise_or(t, turned, out=t)
        np.add(t, b, out=t)
        a, b, c, d, t = d, t, b, c, a
    return [a, b, c, d]


def _laid(lo: int, hi: int, digits: int, left: int) -> dict[int, np.ndarray]:
    """The words that hold the places ``lo`` to ``hi``, of ``digits`` digits each, behind a head of ``left`` bytes: zero where the head is."""
    first, last = left // 4, (left + digits - 1) // 4
    moving = np.zeros((hi - lo, 4 * (last - first + 1)), np.uint8)
    moving[:, left - 4 * first : left - 4 * first + digits] = np.arange(lo, hi)[:, None] // 10 ** np.arange(digits - 1, -1, -1) % 10 + ord("0")
    # a row for each word, so that a step reads its places one after another
    return dict(enumerate(np.ascontiguousarray(moving.view("<u4").T).astype(np.uint32, copy=False), first))


def _grid(heads: list[bytes], moving: dict[int, np.ndarray], digits: int) -> np.ndarray:
    """Draws of every head (all of one length) followed by every place of ``moving`` (all of ``digits`` digits)."""
    left, total = len(heads[0]), len(heads[0]) + digits
    blocks = (total + 8) // 64 + 1
    fixed = np.zeros((len(heads), 64 * blocks), np.uint8)
    fixed[:, :left] = np.frombuffer(b"".join(heads), np.uint8).reshape(len(heads), left)
    fixed[:, total] = 0x80
    fixed[:, -8:] = np.frombuffer((8 * total).to_bytes(8, "little"), np.uint8)
    fixed = fixed.view("<u4").astype(np.uint32)
    shape = (len(heads), len(next(iter(moving.values()))))
    word = lambda k: fixed[:, k, None] | moving[k] if k in moving else fixed[:, k, None] if 4 * k < left and len(heads) > 1 else int(fixed[0, k])
    old = [np.full(shape, x, np.uint32) for x in _BEGIN]
    turned, free = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for block in range(blocks):
        words, last = [word(16 * block + k) for k in range(16)], block == blocks - 1
        if not last:
            new = _steps([x.copy() for x in old], words, 64, turned, free.copy())
            old = [x + y for x, y in zip(old, new, strict=True)]
    first = old[0].copy() if blocks > 1 else np.uint32(_BEGIN[0])
    # after 61 steps, the word made last is the second of four
    return (_steps(old, words, _FIRST_WORD, turned, free)[1] + first).byteswap()


def uniforms(seed: str, resamples: list[int], start: int, stop: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """``(resamples, draws)`` in pieces that cover places ``start`` to ``stop`` of every resample once: a row of draws each,
    equal to ``uniform(seed, "<resample>:<place>")``."""
    alike: dict[int, list[int]] = {}
    for b in resamples:
        alike.setdefault(len(str(b)), []).append(b)
    lo = start
    while lo < stop:
        digits = len(str(lo))
        hi = min(stop, 10**digits, lo + CELLS)
        rows = max(1, CELLS // (hi - lo))
        for same in alike.values():
            # all resamples of one length share the places' words
            moving = _laid(lo, hi, digits, len(f"{seed}:{same[0]}:".encode()))
            for i in range(0, len(same), rows):
                yield same[i : i + rows], _grid([f"{seed}:{b}:".encode() for b in same[i : i + rows]], moving, digits)
        lo = hi
