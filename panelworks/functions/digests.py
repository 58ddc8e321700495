"""MD5 of many short texts at once, in numpy."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

AT_ONCE = 32_768  # digests whose state stays in a processor's cache

_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_BLOCK, _TEXT = 64, 55  # bytes of a block, and of the longest text that one block holds


def _rounds(words: list, fixed: list[int], shape: tuple[int, int]) -> list[np.ndarray]:
    """State after one block; ``words`` are the varying parts (None: none) that are added to ``fixed``."""
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f, turned = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i, (sine, turn) in enumerate(zip(_SINES, _TURNS)):
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            at = 7 * i % 16
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        f += a
        f += np.uint32((sine + fixed[at]) & 0xFFFFFFFF)
        if words[at] is not None:
            f += words[at]
        np.right_shift(f, np.uint32(32 - turn), out=turned)
        f <<= np.uint32(turn)
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    for x, start in zip((a, b, c, d), _START):
        x += np.uint32(start)
    return [a, b, c, d]


def digest_words(heads: Sequence[bytes], numbers: np.ndarray) -> np.ndarray:
    """Big-endian 32-bit words of md5(head + decimal number): numbers x (heads x 4).

    A text is its head's part plus its number's part of a block, so the heads of one
    length and the numbers of one length make their blocks by a broadcast sum.
    """
    numbers = np.asarray(numbers, np.int64)
    longest = max(map(len, heads), default=0) + len(str(numbers.max(initial=0)))
    if longest > _TEXT or numbers.min(initial=0) < 0:
        raise ValueError("digest_words takes numbers from zero and texts of one block")
    order = np.argsort(numbers, kind="stable")
    ordered = numbers[order]
    ends = np.searchsorted(ordered, 10 ** np.arange(1, 19, dtype=np.int64)).tolist() + [len(ordered)]
    out = np.empty((4, len(heads), len(numbers)), np.uint32)
    for digits, (start, end) in enumerate(zip([0, *ends], ends), 1):
        if start == end:
            continue
        shown = ordered[start:end, None] // 10 ** np.arange(digits - 1, -1, -1, dtype=np.int64) % 10 + ord("0")
        for size in sorted({len(h) for h in heads}):
            mine = np.array([k for k, h in enumerate(heads) if len(h) == size])
            first = np.zeros((len(mine), _BLOCK), np.uint8)
            first[:, :size] = [list(heads[k]) for k in mine]
            second = np.zeros((end - start, _BLOCK), np.uint8)
            second[:, size : size + digits] = shown
            second[:, size + digits] = 0x80
            first, second = (np.ascontiguousarray(x.view("<u4").T) for x in (first, second))
            fixed = [0] * 14 + [8 * (size + digits), 0]
            step = max(1, AT_ONCE // (end - start))
            for x in range(0, end - start, AT_ONCE):
                for h in range(0, len(mine), step):
                    words = [p[h : h + step, None] + q[None, x : x + AT_ONCE] if p.any() or q.any() else None for p, q in zip(first, second)]
                    shape = (len(mine[h : h + step]), len(second[0, x : x + AT_ONCE]))
                    for w, state in enumerate(_rounds(words, fixed, shape)):
                        out[w, mine[h : h + step], start + x : start + x + shape[1]] = state
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return out.byteswap().transpose(2, 1, 0)[place].reshape(len(numbers), -1)
