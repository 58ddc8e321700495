"""Vectorised statistics over packed document bytes, used by the classifiers."""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint32(0x9E3779B1)
_RADIX = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_RADIX), -1, 1 << 64))


def gram_buckets(data: np.ndarray, ends: np.ndarray, orders: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """Bucket of the byte n-gram at each position, one array per order.

    A position whose n-gram would leave its document has bucket ``2**bits``.
    """
    low = LOWER[data].astype(np.uint32)
    rolled, out = low, []
    for n in range(1, max(orders) + 1):
        if n > 1:
            rolled = rolled[:-1] * _STEP + low[n - 1 :] if len(rolled) > 1 else rolled[:0]
        if n not in orders:
            continue
        bucket = np.full(len(data), 1 << bits, np.int32)
        mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
        bucket[: len(rolled)] = mixed >> np.uint32(32 - bits)
        for back in range(1, n):
            at = ends - back
            bucket[at[at >= 0]] = 1 << bits
        out.append(bucket)
    return out


def sums_by_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (positions x k) over each document; an empty one has zeros."""
    out = np.zeros((len(offsets) - 1, values.shape[1]))
    full = np.diff(offsets) > 0
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0, dtype=np.float64)
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for each word, from one running polynomial sum."""
    powers = np.full(len(data) + 1, _RADIX)
    powers[0] = 1
    powers = np.cumprod(powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(powers[:-1] * (data.astype(np.uint64) + np.uint64(1)), out=sums[1:])
    inverse = np.full(len(data) + 1, _INVERSE)
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    mixed = (sums[ends] - sums[starts]) * inverse[starts]
    return mixed ^ (mixed >> np.uint64(29))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; white space and document borders separate words."""
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= SPACE[data[:-1]]
    last[:-1] &= SPACE[data[1:]]
    edges = offsets[1:-1][offsets[1:-1] < len(data)]
    first[edges] = inside[edges]
    edges = offsets[1:-1][offsets[1:-1] > 0]
    last[edges - 1] = inside[edges - 1]
    return np.nonzero(first)[0], np.nonzero(last)[0] + 1
