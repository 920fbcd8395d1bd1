"""Whole numbers in as few bytes as each needs."""

from __future__ import annotations

import numpy as np


def short_bytes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of unsigned numbers of 64 bits, and how many each has.

    A byte holds seven bits, the lowest first; it is below 128 where its number ends.
    """
    size = np.ones(len(numbers), dtype=np.int64)
    for bits in range(7, 64, 7):
        longer = numbers >= np.uint64(1 << bits)
        if not longer.any():
            break
        size += longer
    begin = np.cumsum(size) - size
    data = np.empty(int(size.sum()), dtype=np.uint8)
    for nth in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > nth)
        bits = (numbers[some] >> np.uint64(7 * nth)) & np.uint64(127)
        goes_on = (size[some] > nth + 1).astype(np.uint8) << 7
        data[begin[some] + nth] = bits.astype(np.uint8) | goes_on
    return data, size


def from_short_bytes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in ``data``, and how many lie between each two of its ``edges``."""
    last = np.flatnonzero(data < 128)
    begin = np.append(0, last + 1)[:-1]
    size = last - begin + 1
    numbers = np.zeros(len(last), dtype=np.uint64)
    for nth in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > nth)
        bits = (data[begin[some] + nth] & 127).astype(np.uint64)
        numbers[some] |= bits << np.uint64(7 * nth)
    return numbers, np.diff(np.searchsorted(last, edges))
