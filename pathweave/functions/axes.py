"""Short coordinates for the grouped numpy steps."""

from __future__ import annotations

import numpy as np


def _pairs_order(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    low = value.min()
    span = int(value.max() - low) + 1
    if span * (int(group.max()) + 1) < 1 << 62:
        return np.argsort(group * span + (value - low), kind="stable")
    return np.lexsort((value, group))


def compact(
    group: np.ndarray, value: np.ndarray, reach: int
) -> tuple[np.ndarray, np.ndarray]:
    """Two coordinates for ``value``: one over all groups, one within its group.

    Differences up to ``reach`` are kept and longer gaps shrink to ``reach + 1``.
    On the common axis groups lie ``reach + 1`` apart, with a margin in front; the
    axis within a group starts at 0.
    """
    order = _pairs_order(group, value)
    g, v = group[order], value[order]
    step = np.empty(len(v), dtype=np.int64)
    step[0] = reach + 1
    np.minimum(v[1:] - v[:-1], reach + 1, out=step[1:])
    new = np.flatnonzero(g[1:] != g[:-1]) + 1
    step[new] = reach + 1
    along = np.cumsum(step)
    starts = np.concatenate(([0], new))
    lengths = np.diff(np.concatenate((starts, [len(v)])))
    common = np.empty_like(along)
    common[order] = along
    within = np.empty_like(along)
    within[order] = along - np.repeat(along[starts], lengths)
    return common, within


def segments(group: np.ndarray, value: np.ndarray, reach: int) -> np.ndarray:
    """Group numbers after cutting every group at gaps longer than ``reach``."""
    order = _pairs_order(group, value)
    g, v = group[order], value[order]
    cut = np.empty(len(v), dtype=np.int64)
    cut[0] = 0
    cut[1:] = (g[1:] != g[:-1]) | (v[1:] - v[:-1] > reach)
    cut = np.cumsum(cut)
    number = np.empty_like(cut)
    number[order] = cut
    return number


def slices(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each stretch of equal values."""
    cuts = np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1
    edges = np.concatenate(([0], cuts, [len(sorted_values)]))
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))
