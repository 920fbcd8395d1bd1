"""Numpy steps of gap-bounded chaining.

All groups of a call advance together, one relative position at a time. Anchors are
sorted into square cells of ``reach`` positions, so that those in the box before an
anchor lie in two stretches of the sorted cells; only anchors that are there are
looked at, and memory is linear in anchors whatever the reach.
"""

from __future__ import annotations

import numpy as np

from pathweave.functions.axes import compact, segments, slices

NONE = -1
_GATHER = 1 << 20


class Box:
    """Anchors of one call, distinct, in (relative, group, reference) order."""

    def __init__(self, group, ref, rel, reach: int, known=None):
        # Segments do not touch each other, so all of them advance together.
        segment = segments(segments(group, rel, reach), ref, reach)
        across, _ = compact(segment, ref, reach)
        _, level = compact(segment, rel, reach)
        width = int(across.max()) + reach + 2
        key = level * width + across
        order = np.argsort(key, kind="stable")
        key = key[order]
        keep = np.ones(len(key), dtype=bool)
        keep[1:] = key[1:] != key[:-1]
        order = order[keep]
        self.order, self.reach, self.width = order, reach, width
        self.group, self.ref, self.rel = group[order], ref[order], rel[order]
        self.across, self.level = across[order], level[order]
        self.known = None if known is None else known[order]
        self.levels = slices(self.level)

    def score(self, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
        """Best score and predecessor index (or ``NONE``) of every anchor.

        Anchors with a known score keep it and get no predecessor.
        """
        reach = self.reach
        score = np.zeros(len(self.ref), dtype=np.int64)
        pointer = np.full(len(self.ref), NONE, dtype=np.int64)
        asks = np.ones(len(self.ref), dtype=bool)
        if self.known is not None:
            asks = self.known == NONE
            score[~asks] = self.known[~asks]
        cells, firsts, lasts = self._boxes(reverse)
        for first, last in self.levels:
            for a in self._portions(firsts[:, first:last], lasts[:, first:last], first):
                own = np.flatnonzero(asks[a[0] : a[1]]) + a[0]
                counts = (lasts[:, own] - firsts[:, own]).ravel()
                if not counts.any():
                    continue
                q = np.repeat(np.concatenate([own, own]), counts)
                place = np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)
                p = cells[np.repeat(firsts[:, own].ravel(), counts) + place]
                rise = self.level[q] - self.level[p]
                along = self.across[p] - self.across[q] if reverse else self.across[q] - self.across[p]
                near = (rise > 0) & (rise <= reach) & (along > 0) & (along <= reach)
                q, p = q[near], p[near]
                if not len(q):
                    continue
                value = score[p] + reach + 1 - np.minimum(rise[near], along[near])
                # of equal ones the first by (relative, reference), which is the order of anchors
                order = np.lexsort((p, -value, q))
                best = order[np.flatnonzero(np.diff(q[order], prepend=-1))]
                score[q[best]] = value[best]
                pointer[q[best]] = p[best]
        return score, pointer

    def _boxes(self, reverse: bool):
        """Anchors by cell, and for each anchor the two stretches of them that cover its box."""
        reach = self.reach
        row, column = self.level // reach, self.across // reach
        columns = int(column.max()) + 3
        cell = row * columns + column + 1
        cells = np.argsort(cell, kind="stable")
        ordered = cell[cells]
        left = cell if reverse else cell - 1
        low = np.stack([left - columns, left])
        firsts = np.searchsorted(ordered, low.ravel()).reshape(2, -1)
        lasts = np.searchsorted(ordered, (low + 1).ravel(), side="right").reshape(2, -1)
        return cells, firsts, lasts

    @staticmethod
    def _portions(firsts, lasts, begin):
        """Bounds of anchors that look at about ``_GATHER`` others together."""
        total = np.cumsum((lasts - firsts).sum(0))
        cuts = np.searchsorted(total, np.arange(_GATHER, total[-1] + _GATHER, _GATHER))
        edges = np.unique(np.concatenate(([0], cuts + 1, [len(total)])))
        edges = edges[edges <= len(total)]
        return [(begin + x, begin + y) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]

    def pull_owners(self, owner: np.ndarray, pointer: np.ndarray) -> None:
        """Gives every anchor the least owner found along the paths through it."""
        for first, last in reversed(self.levels):
            p = pointer[first:last]
            linked = np.flatnonzero(p != NONE)
            if len(linked):
                np.minimum.at(owner, p[linked], owner[first + linked])


def linkable(group, ref, rel, reach: int, matched: int) -> np.ndarray:
    """Anchors of segments that can hold a chain: of two anchors or more, and wide enough."""
    segment = segments(segments(group, rel, reach), ref, reach)
    order = np.argsort(segment, kind="stable")
    starts = np.flatnonzero(np.diff(segment[order], prepend=-1))
    fits = np.diff(np.append(starts, len(order))) > 1
    for place in (ref[order], rel[order]):
        span = np.maximum.reduceat(place, starts) - np.minimum.reduceat(place, starts) + 1
        fits &= span >= matched
    return np.flatnonzero(fits[segment])


def end_order(score, ptr_ref, ptr_rel, ref, rel) -> np.ndarray:
    """Order in which chain ends claim their paths."""
    return np.lexsort((rel, ref, -ptr_rel, -ptr_ref, -score))


def chain_step(reach: int, matched: int, orientations: tuple[str, ...]):
    """Anchors of whole chromosome pairs to chains."""

    def step(group, columns):
        parts = []
        some = linkable(group, columns["ref_pos"], columns["rel_pos"], reach, matched)
        if not len(some):
            orientations_left = ()
        else:
            orientations_left = orientations
            box = Box(group[some], columns["ref_pos"][some], columns["rel_pos"][some], reach)
        for orientation in orientations_left:
            score, pointer = box.score(orientation == "-")
            ends = np.flatnonzero(pointer != NONE)
            if not len(ends):
                continue
            before = pointer[ends]
            ends = ends[
                end_order(
                    score[ends], box.ref[before], box.rel[before], box.ref[ends], box.rel[ends]
                )
            ]
            count = len(ends)
            owner = np.full(len(score), count, dtype=np.int64)
            owner[ends] = np.arange(count)
            box.pull_owners(owner, pointer)
            member = np.flatnonzero(owner < count)
            by = owner[member]
            low_ref = box.ref[ends].copy()
            high_ref = low_ref.copy()
            low_rel = box.rel[ends].copy()
            np.minimum.at(low_ref, by, box.ref[member])
            np.maximum.at(high_ref, by, box.ref[member])
            np.minimum.at(low_rel, by, box.rel[member])
            high_rel = box.rel[ends]
            alive = owner[ends] == np.arange(count)
            keep = np.flatnonzero(
                alive
                & (high_ref - low_ref + 1 >= matched)
                & (high_rel - low_rel + 1 >= matched)
            )
            parts.append(
                {
                    "group": box.group[ends[keep]],
                    "orientation": np.full(len(keep), orientation, dtype=object),
                    "ref_start": low_ref[keep],
                    "ref_end": high_ref[keep],
                    "rel_start": low_rel[keep],
                    "rel_end": high_rel[keep],
                }
            )
        names = ("group", "orientation", "ref_start", "ref_end", "rel_start", "rel_end")
        empty = {n: np.array([], dtype=object if n == "orientation" else np.int64) for n in names}
        return {n: np.concatenate([p[n] for p in parts] or [empty[n]]) for n in names}

    return step


def score_step(reach: int, reverse: bool):
    """Anchors, some with a known ``score``, to scored anchors with pointers."""

    def step(group, columns):
        known = columns.get("score")
        ref, rel = columns["ref_pos"], columns["rel_pos"]
        box = Box(group, ref, rel, reach, known)
        score, pointer = box.score(reverse)
        own = np.arange(len(score)) if known is None else np.flatnonzero(box.known == NONE)
        before = pointer[own]
        linked = before != NONE
        return {
            "group": box.group[own],
            "ref_pos": box.ref[own],
            "rel_pos": box.rel[own],
            "score": score[own],
            "ptr_ref": np.where(linked, box.ref[before], NONE),
            "ptr_rel": np.where(linked, box.rel[before], NONE),
        }

    return step
