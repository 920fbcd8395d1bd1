"""Periodic runs of words: maximal stretches that repeat with some period at least three times.

A run of period q is a maximal stretch in which words q apart are equal, of at least ``LEAST``
words and ``TIMES`` periods. In a task, texts of a slice are taken together:

1. In a run of period p the words equal to those p further on are a stretch of at least
   ``max(LEAST - p, (TIMES - 1) * p)``. So one point of a grid of about twice p starts an
   eight-word window that stands again p further on. These are the candidates: as the sum of n/p
   over all p is harmonic, n log n windows are compared, and only texts with a repeated window at all.
2. A run-length grammar is made of the texts with candidates (``recompression``). Two extensions
   of it, to the right and to the left, give a candidate's exact maximal stretch.
3. Stretches that are too short are left out, and of those with the same ends the one with the
   smallest period stays: the others are its multiples.

Defined cases: a null text has no words and no run; a row without an id is a row like others, but
``order`` does not see it; repeated rows are answered each; other columns are left out. Word
identity rests on 64-bit hashes. Memory is bound by a slice of texts or one longest text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pathweave.llm.recompression import Grammar
from pathweave.llm.texts import Texts, repeated, slices, span_hashes, window_hashes

LEAST = 24
TIMES = 3
#: Words of a window that a candidate's two places must share.
WINDOW = 8
#: Grid points that are looked at together.
POINTS = 1 << 18

_RUN = "struct<start: long, length: long, period: long>"


def grid_step(period: np.ndarray) -> np.ndarray:
    """Every ``grid_step`` words one window lies inside the equal stretch of a run."""
    return np.maximum(LEAST - period, (TIMES - 1) * period) - WINDOW + 1


def candidates(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of the grid at which the text's window stands again a period later.

    ``windows`` holds the hash of the window at each word of one text.
    """
    words = len(windows) + WINDOW - 1
    periods = np.arange(1, min(words // TIMES, len(windows) - 1) + 1)
    steps = grid_step(periods)
    counts = -(-(len(windows) - periods) // steps)
    ends = np.cumsum(counts)
    places, found = [], []
    begin = 0
    while begin < len(periods):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + POINTS, side="right")))
        count = counts[begin:end]
        number = np.arange(count.sum()) - np.repeat(ends[begin:end] - count - before, count)
        place = number * np.repeat(steps[begin:end], count)
        period = np.repeat(periods[begin:end], count)
        hit = windows[place] == windows[place + period]
        places.append(place[hit])
        found.append(period[hit])
        begin = end
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(found)


def runs_of(hashes: np.ndarray, first: np.ndarray) -> dict[int, np.ndarray]:
    """``start, length, period`` of the runs, by start, then period, of each text that has some.

    ``hashes`` are the words of all texts, that of text k from ``first[k]`` to ``first[k + 1]``.
    """
    counts = np.diff(first)
    of = np.repeat(np.arange(len(counts)), counts)
    windows, at = window_hashes(hashes, of, WINDOW)
    again = np.unique(of[at][repeated(windows, of[at])[0]])
    starts = np.searchsorted(of[at], again)
    ends = np.searchsorted(of[at], again, side="right")
    asked = {}
    for k, begin, end in zip(again.tolist(), starts.tolist(), ends.tolist(), strict=True):
        place, period = candidates(windows[begin:end])
        if len(place):
            asked[k] = place, period
    if not asked:
        return {}
    # each text stands behind its closing number, and one more closes the last
    texts = np.array(list(asked))
    sizes = counts[texts]
    base = np.cumsum(sizes + 1) - sizes
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    symbols = np.zeros(sizes.sum() + len(texts) + 1, np.int64)
    words = np.unique(hashes[place + np.repeat(first[texts], sizes)], return_inverse=True)[1]
    symbols[place + np.repeat(base, sizes)] = words
    symbols[np.append(base - 1, len(symbols) - 1)] = -1 - np.arange(len(texts) + 1)
    grammar = Grammar(symbols)
    hits = np.array([len(p) for p, _ in asked.values()])
    owner = np.repeat(np.arange(len(texts)), hits)
    period = np.concatenate([p for _, p in asked.values()])
    here = np.concatenate([p for p, _ in asked.values()]) + base[owner]
    start = here - grammar.extensions(here - 1, here + period - 1, -1)
    end = here + period + grammar.extensions(here, here + period, 1)
    keep = end - start >= np.maximum(LEAST, TIMES * period)
    owner, start, end, period = owner[keep], start[keep], end[keep], period[keep]
    order = np.lexsort((period, end, start, owner))
    owner, start, end, period = owner[order], start[order], end[order], period[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    owner, start, end, period = owner[fresh], start[fresh], end[fresh], period[fresh]
    order = np.lexsort((period, start, owner))
    rows = np.stack([start - base[owner], end - start, period], 1)[order]
    owner = owner[order]
    some = np.unique(owner)
    cuts = np.searchsorted(owner, some)
    return dict(zip(texts[some].tolist(), np.split(rows, cuts[1:]) if len(some) else [], strict=True))


def best_run(runs: np.ndarray) -> list[int]:
    """The run with the greatest exact exponent; of equal ones the first, then the shortest period."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = [start, length, period]
    return best


def kept_words(runs: np.ndarray, count: int) -> np.ndarray:
    """Which words no run holds behind its first period."""
    change = np.zeros(count + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def find(documents: DataFrame, order: Callable[[int, int], np.ndarray | None] | None = None) -> DataFrame:
    """``doc_id, runs, best, collapsed`` of each row.

    ``collapsed`` is the text with one blank between words and without the repetitions: words that
    a run holds behind its first period. ``order`` may give, for an id and a number of words, the
    words to read instead, by their numbers.
    """

    def run(batches):
        for piece in slices(batches):
            texts = Texts(piece.column(1))
            starts, ends, of = texts.words()
            hashes = span_hashes(texts.data, starts, ends)
            first = np.searchsorted(of, np.arange(texts.count + 1))
            counts = np.diff(first).tolist()
            orders = {}
            for k, doc_id in enumerate(piece.column(0).to_pylist()):
                if order is not None and doc_id is not None and counts[k]:
                    if (read := order(doc_id, counts[k])) is not None:
                        orders[k] = read
                        hashes[first[k] : first[k + 1]] = hashes[first[k] : first[k + 1]][read]
            found = runs_of(hashes, first)
            collapsed = []
            data, offsets = texts.data.tobytes(), texts.offsets.tolist()
            for k in range(texts.count):
                words = data[offsets[k] : offsets[k + 1]].split()
                if k in orders or k in found:
                    read = orders.get(k, np.arange(len(words)))
                    if k in found:
                        read = read[kept_words(found[k], len(words))]
                    words = [words[w] for w in read.tolist()]
                collapsed.append(b" ".join(words).decode())
            names = ("start", "length", "period")
            rows = [
                [dict(zip(names, r, strict=True)) for r in found[k].tolist()] if k in found else []
                for k in range(texts.count)
            ]
            best = [dict(zip(names, best_run(found[k]), strict=True)) if k in found else None for k in range(texts.count)]
            kind = pa.struct([(n, pa.int64()) for n in names])
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(rows, pa.list_(kind)), pa.array(best, kind), pa.array(collapsed, pa.string())],
                names=["doc_id", "runs", "best", "collapsed"],
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, f"doc_id long, runs array<{_RUN}>, best {_RUN}, collapsed string"
    )
