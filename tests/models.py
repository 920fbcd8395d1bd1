"""Plain models of the semantics, each a closed statement instead of a walk, for comparison."""

from __future__ import annotations

from functools import cache, reduce
from itertools import groupby


def chain_model(anchors, intermediate, matched, reverse):
    """Chains of one chromosome pair as a set of (ref_start, ref_end, rel_start, rel_end).

    An anchor belongs to the best-ranked end whose path of predecessors passes through it.
    """
    reach = intermediate + 1
    turn = -1 if reverse else 1
    points = frozenset(anchors)

    def box(q):
        return [(q[0] - turn * x, q[1] - y) for x in range(1, reach + 1) for y in range(1, reach + 1)]

    before = {q: [p for p in box(q) if p in points] for q in points}

    def weight(p, q):
        return reach + 1 - min(abs(q[0] - p[0]), q[1] - p[1])

    @cache
    def score(q):
        return max((score(p) + weight(p, q) for p in before[q]), default=0)

    for q in sorted(points, key=lambda a: a[1]):  # fills the cache without deep recursion
        score(q)
    link = {
        q: min(before[q], key=lambda p: (-score(p) - weight(p, q), p[1], p[0])) for q in points if before[q]
    }
    ranked = sorted(link, key=lambda q: (-score(q), -link[q][0], -link[q][1], q))
    rank = {q: k for k, q in enumerate(ranked)}
    # along falling relative positions every anchor hands its owner on to its predecessor
    owner = dict(rank)
    for q in sorted(link, key=lambda a: -a[1]):
        owner[link[q]] = min(owner[q], owner.get(link[q], len(rank)))
    members = {}
    for q, k in owner.items():
        members.setdefault(k, []).append(q)
    spans = {
        (min(r), max(r), min(s), max(s)) for r, s in (tuple(zip(*m)) for m in members.values())
    }
    return {x for x in spans if x[1] - x[0] >= matched - 1 and x[3] - x[2] >= matched - 1}


def run_model(ref_path, rel_path):
    """Runs of one pair, as (ref_start, rel_start, ref_end, rel_end), by end and start.

    ``held[i]`` maps each relative position matched at rank ``i`` to the start of its run.
    """

    def choose(state, end):
        free, taken = state
        pick = next((x for x in (end + 1, end - 1) if x in free), None)
        return (free, taken) if pick is None else (free - {pick}, {**taken, pick: end})

    def held_at(former, i):
        here = frozenset(x for x, family in enumerate(rel_path) if family == ref_path[i])
        in_order = sorted(former, key=lambda end: former[end])
        free, taken = reduce(choose, in_order, (here, {}))
        return {**{x: former[end] for x, end in taken.items()}, **{x: (i, x) for x in free}}

    held = [{}]
    for i in range(len(ref_path)):
        held.append(held_at(held[-1], i))
    last = {start: (i, x) for i, places in enumerate(held[1:]) for x, start in places.items()}
    return sorted(
        ((*start, *end) for start, end in last.items()), key=lambda r: (r[2], r[0], r[1])
    )


def merge_model(runs, intermediate, matched):
    """Merged reference hulls of one pair's runs.

    The relative test needs the run before only, so it cuts the order first; each piece is then
    folded over (low, high, count) states of the reference.
    """
    ordered = sorted(runs, key=lambda r: (min(r[1::2]), r[2], r[0], r[1]))
    gaps = [min(b[1::2]) - max(a[1::2]) - 1 for a, b in zip(ordered, ordered[1:])]
    pieces = [0]
    for gap in gaps:
        pieces.append(pieces[-1] + (gap > intermediate))

    def grow(states, run):
        start, end = run[0::2]
        if states:
            low, high, count = states[-1]
            if min(abs(x - y) for x in (start, end) for y in (low, high)) <= intermediate + 1:
                grown = (min(low, start), max(high, end), count + end - start + 1)
                return (*states[:-1], grown)
        return (*states, (start, end, end - start + 1))

    hulls = []
    for _, piece in groupby(zip(pieces, ordered), key=lambda x: x[0]):
        hulls += reduce(grow, (run for _, run in piece), ())
    return [(low, high) for low, high, count in hulls if count >= matched]


def sweep_model(intervals, support):
    """Regions of the support sweep, from the number of intervals open after each arrival.

    An arrival that leaves fewer than ``support`` open ends a segment. A segment's region starts
    at its last arrival that leaves exactly ``support`` open, and ends at the ``support``-th
    largest end among all arrivals before the one that closes it.
    """
    arrivals = sorted(intervals)
    sizes = [
        sum(t >= start for _, t in arrivals[: k + 1]) for k, (start, _) in enumerate(arrivals)
    ]
    closing = [k for k, size in enumerate(sizes) if size < support] + [len(arrivals)]
    found = []
    for begin, end in zip([0, *closing], closing):
        opened = [arrivals[k][0] for k in range(begin, end) if sizes[k] == support]
        if opened:
            ends = sorted((t for _, t in arrivals[:end]), reverse=True)
            found.append((opened[-1], ends[support - 1]))
    return found


def coverage_model(by_chromosome, support):
    """Maximal ranges covered by at least ``support`` chromosomes."""
    covers = {
        name: {x for s, t in spans for x in range(s, t + 1)} for name, spans in by_chromosome.items()
    }
    good = sorted(
        x for x in set().union(*covers.values()) if sum(x in c for c in covers.values()) >= support
    )
    ranges = [[x for _, x in piece] for _, piece in groupby(enumerate(good), key=lambda p: p[1] - p[0])]
    return [(r[0], r[-1]) for r in ranges]
