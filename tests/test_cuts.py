"""Cuts across buckets, and anchors found by their neighbours, against plain loops."""

import random

import numpy as np
import pytest

from pathweave.functions.prefix import stretches
from pathweave.operators import runs as run_module
from pathweave.operators.anchors import anchors
from pathweave.operators.run_steps import diagonal_step, merge_runs, mergeable_diagonal_step
from pathweave.operators.segments import anchor_segments, linked_anchors, near_positions


@pytest.mark.parametrize("width", [1 << 16, 5, 1])
def test_stretches_cross_buckets(spark, width):
    random.seed(width)
    rows = [(k, p) for k in range(6) for p in random.choices(range(60), k=25) for _ in range(random.randint(1, 2))]
    rows += [(9, p) for p in range(40)] + [(10, 3)]
    want = []
    for k in {r[0] for r in rows}:
        begin = last = None
        for p in sorted(p for c, p in rows if c == k):
            if last is None or p - last > 2:
                begin = p
            last = p
            want.append((k, p, begin))
    got = stretches(spark.createDataFrame(rows, "k int, p long"), ["k"], "p", 2, "begins", width)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("width", [1 << 16, 4])
def test_pieces_cross_buckets(spark, width):
    random.seed(width)
    rows = []
    for c in range(4):
        for _ in range(40):
            s, a, n = random.randint(0, 30), random.randint(0, 90), random.randint(0, 6)
            rows.append((c, 7, s, a, s + n, a + random.choice([n, -n])))
    runs = spark.createDataFrame(rows, "ref_chr long, rel_chr long, ref_start long, rel_start long, ref_end long, rel_end long")
    got = {}
    for r in run_module.relative_pieces(runs, 2, width).collect():
        got.setdefault((r.ref_chr, r.piece), []).append((r.ref_start, r.rel_start, r.ref_end, r.rel_end))
    want = []
    for c in range(4):
        mine = sorted((r[2:] for r in rows if r[0] == c), key=lambda r: (min(r[1], r[3]), r[2], r[0], r[1]))
        for k, r in enumerate(mine):
            if not k or min(r[1], r[3]) - max(mine[k - 1][1], mine[k - 1][3]) - 1 > 2:
                want.append([])
            want[-1].append(r)
    assert sorted(sorted(v) for v in got.values()) == sorted(sorted(v) for v in want)


def test_one_long_pair_needs_no_strips(spark, monkeypatch):
    """Pieces that fit are the groups, however many runs the pair has."""
    def stepped(*args):
        raise AssertionError("a strip was made")

    monkeypatch.setattr(run_module, "split_by_wave", stepped)
    runs = spark.range(20_000).selectExpr(
        "1L AS ref_chr", "2L AS rel_chr", "id * 7 AS ref_start", "id * 9 AS rel_start", "id * 7 + 2 AS ref_end",
        "id * 9 + IF(id % 5 = 0, 2, 8) AS rel_end",
    )
    found = run_module.merged_runs(runs, 4, 1, runs_per_task=100)
    assert found.count() == 4_001  # the first run, then five and five


def test_islands_that_fit_need_no_strips(spark, monkeypatch):
    def stepped(*args):
        raise AssertionError("a strip was made")

    monkeypatch.setattr(run_module, "split_by_wave", stepped)
    rows = [(c, 3 * k + j, f"f{k}-{j}") for c in (1, 2) for k in range(200) for j in range(2)]
    positions = spark.createDataFrame(rows, "chromosome long, pos long, family string")
    found = run_module.exact_runs(positions, block_anchors=50)
    assert found.count() == 400 and found.filter("ref_end = ref_start + 1").count() == 400


def test_segments_and_neighbours(spark):
    random.seed(8)
    rows = sorted({(c, random.randint(0, 80), random.choice("ABCDEFGH")) for c in range(4) for _ in range(30)})
    positions = spark.createDataFrame(rows, "chromosome long, pos int, family string")
    every = {tuple(r) for r in anchors(positions).collect()}
    for reach in (1, 4):
        near = near_positions(positions, reach).cache()
        for orientations in (("+",), ("-",), ("+", "-")):
            want = {
                a for a in every for b in every
                if a[:2] == b[:2] and 0 < abs(a[2] - b[2]) <= reach and 0 < abs(a[3] - b[3]) <= reach
                and ("+" if (a[2] < b[2]) == (a[3] < b[3]) else "-") in orientations
            }
            got = [tuple(r) for r in linked_anchors(near, orientations).collect()]
            assert len(got) == len(set(got)) and set(got) == want
            one = {tuple(r) for r in linked_anchors(near, orientations, 2).collect()}
            assert one == {a for a in want if a[0] == 2}
        cut = anchor_segments(spark.createDataFrame(sorted(every), "ref_chr long, rel_chr long, ref_pos long, rel_pos long"), reach)
        place = {tuple(r)[:4]: tuple(r)[4:] for r in cut.select("ref_chr", "rel_chr", "ref_pos", "rel_pos", "rel_piece", "ref_piece").collect()}
        assert set(place) == every
        for a in every:
            for b in every:
                if a[:2] == b[:2] and abs(a[2] - b[2]) <= reach and abs(a[3] - b[3]) <= reach:
                    assert place[a] == place[b]


def test_sparse_chains_equal_those_of_all_anchors(spark, monkeypatch):
    from pathweave.operators import segments
    from pathweave.operators.chains import chains

    random.seed(5)
    rows = sorted({(c, p, f"f{random.randint(0, 25)}") for c in range(5) for p in range(60)})
    positions = spark.createDataFrame(rows, "chromosome long, pos int, family string")
    plain = sorted(tuple(r) for r in chains(positions, 2, 2).collect())
    monkeypatch.setattr(segments, "WORTH_TRYING", 0)
    lists = segments.sparse_anchors  # the plan is taken where it moves fewer rows
    monkeypatch.setattr("pathweave.operators.chains.sparse_anchors", lambda *a: lists(*a) or segments.linked_anchors(near_positions(positions, 3), ("+", "-")))
    for limit in (1 << 20, 60):
        assert sorted(tuple(r) for r in chains(positions, 2, 2, block_anchors=limit).collect()) == plain


def hulls_of(runs, intermediate, matched):
    if not len(runs["group"]):
        return []
    hulls = merge_runs(runs, intermediate, matched)[0]
    return sorted(zip(*(hulls[c].tolist() for c in ("group", "ref_start", "ref_end"))))


def test_diagonals_that_no_hull_keeps_are_left_out():
    rng = np.random.default_rng(8)
    fewer = 0
    for turn in range(60):
        group = np.sort(rng.integers(0, 4, 40))
        places = {c: rng.integers(0, 20 + 5 * turn, 40) for c in ("ref_pos", "rel_pos")}
        every = diagonal_step(group, places)
        for intermediate, matched in ((0, 2), (2, 2), (2, 3), (1, 1), (4, 5)):
            some = mergeable_diagonal_step(intermediate, matched)(group, places)
            want, got = (hulls_of(runs, intermediate, matched) for runs in (every, some))
            assert got == want
            fewer += len(some["group"]) < len(every["group"])
            assert matched > 1 or len(some["group"]) == len(every["group"])
    assert fewer > 100


def test_runs_of_a_merge_are_few(spark):
    rng = random.Random(8)
    data = [(c, p, f"f{rng.randint(0, 40)}") for c in range(3) for p in range(40, 900, 20)]
    data += [(0, 1, "x"), (1, 1, "x"), (0, 3, "y"), (1, 4, "y")]
    positions = spark.createDataFrame(data, "chromosome long, pos int, family string")
    found = run_module.diagonal_runs(positions, merge=(2, 2))
    assert sorted(map(tuple, found.collect())) == [
        (0, 1, 1, 1, 1, 1), (0, 1, 3, 4, 3, 4), (1, 0, 1, 1, 1, 1), (1, 0, 4, 3, 4, 3),
    ]
