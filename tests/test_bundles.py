"""Pairs as bundles: the anchors of the plain join, whatever is split, and nothing shuffled per pair of lists."""

import random

import pytest
from pyspark.sql import functions as F

from pathweave.operators import anchors as anchor_module, bundles as bundle_module
from pathweave.operators.anchors import (
    anchors,
    distinct_step,
    lay_out,
    pair_lists,
    relatives,
    unfold,
    written_lists,
)
from pathweave.operators.bundles import bundles, map_bundles, map_pairs
from pathweave.operators.runs import diagonal_runs, exact_runs, island_sizes, islands
from pathweave.operators.segments import anchor_segments, segment_sizes, sizes_of_segments

PLACES = {"ref_pos": "long", "rel_pos": "long"}


def given(spark, kind="long"):
    random.seed(7)
    name = (lambda c: c - 3) if kind == "long" else (lambda c: f"c{c}")
    rows = [(name(c), p, random.choice("ABCDEFGH")) for c in range(5) for p in range(25)]
    # two families at one position, and positions in several lists
    rows += [(name(c), p, "A") for c in range(3) for p in (1, 2, 3000, 3001)]
    return spark.createDataFrame(rows, f"chromosome {kind}, pos int, family string").distinct()


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_bundles_hold_the_anchors_of_the_plain_join(spark, kind, monkeypatch):
    positions = given(spark, kind)
    lists = written_lists(positions)
    want = rows(unfold(pair_lists(lists)).distinct())
    assert rows(anchors(positions)) == want
    assert rows(anchors(positions, block_anchors=30)) == want
    monkeypatch.setattr(bundle_module, "PARTNERS_PER_ROW", 3)
    assert rows(map_bundles(bundles(lists, 10, 2), distinct_step, PLACES)) == want


def test_a_pair_is_shuffled_once(spark):
    lists = written_lists(given(spark))
    every = unfold(pair_lists(lists)).count()
    one_way = bundles(lists, 1 << 21).agg(F.sum(F.size("positions") * F.size("partners"))).first()[0]
    assert 2 * one_way == every


def test_only_pairs_that_really_exceed_the_limit_are_giant(spark):
    # each family is on two chromosomes, so that the bound from copies is far above any pair
    data = [(c, 10 * d + c, f"{min(c, d)}-{max(c, d)}") for c in range(8) for d in range(8) if c != d]
    layout = lay_out(spark.createDataFrame(data, "chromosome long, pos int, family string"), 3)
    assert layout.has_giants
    assert layout.giant_pairs().count() == 0


@pytest.mark.parametrize("limit", [1 << 21, 30])
def test_sizes_from_calls_are_those_of_plain_joins(spark, limit):
    positions = given(spark)
    pairs = pair_lists(written_lists(positions))
    plain = islands(pairs).groupBy("ref_chr", "rel_chr", "island").agg(F.count("*"), F.sum("n"))
    assert rows(island_sizes(positions, block_anchors=limit)) == rows(plain)
    found = unfold(pairs).distinct()
    assert rows(sizes_of_segments(positions, 2, limit)) == rows(segment_sizes(anchor_segments(found, 2)))
    along = {tuple(r) for r in found.collect()}
    want = []
    for c, l, r, p in along:
        if (c, l, r - 1, p - 1) not in along:
            n = 0
            while (c, l, r + n + 1, p + n + 1) in along:
                n += 1
            want.append((c, l, r, p, r + n, p + n))
    assert rows(diagonal_runs(positions, block_anchors=limit)) == sorted(want)


def test_runs_do_not_change_with_the_limit(spark):
    positions = given(spark).groupBy("chromosome", "pos").agg(F.min("family").alias("family"))
    assert rows(exact_runs(positions, block_anchors=30)) == rows(exact_runs(positions))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_relatives_make_no_row_for_each_pair_of_carriers(spark, monkeypatch, kind):
    monkeypatch.setattr(anchor_module, "pair_lists", None)
    monkeypatch.setattr(anchor_module, "ANCHORS_PER_BLOCK", 3)
    monkeypatch.setattr(bundle_module, "LISTS_PER_CELL", 2)
    one = "c9" if kind == "string" else 9
    odd = [(one, 0, None), (None, 0, "A"), (one, 1, "Z")]
    rows = [tuple(r) for r in given(spark, kind).collect()]
    positions = spark.createDataFrame(rows + odd, f"chromosome {kind}, pos int, family string")
    carried = {(c, f) for c, _, f in rows}
    want = {(c, d) for c, f in carried for d, g in carried if f == g and c != d}
    got = [tuple(r) for r in relatives(positions).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("at_most", [None, 85])
def test_dense_pairs_meet_in_blocks(spark, monkeypatch, kind, at_most):
    lists = written_lists(given(spark, kind))
    want = map_bundles(bundles(lists, 40), distinct_step, PLACES, at_most)
    want = sorted(tuple(r) for r in want.collect())
    monkeypatch.setattr(bundle_module, "PARTNERS_PER_MEETING", 500)
    monkeypatch.setattr(bundle_module, "WORTH_BLOCKS", 0)
    monkeypatch.setattr(bundle_module, "LEAST_BLOCKS", 3)
    monkeypatch.setattr(bundle_module, "bundles", None)
    got = map_pairs(lists, 40, distinct_step, PLACES, at_most)
    assert want and sorted(tuple(r) for r in got.collect()) == want
