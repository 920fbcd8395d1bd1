"""What follows on whole pairs is done where they are made, and little travels to there."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathweave.functions.numbers import from_short_bytes, short_bytes
from pathweave.operators import anchors as anchor_module, bundles as bundle_module, runs as run_module
from pathweave.operators.anchors import (
    PAIR,
    anchors,
    distinct_step,
    family_positions,
    pair_totals,
    position_lists,
    written_lists,
)
from pathweave.operators.bundles import bundles, map_bundles
from pathweave.operators.runs import diagonal_runs, exact_runs, piece_totals, relative_pieces

PLACES = {"ref_pos": "long", "rel_pos": "long"}


def given(spark, kind="long", far=0):
    random.seed(11)
    name = (lambda c: (c - 2) * (1 + far)) if kind == "long" else (lambda c: f"c{c}")
    rows = [(name(c), p + far * (p % 3), random.choice("ABCDEFGHIJ")) for c in range(5) for p in range(30)]
    return spark.createDataFrame(rows, f"chromosome {kind}, pos long, family string").distinct()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_numbers_come_back_from_short_bytes():
    numbers = np.array([0, 1, 127, 128, 16383, 16384, 1 << 63, (1 << 64) - 1], dtype=np.uint64)
    data, size = short_bytes(numbers)
    assert size.tolist() == [1, 1, 1, 2, 2, 3, 10, 10]
    again, counts = from_short_bytes(data, np.array([0, 3, 3, len(data)]))
    assert again.tolist() == numbers.tolist() and counts.tolist() == [3, 0, 5]


@pytest.mark.parametrize("kind, far", [("long", 0), ("long", 1 << 40), ("long", -(1 << 40)), ("string", 0)])
def test_packed_bundles_hold_the_same(spark, monkeypatch, kind, far):
    lists = written_lists(given(spark, kind, far))
    want = rows(map_bundles(bundles(lists, 1 << 21), distinct_step, PLACES))
    assert want
    for per_home, partners in ((1 << 21, 1 << 10), (10, 3)):
        monkeypatch.setattr(bundle_module, "PARTNERS_PER_ROW", partners)
        packed = bundles(lists, per_home, 2, packed=True)
        assert "positions" not in packed.columns
        assert rows(map_bundles(packed, distinct_step, PLACES)) == want


@pytest.mark.parametrize("limit", [1 << 21, 30])
def test_pieces_are_cut_where_runs_are_made(spark, monkeypatch, limit):
    positions = given(spark)
    table = relative_pieces(diagonal_runs(positions), 2)
    want = table.groupBy(*PAIR, "piece").agg(
        F.count("*"),
        F.min("low"),
        F.max(F.greatest("rel_start", "rel_end")),
        F.sum(F.col("ref_end") - F.col("ref_start") + 1),
    )
    want = rows(want)
    if limit > 30:
        monkeypatch.setattr(run_module, "map_groups", None)
    pieces = relative_pieces(diagonal_runs(positions, block_anchors=limit, together=True), 2)
    assert rows(piece_totals(pieces)) == want


@pytest.mark.parametrize("limit", [1 << 21, 30])
def test_totals_of_pairs_are_those_of_their_anchors(spark, limit):
    positions = given(spark)
    want = anchors(positions).groupBy(*PAIR).agg(
        F.count("*"), F.sum("ref_pos"), F.sum("rel_pos"), F.sum(F.col("ref_pos") * F.col("rel_pos"))
    )
    found = pair_totals(anchors(positions, block_anchors=limit, together=True))
    assert rows(found) == rows(want)


def test_totals_that_do_not_fit_fail(spark):
    data = [(c, 1 << 31, "A") for c in range(2)] + [(c, (1 << 31) + 1, "B") for c in range(2)]
    positions = spark.createDataFrame(data, "chromosome long, pos long, family string")
    with pytest.raises(Exception, match="64 bits"):
        pair_totals(anchors(positions, together=True)).collect()


def test_small_pairs_do_not_cut_homes_into_many_rows(spark, monkeypatch):
    asked = []

    def noted(lists, per_home, *more, **options):
        asked.append(per_home)
        return bundles(lists, per_home, *more, **options)

    monkeypatch.setattr(anchor_module, "bundles", noted)
    monkeypatch.setattr(bundle_module, "bundles", noted)
    positions = given(spark).groupBy("chromosome", "pos").agg(F.min("family").alias("family"))
    found = rows(exact_runs(positions, block_anchors=20))
    assert asked and min(asked) >= anchor_module.ANCHORS_PER_BLOCK
    assert found == rows(exact_runs(positions))


def test_lists_hold_repeated_positions_once(spark, monkeypatch):
    data = [(c, c % 3, "AB"[c % 2]) for c in range(6)]
    genes = spark.createDataFrame(data * 2, "chromosome long, number long, family string")
    positions = family_positions(genes, distinct=False)
    assert positions.count() == 12
    want = [(f, c, 0, [p]) for c, p, f in data]
    assert rows(position_lists(positions)) == sorted(want)
    want = rows(written_lists(family_positions(genes)))
    assert rows(written_lists(positions)) == want
    monkeypatch.setattr(anchor_module, "POSITIONS_PER_TASK", 1)
    assert rows(written_lists(positions)) == want
