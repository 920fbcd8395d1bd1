"""Anchors found from the families around positions: a row a position, the same whatever is split."""

import random

import pytest
from pyspark.sql import functions as F

from pathweave.operators import neighbours
from pathweave.operators.neighbours import linked_anchors, meeting_anchors, near_positions


def rows(df):
    return sorted(map(tuple, df.collect()))


def given(spark, kind="long"):
    random.seed(4)
    name = (lambda c: c) if kind == "long" else (lambda c: f"c{c}")
    data = {(name(c), random.randint(-5, 60), random.choice("ABCDEFGH")) for c in range(4) for _ in range(50)}
    return spark.createDataFrame(sorted(data), f"chromosome {kind}, pos int, family string")


def test_a_position_travels_once_whatever_is_near(spark, monkeypatch):
    positions = given(spark)
    monkeypatch.setattr(neighbours, "STRETCH", 8)
    near = near_positions(positions, 20)
    assert near.count() == positions.count()
    around = {(r.chromosome, r.pos, r.family): len(r.near) for r in near.collect()}
    every = positions.collect()
    for (c, p, f), n in around.items():
        assert n == sum(r.chromosome == c and 0 < abs(r.pos - p) <= 20 for r in every)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_cells_and_portions_change_nothing(spark, kind, monkeypatch):
    positions = given(spark, kind)
    want = rows(linked_anchors(near_positions(positions, 2), ("+",)))
    assert want
    near = near_positions(positions, 2, exact=False)
    counts = near.groupBy("family").agg(F.count(F.lit(1)).alias("positions"))
    monkeypatch.setattr(neighbours, "_MEETINGS", 5)
    assert rows(meeting_anchors(near, counts, ("+",), per_cell=7).distinct()) == want
