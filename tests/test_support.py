import random

import pytest
from models import coverage_model, sweep_model

from pathweave.operators.support import support_regions

GOLDEN = [(0, 4), (2, 6), (5, 9), (12, 14), (13, 15)]


def hulls_of(spark, by_reference):
    """``by_reference``: reference to relative to intervals."""
    rows = [
        (r, l, s, t)
        for r, relatives in by_reference.items()
        for l, intervals in relatives.items()
        for s, t in intervals
    ]
    return spark.createDataFrame(rows, "ref_chr long, rel_chr long, ref_start long, ref_end long")


def regions(df):
    out = {}
    for r in df.orderBy("ref_chr", "region_id").collect():
        spans = out.setdefault(r.ref_chr, [])
        assert r.region_id == len(spans)
        spans.append((r.start, r.end))
    return out


def test_goldens(spark):
    hulls = hulls_of(spark, {1: {i: [span] for i, span in enumerate(GOLDEN)}})
    assert regions(support_regions(hulls, 2)) == {1: [(5, 6), (13, 14)]}
    assert regions(support_regions(hulls, 2, "coverage")) == {1: [(2, 6), (13, 14)]}
    apart = hulls_of(spark, {1: {2: [(0, 3)], 3: [(5, 8)]}})
    assert regions(support_regions(apart, 1)) == {1: [(5, 8)]}
    fused = hulls_of(spark, {1: {1: [(0, 5)], 2: [(1, 5)], 3: [(6, 9)], 4: [(0, 1)]}})
    assert regions(support_regions(fused, 2)) == {1: [(0, 5)]}
    assert regions(support_regions(fused, 1, "coverage")) == {1: [(0, 9)]}
    with pytest.raises(ValueError):
        support_regions(fused, 0)
    with pytest.raises(ValueError):
        support_regions(fused, 1, "other")


@pytest.mark.parametrize("support,width", [(1, 3), (2, 1 << 16), (3, 5), (4, 2)])
def test_against_models(spark, support, width):
    rng = random.Random(support)
    data = {}
    for r in range(120):
        data[r] = {
            l: [
                (s, s + rng.randint(0, 8))
                for s in (rng.randint(0, 30) for _ in range(rng.randint(1, 4)))
            ]
            for l in range(rng.randint(1, 6))
        }
    hulls = hulls_of(spark, data)
    sweep = {
        r: sweep_model([i for spans in rels.values() for i in spans], support)
        for r, rels in data.items()
    }
    got = regions(support_regions(hulls, support, "sweep", width))
    assert got == {r: spans for r, spans in sweep.items() if spans}
    covered = {r: coverage_model(rels, support) for r, rels in data.items()}
    got = regions(support_regions(hulls, support, "coverage", width))
    assert got == {r: spans for r, spans in covered.items() if spans}
