import random

import numpy as np
import pytest
from models import chain_model

from pathweave.operators import anchors as anchor_module
from pathweave.operators import chains as ch
from pathweave.operators.anchors import anchors, family_positions, relatives
from pathweave.operators.chain_steps import chain_step


def positions_of(spark, paths):
    """``paths``: chromosome to a string of one-letter families, '.' for none."""
    rows = [(c, i, f) for c, path in paths.items() for i, f in enumerate(path) if f != "."]
    return spark.createDataFrame(rows, "chromosome long, pos int, family string")


def model_chains(paths, intermediate, matched):
    found = set()
    for r, ref in paths.items():
        for l, rel in paths.items():
            if r == l:
                continue
            pairs = [
                (i, j) for i, f in enumerate(ref) for j, g in enumerate(rel) if f == g and f != "."
            ]
            for sign in "+-":
                for c in chain_model(pairs, intermediate, matched, sign == "-"):
                    found.add((r, l, sign, *c))
    return found


def rows(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def random_paths(seed, count=4, longest=40, letters="ABCDE.", shortest=1):
    rng = random.Random(seed)
    return {
        10 + i: "".join(rng.choice(letters) for _ in range(rng.randint(shortest, longest)))
        for i in range(count)
    }


def test_golden_pair():
    pairs = [(0, 0), (1, 1), (2, 2), (5, 5), (9, 3), (8, 4), (7, 5)]
    ref, rel = (np.array(x, dtype=np.int64) for x in zip(*pairs))
    out = chain_step(3, 3, ("+", "-"))(np.zeros(7, dtype=np.int64), {"ref_pos": ref, "rel_pos": rel})
    got = list(
        zip(out["orientation"], out["ref_start"], out["ref_end"], out["rel_start"], out["rel_end"])
    )
    assert got == [("+", 0, 5, 0, 5), ("-", 5, 9, 3, 5)]


def test_step_against_model():
    rng = random.Random(5)
    for case in range(400):
        intermediate, matched = rng.randint(0, 6), rng.randint(1, 5)
        sets = [
            [(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(rng.randint(1, 60))]
            for _ in range(rng.randint(1, 4))
        ]
        group = np.concatenate([np.full(len(s), i) for i, s in enumerate(sets)])
        flat = [a for s in sets for a in s]
        columns = {
            "ref_pos": np.array([a[0] for a in flat]),
            "rel_pos": np.array([a[1] for a in flat]),
        }
        out = chain_step(intermediate + 1, matched, ("+", "-"))(group, columns)
        names = ("group", "orientation", "ref_start", "ref_end", "rel_start", "rel_end")
        got = sorted(zip(*(out[n].tolist() for n in names)))
        want = sorted(
            (i, sign, *c)
            for i, s in enumerate(sets)
            for sign in "+-"
            for c in chain_model(s, intermediate, matched, sign == "-")
        )
        assert got == want, case


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_of_paths(spark, seed):
    paths = random_paths(seed)
    found = ch.chains(positions_of(spark, paths), 3, 4)
    assert rows(found) == model_chains(paths, 3, 4)
    one = ch.chains(positions_of(spark, paths), 3, 4, query=11)
    assert rows(one) == {c for c in model_chains(paths, 3, 4) if c[0] == 11}


def test_blocks_equal_whole_pairs(spark):
    intermediate, limit = 3, 80
    paths = random_paths(4, count=3, longest=30, letters="AABC.", shortest=20)
    paths[99] = "AB"  # no pair with this one is giant
    positions = positions_of(spark, paths)
    assert anchor_module.lay_out(positions, limit).has_giants
    found = ch.chains(positions, intermediate, 3, block_anchors=limit)
    assert rows(found) == model_chains(paths, intermediate, 3)
    whole = ch.chain_scores(positions, intermediate, orientation="-")
    cut = ch.chain_scores(positions, intermediate, orientation="-", block_anchors=limit)
    assert rows(whole) == rows(cut)


def test_no_shared_family(spark):
    positions = positions_of(spark, {1: "AB", 2: "CD"})
    assert rows(ch.chains(positions, 5, 1)) == set()
    assert rows(ch.chains(positions, 0, 1, block_anchors=1)) == set()
    assert rows(relatives(positions)) == set()


def test_hot_family_is_spread(spark, monkeypatch):
    paths = {1: "A" * 30 + "B", 2: "BA" * 20, 3: "CCC"}
    positions = positions_of(spark, paths)
    monkeypatch.setattr(anchor_module, "POSITIONS_PER_LIST", 4)
    lists = anchor_module.position_lists(positions)
    plain = anchor_module.pair_lists(lists)
    spread = anchor_module.pair_lists(lists, pairs_per_cell=9)
    assert as_anchors(plain) == as_anchors(spread)
    assert len(as_anchors(plain)) == 2 * (30 * 20 + 20)
    assert rows(ch.chains(positions, 2, 3)) == model_chains(paths, 2, 3)


def as_anchors(pairs):
    found = [
        (r.ref_chr, r.rel_chr, i, j)
        for r in pairs.collect()
        for i in r.ref_positions
        for j in r.rel_positions
    ]
    assert len(found) == len(set(found))
    return set(found)


def test_null_family_and_repeated_numbers(spark):
    genes = spark.createDataFrame(
        [(1, 0, "A"), (1, 0, "B"), (1, 1, "-1"), (2, 4, "A"), (2, 4, "B"), (2, 5, "-1")],
        "chromosome long, number int, family string",
    )
    assert rows(anchors(family_positions(genes), query=1)) == {(1, 2, 0, 4)}
    assert rows(relatives(family_positions(genes), query=1)) == {(1, 2)}
    assert rows(relatives(family_positions(genes))) == {(1, 2), (2, 1)}
