"""The MinHash join against comparing all pairs of sets."""

import random

import numpy as np
import pytest
from plain import linked_groups, rows_of
from pyspark.sql import functions as F

from pathweave.llm import minhash_join
from pathweave.llm.group_join import Threshold

COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def near(documents, *given):
    return sorted((tuple(r) for r in minhash_join.near_duplicates(documents, *given).select(*COLUMNS).collect()), key=str)


def plain_near(documents, size, num, den):
    return sorted(((d, n, c, d == c) for d, n, c, _ in linked_groups(rows_of(documents), size, num, den)), key=str)


@pytest.mark.parametrize("size, num, den, block", [(5, 85, 100, 512), (2, 1, 2, 4)])
def test_near_duplicates(documents, monkeypatch, size, num, den, block):
    monkeypatch.setattr(minhash_join, "BLOCK", block)
    clashing = documents.withColumns({c: F.lit(1) for c in ("posts", "cluster", "block", "b", "shingles", "n_shingles")})
    assert near(clashing, size, num, den) == plain_near(documents, size, num, den)


def test_chains_of_links_are_one_component(spark):
    random.seed(4)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[8 * k : 8 * k + 200]) for k in range(25)]
    texts += [t.upper() for t in texts[:3]] + [" ".join(random.sample(words, 200)), "w1 w2", "w1  w2", "w1 w2 w3"]
    rows = list(enumerate(texts))
    random.shuffle(rows)
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near(documents)
    assert got == plain_near(documents, 5, 85, 100)
    assert len({c for d, _, c, _ in got if d < 28}) == 1


def test_no_documents(no_documents):
    assert near(no_documents) == []


def test_fewest_matches_are_rarely_missed():
    least = minhash_join.least_matches(32, 0.85)
    random.seed(7)
    rows = np.random.default_rng(3)
    limit = Threshold(85, 100)
    for _ in range(20):
        both = rows.integers(0, 2**63, 340, np.uint64)
        own = [np.sort(np.concatenate([both, rows.integers(0, 2**63, 30, np.uint64)])) for _ in range(2)]
        sizes = np.array([len(s) for s in own])
        made = minhash_join.posts(np.concatenate(own), sizes, 32)
        assert (made[0] == made[1]).sum() >= least
        assert limit.den * len(both) >= limit.num * 400


def block_of(sets, coordinates=16):
    sizes = np.array([len(s) for s in sets])
    made = minhash_join.posts(np.concatenate(sets), sizes, coordinates)
    return minhash_join.Block(
        [
            {"sid": k, "shingles": s.tobytes(), "posts": m.tobytes(), "prefix": m.view(np.int64).tolist()}
            for k, (s, m) in enumerate(zip(sets, made))
        ]
    )


@pytest.mark.parametrize("few", [0, 10**9])
def test_overlaps_and_collisions(monkeypatch, few):
    monkeypatch.setattr(minhash_join, "FEW", few)
    monkeypatch.setattr(minhash_join, "CELLS", 64)
    random.seed(6)
    sets = [np.array(sorted(random.sample(range(60), random.randint(1, 40))), np.uint64) for _ in range(30)]
    one, other = block_of(sets[:18]), block_of(sets[18:])
    for a, b in ((one, one), (one, other)):
        pairs = minhash_join.collisions(a, b, 5)
        want = [
            (x, y) for x in range(len(a.sids)) for y in range(len(b.sids))
            if (x < y or a is not b) and (a.posts[x] == b.posts[y]).sum() >= 5
        ]
        assert [tuple(p) for p in pairs.tolist()] == want
        both = minhash_join.overlaps(a, b, pairs)
        assert both.tolist() == [len({*a.shingles[x].tolist()} & {*b.shingles[y].tolist()}) for x, y in want]
