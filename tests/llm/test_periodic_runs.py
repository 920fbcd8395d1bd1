"""Periodic runs against counting, and grammar extensions against comparing words one by one."""

import random

import numpy as np
import pytest
from plain import WORD
from pyspark.sql import functions as F

from pathweave.llm import periodic_runs
from pathweave.llm.queries import planted_repeats
from pathweave.llm.recompression import Grammar


def plain_runs(words):
    found = {}
    for period in range(1, len(words) // 3 + 1):
        at = 0
        while at + period < len(words):
            begin = at
            while at + period < len(words) and words[at] == words[at + period]:
                at += 1
            if at + period - begin >= max(24, 3 * period):
                found.setdefault((begin, at + period), period)
            at += 1
    return sorted((b, e - b, p) for (b, e), p in found.items())


def some_words():
    words = [random.randrange(random.choice([1, 2, 3, 40])) for _ in range(random.randint(0, 150))]
    for _ in range(random.randint(0, 3)):
        at, period = random.randint(0, len(words)), random.randint(1, 20)
        words[at : at + period] = words[at : at + period] * random.randint(2, 8)
    return words


@pytest.mark.parametrize("points", [1 << 18, 7])
def test_runs_equal_counting(points, monkeypatch):
    monkeypatch.setattr(periodic_runs, "POINTS", points)
    random.seed(points)
    for _ in range(150):
        texts = [some_words() for _ in range(random.randint(1, 5))]
        first = np.cumsum([0, *map(len, texts)])
        hashes = np.array(sum(texts, []), np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        got = periodic_runs.runs_of(hashes, first)
        for k, words in enumerate(texts):
            assert [tuple(r) for r in got[k].tolist()] == plain_runs(words) if k in got else not plain_runs(words)


@pytest.mark.parametrize("letters", [1, 2, 5])
def test_extensions_equal_comparing(letters):
    random.seed(letters)
    for _ in range(60):
        texts = [[random.randrange(letters) for _ in range(random.randint(1, 60))] for _ in range(2)]
        symbols = np.array([-1, *texts[0], -2, *texts[1], -3])
        grammar = Grammar(symbols)
        places = np.flatnonzero(symbols >= 0)
        a, b = np.array([(x, y) for x in random.choices(places, k=20) for y in random.choices(places, k=3) if x != y] or [(1, 2)]).T
        for step in (1, -1):
            for x, y, length in zip(a, b, grammar.extensions(a, b, step)):
                same = 0
                while x != y and symbols[x + step * same] == symbols[y + step * same]:
                    same += 1
                assert same == length


def test_grammars_are_logarithmic():
    random.seed(1)
    symbols = np.array([-1, *[random.randrange(50) for _ in range(20_000)], -2])
    assert len(Grammar(symbols).levels) < 60
    assert len(Grammar(np.array([-1, *[3] * 20_000, -2])).levels) == 2


def test_best_run_is_exact():
    assert periodic_runs.best_run(np.array([(9, 30, 10), (3, 72, 24), (5, 24, 8)])) == [9, 30, 10]
    assert periodic_runs.best_run(np.array([(0, 299, 100), (3, 300, 100), (9, 30, 10)])) == [3, 300, 100]


def plain_row(doc_id, text):
    words = WORD.findall(text)
    if doc_id is not None and words and (order := planted_repeats(doc_id, len(words))) is not None:
        words = [words[k] for k in order]
    runs = plain_runs(words)
    gone = {k for b, length, p in runs for k in range(b + p, b + length)}
    return doc_id, runs, " ".join(w for k, w in enumerate(words) if k not in gone)


def test_find(spark, documents):
    random.seed(2)
    rows = [(k, " \n".join(f"w{x}" for x in some_words())) for k in range(400, 460)]
    rows += [(500, "a b c d e f g h " * 3 + " x y"), (501, "é " * 24), (502, None), (502, None), (None, "b " * 30)]
    small = documents.filter("coalesce(length(text), 0) < 30000").select("doc_id", "text")
    given = spark.createDataFrame(rows, "doc_id long, text string").unionByName(small)
    got = periodic_runs.find(given.withColumns({"runs": F.lit(1), "best": F.lit(2)}), planted_repeats).collect()
    want = [plain_row(*r) for r in given.select("doc_id", F.coalesce("text", F.lit(""))).collect()]
    assert sorted(((r[0], [tuple(x) for x in r[1]], r[3]) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        exact = [(-x.length / x.period, x.start, x.period) for x in r.runs]
        assert (r.best is None) == (not exact)
        if exact:
            assert (-r.best.length / r.best.period, r.best.start, r.best.period) == min(exact)


def test_very_long_and_no_documents(spark, documents, no_documents):
    long = {r.doc_id: r for r in periodic_runs.find(documents.filter("doc_id in (320, 321, 322)")).collect()}
    assert [tuple(x) for x in long[320].runs] == [(0, 30000, 1)] and long[320].collapsed == "word"
    assert long[321].runs == [] and long[322].collapsed == "line"
    assert periodic_runs.find(no_documents).collect() == []
