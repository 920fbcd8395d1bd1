"""Encoders against their libraries, packing by its rules, top-k against brute force."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import pytest
from plain import best_rows, rows_of

from pathweave.llm import exact_topk, packing, sentence_pieces
from pathweave.llm.queries import tokenizer_file

PARTS = list("ab \n\t\x0b#é|▁") + [
    "abc ", "xy z ", "  ", "    ", "ﬁ", "é", "\x00", "日本", "\r", "👍🏽", "　", "<s>", "</s>", "<0x41>",
    "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'ll", "Σ", "ΑΣ ", " ̈", "İ", "Word.", "a.b,", "ß,", "é.",
]


def odd_texts():
    random.seed(2)
    return ["", " ", "  ", "▁", "a▁▁b"] + ["".join(random.choices(PARTS, k=random.randint(0, 40))) for _ in range(1500)]


def test_pieces_are_the_library_s():
    import sentencepiece

    file = tokenizer_file("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=file)
    texts = odd_texts()
    for text, (ids, decoded) in zip(texts, sentence_pieces.encode_texts(texts, file)):
        want = model.encode(text, add_bos=True, add_eos=True)
        assert array("I", want).tobytes() == ids and model.decode(want) == decoded


def test_piece_digest(documents, no_documents):
    import sentencepiece

    file = tokenizer_file("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=file)
    got = sorted((tuple(r) for r in sentence_pieces.digest(documents, file).collect()), key=str)
    want = []
    for doc, text in rows_of(documents):
        ids = model.encode(text, add_bos=True, add_eos=True)
        digests = [hashlib.sha256(b).hexdigest() for b in (array("I", ids).tobytes(), model.decode(ids).encode())]
        want.append((doc, len(ids), *digests))
    assert got == sorted(want, key=str)
    assert sentence_pieces.digest(no_documents, file).count() == 0


def test_tokens_are_the_library_s():
    from tokenizers import Tokenizer

    file = tokenizer_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(file)
    texts = odd_texts()
    for text, ids in zip(texts, packing.token_ids(texts, file)):
        assert array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes() == ids


@pytest.mark.parametrize("capacity", [4096, 64])
def test_every_token_is_packed_once_without_gaps(documents, capacity):
    from tokenizers import Tokenizer

    file = tokenizer_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(file)
    rows = packing.pack_documents(documents, file, capacity).collect()
    want = []
    for doc, text in rows_of(documents):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want.append((doc, k // capacity, k, len(part), zlib.crc32(array("I", part).tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r["length"] for r in rows) // capacity)
    assert len(sequences) <= 1.05 * least + 1


def test_plans_hold_every_piece_and_are_near_the_bound():
    random = np.random.default_rng(1)
    for size, capacity in ((1, 8), (50, 8), (3000, 128), (20000, 128)):
        lengths = np.minimum(capacity, random.geometric(4 / capacity, size))
        counts = np.bincount(lengths, minlength=capacity + 1)
        plan = packing.packing_plan(counts, capacity)
        held = np.zeros(capacity + 1, int)
        for pattern, times in plan:
            assert sum(pattern) <= capacity and times > 0
            np.add.at(held, list(pattern), times)
        assert (held == counts).all()
        bound = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
        assert sum(t for _, t in plan) <= 1.03 * bound + 1


def test_packing_nothing(no_documents):
    assert packing.pack_documents(no_documents, tokenizer_file("word_bpe_49k.json")).count() == 0


def test_top_k_is_exact(spark):
    random.seed(9)
    vectors = [(k, [random.gauss(0, 0.2) for _ in range(6)]) for k in range(450)]
    vectors += [(k, vectors[7][1]) for k in range(500, 620)]  # ties
    vectors += [(700, None), (800, [0.1, None] + [0.0] * 4), (900, [float("nan")] * 6), (1000, [float("inf")] * 6)]
    vectors += [(1100, []), (1200, [0.5, 0.5]), (1201, [-0.5, 0.5]), (None, [0.1] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, rank int, score int")
    exact = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    for block in (4096, 64):
        got = sorted(tuple(r) for r in exact_topk.top_k(df, block=block).collect())
        assert got == best_rows(exact)
    assert exact_topk.top_k(df.limit(0)).count() == 0


def read_of(rows, queries, barred, bar=-np.inf):
    """Shares of entries read and rows resolved, with results held against scoring all rows."""
    lists = exact_topk.SortedLists(rows)
    shares, resolved = [], []
    for q in queries:
        out = np.arange(len(rows)) == (q if barred else -1)
        found, scores, read = exact_topk.best_rows(lists, rows[q], out, 10, bar)
        whole = np.where(out, -np.inf, rows @ rows[q])
        want = np.lexsort((np.arange(len(rows)), -whole))[:10]
        want = want[whole[want] >= bar]
        mine = np.lexsort((found, -scores))[: len(want)]
        assert (found[mine] == want).all() and (scores[mine] == whole[want]).all()
        shares.append(read)
        resolved.append(len(found))
    return np.array(shares), np.array(resolved)


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_bounds_decide_on_the_given_vectors(scale):
    import pyarrow.parquet as pq

    vectors = pq.read_table(f"/root/testdata/{scale}/embeddings.parquet").column("embedding").to_pylist()
    rows = np.floor(1024 * np.array(vectors, float))
    shares, resolved = read_of(rows, range(0, len(rows), 100), True)
    # the lists are never read to their ends, and few rows are left to resolve
    assert shares.max() < 0.9 and resolved.max() <= exact_topk.RESOLVED * 10
    # a score carried over from earlier blocks stops the reading sooner
    whole = rows @ rows[0]
    bar = np.sort(whole)[-11]
    with_bar, _ = read_of(rows, [0], True, bar)
    without, _ = read_of(rows, [0], True)
    assert with_bar[0] <= without[0]


def test_reading_stops_early_where_scores_are_spread():
    rows = np.floor(1024 * np.random.default_rng(3).normal(0, 1, (2000, 3)) ** 3)
    shares, resolved = read_of(rows, range(5), False)
    assert shares.max() < 0.7 and resolved.max() <= exact_topk.RESOLVED * 10


def test_lists_without_impact_are_read_whole():
    rows = np.zeros((50, 4))
    shares, resolved = read_of(rows, [0, 7], True)
    assert (resolved == 49).all()
    rows[:, 2] = np.arange(50) % 3
    read_of(rows, range(0, 50, 7), True)
