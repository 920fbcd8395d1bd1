"""Language-model scoring: stupid backoff over n-gram count tables partitioned by hash.

The model is a bigram model over all documents, with counts of its own for every word. A bigram
seen at least ``LEAST`` times scores its count over its first word's as a first word; any other
backs off to ``BACKOFF`` times the share of its second word among all words, and so does the
first word of a document without the factor.

The documents are cut into chunks. Each counts its n-grams (no word: the total; words; bigrams)
and deals them out by hash, every n-gram of a chunk once, so that a hot one has a row's place for
each chunk at most. One task then has all of an n-gram, adds up its counts and answers every chunk
that asked; the chunk, whose words travel along, sums the scores of its documents. Nothing of the
model is sent to every task or to the driver, and it grows with the input. Scores are whole
micro-nats, so sums do not depend on their order.

With ``LEAST`` 2 a bigram that stands only once in the corpus, in the scored document itself, backs
off: its own occurrence is no evidence. Exact copies and repeats in a document count as evidence.

Defined cases: null texts and texts without words have no words and score 0; repeated rows count
as often as they come; other columns are left out of the result. Words and bigrams are compared by
64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pathweave.llm.group_join import runs
from pathweave.llm.texts import Texts, mixed, slices, span_hashes

LEAST = 2
BACKOFF = 0.4
#: Bytes of text whose n-grams a task gets on average, and words of a chunk.
TASK_BYTES = 1 << 27
CHUNK = 1 << 20
#: Documents of a chunk.
CHUNK_TEXTS = 60_000
LEAST_PARTS = 256
#: What sets n-grams of one word apart.
_ONE, _TWO = np.uint64(0xD1B54A32D192ED03), np.uint64(0xABC98388FB8FAC03)


def micro(value) -> np.ndarray:
    """Natural logarithms in whole millionths."""
    return np.floor(np.log(value) * 1e6 + 0.5).astype(np.int64)


def _words(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, int]:
    texts = Texts(piece.column(1))
    starts, ends, of = texts.words()
    return span_hashes(texts.data, starts, ends), of, texts.count


def score_documents(documents: DataFrame) -> DataFrame:
    """``doc_id, n_words, score_micro, score``: the log score, and its mean a word in nats."""
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tasks = 1 + (texts.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0) // TASK_BYTES
    parts = max(LEAST_PARTS, 8 * tasks)

    def explode(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        words_held = texts_held = 0
        for piece in slices(batches):
            words, of, count = _words(piece)
            if held and (words_held + len(words) > CHUNK or texts_held + count > CHUNK_TEXTS):
                yield from _exploded(held, chunk, parts)
                held, words_held, texts_held, chunk = [], 0, 0, chunk + 1
            held.append((piece.column(0), np.bincount(of, minlength=count), words))
            words_held += len(words)
            texts_held += count
        if held:
            yield from _exploded(held, chunk, parts)

    def count(batches):
        held, part = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["ids"] is not None:  # a chunk's documents pass through
                    yield _row(**(row | {"part": -1}))
                    continue
                if row["part"] != part and held:
                    yield from _counted(held)
                    held = []
                part = row["part"]
                held.append(row)
        if held:
            yield from _counted(held)

    def score(batches):
        held, meta = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["ids"] is None:
                    held.append(row["counts"])
                    continue
                if meta is not None:
                    yield _scored(meta, held)
                held, meta = [], row
        if meta is not None:
            yield _scored(meta, held)

    kinds = "part int, chunk long, grams binary, counts binary, ids binary, sizes binary, words binary, places binary"
    return (
        texts.mapInArrow(explode, kinds)
        .repartition(tasks, "part")
        .sortWithinPartitions("part")
        .mapInArrow(count, kinds)
        .repartition("chunk")
        .sortWithinPartitions("chunk", "part")
        .mapInArrow(score, "doc_id long, n_words long, score_micro long")
        .withColumn(
            "score", F.col("score_micro") / F.greatest(F.col("n_words"), F.lit(1)) / F.lit(1e6)
        )
    )


def _squeezed(values: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _restored(kind: np.dtype, data: bytes) -> np.ndarray:
    count, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(data[8:], count * width, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, count).T).reshape(-1).view(kind)


def _row(part: int, chunk: int, **given: bytes) -> pa.RecordBatch:
    names = ("grams", "counts", "ids", "sizes", "words", "places")
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([chunk]), *(pa.array([given.get(n)], pa.binary()) for n in names)],
        names=["part", "chunk", *names],
    )


def _grams(words: np.ndarray, places: np.ndarray, sizes: np.ndarray):
    """The bigrams of a chunk's words, each once as (first word + 1, second word), and each word's.

    The first word of a document follows nothing. Then the hashes of all n-grams, rising, and
    their order: the total, the words, the bigrams.
    """
    first = np.zeros(len(places), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    before = np.concatenate((np.zeros(1, np.uint64), places[:-1].astype(np.uint64) + np.uint64(1)))[: len(places)]
    before[first] = 0
    table, of = np.unique((before << np.uint64(32)) | places.astype(np.uint64), return_inverse=True)
    two = table[np.searchsorted(table, np.uint64(1 << 32)) :]
    behind = words[(two & np.uint64(2**32 - 1)).astype(np.int64)]
    ahead = words[(two >> np.uint64(32)).astype(np.int64) - 1]
    hashes = np.concatenate(
        (np.zeros(1, np.uint64), mixed(words ^ _ONE), mixed(mixed(ahead ^ _TWO) + behind))
    )
    order = np.argsort(hashes, kind="stable")
    return table, of, hashes[order], order


def _exploded(held, chunk: int, parts: int):
    """The n-grams of a chunk of documents, each once with its counts, in parts by hash."""
    sizes = np.concatenate([h[1] for h in held])
    words, places = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True)
    sink = pa.BufferOutputStream()
    ids = pa.table({"doc_id": pa.chunked_array([h[0] for h in held])})
    with pa.ipc.new_stream(sink, ids.schema) as writer:
        writer.write_table(ids)
    yield _row(
        int(mixed(np.array([chunk], np.uint64))[0]) % parts, chunk, ids=sink.getvalue().to_pybytes(),
        sizes=_squeezed(sizes.astype(np.uint32)), words=_squeezed(words), places=_squeezed(places.astype(np.uint32)),
    )
    if not len(places):
        return
    table, of, hashes, order = _grams(words, places, sizes)
    times = np.bincount(of, minlength=len(table))
    single = int(np.searchsorted(table, np.uint64(1 << 32)))
    heads = np.bincount((table[single:] >> np.uint64(32)).astype(np.int64) - 1, times[single:], len(words))
    counts = np.zeros((len(hashes), 2), np.uint32)
    counts[0, 0] = len(places)
    counts[1 : len(words) + 1] = np.stack((np.bincount(places, minlength=len(words)), heads), 1)
    counts[len(words) + 1 :, 0] = times[single:]
    counts = counts[order]
    part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cut = runs(part)
    for begin, end in zip(cut[:-1], cut[1:]):
        yield _row(
            int(part[begin]), chunk, grams=_squeezed(np.diff(hashes[begin:end], prepend=np.uint64(0))),
            counts=_squeezed(counts[begin:end].reshape(-1)),
        )


def _counted(rows):
    """The count table of one part, joined to the n-grams of every chunk in it."""
    keys = [np.cumsum(_restored(np.uint64, r["grams"]), dtype=np.uint64) for r in rows]
    table, place = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.zeros((len(table), 2), np.int64)
    np.add.at(counts, place, np.concatenate([_restored(np.uint32, r["counts"]).reshape(-1, 2) for r in rows]))
    begin = 0
    for row, key in zip(rows, keys):
        mine = counts[place[begin : begin + len(key)]]
        begin += len(key)
        yield _row(row["part"], row["chunk"], counts=_squeezed(mine.reshape(-1)))


def _scored(meta, answers) -> pa.RecordBatch:
    """The documents of one chunk, from the answers of all parts in their order."""
    sizes = _restored(np.uint32, meta["sizes"]).astype(np.int64)
    words, places = _restored(np.uint64, meta["words"]), _restored(np.uint32, meta["places"])
    total = np.zeros(len(sizes), np.int64)
    if len(places):
        table, of, hashes, order = _grams(words, places, sizes)
        counts = np.zeros((len(hashes), 2), np.int64)
        counts[order] = np.concatenate([_restored(np.int64, a) for a in answers]).reshape(-1, 2)
        some = sizes > 0
        total[some] = np.add.reduceat(gram_values(table, counts, len(words))[of], (np.cumsum(sizes) - sizes)[some])
    ids = pa.ipc.open_stream(meta["ids"]).read_all().column(0).combine_chunks()
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(sizes), pa.array(total)], names=["doc_id", "n_words", "score_micro"]
    )


def gram_values(table: np.ndarray, counts: np.ndarray, words: int) -> np.ndarray:
    """The stupid-backoff score of each bigram in micro-nats; counts: total, words, bigrams."""
    before = (table >> np.uint64(32)).astype(np.int64)
    word = (table & np.uint64(2**32 - 1)).astype(np.int64)
    follows = before > 0
    share = counts[1 + word, 0] / counts[0, 0]
    share[follows] *= BACKOFF
    value = micro(share)
    both = np.zeros(len(table), np.int64)
    both[follows] = counts[words + 1 :, 0]
    seen = follows & (both >= LEAST)
    value[seen] = micro(both[seen] / counts[before[seen], 1])
    return value
