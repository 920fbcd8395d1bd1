"""Best-fit packing by patterns whose repeat counts come from non-negative least squares.

A document is its token ids and an end id, cut into full sequences and a shorter last piece.
The histogram of the shorter pieces (at most ``capacity - 1`` lengths, whatever the input) goes to
the driver. There, patterns of few lengths that fill a sequence are enumerated, non-negative least
squares fits how often each should repeat to match the histogram, the counts are rounded down,
and the residual lengths are packed best-fit, longest first, many equal pieces at a time. The
plan says for each length which ranks of its pieces go to which pattern and slot. Pieces get
ranks within their length without meeting in one task: a length is split over buckets of about
``BUCKET_ROWS`` pieces, whose counts give each bucket its first rank.

Defined cases: null and empty texts are one end id; repeated rows are packed as often as they
come; a table without rows gives none; other columns are left out of the result.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pathweave.llm.chunks import TABLE_CHUNKS, ChunkTable
from pathweave.llm.texts import slices
from pathweave.session import files_for, materialise

CAPACITY = 4096
END_ID = 1
#: Patterns hold at most so many lengths, and at most so many patterns are fitted.
PATTERN_LENGTHS = 3
PATTERNS = 30_000
FIT_STEPS = 400
BUCKET_ROWS = 50_000
#: Marks that are cut from words before these are looked up.
MARKS = ".,"
WORD_END = "</w>"
#: Words that are encoded as one text.
JOINED = 100

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def _tokenizer(file: str, most: int):
    """The tokenizer and its table: white-space separated chunk -> ids as bytes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(file)

    def ids(chunks: list[str]) -> list[bytes]:
        coded = tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [array("I", c.ids).tobytes() for c in coded]

    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, number in tokenizer.get_vocab().items():
        ends[number] = token.endswith(WORD_END)

    def words(chunks: list[str]) -> list[bytes]:
        """Chunks of letters alone go together, as each ends where a token ends a word."""
        plain = [c for c in chunks if c.isalpha()] if ends.any() else []
        texts = [" ".join(plain[k : k + JOINED]) for k in range(0, len(plain), JOINED)]
        coded = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        numbers = np.array([number for c in coded for number in c.ids], np.uint32)
        data, cut = numbers.tobytes(), (4 * (np.flatnonzero(ends[numbers]) + 1)).tolist()
        if len(cut) != len(plain):
            return ids(chunks)
        parts = iter([data[a:b] for a, b in zip([0, *cut], cut)])
        rest = iter(ids([c for c in chunks if not c.isalpha()]))
        return [next(parts) if c.isalpha() else next(rest) for c in chunks]

    marks = dict(zip(MARKS, ids(list(MARKS)), strict=True))
    # a mark behind a letter is a token of its own where the tokenizer parts letters from others
    parted = ids(["a."])[0] == ids(["a"])[0] + marks["."]

    def encode(chunks: list[str]) -> list[bytes]:
        if not parted:
            return words(chunks)
        cut = [c[-1:] in marks and c[-2:-1].isascii() and c[-2:-1].isalpha() for c in chunks]
        whole = [c[:-1] if m else c for c, m in zip(chunks, cut, strict=True)]
        places = map(table.get, whole)
        known = {c: table.coded[p] for c, p in zip(whole, places) if p is not None and p < len(table.coded)}
        new = list({c for c in whole if c not in known})
        known.update(zip(new, words(new), strict=True))
        return [known[w] + marks[c[-1]] if m else known[w] for c, m, w in zip(chunks, cut, whole, strict=True)]

    table = ChunkTable(encode, most)
    lower = ids(["Ab\u00c9"]) == ids(["ab\u00e9"])
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return lower, special, table


def token_ids(
    texts: list[str], tokenizer_file: str, table_chunks: int = TABLE_CHUNKS
) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text.

    Fits tokenizers that drop white space, so that a text's ids are those of its words. Texts of
    Latin-1 characters are put into lower case first where the tokenizer does so.
    """
    lower, special, table = _tokenizer(tokenizer_file, table_chunks)
    chunked = []
    for text in texts:
        if lower and (text.isascii() or _latin(text)):
            low = text.lower()
            # written otherwise, a special token is ordinary text
            text = text if any(s in low for s in special) else low
        chunked.append(text.replace("\n", " ").split(" "))
    return [b"".join(parts) for parts in table.encodings(chunked)]


def _latin(text: str) -> bool:
    """Only Latin-1 characters, whose lower case does not depend on their neighbours."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def document_pieces(
    documents: DataFrame,
    tokenizer_file: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    table_chunks: int = TABLE_CHUNKS,
) -> DataFrame:
    """``PIECES``: every document's ids cut into pieces of at most ``capacity``."""
    end = array("I", [end_id]).tobytes()
    width = 4 * capacity

    def run(batches):
        for batch in slices(batches):
            rows = ([], [], [], [], [])
            texts = [t or "" for t in batch.column(1).to_pylist()]
            coded = token_ids(texts, tokenizer_file, table_chunks)
            for doc, ids in zip(batch.column(0).to_pylist(), coded, strict=True):
                ids += end
                for k in range(0, len(ids), width):
                    part = ids[k : k + width]
                    row = (doc, k // width, k // 4, len(part) // 4, zlib.crc32(part))
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(rows, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, PIECES
    )


def few_length_patterns(counts: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Patterns of at most ``PATTERN_LENGTHS`` lengths that fill ``capacity`` exactly.

    All pairs come first, then triples of the commonest lengths with the length that completes
    them. The number is bound by ``PATTERNS``, not by the input.
    """
    there = np.flatnonzero(counts)
    found = [(int(a), capacity - int(a)) for a in there if 2 * a >= capacity and counts[capacity - a]]
    common = there[np.argsort(-counts[there], kind="stable")]
    seen = set()
    for k in range(len(common)):
        a = int(common[k])
        rest = capacity - a - common[: k + 1]
        for b, c in zip(common[: k + 1].tolist(), rest.tolist(), strict=True):
            if c > 0 and counts[c]:
                seen.add(tuple(sorted((a, b, c), reverse=True)))
        if len(seen) >= PATTERNS:
            break
    return found + sorted(seen)[:PATTERNS]


def fitted_repeats(patterns: list[tuple[int, ...]], counts: np.ndarray) -> np.ndarray:
    """Non-negative repeat counts that minimise the squared distance to the histogram.

    Accelerated projected gradient steps; a pattern has few lengths, so the matrix is never built.
    """
    column = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.concatenate([np.asarray(p) for p in patterns])
    size = len(counts)
    # the squared norm of the matrix is at most its largest row sum times its largest column sum
    step = 1.0 / (np.bincount(row, minlength=size).max() * PATTERN_LENGTHS)
    x = y = np.zeros(len(patterns))
    speed = 1.0
    for _ in range(FIT_STEPS):
        miss = np.bincount(row, y[column], size) - counts
        new = np.maximum(0.0, y - step * np.bincount(column, miss[row], len(patterns)))
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        y = new + (speed - 1) / faster * (new - x)
        x, speed = new, faster
    return x


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first into the fullest open sequence that has room; equal ones move together."""
    open_by_room: dict[int, list[list]] = defaultdict(list)
    rooms = np.zeros(capacity + 1, bool)
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            fits = np.flatnonzero(rooms[length:])
            if not len(fits):
                alike = capacity // length
                for each, times in ((alike, left // alike), (left % alike, 1)):
                    if each and times:
                        room = capacity - each * length
                        open_by_room[room].append([(length,) * each, times])
                        rooms[room] = True
                break
            room = length + int(fits[0])
            pattern, times = open_by_room[room].pop()
            used = min(times, left)
            if used < times:
                open_by_room[room].append([pattern, times - used])
            rooms[room] = bool(open_by_room[room])
            open_by_room[room - length].append([(*pattern, length), used])
            rooms[room - length] = True
            left -= used
    return [(tuple(p), n) for group in open_by_room.values() for p, n in group]


def packing_plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, how many sequences) that hold every piece of the histogram once."""
    left = counts.astype(np.int64).copy()
    plan = []
    if patterns := few_length_patterns(left, capacity):
        for repeats, pattern in sorted(
            zip(np.floor(fitted_repeats(patterns, left) + 1e-6).astype(int).tolist(), patterns),
            key=lambda x: (-x[0], x[1]),
        ):
            need = np.bincount(pattern, minlength=len(left))
            used = np.flatnonzero(need)
            repeats = min(repeats, int((left[used] // need[used]).min()))
            if repeats > 0:
                left[used] -= repeats * need[used]
                plan.append((pattern, repeats))
    return plan + best_fit(left, capacity)


class Placement:
    """For each length the ascending first ranks of its slots, and what they stand for."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        begin = 0
        for pattern, times in plan:
            offset = 0
            for length in pattern:
                slots[length].append((times, begin, offset))
                offset += length
            begin += times
        self.sequences = begin
        self.slots = {}
        for length, mine in slots.items():
            times, first, offset = (np.array(c, np.int64) for c in zip(*mine, strict=True))
            self.slots[length] = (np.cumsum(times) - times, first, offset)

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and ranks."""
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for length in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == length)
            ranks_from, first, at = self.slots[length]
            slot = np.searchsorted(ranks_from, ranks[mine], side="right") - 1
            sequence[mine] = first[slot] + ranks[mine] - ranks_from[slot]
            offset[mine] = at[slot]
        return sequence, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    The plan that every task gets has at most ``PATTERNS`` fitted patterns and, from the residual,
    a few for each length: it is bound by the capacity, not by the input.
    """
    spark = pieces.sparkSession
    pieces = materialise(pieces, "pieces")
    rows = pieces.count()
    buckets = max(1, -(-rows // BUCKET_ROWS))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    groups = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("pieces"))
    groups = materialise(groups, "lengths", files_for(rows))
    counts = np.zeros(capacity + 1, np.int64)
    for row in groups.groupBy("length").agg(F.sum("pieces").alias("pieces")).collect():
        counts[row["length"]] = row["pieces"]
    placement = spark.sparkContext.broadcast(Placement(packing_plan(counts, capacity)))
    first_ranks = groups.withColumn(
        "first_rank",
        F.coalesce(
            F.sum("pieces").over(
                Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    ).drop("pieces")
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.join(first_ranks, ["length", "bucket"]).withColumn(
        "rank", F.col("first_rank") + F.row_number().over(order) - 1
    )

    def run(batches):
        for batch in batches:
            lengths, ranks = (batch.column(n).to_numpy() for n in ("length", "rank"))
            sequence, offset = placement.value.place(lengths, ranks)
            kept = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    placed = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return placed.coalesce(files_for(rows)).mapInArrow(
        run, PIECES + ", sequence_id long, offset long"
    )


def pack_documents(
    documents: DataFrame,
    tokenizer_file: str,
    capacity: int = CAPACITY,
    table_chunks: int = TABLE_CHUNKS,
) -> DataFrame:
    pieces = document_pieces(documents, tokenizer_file, capacity, END_ID, table_chunks)
    return pack(pieces, capacity)
