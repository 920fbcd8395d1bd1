"""Whole texts as byte arrays inside a task: words, lines, hashes and code-point offsets.

Every step works on a slice of an Arrow batch, so memory is bound by ``SLICE_BYTES`` or by the
longest single text. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken together up to so many UTF-8 bytes.
SLICE_BYTES = 1 << 19
#: And up to so many in number.
SLICE_TEXTS = 10_000

_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RANDOM = np.random.Generator(np.random.PCG64(20240521))
_BYTE = _RANDOM.integers(0, 2**64, 256, np.uint64)
_NEAR = _RANDOM.integers(0, 2**64, 4096, np.uint64) | np.uint64(1)
_FAR = _RANDOM.integers(0, 2**64, 4096, np.uint64) | np.uint64(1)
_FAR[0] = 1  # words that fit into _NEAR hash alike beside longer ones
_FACTORS = _RANDOM.integers(0, 2**64, 16, np.uint64) | np.uint64(1)


class Texts:
    """UTF-8 bytes of several texts, with the byte offset at which each begins."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        self.count = len(column)
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + self.count + 1]
        self.offsets = at - at[0]
        self.data = (
            np.frombuffer(data, np.uint8)[at[0] : at[-1]]
            if data is not None
            else np.zeros(0, np.uint8)
        )

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs of true bytes that do not cross a text's border, as starts and ends."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        step = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = step == 1, step == -1
        borders = self.offsets[1:-1]
        borders = borders[(borders > 0) & (borders < len(inside))]
        torn = np.unique(borders[inside[borders] & inside[borders - 1]])
        starts[torn] = True
        ends[torn] = True
        return np.flatnonzero(starts), np.flatnonzero(ends)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the words ``[^\\x20\\x09-\\x0D]+``."""
        starts, ends = self.spans(~_GAP[self.data])
        return starts, ends, self.text_of(starts)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, side="right") - 1

    def per_text(self, at: np.ndarray) -> np.ndarray:
        """How many of the ascending byte positions ``at`` each text holds."""
        return np.diff(np.searchsorted(at, self.offsets))

    def code_points_before(self) -> np.ndarray:
        """For each byte position, the code points before it in the whole slice."""
        return np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))


def mixed(value: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values spread over the whole word."""
    value = value ^ (value >> np.uint64(30))
    value = value * np.uint64(0xBF58476D1CE4E5B9)
    value = value ^ (value >> np.uint64(27))
    value = value * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty span's bytes; the same bytes hash alike everywhere."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    value = _BYTE[data[place + np.repeat(starts, lengths)]] * _NEAR[place & 4095]
    if lengths.max() > 4096:
        value *= _FAR[(place >> 12) & 4095]
    return mixed(np.add.reduceat(value, first) + lengths.astype(np.uint64))


def window_hashes(hashes: np.ndarray, texts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` neighbouring words of one text, and the first word of each window."""
    count = max(0, len(hashes) - size + 1)
    total = np.zeros(count, np.uint64)
    for k in range(size):
        total += hashes[k : k + count] * _FACTORS[k]
    first = np.flatnonzero(texts[:count] == texts[size - 1 : size - 1 + count])
    return mixed(total[first]), first


def repeated(hashes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: hash seen earlier in the same text; hash seen twice or more in it."""
    order = np.lexsort((hashes, texts))
    same = (hashes[order][1:] == hashes[order][:-1]) & (texts[order][1:] == texts[order][:-1])
    later, often = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    later[order[1:][same]] = True
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    return later, often


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds one text or at most ``SLICE_BYTES`` of them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        sizes = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
            end = min(end, begin + SLICE_TEXTS)
            yield batch.slice(begin, end - begin)
            begin = end


def per_text(step: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """``step`` over slices, in the form that ``mapInArrow`` takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            yield step(piece)

    return run


def record(schema: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, kind) for c, (_, kind) in zip(columns, schema)
    ]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in schema])
