"""SentencePiece encoding and decoding through a distinct-chunk table.

No piece of the model may hold a whitespace marker behind another character, so no merge crosses
the border in front of a run of markers. A chunk is such a run with what follows it; a text, with
the marker that the model puts in front, is a sequence of chunks, and its ids are theirs. Each
distinct chunk is segmented once a task by the library and its ids are joined back by position.
Models with such pieces, or whose normaliser changes more than spaces, are refused.

Decoding joins the pieces' texts by the same table: a chunk decodes to one space and what the
library decodes its ids to, and the first space of the text goes.

Defined cases: null text counts as empty, which gives the begin and end ids alone; repeated rows
are kept apart; the result has no other columns of the input.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pathweave.llm.chunks import ChunkTable
from pathweave.llm.texts import slices

MARK = "▁"
_LONG_GAP = re.compile(" +[^ ]*")


def chunks_of(text: str) -> list[str]:
    """The chunks, each without its first marker; markers are written as spaces."""
    marked = " " + text.replace(MARK, " ") if text else ""
    if "  " in marked:
        return [chunk[1:] for chunk in _LONG_GAP.findall(marked)]
    return marked.split(" ")[1:]


@lru_cache(maxsize=2)
def coder(model_file: str):
    """The model, checked, and its chunk table: chunk -> (ids as bytes, decoded text)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in pieces):
        raise ValueError("a piece of this model crosses a whitespace marker")
    probe = " \u00c5  e\u0301\ufb01\t "
    if model.decode(model.encode(probe)) != probe:
        raise ValueError("this model's normaliser changes texts")
    lone = model.piece_to_id(MARK)

    def encode(chunks: list[str]) -> list[tuple[bytes, str]]:
        # the library puts no marker in front of an empty text
        coded = [ids or [lone] for ids in model.encode(chunks, num_threads=1)]
        return [
            (array("I", ids).tobytes(), " " + text)
            for ids, text in zip(coded, model.decode(coded, num_threads=1), strict=True)
        ]

    return model, ChunkTable(encode)


def encode_texts(texts: list[str], model_file: str) -> list[tuple[bytes, str]]:
    """Ids (little-endian unsigned 32-bit, with begin and end) and decoded text of each text."""
    model, table = coder(model_file)
    begin, end = array("I", [model.bos_id()]).tobytes(), array("I", [model.eos_id()]).tobytes()
    coded = []
    for parts in table.encodings([chunks_of(text) for text in texts]):
        ids = b"".join([begin, *[p[0] for p in parts], end])
        coded.append((ids, "".join([p[1] for p in parts])[1:]))
    return coded


def encode_documents(documents: DataFrame, model_file: str) -> DataFrame:
    """``doc_id``, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` text."""

    def run(batches):
        for piece in slices(batches):
            coded = encode_texts([t or "" for t in piece.column(1).to_pylist()], model_file)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0),
                    pa.array([c[0] for c in coded], pa.binary()),
                    pa.array([c[1] for c in coded], pa.string()),
                ],
                names=["doc_id", "ids", "decoded"],
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, ids binary, decoded string"
    )


def digest(documents: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: ids stay in the task that made them."""

    def run(batches):
        for piece in slices(batches):
            coded = encode_texts([t or "" for t in piece.column(1).to_pylist()], model_file)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0),
                    pa.array([len(ids) // 4 for ids, _ in coded], pa.int64()),
                    pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in coded]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in coded]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
