"""Distinct-chunk tables: each distinct chunk of text is encoded once a task, then joined back.

An encoder fits when it gives a text the ids of its chunks one after the other. The table of a
Python worker is emptied once it holds ``most`` chunks, about 200 bytes each, which changes no
result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from operator import itemgetter

#: Chunks kept by one worker.
TABLE_CHUNKS = 1_000_000


class ChunkTable(dict):
    """Places in ``coded`` by chunk; ``encode`` takes a list of chunks not seen before."""

    def __init__(self, encode: Callable[[list[str]], Sequence], most: int = TABLE_CHUNKS):
        super().__init__()
        self.encode, self.most = encode, most
        self.coded, self.missing = [], []

    def __missing__(self, chunk: str) -> int:
        place = self[chunk] = len(self)
        self.missing.append(chunk)
        return place

    def encodings(self, chunks_of_texts: list[list[str]]) -> list[Sequence]:
        """For each text the encodings of its chunks."""
        if len(self) > self.most:
            self.clear()
            self.coded = []
        places = [itemgetter(*chunks)(self) if chunks else () for chunks in chunks_of_texts]
        if self.missing:
            self.coded.extend(self.encode(self.missing))
            self.missing = []
        return [
            itemgetter(*p)(self.coded) if type(p) is tuple and p else () if p == () else (self.coded[p],)
            for p in places
        ]
