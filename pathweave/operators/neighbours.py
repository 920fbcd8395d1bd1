"""Anchors that have a neighbour, found from the families around each position.

Two anchors of one pair are neighbours when both chromosomes have the same two families near each
other. So a position travels once, with codes of the families around it, to the others of its own
family; which of them share a code is seen there, and no other anchor is made. What is shuffled
grows with positions and the reach, not with anchors or with pairs of neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pathweave.functions.groups import ARROW, lengths, whole_groups
from pathweave.functions.prefix import bucket_of
from pathweave.operators.bundles import BLOCK
from pathweave.session import materialise

# Positions of a chromosome whose surroundings are found together, at the least.
STRETCH = 1 << 12
# A family with more positions than this on all chromosomes is spread over several groups.
POSITIONS_PER_CELL = 1 << 12
# Rows of one call, and meetings of two codes that are looked at together.
_ROWS_PER_CALL = 1 << 14
_MEETINGS = 1 << 20

_PLACES = ("chromosome", "bucket")


def near_positions(positions: DataFrame, reach: int, exact: bool = True) -> DataFrame:
    """``(family, chromosome, pos, near)``, ``near`` the families at most ``reach`` away.

    A family is a hash of 63 bits, or without ``exact`` of 31, as it is for a position further on;
    one further back is its complement. Positions without any are left out.
    """
    kind = "long" if exact else "int"
    width = max(STRETCH, 2 * reach)
    at = F.col("pos")
    homes = F.array_distinct(F.array(*[bucket_of(at + shift, width) for shift in (-reach, 0, reach)]))
    bits = F.lit((1 << 63) - 1 if exact else (1 << 31) - 1)
    spread = positions.filter(
        "chromosome IS NOT NULL AND pos IS NOT NULL AND family IS NOT NULL"
    ).select(
        "chromosome",
        "pos",
        "family",
        F.xxhash64("family").bitwiseAND(bits).cast(kind).alias("code"),
        F.explode(homes).alias("bucket"),
    )
    types = {f.name: f.dataType.simpleString() for f in spread.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in ("family", "chromosome", "pos"))
    ordered = spread.repartition(*_PLACES).sortWithinPartitions(*_PLACES, "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, list(_PLACES), None, _ROWS_PER_CALL):
            yield _surroundings(table, starts, reach, width)

    return ordered.mapInArrow(run, f"{schema}, near array<{kind}>")


def _groups(table: pa.Table, starts: np.ndarray) -> np.ndarray:
    group = np.zeros(table.num_rows, dtype=np.int64)
    group[starts[1:]] = 1
    return np.cumsum(group)


def _counted(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``n`` things of each row: the row and the number of every thing."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _surroundings(table: pa.Table, starts: np.ndarray, reach: int, width: int) -> pa.RecordBatch:
    code = table.column("code").to_numpy()
    place = table.column("pos").to_numpy().astype(np.int64)
    place = place - table.column("bucket").to_numpy() * width
    key = _groups(table, starts) * (width + 4 * reach) + place + 2 * reach
    first, last = np.searchsorted(key, key, "right"), np.searchsorted(key, key + reach, "right")
    back, here = np.searchsorted(key, key - reach, "left"), np.searchsorted(key, key, "left")
    size = last - first + here - back
    own = np.flatnonzero((place >= 0) & (place < width) & (size > 0))
    row, nth = _counted(size[own])
    further = (last - first)[own][row]
    ahead = nth < further
    at = np.where(ahead, first[own][row] + nth, back[own][row] + nth - further)
    near = np.where(ahead, code[at], ~code[at])
    ends = np.concatenate(([0], np.cumsum(size[own]))).astype(np.int32)
    kept = table.take(pa.array(own))
    names = ["family", "chromosome", "pos"]
    return pa.RecordBatch.from_arrays(
        [
            *[kept.column(c).combine_chunks() for c in names],
            pa.ListArray.from_arrays(pa.array(ends), pa.array(near)),
        ],
        names=[*names, "near"],
    )


def linked_anchors(near: DataFrame, orientations: tuple[str, ...], query=None) -> DataFrame:
    """Distinct anchors that have a neighbour in one of the orientations.

    ``near`` is what ``near_positions`` finds. Two anchors are neighbours when their chromosomes
    both have neighbours of the same two families, in the same order or, reversed, in the opposite.
    """
    counts = near.groupBy("family").agg(F.count(F.lit(1)).alias("positions"))
    return meeting_anchors(near, counts, orientations, query).distinct()


def meeting_anchors(
    near: DataFrame,
    counts: DataFrame,
    orientations: tuple[str, ...],
    query=None,
    per_cell: int | None = None,
) -> DataFrame:
    """Anchors of two positions of one family that share a family in ``near``, family by family.

    ``counts`` are the ``positions`` of each family. One of very many is laid out in cells, and
    every two cells meet in one block.
    """
    per_cell = POSITIONS_PER_CELL if per_cell is None else per_cell
    hot = counts.filter(F.col("positions") > per_cell).select(
        "family", F.ceil(F.col("positions") / per_cell).cast("int").alias("cells")
    )
    hot = materialise(hot, "hot-families", files=1)
    cells = F.coalesce("cells", F.lit(1))
    asked = F.lit(True) if query is None else F.col("chromosome") == query
    placed = near.join(hot, "family", "left").select(
        *near.columns,
        asked.alias("asked"),
        F.pmod(F.xxhash64("chromosome", "pos"), cells).cast("int").alias("cell"),
        F.explode(F.sequence(F.lit(0), cells - 1)).alias("other"),
    )
    placed = placed.select(
        "*", F.least("cell", "other").alias("lo"), F.greatest("cell", "other").alias("hi")
    ).drop("other")
    kind = next(f.dataType.simpleString() for f in near.schema.fields if f.name == "chromosome")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, BLOCK, None, _ROWS_PER_CALL):
            yield from _meet(table, starts, orientations)

    schema = f"ref_chr {kind}, rel_chr {kind}, ref_pos long, rel_pos long"
    return placed.repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(run, schema)


def _meet(
    table: pa.Table, starts: np.ndarray, orientations: tuple[str, ...]
) -> Iterator[pa.RecordBatch]:
    near = table.column("near").combine_chunks()
    row = np.repeat(np.arange(table.num_rows), lengths(near))
    code = near.flatten().to_numpy()
    before = code < 0
    code = np.where(before, ~code, code).astype(np.int64)
    if near.type.value_type == pa.int64():
        code = np.unique(code, return_inverse=True)[1]
    key = (_groups(table, starts)[row] << 31) + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    twice = key[1:] == key[:-1]
    several = np.append(False, twice) | np.append(twice, False)
    key, order = key[several], order[several]
    if not len(key):
        return
    row, before = row[order], before[order]
    chromosome = np.unique(
        table.column("chromosome").to_numpy(zero_copy_only=False), return_inverse=True
    )[1]
    lo, hi, cell = (table.column(c).to_numpy() for c in ("lo", "hi", "cell"))
    whole, second = lo == hi, cell == hi
    asked = table.column("asked").to_numpy(zero_copy_only=False)
    # every entry meets those after it that have its family and code
    others = np.searchsorted(key, key, "right") - 1 - np.arange(len(key))
    turn = np.cumsum(others) // _MEETINGS
    found, waiting = np.zeros(0, dtype=np.int64), []
    for some in np.split(np.arange(len(key)), np.flatnonzero(np.diff(turn)) + 1):
        entry, nth = _counted(others[some])
        one = some[entry]
        two = one + 1 + nth
        a, b = row[one], row[two]
        fits = (chromosome[a] != chromosome[b]) & (asked[a] | asked[b])
        fits &= whole[a] | (second[a] != second[b])
        if len(set(orientations)) == 1:
            fits &= (before[one] == before[two]) == (orientations[0] == "+")
        a, b = a[fits], b[fits]
        waiting.append(np.minimum(a, b) * table.num_rows + np.maximum(a, b))
        if sum(map(len, waiting)) > 4 * _MEETINGS:
            found, waiting = np.unique(np.concatenate([found, *waiting])), []
    found = np.unique(np.concatenate([found, *waiting]))
    places = table.select(["chromosome", "pos"]).combine_chunks()
    for begin in range(0, len(found), _MEETINGS):
        a, b = np.divmod(found[begin : begin + _MEETINGS], table.num_rows)
        ref, rel = np.concatenate([a, b]), np.concatenate([b, a])
        ref, rel = ref[asked[ref]], rel[asked[ref]]
        ref, rel = places.take(pa.array(ref)), places.take(pa.array(rel))
        columns = [t.column(c).combine_chunks() for c in ("chromosome", "pos") for t in (ref, rel)]
        columns[2:] = [c.cast(ARROW["long"]) for c in columns[2:]]
        yield pa.RecordBatch.from_arrays(
            columns, names=["ref_chr", "rel_chr", "ref_pos", "rel_pos"]
        )
