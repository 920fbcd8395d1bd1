"""Cuts between anchors that no chain crosses, and whether neighbours are looked for first.

Both are plain joins and windows, so one chromosome pair spreads over many tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pathweave.functions.axes import segments as cut
from pathweave.functions.prefix import stretches
from pathweave.operators.anchors import (
    ANCHORS_PER_BLOCK,
    PAIR,
    distinct_step,
    lay_out,
    map_anchors,
    on_query,
)
from pathweave.operators.neighbours import linked_anchors, meeting_anchors, near_positions
from pathweave.session import materialise

SEGMENT = [*PAIR, "rel_piece", "ref_piece"]
# Neighbours are looked for first where pairs of lists outnumber their codes by this factor,
WORTH_TRYING = 1
# and where an anchor meets fewer than this many by chance.
LINKED_BY_CHANCE = 0.5


def anchor_segments(anchors: DataFrame, reach: int, keys: list[str] = PAIR) -> DataFrame:
    """``anchors`` with ``rel_piece`` and ``ref_piece``: where their segment begins.

    First the relative axis of a pair is cut at gaps longer than ``reach``, then the reference axis
    of each piece. Anchors of a chain are at most ``reach`` apart on both, so none crosses a cut.
    """
    pieces = stretches(anchors, keys, "rel_pos", reach, "rel_piece")
    return stretches(pieces, [*keys, "rel_piece"], "ref_pos", reach, "ref_piece")


def segment_sizes(segments: DataFrame) -> DataFrame:
    """``anchors`` and the ends on both axes of each segment."""
    return segments.groupBy(*SEGMENT).agg(
        F.count(F.lit(1)).alias("anchors"),
        F.min("ref_pos").alias("ref_start"),
        F.max("ref_pos").alias("ref_end"),
        F.min("rel_pos").alias("rel_start"),
        F.max("rel_pos").alias("rel_end"),
    )


def sizes_of_segments(
    positions: DataFrame, reach: int, block_anchors: int = ANCHORS_PER_BLOCK
) -> DataFrame:
    """``segment_sizes`` of all anchors; pairs that fit into a call are cut there."""
    layout = lay_out(positions, block_anchors)
    ends = ("anchors", "ref_start", "ref_end", "rel_start", "rel_end")
    columns = {c: "long" for c in (*SEGMENT[2:], *ends)}
    found = map_anchors(layout, None, _size_step(reach), columns)
    if not layout.has_giants:
        return found
    giants = anchor_segments(layout.giant_anchors().distinct(), reach)
    return found.unionByName(segment_sizes(giants))


def _size_step(reach: int):
    def step(group, columns):
        anchors = distinct_step(group, columns)
        group, ref, rel = anchors["group"], anchors["ref_pos"], anchors["rel_pos"]
        piece = cut(group, rel, reach)
        segment = cut(piece, ref, reach)
        order = np.argsort(segment, kind="stable")
        first = np.flatnonzero(np.diff(segment[order], prepend=-1))
        piece_start = np.full(int(piece.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(piece_start, piece, rel)
        ref, rel = ref[order], rel[order]
        low = np.minimum.reduceat(ref, first)
        return {
            "group": group[order][first],
            "rel_piece": piece_start[piece[order][first]],
            "ref_piece": low,
            "anchors": np.diff(np.append(first, len(order))),
            "ref_start": low,
            "ref_end": np.maximum.reduceat(ref, first),
            "rel_start": np.minimum.reduceat(rel, first),
            "rel_end": np.maximum.reduceat(rel, first),
        }

    return step


def sparse_anchors(
    lists: DataFrame, reach: int, orientations: tuple[str, ...], query=None
) -> DataFrame | None:
    """Anchors with a neighbour, where finding those first moves fewer rows than all anchors.

    A few others may be among them, and an anchor may come twice. ``None`` where pairs of lists are
    few, or so few families make the positions that most anchors have a neighbour by chance.
    """
    counts = lists.groupBy("family").agg(
        F.count(F.lit(1)).alias("lists"), F.sum(F.size("positions")).alias("positions")
    )
    counts = materialise(counts, "family-counts")
    sizes = counts
    if query is None:
        sizes = sizes.withColumn("refs", F.col("lists"))
    else:
        own = on_query(lists, query).groupBy("family").agg(F.count(F.lit(1)).alias("refs"))
        sizes = sizes.join(own, "family")
    rows, positions, squares = sizes.agg(
        F.sum(F.col("refs").cast("double") * F.col("lists")),
        F.sum("positions"),
        F.sum(F.col("positions").cast("double") * F.col("positions")),
    ).first()
    if rows is None or rows <= WORTH_TRYING * positions * reach:
        return None
    by_chance = squares / positions**2 * 2 * reach**2 * len(orientations)
    if by_chance > LINKED_BY_CHANCE:
        return None
    flat = lists.select("chromosome", F.explode("positions").alias("pos"), "family")
    return meeting_anchors(
        near_positions(flat, reach, exact=False), counts, orientations, query
    )
