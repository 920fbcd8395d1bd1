"""Gap-bounded collinear chains, forward and reverse."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from pathweave.functions.checks import check_intermediate, check_matched
from pathweave.operators import chain_blocks
from pathweave.functions.groups import Step, map_groups
from pathweave.operators.anchors import (
    ANCHORS_PER_BLOCK,
    PAIR,
    lay_out,
    map_anchors,
    written_lists,
)
from pathweave.operators.chain_steps import chain_step, score_step
from pathweave.operators.passages import passages
from pathweave.operators.segments import (
    SEGMENT,
    anchor_segments,
    segment_sizes,
    sparse_anchors,
)
from pathweave.session import materialise

ORIENTATIONS = ("+", "-")
CHAIN_COLUMNS = {
    "orientation": "string",
    "ref_start": "long",
    "ref_end": "long",
    "rel_start": "long",
    "rel_end": "long",
}
SCORE_COLUMNS = {
    "ref_pos": "long",
    "rel_pos": "long",
    "score": "long",
    "ptr_ref": "long",
    "ptr_rel": "long",
}


def chains(
    positions: DataFrame,
    intermediate: int,
    matched: int,
    query=None,
    orientations: tuple[str, ...] = ORIENTATIONS,
    block_anchors: int = ANCHORS_PER_BLOCK,
) -> DataFrame:
    """Disjoint chains ``(ref_chr, rel_chr, orientation, ref_start, … rel_end)``.

    Consecutive anchors of a chain lie at most ``intermediate + 1`` apart on both
    chromosomes; a chain spans at least ``matched`` positions on both. Without gaps, forward and
    without a query they are found from where they begin and end, and no anchor is made.
    """
    reach = check_intermediate(intermediate) + 1
    matched = check_matched(matched)
    if reach == 1 and query is None and tuple(orientations) == ("+",):
        found = passages(positions, max(matched, 2))
        if found is not None:
            return found.select(*PAIR, F.lit("+").alias("orientation"), *list(CHAIN_COLUMNS)[1:])

    def in_blocks(anchors: DataFrame, width: int, top: int) -> DataFrame:
        blocks = chain_blocks.Blocks(width, top)
        return chain_blocks.chains(anchors, blocks, reach, matched, orientations)

    step = chain_step(reach, matched, orientations)
    return _over_anchors(
        positions, reach, matched, query, orientations, block_anchors, step, CHAIN_COLUMNS, in_blocks
    )


def chain_scores(
    positions: DataFrame,
    intermediate: int,
    query=None,
    orientation: str = "+",
    block_anchors: int = ANCHORS_PER_BLOCK,
) -> DataFrame:
    """Score and predecessor of every anchor that has a predecessor."""
    reach = check_intermediate(intermediate) + 1

    def in_blocks(anchors: DataFrame, width: int, top: int) -> DataFrame:
        blocks = chain_blocks.Blocks(width, top)
        return chain_blocks.scores(anchors, blocks, reach, orientation)

    step = score_step(reach, orientation == "-")
    return _over_anchors(
        positions, reach, 1, query, (orientation,), block_anchors, step, SCORE_COLUMNS, in_blocks
    ).filter("score > 0")


def _over_anchors(
    positions, reach, matched, query, orientations, limit, step: Step, columns, in_blocks
) -> DataFrame:
    """Applies a chaining step to all anchors that can lie in a chain.

    Sparse families: anchors without a neighbour are never made. Otherwise pairs of position lists
    travel, and pairs of chromosomes that are proved to fit into a task are not cut. All others are
    cut into segments, which are the groups then; only a segment that is too large goes in blocks.
    """
    lists = written_lists(positions, query)
    linked = sparse_anchors(lists, reach, orientations, query)
    if linked is not None:
        linked = materialise(linked, "linked")
        large = linked.groupBy(*PAIR).count().filter(F.col("count") > limit).select(*PAIR)
        large = materialise(large, "large-pairs")
        if not large.count():
            return map_groups(linked, PAIR, step, columns)
        small = linked.join(large, PAIR, "left_anti")
        found = map_groups(small, PAIR, step, columns)
        rest = linked.join(large, PAIR, "left_semi")
    else:
        layout = lay_out(positions, limit, query, lists)
        found = map_anchors(layout, query, step, columns)
        if not layout.has_giants:
            return found
        rest = layout.giant_anchors(query).distinct()
    return found.unionByName(_in_segments(rest, reach, matched, limit, step, columns, in_blocks))


def _in_segments(anchors, reach, matched, limit, step, columns, in_blocks) -> DataFrame:
    segments = materialise(anchor_segments(anchors, reach), "segments")
    sizes = segment_sizes(segments).filter(
        (F.col("anchors") > 1)
        & (F.col("ref_end") - F.col("ref_start") + 1 >= matched)
        & (F.col("rel_end") - F.col("rel_start") + 1 >= matched)
    )
    sizes = materialise(sizes.select(*SEGMENT, "anchors", "ref_end", "rel_end"), "segment-sizes")
    fitting = segments.join(sizes.filter(F.col("anchors") <= limit).select(*SEGMENT), SEGMENT)
    names = [*PAIR, *columns]
    found = map_groups(fitting, SEGMENT, step, columns).select(*names)
    over = sizes.filter(F.col("anchors") > limit)
    ref_top, rel_top = over.agg(F.max("ref_end"), F.max("rel_end")).first()
    if ref_top is None:
        return found
    rest = segments.join(over.select(*SEGMENT), SEGMENT).select(*PAIR, "ref_pos", "rel_pos")
    rest = materialise(rest, "oversize")
    thickest = rest.groupBy(*PAIR, "ref_pos").count().agg(F.max("count")).first()[0]
    # a block of this width holds at most about ``limit`` anchors
    width = max(math.isqrt(limit), limit // thickest, reach)
    return found.unionByName(in_blocks(rest, width, max(ref_top, rel_top)).select(*names))
