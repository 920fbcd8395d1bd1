"""Chaining of chromosome pairs too large for one task.

A pair is laid out on a grid of blocks. A block needs only the scored anchors
within reach of its edges, from three earlier neighbours, so all blocks on one
anti-diagonal run together and the anti-diagonals follow one another. Claims on
chains then travel back the same way. Results equal those of whole pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from pathweave.functions.groups import map_groups
from pathweave.operators.anchors import PAIR
from pathweave.operators.chain_steps import NONE, Box, end_order, score_step
from pathweave.operators.waves import WaveTable, split_by_wave, used_waves

BLOCK = [*PAIR, "block_ref", "block_rel"]
SCORED = {
    "ref_pos": "long",
    "rel_pos": "long",
    "score": "long",
    "ptr_ref": "long",
    "ptr_rel": "long",
}
CLAIM = ["end_score", "end_ptr_ref", "end_ptr_rel", "end_ref", "end_rel"]
OWNED = {
    "ref_pos": "long",
    "rel_pos": "long",
    "ptr_ref": "long",
    "ptr_rel": "long",
    **{c: "long" for c in CLAIM},
}


@dataclass(frozen=True)
class Blocks:
    """Grid of ``width`` by ``width`` positions; no position exceeds ``top``."""

    width: int
    top: int


def _along(ref: Column, blocks: Blocks, reverse: bool) -> Column:
    """Reference axis in the direction chains rise."""
    return F.lit(blocks.top) - ref if reverse else ref


def _block(axis: Column, width: int) -> Column:
    return F.floor(axis / width).cast("long")


def _placed(rows: DataFrame, ref: str, rel: str, blocks: Blocks, reverse: bool) -> DataFrame:
    along = _along(F.col(ref), blocks, reverse)
    return rows.select(
        "*",
        _block(along, blocks.width).alias("block_ref"),
        _block(F.col(rel), blocks.width).alias("block_rel"),
    ).withColumn("wave", F.col("block_ref") + F.col("block_rel"))


def _edge_rows(scored: DataFrame, blocks: Blocks, reach: int, reverse: bool) -> DataFrame:
    """Scored anchors near an edge, once for each later neighbour they can reach."""
    width = blocks.width
    near_ref = _along(F.col("ref_pos"), blocks, reverse) % width >= width - reach
    near_rel = F.col("rel_pos") % width >= width - reach

    def neighbour(test: Column, d_ref: int, d_rel: int) -> Column:
        target = F.struct(
            (F.col("block_ref") + d_ref).alias("r"), (F.col("block_rel") + d_rel).alias("l")
        )
        return F.when(test, target)

    targets = F.array_compact(
        F.array(
            neighbour(near_ref, 1, 0),
            neighbour(near_rel, 0, 1),
            neighbour(near_ref & near_rel, 1, 1),
        )
    )
    return scored.select(
        *PAIR, "ref_pos", "rel_pos", "score", F.explode(targets).alias("target")
    ).select(
        *PAIR,
        F.col("target.r").alias("block_ref"),
        F.col("target.l").alias("block_rel"),
        "ref_pos",
        "rel_pos",
        "score",
    )


def _score_waves(
    anchors: DataFrame, waves: list[int], blocks: Blocks, reach: int, reverse: bool
) -> WaveTable:
    scored = WaveTable(anchors.sparkSession, "chain-scored")
    edges = WaveTable(anchors.sparkSession, "chain-edges")
    for wave in waves:
        own = anchors.filter(F.col("wave") == wave).select(
            *BLOCK, "ref_pos", "rel_pos", F.lit(NONE).cast("long").alias("score")
        )
        earlier = edges.read(wave - 1, wave - 2)
        if earlier is not None:
            here = earlier.filter(F.col("block_ref") + F.col("block_rel") == wave)
            # Blocks without anchors of their own yield nothing.
            own = own.unionByName(here)
        scored.write(wave, map_groups(own, BLOCK, score_step(reach, reverse), SCORED))
        edges.write(wave, _edge_rows(scored.read(wave), blocks, reach, reverse))
    return scored


def _finder(box: Box):
    """Looks anchors up by group and positions; ``NONE`` where there is none."""
    refs, rels = np.unique(box.ref), np.unique(box.rel)

    def key(group, ref, rel):
        at_ref = np.minimum(np.searchsorted(refs, ref), len(refs) - 1)
        at_rel = np.minimum(np.searchsorted(rels, rel), len(rels) - 1)
        known = (refs[at_ref] == ref) & (rels[at_rel] == rel)
        return (group * len(refs) + at_ref) * len(rels) + at_rel, known

    own, _ = key(box.group, box.ref, box.rel)
    order = np.argsort(own)
    own = own[order]

    def find(group, ref, rel):
        wanted, known = key(group, ref, rel)
        at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
        return np.where(known & (own[at] == wanted), order[at], NONE)

    return find


def _claim_step(reach: int):
    """Scored anchors and claims from later blocks to anchors with their best claim.

    A claim row names an anchor of the block and the end that wants it.
    """

    def step(group, columns):
        claimed = columns["end_score"] != NONE
        own = np.flatnonzero(~claimed)
        if not len(own):
            none = np.array([], dtype=np.int64)
            return {"group": none, **{c: none for c in OWNED}}
        message = np.flatnonzero(claimed)
        box = Box(group[own], columns["ref_pos"][own], columns["rel_pos"][own], reach)
        rows = own[box.order]
        score, ptr_ref, ptr_rel = (columns[c][rows] for c in ("score", "ptr_ref", "ptr_rel"))
        find = _finder(box)
        pointer = np.full(len(rows), NONE, dtype=np.int64)
        ends = np.flatnonzero(score > 0)
        pointer[ends] = find(box.group[ends], ptr_ref[ends], ptr_rel[ends])
        targets = find(
            group[message], columns["ref_pos"][message], columns["rel_pos"][message]
        )
        claims = {
            "end_score": score[ends],
            "end_ptr_ref": ptr_ref[ends],
            "end_ptr_rel": ptr_rel[ends],
            "end_ref": box.ref[ends],
            "end_rel": box.rel[ends],
        }
        claims = {c: np.concatenate([v, columns[c][message]]) for c, v in claims.items()}
        order = end_order(*(claims[c] for c in CLAIM))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        owner = np.full(len(rows), len(order), dtype=np.int64)
        owner[ends] = rank[: len(ends)]
        np.minimum.at(owner, targets, rank[len(ends) :])
        box.pull_owners(owner, pointer)
        taken = np.flatnonzero(owner < len(order))
        best = order[owner[taken]]
        outside = (pointer[taken] == NONE) & (score[taken] > 0)
        return {
            "group": box.group[taken],
            "ref_pos": box.ref[taken],
            "rel_pos": box.rel[taken],
            # Kept only where the predecessor lies in an earlier block.
            "ptr_ref": np.where(outside, ptr_ref[taken], NONE),
            "ptr_rel": np.where(outside, ptr_rel[taken], NONE),
            **{c: v[best] for c, v in claims.items()},
        }

    return step


def _own_waves(scored: WaveTable, blocks: Blocks, reach: int, reverse: bool) -> DataFrame:
    spark = scored.spark
    owned = WaveTable(spark, "chain-owned")
    claims = WaveTable(spark, "chain-claims")
    no_claim = [F.lit(NONE).cast("long").alias(c) for c in CLAIM]
    for wave in sorted(scored.waves, reverse=True):
        own = scored.read(wave).select(*BLOCK, *SCORED, *no_claim)
        later = claims.read(wave + 1, wave + 2)
        if later is not None:
            nothing = [F.lit(NONE).cast("long").alias(c) for c in ("score", "ptr_ref", "ptr_rel")]
            here = later.filter(F.col("wave") == wave)
            own = own.unionByName(here.select(*BLOCK, "ref_pos", "rel_pos", *nothing, *CLAIM))
        owned.write(wave, map_groups(own, BLOCK, _claim_step(reach), OWNED))
        leaving = (
            owned.read(wave)
            .filter(F.col("ptr_rel") != NONE)
            .select(
                *PAIR,
                F.col("ptr_ref").alias("ref_pos"),
                F.col("ptr_rel").alias("rel_pos"),
                *CLAIM,
            )
        )
        claims.write(wave, _placed(leaving, "ref_pos", "rel_pos", blocks, reverse))
    return owned.read_all()


def _laid_out(pairs: DataFrame, blocks: Blocks, reverse: bool) -> tuple[DataFrame, list[int]]:
    placed = _placed(pairs.distinct(), "ref_pos", "rel_pos", blocks, reverse)
    laid_out = split_by_wave(placed, "chain-anchors")
    return laid_out, used_waves(laid_out)


def scores(pairs: DataFrame, blocks: Blocks, reach: int, orientation: str) -> DataFrame:
    reverse = orientation == "-"
    laid_out, waves = _laid_out(pairs, blocks, reverse)
    if not waves:
        return map_groups(pairs, PAIR, score_step(reach, reverse), SCORED)
    return _score_waves(laid_out, waves, blocks, reach, reverse).read_all()


def chains(
    pairs: DataFrame,
    blocks: Blocks,
    reach: int,
    matched: int,
    orientations: tuple[str, ...],
) -> DataFrame:
    parts = []
    for orientation in orientations:
        reverse = orientation == "-"
        laid_out, waves = _laid_out(pairs, blocks, reverse)
        if waves:
            scored = _score_waves(laid_out, waves, blocks, reach, reverse)
            owned = _own_waves(scored, blocks, reach, reverse)
        else:
            owned = laid_out.select(
                "*", F.col("ref_pos").alias("end_ref"), F.col("rel_pos").alias("end_rel")
            )
        parts.append(
            owned.groupBy(*PAIR, "end_ref", "end_rel")
            .agg(
                F.min("ref_pos").alias("ref_start"),
                F.max("ref_pos").alias("ref_end"),
                F.min("rel_pos").alias("rel_start"),
                F.max("rel_pos").alias("rel_end"),
            )
            .filter(F.col("ref_end") - F.col("ref_start") + 1 >= matched)
            .filter(F.col("rel_end") - F.col("rel_start") + 1 >= matched)
            .select(
                *PAIR,
                F.lit(orientation).alias("orientation"),
                "ref_start",
                "ref_end",
                "rel_start",
                "rel_end",
            )
        )
    return reduce(DataFrame.unionByName, parts)
