"""Anchors: positions of one family on a reference and on a relative chromosome."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from pathweave.functions.groups import Columns, Step, map_groups
from pathweave.functions.prefix import bucket_of
from pathweave.operators.bundles import bundles, map_bundles, map_pairs
from pathweave.session import materialise

# Positions of one family on one chromosome travel as lists; a list covers this many
# positions, so it stays short however often the family occurs.
POSITIONS_PER_LIST = 1 << 10
# Positions of a family that one task may lay out.
POSITIONS_PER_TASK = 1 << 16
# A family whose lists make more pairs than this is spread over several join keys.
PAIRS_PER_CELL = 1 << 18
# Most anchors one task call may have to hold for one chromosome pair.
ANCHORS_PER_BLOCK = 1 << 21

PAIR = ["ref_chr", "rel_chr"]


def family_positions(
    genes: DataFrame, null_family: str | None = "-1", distinct: bool = True
) -> DataFrame:
    """``(chromosome, pos, family)`` by stored gene number, null family left out.

    Without ``distinct`` rows may repeat, for operators that lay positions out as lists, which hold
    each once.
    """
    positions = genes.select("chromosome", F.col("number").alias("pos"), "family")
    if null_family is not None:
        positions = positions.filter(F.col("family") != null_family)
    return positions.distinct() if distinct else positions


def path_positions(paths: DataFrame) -> DataFrame:
    """``(chromosome, pos, family)`` by rank on the chromosome's path."""
    return paths.select("chromosome", "pos", "family")


def on_query(positions: DataFrame, query=None) -> DataFrame:
    """Positions of the query chromosome, or all of them without one."""
    return positions if query is None else positions.filter(F.col("chromosome") == query)


def query_families(positions: DataFrame, query=None) -> DataFrame:
    """Positions, on any chromosome, of the families the query chromosome carries."""
    families = on_query(positions, query).select("family").distinct()
    return positions.join(families, "family", "left_semi")


def shared_families(positions: DataFrame) -> DataFrame:
    """Positions of families that more than one chromosome carries."""
    carried = positions.groupBy("family").agg(
        F.min("chromosome").alias("first"),
        F.max("chromosome").alias("last"),
        F.count(F.lit(1)).alias("positions"),
    )
    shared = carried.filter("first <> last").select("family", "positions")
    shared = materialise(shared, "shared-families")
    names = shared.select("family")
    if (shared.agg(F.max("positions")).first()[0] or 0) <= POSITIONS_PER_TASK:
        # dealt once, for the join and for the lists
        return positions.repartition("family").join(names, "family", "left_semi")
    # dealt anew by the keys of the lists, so that a hot family is not one task's
    return positions.join(names, "family", "left_semi").repartition(
        "family", "chromosome", bucket_of(F.col("pos"), POSITIONS_PER_LIST)
    )


def _spread_families(ref: DataFrame, rel: DataFrame | None, pairs_per_cell: int) -> DataFrame:
    side = math.isqrt(pairs_per_cell)
    counts = ref.groupBy("family").agg(F.count(F.lit(1)).alias("refs"))
    if rel is None:
        counts = counts.withColumn("rels", F.col("refs"))
    else:
        counts = counts.join(
            rel.groupBy("family").agg(F.count(F.lit(1)).alias("rels")), "family"
        )
    pairs = F.col("refs").cast("double") * F.col("rels")
    return (
        counts.filter(pairs > pairs_per_cell)
        .select(
            "family",
            F.ceil(F.col("refs") / side).cast("int").alias("ref_cells"),
            F.ceil(F.col("rels") / side).cast("int").alias("rel_cells"),
        )
    )


def _cells(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), F.coalesce(count, F.lit(1)) - 1))


def _own_cell(count: Column) -> Column:
    return F.pmod(F.xxhash64("chromosome", "chunk"), F.coalesce(count, F.lit(1))).cast("int")


def position_lists(positions: DataFrame) -> DataFrame:
    """``(family, chromosome, chunk, positions)``, a list of distinct ones per stretch of a chromosome."""
    return positions.groupBy(
        "family",
        "chromosome",
        bucket_of(F.col("pos"), POSITIONS_PER_LIST).alias("chunk"),
    ).agg(F.collect_set("pos").alias("positions"))


def written_lists(positions: DataFrame, query=None) -> DataFrame:
    """The position lists, written once: sizing, both join sides and salting read them.

    With a query only families that it carries are laid out, without one only those that
    two chromosomes carry, as no other makes an anchor.
    """
    positions = materialise(positions, "positions")
    wanted = shared_families(positions) if query is None else query_families(positions, query)
    return materialise(position_lists(wanted), "lists")


def pair_lists(
    lists: DataFrame,
    query=None,
    pairs_per_cell: int = PAIRS_PER_CELL,
    giant_above: float | None = None,
) -> DataFrame:
    """``(ref_chr, rel_chr, ref_positions, rel_positions)`` of every shared family.

    A row stands for all pairs of its two lists, so what is shuffled grows with the
    positions and not with their pairs. The equi-join is on the family. Families
    with very many lists are laid out on a grid of cells first: each reference row
    goes to one grid row, each relative row to one grid column, so every two meet
    in exactly one cell. With ``giant_above``, rows say whether the product of
    their weights exceeds it.
    """
    ref = on_query(lists, query)
    # any number of families may be hot; adaptive execution picks the join by the table's size
    spread = materialise(
        _spread_families(ref, None if query is None else lists, pairs_per_cell), "spread"
    )
    weighed = giant_above is not None

    def side(rows: DataFrame, name: str, own: str, own_cells: str, other: str, other_cells: str):
        return rows.join(spread, "family", "left").select(
            "family",
            F.col("chromosome").alias(f"{name}_chr"),
            F.col("positions").alias(f"{name}_positions"),
            *([F.col("weight").alias(f"{name}_weight")] if weighed else []),
            _own_cell(F.col(own_cells)).alias(own),
            _cells(F.col(other_cells)).alias(other),
        )

    left = side(ref, "ref", "cell_row", "ref_cells", "cell_column", "rel_cells")
    right = side(lists, "rel", "cell_column", "rel_cells", "cell_row", "ref_cells")
    giant = F.col("ref_weight") * F.col("rel_weight") > giant_above if weighed else None
    return (
        left.join(right, ["family", "cell_row", "cell_column"])
        .filter(F.col("ref_chr") != F.col("rel_chr"))
        .select(
            *PAIR,
            "ref_positions",
            "rel_positions",
            *([giant.alias("giant")] if weighed else []),
        )
    )


def unfold(pairs: DataFrame) -> DataFrame:
    """``(ref_chr, rel_chr, ref_pos, rel_pos)``, one row per anchor and family."""
    return (
        pairs.select(*PAIR, F.explode("ref_positions").alias("ref_pos"), "rel_positions")
        .select(*PAIR, "ref_pos", F.explode("rel_positions").alias("rel_pos"))
        .select(*PAIR, F.col("ref_pos").cast("long"), F.col("rel_pos").cast("long"))
    )


def distinct_step(group, columns):
    """The distinct anchors of whole pairs."""
    ref, rel = columns["ref_pos"], columns["rel_pos"]
    order = np.lexsort((rel, ref, group))
    group, ref, rel = group[order], ref[order], rel[order]
    new = np.ones(len(group), dtype=bool)
    new[1:] = (np.diff(group) != 0) | (np.diff(ref) != 0) | (np.diff(rel) != 0)
    return {"group": group[new], "ref_pos": ref[new], "rel_pos": rel[new]}


def anchors(
    positions: DataFrame,
    query=None,
    block_anchors: int = ANCHORS_PER_BLOCK,
    together: bool = False,
) -> DataFrame | PairRows:
    """Distinct anchors; two genes may share a chromosome and a number.

    With ``together``, without a query, they are ``PairRows`` for what follows in the same task.
    """
    if query is not None:
        return unfold(pair_lists(written_lists(positions, query), query)).distinct()
    layout = lay_out(positions, block_anchors)
    giants = layout.giant_anchors().distinct() if layout.has_giants else None
    found = PairRows(layout, distinct_step, {"ref_pos": "long", "rel_pos": "long"}, giants)
    return found if together else found.rows()


def pair_totals(found: PairRows) -> DataFrame:
    """``anchors`` of each pair, and the sums of their positions and products."""
    names = ("anchors", "refs", "rels", "products")
    return found.then(_total_step, {c: "long" for c in names}, _totals).rows()


def _totals(found: DataFrame) -> DataFrame:
    found = found.withColumn("product", F.col("ref_pos").cast("long") * F.col("rel_pos"))
    return found.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("anchors"),
        F.sum("ref_pos").alias("refs"),
        F.sum("rel_pos").alias("rels"),
        F.sum("product").alias("products"),
    )


def _total_step(group, columns):
    first = np.flatnonzero(np.diff(group, prepend=-1))
    ref, rel = columns["ref_pos"], columns["rel_pos"]
    if len(first) and np.add.reduceat(np.abs(ref.astype(float) * rel), first).max() >= 1 << 62:
        raise OverflowError("a sum of products of positions does not fit into 64 bits")
    return {
        "group": group[first],
        "anchors": np.diff(np.append(first, len(group))),
        "refs": np.add.reduceat(ref, first) if len(first) else ref,
        "rels": np.add.reduceat(rel, first) if len(first) else rel,
        "products": np.add.reduceat(ref * rel, first) if len(first) else ref,
    }


def relatives(positions: DataFrame, query=None) -> DataFrame:
    """``(ref_chr, rel_chr)`` of chromosomes that share a family with the reference."""
    if query is not None:
        return (
            query_families(positions, query)
            .select(F.lit(query).alias("ref_chr"), F.col("chromosome").alias("rel_chr"))
            .filter(F.col("rel_chr") != F.col("ref_chr"))
            .distinct()
        )
    carriers = positions.groupBy("family", "chromosome").agg(
        F.lit(0).alias("chunk"), F.array(F.lit(0)).alias("positions")
    )
    carriers = materialise(carriers, "carriers")
    # every pair is whole within one call, so nothing is left to make distinct
    return map_bundles(bundles(carriers, ANCHORS_PER_BLOCK, packed=True), _size_step(0), {})


def _size_step(limit: int):
    """Pairs of more than ``limit`` anchors."""

    def step(group, columns):
        return {"group": np.flatnonzero(np.bincount(group) > limit)}

    return step


@dataclass(frozen=True)
class Layout:
    """Which chromosome pairs are proved to fit into one task call.

    ``lists`` has a ``weight`` where some pairs may be giant: a pair may be when the
    product of its two weights exceeds ``limit`` squared.
    """

    lists: DataFrame
    limit: int

    @property
    def has_giants(self) -> bool:
        return "weight" in self.lists.columns

    def ordinary_pairs(self, query=None) -> DataFrame:
        pairs = pair_lists(self.lists, query, giant_above=self._giant_above())
        return pairs.filter("NOT giant").drop("giant") if self.has_giants else pairs

    def giant_pairs(self, query=None) -> DataFrame:
        """Without a query only the pairs that really exceed the limit."""
        if query is None:
            pairs = pair_lists(self._heavy.join(self._in_giants, "chromosome", "left_semi"))
            return pairs.join(self.giants, PAIR, "left_semi")
        pairs = pair_lists(self.lists, query, giant_above=self._giant_above())
        return pairs.filter("giant").drop("giant")

    @property
    def _heavy(self) -> DataFrame:
        return self.lists.filter("weight > 0").drop("weight")

    @cached_property
    def giants(self) -> DataFrame:
        """``(ref_chr, rel_chr)`` of all pairs with more anchors than the limit, counted."""
        # only how many positions there are is asked for
        none = F.array_repeat(F.lit(0), F.size("positions"))
        per_home = max(self.limit, ANCHORS_PER_BLOCK)
        bundled = bundles(self._heavy.withColumn("positions", none), per_home, packed=True)
        return materialise(map_bundles(bundled, _size_step(self.limit), {}), "giants")

    @property
    def _in_giants(self) -> DataFrame:
        return self.giants.select(F.col("ref_chr").alias("chromosome")).distinct()

    def giant_anchors(self, query=None) -> DataFrame:
        return unfold(self.giant_pairs(query))

    def _giant_above(self) -> float | None:
        return float(self.limit) ** 2 if self.has_giants else None


def lay_out(
    positions: DataFrame,
    limit: int = ANCHORS_PER_BLOCK,
    query=None,
    lists: DataFrame | None = None,
) -> Layout:
    """Writes the position lists and finds the pairs that may exceed ``limit`` anchors.

    By Cauchy-Schwarz, the square of a pair's anchors is at most the product of the
    sums of squared family copies of its two chromosomes. Each pair is judged by its
    own two sums, and only chromosomes that can be part of a giant pair get theirs.
    """
    if lists is None:
        lists = written_lists(positions, query)
    # without a second stretch of a chromosome each list has all copies of its family there
    one, other = lists.agg(F.min("chunk"), F.max("chunk")).first()
    copies = lists.select("chromosome", F.size("positions").alias("copies"))
    if one != other:
        by_family = lists.groupBy("chromosome", "family")
        copies = by_family.agg(F.sum(F.size("positions")).alias("copies"))
    squares = (
        copies.groupBy("chromosome")
        .agg(F.sum(F.col("copies").cast("double") * F.col("copies")).alias("weight"))
    )
    squares = materialise(squares, "squares")
    largest = _two_largest(on_query(squares, query))
    others = _two_largest(squares if query is None else squares.filter(F.col("chromosome") != query))
    if query is None:
        others = others[1:]
    if not largest or not others or largest[0] * others[0] <= float(limit) ** 2:
        return Layout(lists, limit)
    bar = max(largest[0], others[0])
    heavy = squares.filter(F.col("weight") * bar > float(limit) ** 2).select("chromosome", "weight")
    weighed = lists.join(heavy, "chromosome", "left").withColumn(
        "weight", F.coalesce("weight", F.lit(0.0))
    )
    return Layout(weighed, limit)


def _two_largest(squares: DataFrame) -> list[float]:
    return [r.weight for r in squares.orderBy(F.desc("weight")).limit(2).collect()]


@dataclass(frozen=True)
class PairRows:
    """Rows of chromosome pairs that are made once they are read, in the task that has the pair.

    What follows on whole pairs is done there too, so rows in between are neither written nor
    shuffled. ``giants`` are the rows of pairs too large for a task, where there are any.
    """

    layout: Layout
    step: Step
    columns: dict[str, str]
    giants: DataFrame | None
    query: object = None

    def then(
        self,
        step: Step,
        columns: dict[str, str],
        of_giants: Callable[[DataFrame], DataFrame],
    ) -> PairRows:
        """A step on the rows of whole pairs, and the same for a table of giant pairs."""
        first = self.step

        def both(group: np.ndarray, given: Columns) -> Columns:
            found = dict(first(group, given))
            return step(found.pop("group"), found)

        giants = None if self.giants is None else of_giants(self.giants)
        return PairRows(self.layout, both, columns, giants, self.query)

    def rows(self) -> DataFrame:
        found = map_anchors(self.layout, self.query, self.step, self.columns)
        if self.giants is None:
            return found
        return found.unionByName(self.giants.select(*PAIR, *self.columns))


def map_anchors(layout: Layout, query, step: Step, columns: dict[str, str]) -> DataFrame:
    """Applies a step to the anchors of all pairs that fit into one call."""
    if query is None:
        lists = layout.lists.drop("weight")
        at_most = layout.limit if layout.has_giants else None
        return map_pairs(lists, max(layout.limit, ANCHORS_PER_BLOCK), step, columns, at_most)
    return map_groups(
        layout.ordinary_pairs(query),
        PAIR,
        step,
        columns,
        lists=("ref_positions", "rel_positions"),
        pairs=("ref_pos", "rel_pos"),
    )
