"""Anchors of all pairs, shuffled as bundles of one chromosome's positions and their partners.

A pair of chromosomes is at home with the smaller of its two. A bundle holds positions of one family
on a home chromosome and that family's positions on larger ones, so what is shuffled grows with
positions and half their partners in short arrays, not with a row for each pair of lists. The step
sees every pair in both directions, and a pair is whole within one call. On their way the arrays are
packed: chromosomes as steps from one to the next, and no number takes more bytes than it needs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pathweave.functions.groups import (
    ARROW,
    TARGET,
    Columns,
    Step,
    changes,
    lengths,
    portions,
    weights,
    whole_groups,
)
from pathweave.functions.numbers import from_short_bytes, short_bytes
from pathweave.session import materialise

# A family with more lists than this on all chromosomes is spread over several groups.
LISTS_PER_CELL = 1 << 9
# Partners in one row; a longer bundle is several rows.
PARTNERS_PER_ROW = 1 << 10
# Rows of lists that are bundled together, and partners that leave in one batch.
_LISTS_PER_CALL = 1 << 15
_PARTNERS_PER_BATCH = 1 << 20

# Partners of two blocks of chromosomes that meet in a task, and how many times fewer positions
# than partners must travel so that blocks are worth while.
PARTNERS_PER_MEETING = 1 << 21
WORTH_BLOCKS = 4
# Blocks at the least, so that the tasks are many.
LEAST_BLOCKS = 8

BLOCK = ["family", "lo", "hi"]
HOME = ["home", "part"]
LISTS = ["positions", "partners", "partner_positions"]


def _short_types(lists: DataFrame) -> tuple[str, str]:
    """Types of chromosomes and positions, 32 bits wide where all values fit."""
    types = {f.name: f.dataType.simpleString() for f in lists.schema.fields}
    chromosome = types["chromosome"]
    position = types["positions"].removeprefix("array<").removesuffix(">")
    numbers = chromosome in ("bigint", "int")
    low, high, first, last = lists.agg(
        *[f("chromosome") if numbers else F.lit(None) for f in (F.min, F.max)],
        F.min(F.array_min("positions")),
        F.max(F.array_max("positions")),
    ).first()
    half = 1 << 31
    if numbers and low is not None and -half <= low and high < half:
        chromosome = "int"
    if first is not None and -half <= first and last < half:
        position = "int"
    return chromosome, position


def _marked(placed: DataFrame) -> DataFrame:
    """With ``mark``, by which partners are dealt to parts; found after the shuffle, not shuffled."""
    return placed.withColumn("mark", F.pmod(F.hash("chromosome"), F.lit(1 << 30)))


def _known(lists: DataFrame) -> DataFrame:
    return lists.filter("family IS NOT NULL AND chromosome IS NOT NULL")


def _family_sizes(lists: DataFrame) -> DataFrame:
    families = lists.groupBy("family").agg(
        F.count(F.lit(1)).alias("lists"),
        F.sum(F.size("positions")).cast("double").alias("total"),
    )
    return materialise(families, "families")


def _home_parts(lists: DataFrame, families: DataFrame, per_home: int) -> DataFrame:
    parts = (
        lists.select("family", "chromosome", F.size("positions").alias("copies"))
        .join(families.select("family", "total"), "family")
        .groupBy("chromosome")
        .agg(F.sum(F.col("copies") * F.col("total")).alias("anchors"))
        .filter(F.col("anchors") > per_home)
        .select("chromosome", F.ceil(F.col("anchors") / per_home).cast("int").alias("parts"))
    )
    return materialise(parts, "parts")


def map_pairs(
    lists: DataFrame,
    per_home: int,
    step: Step,
    columns: dict[str, str],
    at_most: int | None = None,
) -> DataFrame:
    """Applies a step to the anchors of all pairs, shuffled as bundles or, where those are many, in blocks.

    Few families on many chromosomes make bundles that grow with the square of the chromosomes. There
    chromosomes are dealt to blocks, and every two blocks meet once in a task, so what is shuffled is
    the positions times the number of blocks, and bundles are made inside the task.
    """
    lists = _known(lists)
    families = _family_sizes(lists)
    partners, positions = families.agg(
        F.sum(F.col("lists") * F.col("total") / 2), F.sum("total")
    ).first()
    count = math.ceil(math.sqrt(2 * (partners or 0) / PARTNERS_PER_MEETING))
    worth = max(count, LEAST_BLOCKS)
    if count < 2 or WORTH_BLOCKS * worth * positions > partners:
        bundled = bundles(lists, per_home, packed=True, families=families)
        return map_bundles(bundled, step, columns, at_most)
    count = worth
    return _map_blocks(lists, families, count, per_home, step, columns, at_most)


def _map_blocks(lists, families, count: int, per_home: int, step: Step, columns, at_most) -> DataFrame:
    chromosome, position = _short_types(lists)
    kind = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[chromosome]
    home = next(f.dataType.simpleString() for f in lists.schema.fields if f.name == "chromosome")
    other = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    placed = (
        lists.join(_home_parts(lists, families, per_home), "chromosome", "left")
        .select(
            "family",
            "chromosome",
            F.col("positions").cast(f"array<{position}>").alias("positions"),
            F.coalesce("parts", F.lit(1)).alias("parts"),
            F.pmod(F.xxhash64("chromosome"), F.lit(count)).cast("int").alias("cell"),
            other.alias("other"),
        )
        .select(
            "*", F.least("cell", "other").alias("lo"), F.greatest("cell", "other").alias("hi")
        )
        .drop("other")
    )
    meeting = ["lo", "hi"]
    pairs = count * (count + 1) // 2
    # by range, so that every task gets about as many meetings
    ordered = placed.repartitionByRange(pairs, *meeting).sortWithinPartitions(*meeting, "family")
    ordered = _marked(ordered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, firsts in whole_groups(batches, meeting, None, 1):
            for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), whole.num_rows]):
                table = whole.slice(a, b - a)
                found = list(_bundle(table, changes(table, ["family"]), kind))
                if found:
                    bundled = pa.Table.from_batches(found).sort_by([(c, "ascending") for c in HOME])
                    yield from _steps(bundled.combine_chunks().to_batches(), step, kinds, at_most, TARGET)

    kinds = {c: ARROW[t] for c, t in columns.items()}
    return ordered.mapInArrow(run, _pair_schema(home, columns))


def _pair_schema(home: str, columns: dict[str, str]) -> str:
    return ", ".join(
        [f"ref_chr {home}", f"rel_chr {home}"] + [f"`{c}` {t}" for c, t in columns.items()]
    )


def bundles(
    lists: DataFrame,
    per_home: int,
    lists_per_cell: int = LISTS_PER_CELL,
    packed: bool = False,
    families: DataFrame | None = None,
) -> DataFrame:
    """``(home, part, positions, partners, partner_positions)`` of position lists.

    A home chromosome of more than about ``per_home`` anchors has several parts, by partner. A family
    with very many lists is laid out in cells, and every two cells meet in one block. With ``packed``
    the arrays are bytes, which ``map_bundles`` reads as well.
    """
    lists = _known(lists)
    chromosome, position = _short_types(lists)
    families = _family_sizes(lists) if families is None else families
    parts = _home_parts(lists, families, per_home)
    hot = families.filter(F.col("lists") > lists_per_cell).select(
        "family", F.ceil(F.col("lists") / lists_per_cell).cast("int").alias("cells")
    )
    cells = F.coalesce("cells", F.lit(1))
    placed = (
        lists.join(hot, "family", "left")
        .join(parts, "chromosome", "left")
        .select(
            "family",
            "chromosome",
            F.col("positions").cast(f"array<{position}>").alias("positions"),
            F.coalesce("parts", F.lit(1)).alias("parts"),
            F.pmod(F.xxhash64("chromosome", "chunk"), cells).cast("int").alias("cell"),
            F.explode(F.sequence(F.lit(0), cells - 1)).alias("other"),
        )
        .select(
            "*", F.least("cell", "other").alias("lo"), F.greatest("cell", "other").alias("hi")
        )
        .drop("other")
    )
    kind = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[chromosome]
    home = next(f.dataType.simpleString() for f in lists.schema.fields if f.name == "chromosome")
    if packed:
        names = ", partners array<string>" if chromosome == "string" else ""
        schema = f"home {home}, part int, numbers binary{names}"
    else:
        schema = (
            f"home {home}, part int, positions array<{position}>, "
            f"partners array<{chromosome}>, partner_positions array<{position}>"
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, BLOCK, None, _LISTS_PER_CALL):
            found = _bundle(table, starts, kind)
            yield from map(_pack, found) if packed else found

    ordered = placed.repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    return _marked(ordered).mapInArrow(run, schema)


def _pack(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Bundles with their numbers as bytes: the count of positions, these, partners, and theirs."""
    lists = [rows.column(c) for c in LISTS]
    n_own, n_met = lengths(lists[0]), lengths(lists[1])
    named = pa.types.is_string(lists[1].type.value_type)
    total = 1 + n_own + (1 if named else 2) * n_met
    begin = np.cumsum(total) - total
    numbers = np.empty(int(total.sum()), dtype=np.uint64)
    numbers[begin] = n_own
    own, met = (lists[i].flatten().to_numpy().astype(np.int64) for i in (0, 2))
    _put(numbers, begin + 1, n_own, _unsigned(own))
    if not named:
        # partners rise within a row, from the home on
        partners = lists[1].flatten().to_numpy().astype(np.int64).view(np.uint64)
        before = np.append(np.zeros(1, np.uint64), partners[:-1])
        firsts = np.cumsum(n_met) - n_met
        before[firsts] = rows.column("home").to_numpy().astype(np.int64).view(np.uint64)
        _put(numbers, begin + 1 + n_own, n_met, partners - before)
    _put(numbers, begin + total - n_met, n_met, _unsigned(met))
    data, size = short_bytes(numbers)
    ends = np.append(0, np.cumsum(np.add.reduceat(size, begin))).astype(np.int32)
    packed = pa.Array.from_buffers(
        pa.binary(), rows.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(data)]
    )
    arrays = [rows.column("home"), rows.column("part"), packed, *([lists[1]] if named else [])]
    return pa.RecordBatch.from_arrays(
        arrays, names=[*HOME, "numbers", *(["partners"] if named else [])]
    )


def _unpack(rows: pa.RecordBatch) -> pa.RecordBatch:
    """What ``_pack`` was given, with 64-bit numbers."""
    if not rows.num_rows:
        return rows
    column = rows.column("numbers")
    buffers = column.buffers()
    ends = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + rows.num_rows + 1]
    data = np.frombuffer(buffers[2], np.uint8)[ends[0] : ends[-1]]
    numbers, total = from_short_bytes(data, ends - ends[0])
    begin = np.cumsum(total) - total
    n_own = numbers[begin].astype(np.int64)
    named = "partners" in rows.schema.names
    n_met = total - 1 - n_own
    n_met = n_met if named else n_met // 2
    own = _signed(_get(numbers, begin + 1, n_own))
    met = _signed(_get(numbers, begin + total - n_met, n_met))
    if named:
        partners = rows.column("partners")
    else:
        # a sum over all rows, less what is before a row; unsigned numbers wrap both ways
        summed = np.cumsum(_get(numbers, begin + 1 + n_own, n_met), dtype=np.uint64)
        firsts = np.cumsum(n_met) - n_met
        past = np.append(np.zeros(1, np.uint64), summed)[firsts]
        home = rows.column("home").to_numpy().astype(np.int64).view(np.uint64)
        partners = _lists((summed + np.repeat(home - past, n_met)).view(np.int64), n_met)
    lists = [_lists(own, n_own), partners, _lists(met, n_met)]
    return pa.RecordBatch.from_arrays(
        [rows.column("home"), rows.column("part"), *lists], names=[*HOME, *LISTS]
    )


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _places(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)


def _put(numbers: np.ndarray, begin: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> None:
    numbers[_places(begin, sizes)] = values


def _get(numbers: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return numbers[_places(begin, sizes)]


def _unsigned(values: np.ndarray) -> np.ndarray:
    """Small numbers of either sign as small ones without."""
    return ((values << 1) ^ (values >> 63)).view(np.uint64)


def _signed(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(1)).view(np.int64) ^ -(values & np.uint64(1)).view(np.int64)


def _bundle(table: pa.Table, starts: np.ndarray, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    group = np.zeros(table.num_rows, dtype=np.int64)
    group[starts[1:]] = 1
    group = np.cumsum(group)
    cell, lo, hi = (table.column(c).to_numpy() for c in ("cell", "lo", "hi"))
    values, code = np.unique(
        table.column("chromosome").to_numpy(zero_copy_only=False), return_inverse=True
    )
    count = len(values)
    # a list meets those of the other cell of its block, or of its only one
    own = group * 2 + (cell == hi)
    met = np.where(lo == hi, own, own ^ 1)
    order = np.argsort(own * count + code, kind="stable")
    table = table.take(pa.array(order))
    own, met, code = own[order], met[order], code[order]
    key = own * count + code
    lists = table.column("positions").combine_chunks()
    sizes = lengths(lists)
    offset = np.concatenate(([0], np.cumsum(sizes)))
    chromosome = np.repeat(code, sizes)
    place = lists.flatten().to_numpy(zero_copy_only=False)
    mark = np.repeat(table.column("mark").to_numpy().astype(np.int64), sizes)
    parts = table.column("parts").to_numpy()
    first = offset[np.searchsorted(key, met * count + code, side="right")]
    partners = offset[np.searchsorted(key, (met + 1) * count, side="left")] - first
    homes = np.flatnonzero((partners > 0) & (sizes > 0))
    turn = np.cumsum(partners[homes]) // _PARTNERS_PER_BATCH
    known = pa.array(values).cast(kind)
    for some in np.split(homes, np.flatnonzero(np.diff(turn)) + 1):
        if not len(some):
            continue
        n = partners[some]
        row = np.repeat(np.arange(len(some)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = first[some][row] + nth
        part = np.zeros(len(row), dtype=np.int32)
        if (parts[some] > 1).any():
            part = (mark[at] % parts[some][row]).astype(np.int32)
            sort = np.lexsort((part, row))
            row, at, part = row[sort], at[sort], part[sort]
            new = np.flatnonzero((np.diff(row) != 0) | (np.diff(part) != 0)) + 1
            begins = np.concatenate(([0], new))
            nth = np.arange(len(row)) - np.repeat(begins, np.diff(np.append(begins, len(row))))
        begins = np.flatnonzero(nth % PARTNERS_PER_ROW == 0)
        ends = pa.array(np.append(begins, len(row)).astype(np.int32))
        here = table.take(pa.array(some[row[begins]]))
        yield pa.RecordBatch.from_arrays(
            [
                here.column("chromosome").combine_chunks(),
                pa.array(part[begins], pa.int32()),
                here.column("positions").combine_chunks(),
                pa.ListArray.from_arrays(ends, known.take(pa.array(chromosome[at]))),
                pa.ListArray.from_arrays(ends, pa.array(place[at])),
            ],
            names=[*HOME, "positions", "partners", "partner_positions"],
        )


def map_bundles(
    rows: DataFrame,
    step: Step,
    columns: dict[str, str],
    at_most: int | None = None,
    target: int = TARGET,
) -> DataFrame:
    """Applies a step of ``map_groups`` to the anchors of all pairs, both ways.

    Pairs of more than ``at_most`` anchors are left out before any anchor is made.
    """
    home = next(f.dataType.simpleString() for f in rows.schema.fields if f.name == "home")
    kinds = {c: ARROW[t] for c, t in columns.items()}
    ordered = rows.repartition(*HOME).sortWithinPartitions(*HOME)

    packed = "numbers" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = map(_unpack, batches) if packed else batches
        yield from _steps(lists, step, kinds, at_most, target)

    return ordered.mapInArrow(run, _pair_schema(home, columns))


def _steps(batches, step: Step, kinds, at_most: int | None, target: int) -> Iterator[pa.RecordBatch]:
    """Applies the step to rows of bundles in the order of their homes."""
    weighed = ("positions", "partners")
    for whole, firsts in whole_groups(batches, HOME, weighed, target):
        for table, starts in portions(whole, firsts, weights(whole, weighed), target):
            chromosomes, home, group, pairs = _both_ways(table, starts, at_most)
            if not len(group):
                continue
            out = _along_homes(step(group, pairs), home)
            to = pa.array(out["group"])
            ref, rel = (chromosomes[c].take(to) for c in ("ref_chr", "rel_chr"))
            yield pa.RecordBatch.from_arrays(
                [ref, rel, *[pa.array(out[c], kind) for c, kind in kinds.items()]],
                names=["ref_chr", "rel_chr", *kinds],
            )


def _along_homes(out: Columns, home: np.ndarray) -> Columns:
    """Rows in the order of the home's positions, those that leave from it first.

    Chromosomes and positions of homes repeat then, which files of columns store in less.
    """
    group = out["group"]
    keys = []
    for way, side in enumerate(("ref", "rel")):
        place = out.get(f"{side}_start", out.get(f"{side}_pos", group))
        keys.append(np.where(group & 1 == way, place, 0))
    order = np.lexsort((keys[0] + keys[1], home[group], group & 1))
    return {c: v[order] for c, v in out.items()}


def _both_ways(table: pa.Table, starts: np.ndarray, at_most: int | None):
    """The chromosomes and the home of each group, and the group and positions of every anchor."""
    home = np.zeros(table.num_rows, dtype=np.int64)
    home[starts[1:]] = 1
    home = np.cumsum(home)
    lists = [table.column(c).combine_chunks() for c in ("positions", "partners", "partner_positions")]
    n_own, n_met = lengths(lists[0]), lengths(lists[1])
    own, met = (lists[i].flatten().to_numpy(zero_copy_only=False) for i in (0, 2))
    partners = lists[1].flatten()
    if pa.types.is_integer(partners.type):
        values, code = np.unique(partners.to_numpy(), return_inverse=True)
        values = pa.array(values, partners.type)
    else:
        coded = partners.dictionary_encode()
        values, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    # one entry per partner position and row: its pair, and how many own positions it meets
    row = np.repeat(np.arange(table.num_rows), n_met)
    key = home[row] * len(values) + code
    known, pair = np.unique(key, return_inverse=True)
    if at_most is not None:
        anchors = np.bincount(pair, weights=n_own[row], minlength=len(known))
        fits = anchors <= at_most
        keep = np.flatnonzero(fits[pair])
        number = np.cumsum(fits) - 1
        known, pair, row, met = known[fits], number[pair[keep]], row[keep], met[keep]
    copies = n_own[row]
    entry = np.repeat(np.arange(len(row)), copies)
    nth = np.arange(len(entry)) - np.repeat(np.cumsum(copies) - copies, copies)
    here = own[(np.cumsum(n_own) - n_own)[row[entry]] + nth].astype(np.int64)
    there = met[entry].astype(np.int64)
    group = pair[entry] * 2
    order = np.argsort(group, kind="stable")
    group, here, there = group[order], here[order], there[order]
    # both directions of a pair follow one another
    n = np.bincount(group // 2, minlength=len(known)) if len(group) else np.zeros(0, np.int64)
    begins = np.cumsum(n) - n
    shift = begins[group // 2]
    forward = np.arange(len(group)) + shift
    backward = forward + n[group // 2]
    columns = {"ref_pos": np.empty(2 * len(group), np.int64), "rel_pos": np.empty(2 * len(group), np.int64)}
    both = np.empty(2 * len(group), np.int64)
    for at, direction, ref, rel in ((forward, 0, here, there), (backward, 1, there, here)):
        both[at] = group + direction
        columns["ref_pos"][at], columns["rel_pos"][at] = ref, rel
    homes = table.column("home").combine_chunks().take(pa.array(starts))
    first = homes.take(pa.array(known // len(values))) if len(values) else homes.slice(0, 0)
    second = values.cast(homes.type).take(pa.array(known % max(len(values), 1)))
    turned = np.arange(2 * len(known)) // 2 + (np.arange(2 * len(known)) % 2) * len(known)
    either = pa.concat_arrays([first, second])
    chromosomes = {
        "ref_chr": either.take(pa.array(turned)),
        "rel_chr": either.take(pa.array((turned + len(known)) % max(2 * len(known), 1))),
    }
    return chromosomes, np.repeat(known // max(len(values), 1), 2), both, columns
