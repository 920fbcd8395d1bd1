"""Runs a numpy step over whole groups, many groups per call.

Spark shuffles and sorts the rows by group; a task then streams Arrow batches and
hands the step as many complete groups as weigh about ``TARGET``. Callers bound the
size of a single group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TARGET = 1 << 19

ARROW = {"long": pa.int64(), "string": pa.string()}

Columns = dict[str, np.ndarray]
Step = Callable[[np.ndarray, Columns], Columns]


def changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows at which a new group begins, the first row included."""
    changed = np.zeros(table.num_rows, dtype=bool)
    changed[0] = True
    for key in keys:
        column = table.column(key).combine_chunks()
        if not pa.types.is_integer(column.type):
            column = column.dictionary_encode().indices
        values = column.to_numpy(zero_copy_only=False)
        changed[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(changed)


def whole_groups(
    batches: Iterator[pa.RecordBatch],
    keys: list[str],
    lists: tuple[str, str] | None,
    target: int,
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups, with the rows at which each group begins."""
    held: list[pa.RecordBatch] = []
    weight, limit = 0, target
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        weight += int(weights(batch, lists).sum())
        if weight < limit:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        firsts = changes(table, keys)
        cut = int(firsts[-1])
        if cut:
            yield table.slice(0, cut), firsts[:-1]
            table = table.slice(cut)
        held = table.to_batches()
        weight = int(weights(table, lists).sum())
        limit = max(target, 2 * weight)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, changes(table, keys)


def portions(
    whole: pa.Table, starts: np.ndarray, weights: np.ndarray, target: int
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Complete groups that weigh about ``target`` together, with the rows at which each begins."""
    before = np.concatenate(([0], np.cumsum(weights)))[starts]
    turns = np.flatnonzero(np.diff(before // target, prepend=-1))
    edges = [*starts[turns].tolist(), whole.num_rows]
    for a, b in zip(edges[:-1], edges[1:]):
        yield whole.slice(a, b - a), starts[(starts >= a) & (starts < b)] - a


def lengths(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def weights(rows: pa.Table | pa.RecordBatch, lists: tuple[str, str] | None) -> np.ndarray:
    if lists is None:
        return np.ones(rows.num_rows, dtype=np.int64)
    return lengths(rows.column(lists[0])) * lengths(rows.column(lists[1]))


def _pairs_of_lists(
    table: pa.Table, lists: tuple[str, str], names: tuple[str, str]
) -> tuple[np.ndarray, Columns]:
    """All pairs of each row's two lists, and the row each pair comes from."""
    left, right = (table.column(c).combine_chunks() for c in lists)
    n_left, n_right = lengths(left), lengths(right)
    counts = n_left * n_right
    row = np.repeat(np.arange(table.num_rows), counts)
    begin = np.cumsum(counts) - counts
    turn = np.arange(len(row)) - begin[row]
    width = n_right[row]
    i, j = np.divmod(turn, width)
    values_left, values_right = (a.flatten().to_numpy().astype(np.int64) for a in (left, right))
    from_left, from_right = np.cumsum(n_left) - n_left, np.cumsum(n_right) - n_right
    return row, {
        names[0]: values_left[from_left[row] + i],
        names[1]: values_right[from_right[row] + j],
    }


def map_groups(
    df: DataFrame,
    keys: list[str],
    step: Step,
    columns: dict[str, str],
    lists: tuple[str, str] | None = None,
    pairs: tuple[str, str] | None = None,
    target: int = TARGET,
) -> DataFrame:
    """Applies ``step(group, columns) -> columns`` to whole groups of ``keys``.

    ``step`` gets a non-decreasing group number per row and the non-key columns
    as numpy arrays. It returns a ``group`` array and the arrays named in
    ``columns`` (name to Spark type); the key columns are put back. With ``lists``
    a row stands for all pairs of its two lists; the step sees the pairs, named
    ``pairs``, which never leave the task.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(
        [f"`{k}` {types[k]}" for k in keys] + [f"`{c}` {t}" for c, t in columns.items()]
    )
    kinds = {c: ARROW[t] for c, t in columns.items()}
    values = [c for c in df.columns if c not in keys]
    # The last key varies most where one query chromosome faces all others.
    ordered = df.repartition(*keys).sortWithinPartitions(*reversed(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, starts in whole_groups(batches, keys, lists, target):
            for table, firsts in portions(whole, starts, weights(whole, lists), target):
                group = np.zeros(table.num_rows, dtype=np.int64)
                group[firsts[1:]] = 1
                group = np.cumsum(group)
                if lists is None:
                    given = {c: table.column(c).to_numpy() for c in values}
                else:
                    row, given = _pairs_of_lists(table, lists, pairs)
                    group = group[row]
                out = step(group, given)
                home = pa.array(firsts[out["group"]])
                arrays = [table.column(k).combine_chunks().take(home) for k in keys]
                arrays += [pa.array(out[c], kind) for c, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *columns])

    return ordered.mapInArrow(run, schema)
