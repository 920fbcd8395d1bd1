"""Exact top-k inner products by aggregation without random access.

Vectors become whole numbers and are packed into blocks. A stated query set is held against all
rows in blocks: groups of query blocks and slabs of candidate blocks make a grid, a task has the
queries of one group and reads the candidate blocks of one slab one after the other. Blocks are
dealt to the grid by their own numbers, so there is no join and no side is broadcast.

In a task each component of a candidate block is a sorted list. For a query all lists are read
from both ends, in steps of falling impact: a step reads on until what is unread of every list
would add less than ``tau`` to a score, so lists with a large weight are read deeper. What has
been read of a candidate, and ``tau`` for each unread component, are its lower and upper bound.
Reading stops when the k-th best lower bound, or the k-th score that earlier blocks of the slab
have left, is above the upper bounds of all but a few candidates; their scores are then resolved.
Scores are whole numbers below 2**53 and so exact; a candidate is only ruled out by its bound.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part;
candidates of another length than a query's do not compare with it; rows with the query's own
``vec_id`` are no candidates; repeated candidate rows each count, repeated query rows count once
each; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pathweave.session import materialise

K = 10
SCALE = 1024
#: Rows of a packed block.
BLOCK = 4096
#: Blocks of queries that a task holds, and candidate blocks that it reads at most, on average.
QUERY_BLOCKS = 8
SLAB = 16
#: Each step reads on to this share of the impact of the one before; the first to the mean impact.
STEP = 0.6
#: Once a step falls below this share of the mean impact the lists are read to their ends.
LAST = 0.02
#: Reading stops once so few candidates for each wanted row may still qualify.
RESOLVED = 4

_PACKED = "dim int, block long, n int, ids binary, vectors binary"


def usable() -> Column:
    """A vector without null, NaN or infinite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return (F.size("embedding") > 0) & F.forall("embedding", fine)


def packed(vectors: DataFrame, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """Blocks of at most ``block`` vectors of one length, made where the rows are read."""

    def run(batches):
        number = 0
        partition = _task()
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy()
            flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            first = np.cumsum(sizes) - sizes
            ids = batch.column(0).to_numpy()
            for dim in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == dim)
                for part in np.array_split(mine, -(-len(mine) // block)):
                    rows = flat[first[part][:, None] + np.arange(dim)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([dim], pa.int32()), pa.array([(partition << 32) | number]),
                            pa.array([len(part)], pa.int32()), pa.array([ids[part].tobytes()]),
                            pa.array([rows.tobytes()]),
                        ],
                        names=["dim", "block", "n", "ids", "vectors"],
                    )
                    number += 1

    return vectors.filter(usable() & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")
    ).mapInArrow(run, _PACKED)


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


class SortedLists:
    """The components of a block's rows as lists of rising values, one behind the other."""

    def __init__(self, rows: np.ndarray):
        order = np.argsort(rows, axis=0, kind="stable")
        self.rows, self.count, self.dim = rows, *rows.shape
        self.values = np.ascontiguousarray(np.take_along_axis(rows, order, 0).T)
        self.flat, self.owner = self.values.ravel(), np.ascontiguousarray(order.T).ravel()
        self.impact = np.abs(rows).mean(0) if len(rows) else np.zeros(self.dim)


def best_rows(lists: SortedLists, query: np.ndarray, barred: np.ndarray, k: int, bar: float):
    """Rows that may be among the ``k`` best, with their scores; and the share of entries read.

    ``barred`` rows are no candidates; ``bar`` is a score that k rows are known to have reached.
    """
    n, dim = lists.count, lists.dim
    weight = np.abs(query)
    used = np.flatnonzero(weight)
    known, seen = np.zeros(n), np.zeros(n)
    low, high = np.zeros(len(used), np.int64), np.full(len(used), n)
    mean = float((weight * lists.impact).mean())
    tau = mean
    while True:
        if tau < LAST * mean or not mean:
            tau = 0.0
        if tau:
            edge = tau / weight[used]
            new_low = np.array([np.searchsorted(lists.values[d], -e, "right") for d, e in zip(used, edge)])
            new_high = np.array([np.searchsorted(lists.values[d], e, "left") for d, e in zip(used, edge)])
        else:
            new_low = new_high = high
        starts = np.concatenate([low, new_high]) + np.concatenate([used, used]) * n
        sizes = np.concatenate([new_low - low, high - new_high])
        at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        who = lists.owner[at]
        worth = lists.flat[at] * np.repeat(np.concatenate([query[used], query[used]]), sizes)
        known += np.bincount(who, worth, n)
        seen += np.bincount(who, minlength=n)
        low, high = new_low, new_high
        # one more for what rounding of the edges may have left unread
        open_ = tau * (len(used) - seen) + 1.0 if tau else np.zeros(n)
        lower, upper = known - open_, known + open_
        lower[barred] = -np.inf
        reached = max(bar, np.partition(lower, n - k)[n - k]) if n >= k else bar
        alive = np.flatnonzero((upper >= reached) & ~barred)
        if not tau or len(alive) <= RESOLVED * k:
            break
        tau *= STEP
    scores = lists.rows[alive] @ query
    read = float(seen.sum()) / max(1, n * dim)
    return alive, scores, read


class Best:
    """The best rows of one query so far."""

    def __init__(self, query_id: int, query: np.ndarray, k: int):
        self.query_id, self.query, self.k = query_id, query, k
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0)

    def see(self, lists: SortedLists, ids: np.ndarray) -> None:
        bar = self.scores[-1] if len(self.scores) == self.k else -np.inf
        place, scores, _ = best_rows(lists, self.query, ids == self.query_id, self.k, bar)
        ids, scores = np.concatenate([self.ids, ids[place]]), np.concatenate([self.scores, scores])
        first = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[first], scores[first]


def _dealt(blocks: DataFrame, sizes: DataFrame, query: bool) -> DataFrame:
    """Blocks once for every place of the grid of their length in which they take part."""
    own, other = ("groups", "slabs") if query else ("slabs", "groups")
    mine = F.pmod(F.xxhash64("block"), F.col(own)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
    group, slab = (mine, every) if query else (every, mine)
    return blocks.join(sizes, "dim").select(
        "dim", group.alias("query_group"), slab.alias("slab"), F.lit(query).alias("asks"), "block", "ids", "vectors"
    )


def top_k(vectors: DataFrame, every: int = 100, k: int = K, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the queries are rows whose id is divisible by ``every``."""
    asked = materialise(packed(vectors.filter(F.col("vec_id") % every == 0), block=block), "queries")
    blocks = materialise(packed(vectors, block=block), "blocks")
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = F.ceil(F.col("queries") / (QUERY_BLOCKS * block))
    # a row for each length; both counts only say how the work is dealt
    sizes = (
        asked.groupBy("dim").agg(F.sum("n").alias("queries"))
        .join(blocks.groupBy("dim").agg(F.count(F.lit(1)).alias("blocks")), "dim")
        .select(
            "dim",
            groups.cast("int").alias("groups"),
            F.greatest(F.ceil(F.col("blocks") / SLAB), F.least("blocks", F.ceil(tasks / groups))).cast("int").alias("slabs"),
        )
    )
    sizes = materialise(sizes, "grid", 1)
    keys = ["dim", "query_group", "slab"]
    grid = _dealt(asked, sizes, True).unionByName(_dealt(blocks, sizes, False))

    def found(held):
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.full(len(b.ids), n) for n, _, b in held])),
                pa.array(np.concatenate([np.full(len(b.ids), p, np.int32) for _, p, b in held])),
                pa.array(np.concatenate([np.full(len(b.ids), b.query_id) for _, _, b in held])),
                pa.array(np.concatenate([b.ids for _, _, b in held])),
                pa.array(np.concatenate([b.scores for _, _, b in held]).astype(np.int64)),
            ],
            names=["query_block", "place", "query_id", "vec_id", "score"],
        )

    def run(batches):
        held, key = [], None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids = np.frombuffer(row["ids"], np.int64)
                rows = np.frombuffer(row["vectors"]).reshape(len(ids), row["dim"])
                if key != (mine := tuple(row[c] for c in keys)):
                    if held:
                        yield found(held)
                    held, key = [], mine
                if row["asks"]:  # the queries come first; equal ids are told apart by their place
                    for n, (q, v) in enumerate(zip(ids.tolist(), rows)):
                        held.append((row["block"], n, Best(q, v, k)))
                elif held:
                    lists = SortedLists(rows)
                    for _, _, best in held:
                        best.see(lists, ids)
        if held:
            yield found(held)

    order = Window.partitionBy("query_block", "place", "query_id").orderBy(F.desc("score"), "vec_id")
    return (
        grid.repartition(tasks, *keys)
        .sortWithinPartitions(*keys, F.desc("asks"), "block")
        .mapInArrow(run, "query_block long, place int, query_id long, vec_id long, score long")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
