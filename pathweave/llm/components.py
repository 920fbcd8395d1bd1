"""Connected components of an edge table by hooking to the least neighbour and contraction.

Every round takes each node to its least neighbour, jumps along these pointers, and keeps only
edges between different results; a hub or a large component never meets in one task, as minima
are combined before the shuffle and joins are between written tables, which adaptive execution
can split. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pathweave.session import files_for, materialise


def components(
    edges: DataFrame, label: str = "components", files: int | None = None
) -> DataFrame:
    """``node, root`` of every node of an edge; ``edges`` has long columns ``a`` and ``b``.

    The root is the least node of the component. ``files`` are those of the first edge table.
    """
    edges = materialise(edges.filter("a <> b").select("a", "b").distinct(), label, files)
    roots = None
    while left := edges.count():
        some = files_for(left)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
        up = materialise(up.select("node", F.least("node", "up").alias("up")), label, some)
        up = materialise(_jump(_jump(up, up, "up"), up, "up"), label, some)
        nodes = up.count() if roots is None else roots.count()
        roots = up.withColumnRenamed("up", "root") if roots is None else _jump(roots, up, "root")
        roots = materialise(roots, label, files_for(nodes))
        ends = edges
        for side in ("a", "b"):
            ends = _jump(ends, up, side)
        edges = materialise(ends.filter("a <> b").distinct(), label, some)
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


def _jump(rows: DataFrame, up: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` replaced by what ``up`` points it to."""
    to = up.select(F.col("node").alias("_node"), F.col("up").alias("_up"))
    return rows.join(to, rows[column] == to["_node"], "left").select(
        *[
            F.coalesce("_up", rows[column]).alias(column) if c == column else rows[c]
            for c in rows.columns
        ]
    )
