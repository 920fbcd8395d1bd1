"""Merkle manifest of a table, with proofs by pointer jumping.

Rows are leaves. The leaves of one language are a tree, its root is a subroot; the subroots are
the leaves of one more tree, whose root stands for the whole table. An inner node is the hash of
its children's hexadecimal digests; a last node without a neighbour is hashed alone.

1. Leaves are hashed and dealt by ranges of (language, id), so that a hot language is many tasks;
   a leaf's place in its tree is its row number in its range and the sizes of the ranges before.
2. Aligned blocks of ``2**BITS`` nodes climb ``BITS`` levels in one task each. Every node gets its
   segment, the sibling on the way to its parent. Blocks' tops are the nodes of the next climb.
3. Pointer jumping: a node holds the segment to its ancestor at some distance. A self-join with
   the ancestors' segments concatenates both and doubles the distance, until leaves reach the
   root. Only levels at which a later jump lands are kept, so upper rows fall away quickly.

At distance d an ancestor is shared by at most ``2**d`` leaves, while the ancestors' side has but
one row for so many leaves: it is small enough to be sent to every task, by its size, before a
key could become hot.

Defined cases: a null field is hashed as ``-``, others with their length in bytes before them;
null languages are a tree of their own, before all others; rows of one id are ordered by their
hash, so equal rows are interchangeable; a row without an id comes first in its tree; an empty
table has no result; columns that are not hashed are left out.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pathweave.session import materialise

#: Levels that a block climbs in one task.
BITS = 10
#: The fields of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "tree string, level int, place long, size long, hash binary, segment binary, doc_id long, forged binary"
_ALONE, _LEFT, _RIGHT = b"\x00", b"\x01", b"\x02"


def _told(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(documents: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    """``tree, doc_id, hash, forged`` of each row.

    ``changed`` gives fields other values; ``forged`` is the hash with them, null where it is the
    same row.
    """
    own = {c: F.col(c) for c in FIELDS}
    other = own | (changed or {})
    differs = F.lit(False)
    for c in changed or {}:
        differs = differs | ~own[c].cast("string").eqNullSafe(other[c].cast("string"))

    def digest(fields: dict[str, Column]) -> Column:
        return F.unhex(F.sha2(F.concat(*[_told(fields[c]) for c in FIELDS]), 256))

    return documents.select(
        # null sorts first, and so does the empty string
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        digest(own).alias("hash"),
        F.when(differs, digest(other)).alias("forged"),
    )


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``place``, from 0 in ``order`` within each ``tree``, and ``size`` of the tree.

    Nothing is numbered in one task: the running sum is over one row for each tree and range.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order]
    ranges = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    numbered = materialise(ranges.withColumn("at", F.monotonically_increasing_id()), "ranges")
    numbered = numbered.withColumn("range", F.shiftright("at", 33))
    parts = numbered.groupBy("tree", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "tree", "range",
        (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(Window.partitionBy("tree")).alias("size"),
    )
    return numbered.join(parts, ["tree", "range"]).select(
        *rows.columns, (F.col("at") + F.col("shift")).alias("place"), "size"
    )


def _climbed(base: int, end: int, tree: str, size: int, first: int, hashes: list[bytes], named: list[tuple]):
    """Rows of a block: its nodes from level ``base`` with their segments, then its top without one."""
    height = (size - 1).bit_length()
    top = min(end, height)
    if not height:
        yield tree, 0, first, size, hashes[0], b"", *named[0]
    for level in range(base, top):
        parents = []
        for k in range(0, len(hashes), 2):
            pair = hashes[k : k + 2]
            parents.append(hashlib.sha256(b"".join(h.hex().encode() for h in pair)).digest())
            ways = (_RIGHT + pair[1], _LEFT + pair[0]) if len(pair) == 2 else (_ALONE,)
            for n, way in enumerate(ways):
                who = named[k + n] if level == 0 else (None, None)
                yield tree, level, first + k + n, size, pair[n], way, *who
        first, hashes = first >> 1, parents
    yield tree, top, first, size, hashes[0], None, None, None


def _climb(nodes: DataFrame, base: int) -> DataFrame:
    schema = StructType.fromDDL(_NODE)
    kind = to_arrow_schema(schema)
    bits = BITS

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind
        )

    def run(batches):
        out, held, key, size = [], [], None, 0

        def close():
            if held:
                hashes, named = [h[1] for h in held], [h[2:] for h in held]
                out.extend(_climbed(base, base + bits, key[0], size, held[0][0], hashes, named))
                held.clear()

        for piece in batches:
            for tree, place, n, digest, doc_id, forged in zip(*[c.to_pylist() for c in piece.columns], strict=True):
                if key != (tree, place >> bits):
                    close()
                    key, size = (tree, place >> bits), n
                    if len(out) >= 8192:
                        yield batch(out)
                        out = []
                held.append((place, digest, doc_id, forged))
        close()
        if out:
            yield batch(out)

    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        nodes.withColumn("block", F.shiftright("place", bits))
        .repartition(tasks, "tree", "block")
        .sortWithinPartitions("tree", "block", "place")
        .select("tree", "place", "size", "hash", "doc_id", "forged")
        .mapInArrow(run, schema)
    )


def grown(nodes: DataFrame, label: str = "nodes") -> tuple[DataFrame, DataFrame, int]:
    """All nodes below the roots with their segments; ``tree, root``; the greatest height.

    ``nodes`` are leaves as ``placed`` gives them.
    """
    largest = nodes.agg(F.max("size")).collect()[0][0] or 0
    height = (largest - 1).bit_length() if largest else 0
    below, roots, base = [], [], 0
    while True:
        level = materialise(_climb(nodes, base), label)
        below.append(level.filter("segment is not null"))
        tops = level.filter("segment is null")
        ended = F.expr("shiftleft(1L, level) >= size")
        roots.append(tops.filter(ended).select("tree", F.col("hash").alias("root")))
        base += BITS
        if base >= height:
            break
        nodes = tops.filter(~ended)
    out, ends = below[0], roots[0]
    for more, end in zip(below[1:], roots[1:], strict=True):
        out, ends = out.unionByName(more), ends.unionByName(end)
    return out, ends, height


def jumped(nodes: DataFrame, height: int, label: str = "jumps") -> DataFrame:
    """The leaves with ``segment``: the siblings on their whole way to the root of their tree."""
    nodes = nodes.select("tree", "level", "place", "hash", "segment", "doc_id", "forged")
    distance = 1
    while distance < height:
        upper = nodes.filter(F.col("level") % (2 * distance) == distance).select(
            F.col("tree").alias("_tree"), F.col("level").alias("_level"),
            F.col("place").alias("_place"), F.col("segment").alias("_segment"),
        )
        lower = nodes.filter(F.col("level") % (2 * distance) == 0)
        nodes = lower.join(
            upper,
            (lower["tree"] == upper["_tree"])
            & (lower["level"] + distance == upper["_level"])
            & (F.shiftright(lower["place"], distance) == upper["_place"]),
            "left",
        ).select(
            "tree", "level", "place", "hash",
            F.concat("segment", F.coalesce("_segment", F.lit(b""))).alias("segment"), "doc_id", "forged",
        )
        distance *= 2
        if distance < height:
            nodes = materialise(nodes, label)
    return nodes.filter("level = 0")


def proofs(documents: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, leaf, forged, subroot, root, segment`` of each row, digests and segment binary.

    The segment holds, from the leaf to the root of the table, a byte for each level (0: alone,
    1: the sibling stands left, 2: right) and the sibling's digest if there is one.
    """
    own = materialise(leaves(documents, changed), "leaves")
    nodes, subroots, height = grown(placed(own, "doc_id", "hash"))
    subroots = materialise(subroots, "subroots")
    above = subroots.select(
        F.lit("top").alias("tree"), F.col("root").alias("hash"), F.col("tree").alias("language"),
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("forged"),
    )
    above = materialise(placed(above, "language"), "languages")
    nodes_above, roots, height_above = grown(above.drop("language"), "nodes-above")
    root = roots.collect()  # one row
    ways = above.join(
        jumped(nodes_above, height_above, "jumps-above").select("place", F.col("segment").alias("_above")), "place"
    ).select(F.col("language").alias("_language"), F.col("hash").alias("subroot"), "_above")
    ways = materialise(ways, "ways")
    low = jumped(nodes, height)
    return low.join(ways, low["tree"] == ways["_language"]).select(
        "doc_id", F.col("hash").alias("leaf"), "forged", "subroot",
        F.lit(bytes(root[0]["root"]) if root else None).cast("binary").alias("root"),
        F.concat("segment", "_above").alias("segment"),
    )


def steps(segment: bytes) -> list[tuple[bytes, bytes]]:
    """The side and the sibling's digest (empty where there is none) of each level."""
    out, at = [], 0
    while at < len(segment):
        end = at + (1 if segment[at : at + 1] == _ALONE else 33)
        out.append((segment[at : at + 1], segment[at + 1 : end]))
        at = end
    return out


def folded(leaf: bytes, way: list[tuple[bytes, bytes]]) -> bytes:
    """The root to which a leaf leads along its proof."""
    node = leaf
    for side, sibling in way:
        pair = (sibling, node) if side == _LEFT else (node, sibling)
        node = hashlib.sha256((pair[0].hex() + pair[1].hex()).encode()).digest()
    return node


def verified(proved: DataFrame) -> DataFrame:
    """``proofs`` as digests, with the root that each row, forged where it is, leads to."""

    def run(batches):
        for piece in batches:
            columns = {n: piece.column(n).to_pylist() for n in piece.schema.names}
            ways = [steps(s) for s in columns["segment"]]
            ends = [
                folded(forged or leaf, way)
                for leaf, forged, way in zip(columns["leaf"], columns["forged"], ways, strict=True)
            ]
            texts = ["".join(s.hex() for _, s in way) for way in ways]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    *[pa.array([v.hex() for v in columns[c]], pa.string()) for c in ("leaf", "subroot", "root")],
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                    pa.array([e.hex() for e in ends], pa.string()),
                    pa.array([e == r for e, r in zip(ends, columns["root"], strict=True)], pa.bool_()),
                ],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    return proved.mapInArrow(
        run,
        "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    )


def audit(documents: DataFrame) -> DataFrame:
    """Every row's proof, held against a copy of the table in which some rows were tampered with.

    In the copy ``n_chars`` is one more where 7 divides the CRC of the decimal id.
    """
    told = F.col("doc_id").cast("string").cast("binary")
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    tampered = F.when(F.crc32(told) % 7 == 0, more).otherwise(F.col("n_chars").cast("string"))
    return verified(proofs(documents, {"n_chars": tampered}))
