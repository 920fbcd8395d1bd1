"""Near-duplicate documents by an inverted join of MinHash coordinates, confirmed on whole sets.

A document's set is its distinct word shingles. ``COORDINATES`` hash functions each give the set's
smallest value; two sets agree in a coordinate with the probability of their Jaccard similarity.

1. Documents with equal sets are one class, known by a hash of the set.
2. Every class is posted under each pair of coordinate and value. Linked classes agree in at least
   ``matches`` coordinates but for a chance of ``MISSED``. Posts of one class only count for
   nothing, so a class with fewer others is alone.
3. Prefix: of a class's posts, rarest first, all but ``matches - 1`` are its prefix. Classes that
   agree in enough posts share one of both prefixes. Prefix posts connect classes to clusters, by
   hanging each class on the least one of the post: rows grow with posts, not with pairs.
4. Blocks of a cluster meet in pairs. In a task the prefix posts of both sides are merged as
   inverted lists; only pairs met there are looked at again, the long lists behind the prefixes are
   skipped and just probed for them, and pairs with ``matches`` collisions are confirmed by the
   exact overlap of their sets.

Blocks of a cluster stay quadratic in one very large group of near copies, but no pair becomes a
row: a task returns a forest of what it found linked. At a chance of 10**-9 for each linked pair a
link is missed; groups are held together by many links.

Defined cases: null texts and texts without words have empty sets, link with nothing and are their
own component; texts with fewer words than a shingle have one shingle, all their words; repeated
rows are copies of each other; a row without an id links with nothing but exact copies, and is kept
if no row with an id is among them; other columns are left out of the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pathweave.llm.components import components
from pathweave.llm.group_join import Threshold, marked, packed, set_ids, shingle_sets
from pathweave.llm.texts import Texts, slices
from pathweave.session import files_for, materialise

COORDINATES = 32
#: Chance that a linked pair agrees in fewer coordinates than are asked for.
MISSED = 1e-9
#: Classes of a cluster's block.
BLOCK = 512
#: Up to so many pairs are confirmed one by one, more by a matrix product.
FEW = 200
#: Cells of such a matrix that are open at once.
CELLS = 4_000_000

_RANDOM = np.random.Generator(np.random.PCG64(12))
_FACTOR = _RANDOM.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
_SHIFT = _RANDOM.integers(0, 2**64, 64, np.uint64)
#: A post is a coordinate in the upper and its value in the lower bits.
_VALUE_BITS = 58


def least_matches(coordinates: int, similarity: float, missed: float = MISSED) -> int:
    """The most agreeing coordinates that a pair of the similarity fails to reach as rarely as that."""
    chance = 0.0
    for k in range(coordinates + 1):
        chance += math.comb(coordinates, k) * similarity**k * (1 - similarity) ** (coordinates - k)
        if chance > missed:
            return max(k, 1)
    return coordinates


def posts(hashes: np.ndarray, sizes: np.ndarray, coordinates: int) -> np.ndarray:
    """A row of posts for each non-empty set; ``hashes`` are the sets one behind the other."""
    first = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), coordinates), np.uint64)
    for k in range(coordinates if len(sizes) else 0):
        least = np.minimum.reduceat((hashes ^ _SHIFT[k]) * _FACTOR[k], first)
        out[:, k] = (np.uint64(k) << np.uint64(_VALUE_BITS)) | (least >> np.uint64(64 - _VALUE_BITS))
    return out


def _chosen(hashes: np.ndarray, sizes: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The hashes of some of the sets."""
    count = sizes[some]
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return hashes[place + np.repeat((np.cumsum(sizes) - sizes)[some], count)]


def document_posts(documents: DataFrame, size: int, coordinates: int) -> DataFrame:
    """``doc_id, n, sid, posts``: a set's size and id; its posts for one row of it in each task."""

    def run(batches):
        seen: set[int] = set()
        for piece in slices(batches):
            hashes, sizes = shingle_sets(Texts(piece.column(1)), size)
            ids = set_ids(hashes, sizes).view(np.int64)
            fresh = []
            for k in np.flatnonzero(sizes).tolist():
                if (sid := int(ids[k])) not in seen:
                    seen.add(sid)
                    fresh.append(k)
            fresh = np.array(fresh, np.int64)
            made = posts(_chosen(hashes, sizes, fresh), sizes[fresh], coordinates).view(np.int64)
            lists = np.zeros(len(sizes), np.int64)
            lists[fresh] = coordinates
            offsets = pa.array(np.concatenate(([0], np.cumsum(lists))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0), pa.array(sizes), pa.array(ids, mask=sizes == 0),
                    pa.ListArray.from_arrays(offsets, pa.array(made.ravel())),
                ],
                names=["doc_id", "n", "sid", "posts"],
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n long, sid long, posts array<long>"
    )


def prefixes(sets: DataFrame, matches: int) -> DataFrame:
    """``sid, prefix`` of the classes that share at least ``matches`` posts with others."""
    each = sets.filter("sid is not null").select("sid", F.explode("posts").alias("post"))
    shared = each.groupBy("post").agg(
        F.count(F.lit(1)).alias("times"), F.min("sid").alias("low"), F.max("sid").alias("high")
    )
    shared = materialise(shared.filter("low < high").select("post", "times"), "shared-posts")
    listed = each.join(shared, "post").groupBy("sid").agg(
        F.array_sort(F.collect_set(F.struct("times", "post"))).alias("listed")
    )
    return listed.filter(F.size("listed") >= matches).select(
        "sid", F.slice("listed.post", F.lit(1), F.size("listed") - (matches - 1)).alias("prefix")
    )


def cluster_edges(listed: DataFrame) -> DataFrame:
    """``a, b``: the classes of each prefix post hang on its least one."""
    each = listed.select("sid", F.explode("prefix").alias("post"))
    least = each.groupBy("post").agg(F.min("sid").alias("b"))
    return each.join(least, "post").filter("sid <> b").select(F.col("sid").alias("a"), "b")


class Block:
    """Classes of one side, each once."""

    def __init__(self, rows: list[dict]):
        own = {r["sid"]: r for r in rows}
        self.sids = np.array(list(own), np.int64)
        self.sizes = np.array([len(r["shingles"]) // 8 for r in own.values()], np.int64)
        self.shingles = [np.frombuffer(r["shingles"], np.uint64) for r in own.values()]
        self.posts = np.stack([np.frombuffer(r["posts"], np.uint64) for r in own.values()])
        prefix = [np.array(r["prefix"], np.int64) for r in own.values()]
        keys = np.concatenate(prefix)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.owners = np.repeat(np.arange(len(prefix)), [len(p) for p in prefix])[order]

    def inverted(self) -> dict[int, np.ndarray]:
        """The classes under each prefix post."""
        keys, first = np.unique(self.keys, return_index=True)
        return dict(zip(keys.tolist(), np.split(self.owners, first[1:]), strict=True))


def collisions(asking: Block, asked: Block, matches: int) -> np.ndarray:
    """Pairs of places with at least ``matches`` equal posts."""
    met = np.zeros((len(asking.sids), len(asked.sids)), bool)
    lists = asked.inverted()
    for key, mine in asking.inverted().items():
        if (theirs := lists.get(key)) is not None:
            met[np.ix_(mine, theirs)] = True
    if asking is asked:
        met = np.triu(met, 1)
    left, right = np.nonzero(met)
    enough = np.zeros(len(left), bool)
    for k in range(0, len(left), 1 << 16):
        some = slice(k, k + (1 << 16))
        equal = asking.posts[left[some]] == asked.posts[right[some]]
        enough[some] = equal.sum(1) >= matches
    return np.stack([left[enough], right[enough]], 1)


def overlaps(asking: Block, asked: Block, pairs: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the pairs' sets."""
    if len(pairs) <= FEW:
        return np.array(
            [
                len(np.intersect1d(asking.shingles[a], asked.shingles[b], assume_unique=True))
                for a, b in pairs.tolist()
            ],
            np.int64,
        )
    total = np.zeros((len(asking.sids), len(asked.sids)), np.int64)
    theirs = np.concatenate(asked.shingles)
    common = np.intersect1d(np.concatenate(asking.shingles), theirs)
    step = max(1, CELLS // max(total.shape))
    for k in range(0, len(common), step):
        columns = common[k : k + step]
        left, right = (_incidence(side, columns) for side in (asking, asked))
        total += (left @ right.T).astype(np.int64)
    return total[pairs[:, 0], pairs[:, 1]]


def _incidence(block: Block, columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(block.sids), len(columns)), np.float32)
    for k, shingles in enumerate(block.shingles):
        begin, end = np.searchsorted(shingles, (columns[0], columns[-1]))
        part = shingles[begin : end + 1]
        at = np.minimum(np.searchsorted(columns, part), len(columns) - 1)
        out[k, at[columns[at] == part]] = 1
    return out


def confirmed(asking: Block, asked: Block, matches: int, limit: Threshold) -> np.ndarray:
    """Pairs of places whose sets link."""
    pairs = collisions(asking, asked, matches)
    both = overlaps(asking, asked, pairs)
    either = asking.sizes[pairs[:, 0]] + asked.sizes[pairs[:, 1]] - both
    return pairs[limit.den * both >= limit.num * either]


def _roots(count: int, links: np.ndarray) -> np.ndarray:
    """The least place with which each is connected."""
    root = np.arange(count)
    while True:
        before = root.copy()
        low = np.minimum(root[links[:, 0]], root[links[:, 1]])
        np.minimum.at(root, links[:, 0], low)
        np.minimum.at(root, links[:, 1], low)
        root = root[root]
        if (root == before).all():
            return root


def whole_sets(documents: DataFrame, chosen: DataFrame, size: int, coordinates: int) -> DataFrame:
    """``sid, posts, shingles`` of the classes in ``chosen``, whose columns come along."""
    extra = [c for c in chosen.columns if c not in ("doc_id", "sid")]
    kinds = dict(chosen.dtypes)

    def run(batches):
        for piece in slices(batches):
            hashes, sizes = shingle_sets(Texts(piece.column(0)), size)
            # of several rows with one id only the chosen set counts
            right = np.flatnonzero(set_ids(hashes, sizes).view(np.int64) == piece.column(1).to_numpy())
            mine, counts = _chosen(hashes, sizes, right), sizes[right]
            made = posts(mine, counts, coordinates)
            width = np.arange(len(right) + 1) * coordinates
            yield pa.RecordBatch.from_arrays(
                [
                    *[c.take(pa.array(right)) for c in piece.columns[1:]],
                    packed(np.uint64, made.ravel(), width),
                    packed(np.uint64, mine, np.concatenate(([0], np.cumsum(counts)))),
                ],
                names=["sid", *extra, "posts", "shingles"],
            )

    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return (
        marked(texts, chosen)
        .filter("_marked")  # other texts are not shuffled
        .join(chosen, "doc_id")
        .select("text", "sid", *extra)
        .mapInArrow(run, ", ".join(["sid long", *[f"{c} {kinds[c]}" for c in extra], "posts binary", "shingles binary"]))
    )


def block_pairs(sets: DataFrame) -> DataFrame:
    """Each class once for every pair of blocks ``i, j`` of its cluster in which its block takes part."""
    ends = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(
            F.least("block", other).alias("i"), F.greatest("block", other).alias("j"),
            (F.col("block") > other).alias("second"),
        ),
    )
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        sets.withColumn("at", F.explode(ends))
        .select("cluster", "at.i", "at.j", "at.second", "sid", "prefix", "posts", "shingles")
        .repartition(tasks, "cluster", "i", "j")
        .sortWithinPartitions("cluster", "i", "j")
    )


def linked_classes(members: DataFrame, matches: int, limit: Threshold) -> DataFrame:
    """``a, b``: edges that connect what is linked in each pair of blocks."""

    def one(rows):
        sides = [[r for r in rows if r["second"] == s] for s in (False, True)]
        first = Block(sides[0]) if sides[0] else None
        if rows[0]["i"] == rows[0]["j"]:
            links, sids = confirmed(first, first, matches, limit), first.sids
        elif first is not None and sides[1]:
            second = Block(sides[1])
            links = confirmed(first, second, matches, limit) + [0, len(first.sids)]
            sids = np.concatenate([first.sids, second.sids])
        else:
            return
        root = _roots(len(sids), links)
        some = np.flatnonzero(root != np.arange(len(sids)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(sids[some]), pa.array(sids[root[some]])], names=["a", "b"]
        )

    def run(batches):
        held, key = [], None
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                for row in batch.slice(begin, 256).to_pylist():
                    mine = (row["cluster"], row["i"], row["j"])
                    if mine != key and held:
                        yield from one(held)
                        held = []
                    key = mine
                    held.append(row)
        if held:
            yield from one(held)

    return members.mapInArrow(run, "a long, b long")


def near_duplicates(
    documents: DataFrame, size: int = 5, num: int = 85, den: int = 100, coordinates: int = COORDINATES
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, a row for each row of ``documents``.

    Documents link at a similarity of at least ``num / den``; ``component_id`` is the smallest id
    reachable by links.
    """
    limit = Threshold(num, den)
    matches = least_matches(coordinates, num / den)
    sets = materialise(document_posts(documents, size, coordinates), "posts")
    few = files_for(sets.count())
    classes = sets.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    classes = materialise(classes, "classes", few)
    listed = materialise(prefixes(sets, matches), "prefixes", few)
    clusters = components(cluster_edges(listed), "clusters", few).withColumnRenamed("root", "cluster")
    large = clusters.groupBy("cluster").count().filter(F.col("count") > BLOCK)
    large = materialise(large.select("cluster", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "large", 1)
    chosen = (
        clusters.join(large, "cluster", "left")
        .select(F.col("node").alias("sid"), "cluster", F.coalesce("blocks", F.lit(1)).alias("blocks"))
        .withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
        .join(classes.filter("doc_id is not null"), "sid")
        .join(listed, "sid")
    )
    chosen = materialise(chosen, "chosen", few)
    whole = whole_sets(documents, chosen, size, coordinates)
    linked = materialise(linked_classes(block_pairs(whole), matches, limit), "linked")
    roots = components(linked, "roots", few).withColumnRenamed("node", "sid")
    known = classes.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    known = materialise(known, "known", few)
    first = materialise(known.groupBy("root").agg(F.min("doc_id").alias("component_id")), "first", few)
    answer = materialise(known.join(first, "root").select("sid", "component_id"), "answer", few)
    named = sets.select("doc_id", F.col("n").alias("n_shingles"), "sid").join(answer, "sid", "left")
    return named.select(
        "doc_id", "n_shingles",
        F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
