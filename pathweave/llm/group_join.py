"""N-gram Jaccard join with a token-group matrix.

Two documents link when their sets of word n-grams (shingles) have a Jaccard similarity of at
least ``num / den``. The join is exact on 64-bit shingle hashes, and no step pairs all documents:

1. Documents with equal sets are one class, known by a hash of the set.
2. The whole corpus is first taken as one group: linked sets share at least so many of their
   lowest-hashed shingles (prefix of ``n - need + spare``), so a class with fewer prefix shingles
   that another class has too is alone. This leaves near copies and little else.
3. Of the remaining classes whole sets are made again from their texts, and each shingle's number
   of classes. A set whose shared shingles are fewer than ``need`` is alone. Linked sets share a
   shingle of their prefixes in order of rising frequency; classes connected in this way are a
   cluster, and every link lies inside one.
4. Clusters are cut into blocks, and blocks of one cluster meet in pairs. In a task the classes
   of one side are partitioned into groups of similar ones (next to each other by their lowest
   shingle hash); the matrix row of a group is the union of its shingles. For a query its hits in
   the row bound its overlap with every member; only groups that reach ``need`` are opened, and
   their members' exact overlaps decide.

A shingle, class or cluster that is hot costs one row for each packed chunk of the input, not one
for each document: chunks combine before they are shuffled.

Defined cases: null texts and texts without words have empty sets, link with nothing and are
their own class; texts with fewer words than a shingle have one shingle, all their words; repeated
rows are copies of each other; a row without an id links with nothing but exact copies; other
columns are left out of the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pathweave.llm.components import components
from pathweave.llm.texts import Texts, mixed, slices, span_hashes, window_hashes
from pathweave.session import files_for, materialise

#: Shingles that a task packs together.
CHUNK = 1 << 18
#: Shingles that a task of a packed exchange gets on average, and the least number of parts.
TASK_SHINGLES = 1 << 19
LEAST_PARTS = 256
#: Tasks that make whole sets, besides one for each ``TASK_SHINGLES``.
LEAST_TASKS = 12
#: Classes of a cluster's block; classes and shingles of a group of the matrix.
BLOCK = 512
GROUP = 64
GROUP_SHINGLES = 200_000
#: Cells of the dense part of the matrix that are open at once.
CELLS = 8_000_000
#: Words of 64 marks that say which ids are chosen.
MARK_WORDS = 1 << 20
#: Prefix shingles, as a share of the set, that linked sets must share in step 2.
SPARE = 0.15

_SALT = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in rising order, and how many each text has."""
    data = _LOWER[texts.data]
    starts, ends, of = texts.words()
    words = span_hashes(data, starts, ends)
    hashes, first = window_hashes(words, of, size)
    number = of[first]
    counts = np.bincount(of, minlength=texts.count)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        begin = np.searchsorted(of, short)
        whole = [
            np.bitwise_xor.reduce(mixed(words[b : b + c] + np.arange(c, dtype=np.uint64) * _SALT))
            for b, c in zip(begin.tolist(), counts[short].tolist(), strict=True)
        ]
        hashes = np.concatenate([hashes, mixed(np.array(whole, np.uint64))])
        number = np.concatenate([number, short])
    # a slice has fewer texts than 2**22
    order = np.argsort((number.astype(np.uint64) << np.uint64(42)) | (hashes >> np.uint64(22)))
    hashes, number = hashes[order], number[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (number[1:] != number[:-1])
    return hashes[fresh], np.bincount(number[fresh], minlength=texts.count)


def set_ids(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each set, never zero; zero for empty sets."""
    ids = np.zeros(len(sizes), np.uint64)
    there = np.flatnonzero(sizes)
    if len(there):
        first = (np.cumsum(sizes) - sizes)[there]
        total = np.add.reduceat(mixed(hashes ^ _SALT), first) + sizes[there].astype(np.uint64)
        ids[there] = np.maximum(mixed(total), np.uint64(1))
    return ids


class Threshold:
    """Sizes that follow from a similarity of at least ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def need(self, n):
        """Overlap of a set of ``n`` with any set it links with, at least."""
        return -(-self.num * n // self.den)

    def spare(self, n):
        return np.maximum(1, (SPARE * n).astype(np.int64))

    def head(self, n):
        """Prefix length at which linked sets share ``spare`` of the smaller one."""
        return np.minimum(n, n - self.need(n) + self.spare(n))


def packed(kind: np.dtype, values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """One binary for each stretch of ``values`` between neighbouring ``cuts``."""
    width = np.dtype(kind).itemsize
    data = np.ascontiguousarray(values, kind)
    return pa.Array.from_buffers(
        pa.large_binary(), len(cuts) - 1,
        [None, pa.py_buffer((cuts * width).astype(np.int64)), pa.py_buffer(data)],
    ).cast(pa.binary())


def unpacked(kind: np.dtype, column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(v for v in column.to_pylist() if v is not None), kind)


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    if not len(ordered):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]))


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)


def _parts(shingles: int) -> tuple[int, int]:
    """Tasks of an exchange and parts that are dealt over them."""
    tasks = max(1, -(-shingles // TASK_SHINGLES))
    return tasks, max(LEAST_PARTS, 8 * tasks)


def document_sets(documents: DataFrame, size: int, limit: Threshold) -> DataFrame:
    """``doc_id, n, sid, head``: the set's size and id; its prefix once for each id and task."""

    def run(batches):
        seen: set[int] = set()
        for piece in slices(batches):
            hashes, sizes = shingle_sets(Texts(piece.column(1)), size)
            ids = set_ids(hashes, sizes)
            first = np.cumsum(sizes) - sizes
            new = np.zeros(len(ids), bool)
            for k, sid in enumerate(ids.tolist()):
                if sid and sid not in seen:
                    seen.add(sid)
                    new[k] = True
            heads = np.where(new, limit.head(sizes), 0)
            place = np.arange(heads.sum()) - np.repeat(np.cumsum(heads) - heads, heads)
            taken = hashes[place + np.repeat(first, heads)]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0), pa.array(sizes), pa.array(ids.view(np.int64), mask=sizes == 0),
                    packed(np.uint64, taken, np.concatenate(([0], np.cumsum(heads)))),
                ],
                names=["doc_id", "n", "sid", "head"],
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n long, sid long, head binary"
    )


def _chunks(batches, owner: int, blob: int):
    """(owners, sizes, shingles) of about ``CHUNK`` shingles; an owner once a chunk."""
    owners: dict[int, bytes] = {}
    held = 0
    for batch in batches:
        for who, data in zip(batch.column(owner).to_pylist(), batch.column(blob).to_pylist(), strict=True):
            if data and who not in owners:
                owners[who] = data
                held += len(data) // 8
                if held >= CHUNK:
                    yield _chunk(owners)
                    owners, held = {}, 0
    if owners:
        yield _chunk(owners)


def _chunk(owners: dict[int, bytes]):
    sizes = np.array([len(v) // 8 for v in owners.values()])
    return np.array(list(owners), np.int64), sizes, np.frombuffer(b"".join(owners.values()), np.uint64)


def prefix_credits(sets: DataFrame, shingles: int) -> DataFrame:
    """``sid, credit``: at least as many prefix shingles as the set shares with other sets'.

    A chunk settles the shingles that several of its sets have; each shingle of a chunk is sent
    once, with its owner if it has just one there.
    """
    tasks, parts = _parts(shingles)

    def settle(batches):
        for owners, sizes, hashes in _chunks(batches, 0, 1):
            of = np.repeat(np.arange(len(owners)), sizes)
            order = np.argsort(hashes)
            hashes, of = hashes[order], of[order]
            cut = runs(hashes)
            many = np.diff(cut) > 1
            credit = np.bincount(of[np.repeat(many, np.diff(cut))], minlength=len(owners))
            key, who = hashes[cut[:-1]], np.where(many, 0, owners[of[cut[:-1]]])
            part = _part(key, parts)
            order = np.argsort(part, kind="stable")
            cut = runs(part[order])
            count = len(cut) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[order][cut[:-1]]), packed(np.uint64, key[order], cut),
                    packed(np.int64, who[order], cut), pa.nulls(count, pa.binary()),
                ],
                names=["part", "keys", "owners", "credits"],
            )
            some = np.flatnonzero(credit)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(part[0])], pa.int32()), pa.nulls(1, pa.binary()),
                    pa.array([owners[some].tobytes()]), pa.array([credit[some].tobytes()]),
                ],
                names=["part", "keys", "owners", "credits"],
            )

    def paid(who: np.ndarray, credit: np.ndarray) -> pa.RecordBatch:
        """Credits packed by the part of their set."""
        part = _part(mixed(who.view(np.uint64)), parts)
        order = np.argsort(part, kind="stable")
        cut = runs(part[order])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(part[order][cut[:-1]]),
                packed(np.int64, who[order], cut),
                packed(np.int64, credit[order], cut),
            ],
            names=["part", "sids", "credits"],
        )

    def meet(batches):
        keys, owners = [], []
        for batch in batches:
            local = np.array([c is not None for c in batch.column(3).to_pylist()])
            if local.any():
                mine = batch.filter(pa.array(local))
                yield paid(unpacked(np.int64, mine.column(2)), unpacked(np.int64, mine.column(3)))
            rest = batch.filter(pa.array(~local))
            keys.append(unpacked(np.uint64, rest.column(1)))
            owners.append(unpacked(np.int64, rest.column(2)))
        if keys:
            keys, owners = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(keys)
            keys, owners = keys[order], owners[order]
            cut = runs(keys)
            length = np.diff(cut)
            # an exact copy in another chunk is not another set
            differs = np.add.reduceat(owners != np.repeat(owners[cut[:-1]], length), cut[:-1]) if len(keys) else 0
            shared = np.repeat(differs > 0, length) & (owners != 0)
            who, credit = np.unique(owners[shared], return_counts=True)
            yield paid(who, credit)

    def add(batches):
        batches = list(batches)
        if batches:
            who = np.concatenate([unpacked(np.int64, b.column(1)) for b in batches])
            credit = np.concatenate([unpacked(np.int64, b.column(2)) for b in batches])
            sids, place = np.unique(who, return_inverse=True)
            total = np.zeros(len(sids), np.int64)
            np.add.at(total, place, credit)
            yield pa.RecordBatch.from_arrays([pa.array(sids), pa.array(total)], names=["sid", "credit"])

    return (
        sets.filter(F.length("head") > 0)
        .select("sid", "head")
        .mapInArrow(settle, "part int, keys binary, owners binary, credits binary")
        .repartition(tasks, "part")
        .mapInArrow(meet, "part int, sids binary, credits binary")
        .repartition(tasks, "part")
        .mapInArrow(add, "sid long, credit long")
    )


def whole_sets(documents: DataFrame, chosen: DataFrame, size: int, tasks: int) -> DataFrame:
    """Packed chunks ``chunk, sids, sizes, shingles`` of the chosen ``sid, doc_id``."""

    def run(batches):
        def sets():
            for piece in slices(batches, "text"):
                hashes, sizes = shingle_sets(Texts(piece.column(0)), size)
                ids = set_ids(hashes, sizes).view(np.int64)
                # of several rows with one id only the chosen set counts
                right = ids == piece.column(1).to_numpy()
                blobs = packed(np.uint64, hashes, np.concatenate(([0], np.cumsum(sizes))))
                yield pa.RecordBatch.from_arrays([pa.array(ids), blobs], names=["sid", "set"]).filter(
                    pa.array(right)
                )

        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 32
        for number, (owners, sizes, hashes) in enumerate(_chunks(sets(), 0, 1)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([task | number])]
                + [pa.array([x.tobytes()]) for x in (owners, sizes, hashes)],
                names=["chunk", "sids", "sizes", "shingles"],
            )

    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return (
        marked(texts, chosen)
        .filter("_marked")  # other texts are not shuffled
        .join(chosen, "doc_id")
        .select("text", "sid")
        .coalesce(tasks)
        .mapInArrow(run, "chunk long, sids binary, sizes binary, shingles binary")
    )


def marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` with ``_marked``: true for every row whose ``doc_id`` is in ``ids``, and few others.

    Marks are bits of at most ``MARK_WORDS`` words, a table bound at any size of the input; the
    more ids there are, the more other rows are marked.
    """
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(64 * MARK_WORDS))
    word, bit = F.shiftright(place, 6), F.expr("1L << pmod(xxhash64(cast(doc_id as long)), 64)")
    marks = ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word")
    marks = marks.agg(F.bit_or("_bit").alias("_bits"))
    hit = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    joined = rows.withColumn("_word", word).join(F.broadcast(marks), "_word", "left")
    return joined.withColumn("_marked", hit).drop("_word", "_bits")


def frequencies(chunks: DataFrame, shingles: int) -> DataFrame:
    """``chunk, keys, classes``: the chunk's shingles that two or more sets have, and how many."""
    tasks, parts = _parts(shingles)

    def count(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = np.sort(np.frombuffer(blob, np.uint64))
                cut = runs(hashes)
                keys, times = hashes[cut[:-1]], np.diff(cut)
                part = _part(keys, parts)
                order = np.argsort(part, kind="stable")
                cut = runs(part[order])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part[order][cut[:-1]]), pa.array(np.full(len(cut) - 1, chunk)),
                        packed(np.uint64, keys[order], cut), packed(np.uint32, times[order], cut),
                    ],
                    names=["part", "chunk", "keys", "classes"],
                )

    def add(batches):
        chunk, keys, times, sizes = [], [], [], []
        for batch in batches:
            chunk.append(batch.column(1).to_numpy())
            sizes += [len(v) // 8 for v in batch.column(2).to_pylist()]
            keys.append(unpacked(np.uint64, batch.column(2)))
            times.append(unpacked(np.uint32, batch.column(3)))
        if not chunk:
            return
        chunk, keys = np.repeat(np.concatenate(chunk), sizes), np.concatenate(keys)
        order = np.argsort(keys)
        cut = runs(keys[order])
        total = np.add.reduceat(np.concatenate(times)[order].astype(np.int64), cut[:-1])
        each = np.repeat(total, np.diff(cut))
        order, each = order[each > 1], each[each > 1]
        order2 = np.argsort(chunk[order], kind="stable")
        order, each = order[order2], each[order2]
        cut = runs(chunk[order])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(chunk[order][cut[:-1]]), packed(np.uint64, keys[order], cut),
                packed(np.uint32, np.minimum(each, 2**32 - 1), cut),
            ],
            names=["chunk", "keys", "classes"],
        )

    return (
        chunks.select("chunk", "shingles")
        .mapInArrow(count, "part int, chunk long, keys binary, classes binary")
        .repartition(tasks, "part")
        .mapInArrow(add, "chunk long, keys binary, classes binary")
    )


_LISTED = "sid long, n long, shared binary, a long, b long, part int, keys binary, owners binary"


def listed_sets(
    chunks: DataFrame, found: DataFrame, limit: Threshold, shingles: int, tasks: int
) -> DataFrame:
    """Three kinds of rows: sets that may link (``sid, n, shared``), edges between sets of a chunk
    that share a prefix shingle (``a, b``), and each prefix shingle of a chunk with one of its
    sets (``part, keys, owners``)."""
    _, parts = _parts(shingles)
    answers = found.groupBy("chunk").agg(F.collect_list(F.struct("keys", "classes")).alias("answers"))

    def one(row):
        sids = np.frombuffer(row["sids"], np.int64)
        sizes = np.frombuffer(row["sizes"], np.int64)
        hashes = np.frombuffer(row["shingles"], np.uint64)
        keys = np.frombuffer(b"".join(a["keys"] for a in row["answers"]), np.uint64)
        times = np.frombuffer(b"".join(a["classes"] for a in row["answers"]), np.uint32)
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        of = np.repeat(np.arange(len(sids)), sizes)
        there = keys[at] == hashes
        of, hashes, times = of[there], hashes[there], times[at[there]]
        have = np.bincount(of, minlength=len(sids))
        # single shingles come first in the order, so this is left of the prefix
        left = have - limit.need(sizes) + 1
        fine = left[of] > 0
        of, hashes, times = of[fine], hashes[fine], times[fine]
        order = np.lexsort((hashes, times, of))
        of, hashes = of[order], hashes[order]
        there = np.flatnonzero(left > 0)
        have = np.where(left > 0, have, 0)
        first = np.cumsum(have) - have
        prefix = np.arange(len(of)) - first[of] < left[of]
        key, who = hashes[prefix], sids[of[prefix]]
        order = np.lexsort((who, key))
        key, who = key[order], who[order]
        cut = runs(key)
        least = np.repeat(who[cut[:-1]], np.diff(cut))
        pairs = np.unique(np.stack([who, least], 1)[who != least], axis=0)
        key, who = key[cut[:-1]], who[cut[:-1]]
        part = _part(key, parts)
        order = np.argsort(part, kind="stable")
        cut = runs(part[order])
        lists = packed(np.uint64, hashes, np.concatenate((first[there], [len(hashes)])))
        yield _kinds(sid=pa.array(sids[there]), n=pa.array(sizes[there]), shared=lists)
        yield _kinds(a=pa.array(pairs[:, 0]), b=pa.array(pairs[:, 1]))
        yield _kinds(
            part=pa.array(part[order][cut[:-1]]),
            keys=packed(np.uint64, key[order], cut),
            owners=packed(np.int64, who[order], cut),
        )

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield from one(batch.slice(k, 1).to_pylist()[0])

    return (
        chunks.join(answers, "chunk")
        .select("sids", "sizes", "shingles", "answers")
        .coalesce(tasks)
        .mapInArrow(run, _LISTED)
    )


def _kinds(**given: pa.Array) -> pa.RecordBatch:
    count = len(next(iter(given.values())))
    kinds = {
        "sid": pa.int64(), "n": pa.int64(), "shared": pa.binary(), "a": pa.int64(), "b": pa.int64(),
        "part": pa.int32(), "keys": pa.binary(), "owners": pa.binary(),
    }
    return pa.RecordBatch.from_arrays(
        [given.get(n, pa.nulls(count, k)) for n, k in kinds.items()], names=list(kinds)
    )


def cluster_edges(listed: DataFrame, shingles: int) -> DataFrame:
    """``a, b``: the sets of one prefix shingle, over all chunks, hang on its least set."""
    tasks, _ = _parts(shingles)

    def meet(batches):
        keys, owners = [], []
        for batch in batches:
            keys.append(unpacked(np.uint64, batch.column(1)))
            owners.append(unpacked(np.int64, batch.column(2)))
        if keys:
            keys, owners = np.concatenate(keys), np.concatenate(owners)
            order = np.lexsort((owners, keys))
            keys, owners = keys[order], owners[order]
            cut = runs(keys)
            least = np.repeat(owners[cut[:-1]], np.diff(cut))
            pairs = np.unique(np.stack([owners, least], 1)[owners != least], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    across = (
        listed.filter("part is not null")
        .select("part", "keys", "owners")
        .repartition(tasks, "part")
        .mapInArrow(meet, "a long, b long")
    )
    return listed.filter("a is not null").select("a", "b").unionByName(across)


class Members:
    """Sets of one block, ordered so that similar ones are neighbours."""

    def __init__(self, sids, sizes, copies, blobs):
        lists = [np.frombuffer(b, np.uint64) for b in blobs]
        order = sorted(range(len(sids)), key=lambda k: (int(lists[k].min()), sids[k]))
        self.sids = np.array([sids[k] for k in order], np.int64)
        self.sizes = np.array([sizes[k] for k in order], np.int64)
        self.copies = np.array([copies[k] for k in order], np.int64)
        self.lists = [lists[k] for k in order]
        self.lengths = np.array([len(x) for x in self.lists])

    def groups(self):
        """Bounds of the groups."""
        begin, held = 0, 0
        for k, length in enumerate(self.lengths.tolist()):
            if k > begin and (k - begin >= GROUP or held + length > GROUP_SHINGLES):
                yield begin, k
                begin, held = k, 0
            held += length
        yield begin, len(self.lists)


def block_links(asking: Members, asked: Members, limit: Threshold):
    """Places (asking, asked) of the linked sets of two blocks, or of one with itself."""
    tokens = np.concatenate(asking.lists)
    of = np.repeat(np.arange(len(asking.lists)), asking.lengths)
    need = limit.need(asking.sizes)
    found = []
    for begin, end in asked.groups():
        members = np.concatenate(asked.lists[begin:end])
        union, place = np.unique(members, return_inverse=True)  # the group's row of the matrix
        at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
        hit = union[at] == tokens
        bound = np.bincount(of[hit], minlength=len(need))
        opened = np.flatnonzero(bound >= need)
        if asking is asked:
            opened = opened[opened < end - 1]  # later ones ask nobody here but earlier ones did
        if not len(opened):
            continue
        matrix = np.zeros((end - begin, len(union)), np.float32)
        matrix[np.repeat(np.arange(end - begin), asked.lengths[begin:end]), place] = 1
        hits_of, hits_at = of[hit], at[hit]
        step = max(1, CELLS // len(union))
        for k in range(0, len(opened), step):
            some = opened[k : k + step]
            row = np.full(len(need), -1)
            row[some] = np.arange(len(some))
            mine = row[hits_of] >= 0
            rows = np.zeros((len(some), len(union)), np.float32)
            rows[row[hits_of[mine]], hits_at[mine]] = 1
            both = (rows @ matrix.T).astype(np.int64)
            either = asking.sizes[some][:, None] + asked.sizes[None, begin:end] - both
            q, m = np.nonzero(limit.den * both >= limit.num * either)
            q, m = some[q], m + begin
            found.append(np.stack([q, m], 1)[q < m] if asking is asked else np.stack([q, m], 1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _forest(count: int, links: np.ndarray) -> np.ndarray:
    """The least place that each place is connected with."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[links[:, 0]], root[links[:, 1]])
        new = root.copy()
        np.minimum.at(new, links[:, 0], low)
        np.minimum.at(new, links[:, 1], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def linked_sets(members: DataFrame, limit: Threshold) -> DataFrame:
    """``a, b, links``: edges that connect what is linked, and copies that set ``a`` links with.

    ``members`` has ``cluster, i, j, side`` and the columns of a set; rows of one pair of blocks
    come together, sorted.
    """

    def one(rows):
        sides = [[r for r in rows if r["side"] == s] for s in (0, 1)]
        blocks = [
            Members(*([r[c] for r in side] for c in ("sid", "n", "copies", "shared"))) if side else None
            for side in sides
        ]
        alone = rows[0]["i"] == rows[0]["j"]
        if not alone and (blocks[0] is None or blocks[1] is None):
            return
        asking, asked = (blocks[0], blocks[0]) if alone else blocks
        links = block_links(asking, asked, limit)
        if not len(links):
            return
        if alone:
            sids, copies = asking.sids, asking.copies
        else:
            sids = np.concatenate([asking.sids, asked.sids])
            copies = np.concatenate([asking.copies, asked.copies])
            links = links + [0, len(asking.sids)]
        root = _forest(len(sids), links)
        total = np.zeros(len(sids), np.int64)
        np.add.at(total, links[:, 0], copies[links[:, 1]])
        np.add.at(total, links[:, 1], copies[links[:, 0]])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(sids[some]), pa.array(sids[root[some]]), pa.array(total[some])],
            names=["a", "b", "links"],
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

    return members.mapInArrow(run, "a long, b long, links long")


def block_pairs(sets: DataFrame, clusters: DataFrame, files: int) -> DataFrame:
    """The sets of every cluster, once for each pair of blocks in which their block takes part."""
    spark = sets.sparkSession
    sizes = clusters.groupBy(F.col("root").alias("cluster")).count()
    large = materialise(
        sizes.filter(F.col("count") > BLOCK).select(
            "cluster", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")
        ),
        "large",
        files,
    )
    placed = (
        clusters.withColumnRenamed("root", "cluster")
        .join(large, "cluster", "left")
        .select(F.col("node").alias("sid"), "cluster", F.coalesce("blocks", F.lit(1)).alias("blocks"))
        .withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    )
    ends = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(
            F.least("block", other).alias("i"), F.greatest("block", other).alias("j"),
            F.when(F.col("block") > other, 1).otherwise(0).alias("side"),
        ),
    )
    joined = sets.join(materialise(placed, "placed", files), "sid").withColumn("at", F.explode(ends))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        joined.select("cluster", "at.i", "at.j", "at.side", "sid", "n", "copies", "shared")
        .repartition(tasks, "cluster", "i", "j")
        .sortWithinPartitions("cluster", "i", "j")
    )


def classed_sets(documents: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n, sid`` of each row, and ``sid, component_id, n_links`` of each set."""
    limit = Threshold(num, den)
    sets = materialise(document_sets(documents, size, limit), "sets")
    classes = sets.filter("sid is not null").groupBy("sid", "n").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")
    )
    few = files_for(sets.count())
    classes = materialise(classes, "classes", few)
    shingles = int(classes.agg(F.sum("n")).collect()[0][0] or 0)
    need = F.ceil(F.col("n") * F.lit(num) / F.lit(den))
    asked = F.greatest(F.lit(1), F.floor(F.lit(SPARE) * need - F.lit(1e-6)))
    chosen = materialise(
        prefix_credits(sets, int(shingles * (1 - num / den + SPARE)))
        .join(classes, "sid")
        .filter((F.col("credit") >= asked) & F.col("doc_id").isNotNull())
        .select("sid", "doc_id", "n", "copies"),
        "chosen",
        few,
    )
    left = int(chosen.agg(F.sum("n")).collect()[0][0] or 0)
    tasks = LEAST_TASKS + left // TASK_SHINGLES
    chunks = materialise(whole_sets(documents, chosen.select("sid", "doc_id"), size, tasks), "chunks")
    listed = listed_sets(chunks, frequencies(chunks, left), limit, left, tasks)
    listed = materialise(listed, "listed")
    clusters = components(cluster_edges(listed, left), "clusters", few)
    lists = (
        listed.filter("sid is not null")
        .select("sid", "n", "shared")
        .join(chosen.select("sid", "copies"), "sid")
    )
    found = linked_sets(block_pairs(lists, clusters, few), limit)
    linked = materialise(found.repartition(few), "linked")
    roots = components(linked.select("a", "b"), "roots", few).withColumnRenamed("node", "sid")
    links = linked.groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("links"))
    known = classes.join(roots, "sid", "left").withColumn(
        "root", F.coalesce("root", "sid")
    )
    known = materialise(known.join(links, "sid", "left"), "known", few)
    first = known.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    first = materialise(first, "first", few)
    answer = materialise(
        known.join(first, "root").select(
            "sid", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
        ),
        "answer",
        few,
    )
    return sets.select("doc_id", "n", "sid"), answer


def jaccard_classes(
    documents: DataFrame, size: int = 4, num: int = 85, den: int = 100
) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links``, a row for each row of ``documents``.

    ``component_id`` is the smallest id reachable by links, ``n_links`` the number of other
    documents linked directly.
    """
    sets, answer = classed_sets(documents, size, num, den)
    return (
        sets.withColumnRenamed("n", "n_shingles")
        .join(answer, "sid", "left")
        .coalesce(files_for(sets.count()))
        .select(
            "doc_id", "n_shingles",
            F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        )
    )


def one_of_each(documents: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``documents`` less all but one, that with the smallest id, of each group.

    Only rows that may have to go are looked at again; the others are read and kept as they are.
    Rows without words are no group, and neither are rows without an id.
    """
    sets, answer = classed_sets(documents, size, num, den)
    rows = sets.filter("sid is not null and doc_id is not null").groupBy("doc_id", "sid").count()
    # of equal rows of the kept id one stays
    doubtful = rows.join(answer, "sid").select(
        "doc_id", "sid", (F.col("doc_id") == F.col("component_id")).alias("stays"), "count"
    )
    doubtful = doubtful.filter("not stays or count > 1")
    doubtful = materialise(doubtful, "doubtful", files_for(sets.count()))
    place = documents.columns.index("text")
    schema = StructType([*documents.schema.fields, StructField("_sid", LongType())])

    def run(batches):
        for piece in slices(batches):
            hashes, sizes = shingle_sets(Texts(piece.column(place)), size)
            ids = set_ids(hashes, sizes).view(np.int64)
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(ids)], names=schema.names)

    flagged = marked(documents, doubtful.select("doc_id"))
    looked = flagged.filter("_marked").drop("_marked").mapInArrow(run, schema)
    keys = doubtful.select(F.col("doc_id").alias("_id"), F.col("sid").alias("_key"), F.col("stays").alias("_stays"))
    judged = looked.join(
        keys, (looked["doc_id"].cast("long") == keys["_id"]) & (looked["_sid"] == keys["_key"]), "left"
    )
    free = judged.filter("_stays is null").select(*documents.columns)
    repeated = judged.filter("_stays").dropDuplicates(["_id", "_key"]).select(*documents.columns)
    return flagged.filter("not _marked").select(*documents.columns).unionByName(free).unionByName(repeated)
