"""Merkle manifests against trees that are built in one list."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pathweave.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    values = [row[c] for c in FIELDS]
    if row["n_chars"] is not None:
        values[3] += more
    told = ["-" if v is None else str(v) for v in values]
    return digest("".join("-" if v is None else f"{len(t.encode())}:{t}" for v, t in zip(values, told)))


def climb(nodes):
    """The root, and for every node its proof as (side, sibling) pairs."""
    ways, owners = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        for k in range(len(nodes)):
            for o in owners[k]:
                if k ^ 1 < len(nodes):
                    ways[o].append(("left" if k & 1 else "right", nodes[k ^ 1]))
                else:
                    ways[o].append(("alone", ""))
        nodes = [digest("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]
        owners = [sum(owners[k : k + 2], []) for k in range(0, len(owners), 2)]
    return nodes[0], ways


def plain_audit(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for rs in trees.values():
        rs.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    subs = {x: climb([leaf(r) for r in trees[x]]) for x in langs}
    root, above = climb([subs[x][0] for x in langs])
    out = []
    for x, upper in zip(langs, above):
        for r, way in zip(trees[x], subs[x][1]):
            forged = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node = leaf(r, int(forged))
            for side, other in way + upper:
                node = digest(other + node if side == "left" else node + other)
            proof = digest("".join(other for _, other in way + upper))
            out.append((r["doc_id"], leaf(r), subs[x][0], root, proof, node, node == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def audited(documents):
    return sorted((tuple(r) for r in merkle.audit(documents).select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("bits", [10, 2])
def test_audit_equals_plain_trees(documents, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    clashing = documents.withColumns({c: F.lit(1) for c in ("tree", "place", "level", "segment", "hash", "root")})
    got = audited(clashing)
    assert got == plain_audit(documents.collect())
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("count", [1, 5])
def test_few_leaves_and_null_values(spark, count):
    rows = [(k, None if k == 2 else "é" * k, None, f"l{k % 2}" if k else None, None if k == 4 else 2**63 - 1) for k in range(count)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    assert audited(documents) == plain_audit(documents.collect())


def test_no_leaves(no_documents):
    assert merkle.audit(no_documents).collect() == []


def test_proofs_are_whole(spark):
    documents = spark.range(37).selectExpr("id AS doc_id", "'t' AS text", "'s' AS source", "'en' AS lang", "id AS n_chars")
    for r in merkle.proofs(documents).collect():
        way = merkle.steps(bytes(r["segment"]))
        assert len(way) == 6
        assert merkle.folded(bytes(r["leaf"]), way) == bytes(r["root"])
        assert merkle.folded(bytes(32), way) != bytes(r["root"])
