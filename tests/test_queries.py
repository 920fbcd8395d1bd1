import json
import random

import pytest
from models import chain_model, coverage_model, merge_model, run_model, sweep_model

from pathweave.operators.genes import region_genes, region_places
from pathweave.plans import queries as q
from pathweave.sources.annotation import SCHEMAS, Annotation
from pathweave.sources.documents import (
    gene_list_documents,
    region_documents,
    synteny_documents,
    write_documents,
    write_synteny,
)
from pathweave.sources.graph_tables import export_tables, load_graph


def build(seed=7, count=5):
    rng = random.Random(seed)
    return {
        i + 1: "".join(rng.choice("ABCDEF.") for _ in range(rng.randint(15, 30)))
        for i in range(count)
    }


PATHS = build()


def gene_id(chromosome, pos):
    return chromosome * 1000 + pos


def private(chromosome, path):
    return [f if f != "." else (chromosome, i) for i, f in enumerate(path)]


@pytest.fixture(scope="module")
def annotation(spark):
    genes = [(c, i, f) for c, path in PATHS.items() for i, f in enumerate(path)]
    rows = {
        "feature": [(c, c % 2, f"chr{c}", None, 5000) for c in PATHS]
        + [(gene_id(c, i), c % 2, f"g{c}.{i}", None, None) for c, i, _ in genes],
        "featureloc": [
            (gene_id(c, i), gene_id(c, i), c, 10 * i, 10 * i + 5, 1) for c, i, _ in genes
        ],
        "gene_family_assignment": [
            (gene_id(c, i), gene_id(c, i), f) for c, i, f in genes if f != "."
        ],
        "gene_order": [(gene_id(c, i), c, gene_id(c, i), i) for c, i, _ in genes],
        "organism": [(0, "Even", "e"), (1, "Odd", "o")],
    }
    return Annotation(
        **{name: spark.createDataFrame(rows[name], SCHEMAS[name]) for name in SCHEMAS}
    )


def hulls_of(ref, matched, intermediate):
    out = {}
    for rel in PATHS:
        if rel != ref:
            runs = run_model(private(ref, PATHS[ref]), private(rel, PATHS[rel]))
            out[rel] = merge_model(runs, intermediate, matched)
    return out


def regions_of(ref, matched, intermediate, support, mode):
    hulls = hulls_of(ref, matched, intermediate)
    if mode == "coverage":
        return coverage_model(hulls, support)
    return sweep_model([h for hs in hulls.values() for h in hs], support)


@pytest.mark.parametrize("mode", ["sweep", "coverage"])
def test_query_intervals(annotation, mode):
    found = q.query_intervals(annotation, None, 4, 1, 2, mode)
    got = sorted((r.ref_chr, r.start, r.end) for r in found.collect())
    want = sorted((c, *r) for c in PATHS for r in regions_of(c, 4, 1, 2, mode))
    assert got == want and want
    one = q.query_intervals(annotation, "chr3", 4, 1, 2, mode).collect()
    assert sorted((r.start, r.end) for r in one) == regions_of(3, 4, 1, 2, mode)


def test_query_genes(annotation):
    lists = q.query_genes(annotation, "chr2", 4, 1, 2)
    got = [r.genes for r in lists.orderBy("region_id").collect()]
    want = [
        [f"g2.{i}" for i in range(s, e + 1)] for s, e in regions_of(2, 4, 1, 2, "sweep")
    ]
    assert got == want and want
    documents = gene_list_documents(lists).collect()
    documents.sort(key=lambda r: r.region_id)
    assert [json.loads(r.document) for r in documents] == want


def test_long_regions_unfold_in_parts(spark, annotation):
    paths = q.written_paths(annotation)
    regions = spark.createDataFrame(
        [(1, 0, 1, 9)], "ref_chr long, region_id long, start long, end long"
    )
    named = region_genes(regions, paths, annotation.feature, width=4)
    assert [r.gene for r in named.orderBy("pos").collect()] == [f"g1.{i}" for i in range(1, 10)]


@pytest.mark.parametrize("width", [1, 3, 256])
def test_regions_meet_their_genes_only(spark, annotation, width):
    paths = q.written_paths(annotation)
    rng = random.Random(3)
    regions = [
        (c, i, *sorted((rng.randint(0, 40), rng.randint(0, 40)))) for c in [*PATHS, 99] for i in range(6)
    ] + [(1, 6, 5, 4), (2, 6, 1000, 10**9)]
    given = spark.createDataFrame(regions, "ref_chr long, region_id long, start long, end long")
    if width == 1:
        given = given.filter("end < 1000")
    got = sorted(tuple(r) for r in region_places(given, paths, width).collect())
    assert got == sorted(
        (c, i, p, gene_id(c, p))
        for c, i, start, end in regions
        for p in range(len(PATHS.get(c, "")))
        if start <= p <= end
    )


def test_names_travel_for_genes_in_regions_only(spark, annotation):
    paths = q.written_paths(annotation)
    regions = spark.createDataFrame(
        [(1, 0, 2, 3), (2, 0, 0, 0)], "ref_chr long, region_id long, start long, end long"
    )
    named = region_genes(regions, paths, annotation.feature)
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    assert sorted(r.gene for r in named.collect()) == ["g1.2", "g1.3", "g2.0"]


def test_bad_arguments(annotation):
    for matched, intermediate, support in ((0, 1, 1), (1, -1, 1), (1, 1, 0), ("x", 1, 1)):
        with pytest.raises(ValueError):
            q.query_intervals(annotation, "chr1", matched, intermediate, support)
    with pytest.raises(LookupError):
        q.query_intervals(annotation, "nowhere", 1, 1, 1)


def chains_of(ref, rel, intermediate, matched):
    pairs = [
        (i, j)
        for i, f in enumerate(PATHS[ref])
        for j, g in enumerate(PATHS[rel])
        if f == g and f != "."
    ]
    return {
        sign: chain_model(pairs, intermediate, matched, sign == "-") for sign in ("+", "-")
    }


def blocks_of(ref, rel):
    return sorted(
        (sign, 10 * c[0], 10 * c[1] + 5)
        for sign, found in chains_of(ref, rel, 2, 5).items()
        for c in found
    )


def test_macro_synteny(spark, annotation, tmp_path):
    blocks = q.macro_synteny(annotation, 2, "2", 5).persist()
    got = sorted((r.rel_chr, r.orientation, r.start, r.stop) for r in blocks.collect())
    want = sorted((rel, *b) for rel in PATHS if rel != 2 for b in blocks_of(2, rel))
    assert got == want and want
    shown = synteny_documents(blocks)
    assert {(r.ref_chr, r.ref_name, r.ref_length) for r in shown.collect()} == {(2, "chr2", 5000)}
    write_synteny(shown, str(tmp_path / "doc"))
    (file,) = (tmp_path / "doc" / "ref_chr=2").glob("part-*")
    document = json.loads(file.read_text())
    assert (document["chromosome"], document["length"]) == ("chr2", 5000)
    assert document["tracks"] == [
        json.loads(r.document) for r in sorted(shown.collect(), key=lambda r: r.rel_chr)
    ]
    tracks = {t["chromosome"]: t for t in document["tracks"]}
    for rel in PATHS:
        expected = blocks_of(2, rel) if rel != 2 else []
        if not expected:
            assert f"chr{rel}" not in tracks
            continue
        track = tracks[f"chr{rel}"]
        assert track["genus"] == ("Odd" if rel % 2 else "Even")
        assert [(b["orientation"], b["start"], b["stop"]) for b in track["blocks"]] == expected
    assert sum(len(t["blocks"]) for t in document["tracks"]) == len(want)
    write_documents(shown, str(tmp_path / "rows"))
    again = spark.read.schema(shown.schema).json(str(tmp_path / "rows"))
    assert sorted(again.collect()) == sorted(shown.collect())
    export_tables(annotation, str(tmp_path / "csv"))
    loaded = q.graph_synteny(load_graph(spark, str(tmp_path / "csv")), "2", 2, 5)
    again = sorted((int(r.rel_chr), r.orientation, r.start, r.stop) for r in loaded.collect())
    assert again == want


def test_batch_arguments_fall_back(annotation):
    # What does not parse becomes the default, which is stricter here.
    default = q.macro_synteny(annotation, 2, "five", None).count()
    assert default == sum(
        len(found)
        for rel in PATHS
        if rel != 2
        for found in chains_of(2, rel, 5, 10).values()
    )


def test_region_documents(spark):
    regions = spark.createDataFrame(
        [(1, 0, 2, 5), (1, 1, 7, 9), (2, 0, 1, 1)],
        "ref_chr long, region_id long, start long, end long",
    )
    got = {(r.ref_chr, r.region_id): r.document for r in region_documents(regions).collect()}
    assert got == {(1, 0): "[2,5]", (1, 1): "[7,9]", (2, 0): "[1,1]"}
    lists = spark.createDataFrame([(1, 0, ["a", 'b"'])], "ref_chr long, region_id long, genes array<string>")
    assert gene_list_documents(lists).first().document == '["a","b\\""]'
