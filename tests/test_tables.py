import pytest

from pathweave.functions.checks import find_by_name, repeated_keys, require_unique
from pathweave.operators import paths as path_ops
from pathweave.operators.genes import chain_blocks, interval_genes
from pathweave.operators.tables import (
    chromosome_table,
    family_table,
    gene_order_table,
    gene_table,
    latest,
    organism_table,
)
from pathweave.sources.annotation import (
    SCHEMAS,
    Annotation,
    jdbc_options,
    read_annotation,
)
from pathweave.sources.graph_tables import export_tables, link_tables, load_graph, read_tables

ROWS = {
    # Chromosomes 1 and 2, an unused chromosome 3, genes 10 to 14.
    "feature": [
        (1, 100, "chr1", "chr1", 900),
        (2, 101, "chr2", "chr2", 800),
        (3, 102, "chr3", "chr3", 700),
        *[(g, 100, f"g,{g}", f"g{g}", None) for g in range(10, 15)],
    ],
    "featureloc": [
        (1, 10, 1, 0, 9, 1),
        (2, 11, 1, 10, 19, -1),
        (3, 12, 1, 20, 29, 1),
        (4, 13, 2, 0, 9, 1),
        (5, 14, 2, 5, 6, 1),
        (6, 14, 2, 10, 19, 1),
    ],
    "gene_family_assignment": [
        (1, 10, "A"),
        (2, 11, "old"),
        (3, 11, "B"),
        (4, 13, "A"),
        (5, 14, "B"),
        (6, 99, "elsewhere"),
    ],
    "gene_order": [
        (1, 1, 10, 0),
        (2, 1, 11, 1),
        (3, 1, 12, 3),
        (4, 2, 13, 5),
        (5, 1, 14, 9),
        (6, 2, 14, 6),
    ],
    "organism": [(100, "Genus", "one"), (101, "Genus", "two"), (102, "Genus", "three")],
}


@pytest.fixture(scope="module")
def annotation(spark):
    return Annotation(
        **{name: spark.createDataFrame(ROWS[name], SCHEMAS[name]) for name in SCHEMAS}
    )


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tables(annotation):
    assert rows(gene_table(annotation)) == [
        (10, "g,10", 0, 9, 1, 0, "A", 1),
        (11, "g,11", 10, 19, -1, 1, "B", 1),
        (12, "g,12", 20, 29, 1, 3, "-1", 1),
        (13, "g,13", 0, 9, 1, 5, "A", 2),
        (14, "g,14", 10, 19, 1, 6, "B", 2),
    ]
    assert rows(family_table(annotation)) == [(f, f) for f in ("-1", "A", "B", "old")]
    assert rows(chromosome_table(annotation)) == [
        (1, "chr1", 900, 100),
        (2, "chr2", 800, 101),
    ]
    assert rows(organism_table(annotation)) == [
        (100, "Genus", "one"),
        (101, "Genus", "two"),
    ]


def test_gene_order_table_needs_no_names(annotation):
    columns = ["id", "number", "family", "chromosome"]
    found = gene_order_table(annotation)
    assert rows(found) == rows(gene_table(annotation).select(columns))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_strict_gene_table(spark, annotation):
    lost = Annotation(
        **{**annotation.tables(), "feature": annotation.feature.filter("feature_id <> 12")}
    )
    with pytest.raises(Exception, match="no feature for gene 12"):
        gene_table(lost).collect()
    assert (12, None) in [(r.id, r.name) for r in gene_table(lost, strict=False).collect()]


def test_paths_and_graph(annotation):
    # With two-number buckets, ranks and neighbours cross bucket borders.
    paths = path_ops.chromosome_paths(
        annotation.gene_order, annotation.gene_family_assignment, width=2
    )
    assert rows(paths) == [
        (1, 0, 0, 10, "A"),
        (1, 1, 1, 11, "B"),
        (1, 2, 3, 12, "gene:12"),
        (1, 3, 9, 14, "B"),
        (2, 0, 5, 13, "A"),
        (2, 1, 6, 14, "B"),
    ]
    assert rows(path_ops.undirected_edges(paths, width=2)) == [
        ("A", "B"),
        ("B", "gene:12"),
    ]
    ranked = path_ops.gene_paths(gene_table(annotation), width=2)
    edges = path_ops.directed_edges(ranked, width=1)
    assert rows(edges) == [("A", "B")]
    vertices = path_ops.family_vertices(paths.select("chromosome", "pos", "family"), width=2)
    assert rows(vertices) == [
        ("A", 1, 0, [0]),
        ("A", 2, 0, [0]),
        ("B", 1, 0, [1]),
        ("B", 1, 1, [3]),
        ("B", 2, 0, [1]),
        ("gene:12", 1, 1, [2]),
    ]
    some = vertices.filter("family <> 'B'")
    completed, _ = path_ops.family_graph(some, edges)
    assert ("B", None, None, None) in [tuple(r) for r in completed.collect()]


def test_export_and_load(spark, annotation, tmp_path):
    folder = str(tmp_path / "out")
    export_tables(annotation, folder)
    graph = load_graph(spark, folder)
    assert rows(graph.genes)[0] == ("10", "g,10", 0, 9, 1, 0, "A", "1")
    assert rows(graph.gene_to_chromosome) == [
        ("10", "1"), ("11", "1"), ("12", "1"), ("13", "2"), ("14", "2"),
    ]
    assert rows(graph.chromosome_to_organism) == [("1", "100"), ("2", "101")]
    assert len(rows(graph.gene_to_family)) == 5


def test_latest_row(spark):
    given = [(1, 5, "a", 10), (1, 7, None, None), (1, 6, "c", 12), (2, 1, "d", 13), (None, 3, "e", 14)]
    df = spark.createDataFrame(given, "k long, o long, t string, n int")
    want = [(1, None), (2, 13), (None, 14)]
    assert sorted(map(tuple, latest(df, ["k"], "o", ["n"]).collect()), key=str) == want
    texts = [(1, None, 7), (2, "d", 1), (None, "e", 3)]
    assert sorted(map(tuple, latest(df, ["k"], "o", ["t", "o"]).collect()), key=str) == texts
    twice = df.unionAll(df.filter("k = 2"))
    assert latest(twice, ["k"], "o", ["t"]).count() == latest(twice, ["k"], "o", ["n"]).count() == 3
    assert latest(df.limit(0), ["k"], "o", ["n"]).collect() == []


def test_gene_table_sorts_for_joins_only(annotation):
    plan = gene_table(annotation)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_loaded_ids_are_unique_within_a_kind(spark, annotation, tmp_path):
    export_tables(annotation, str(tmp_path / "out"))
    load_graph(spark, str(tmp_path / "out"))  # organism, chromosome and gene ids may be equal
    (tmp_path / "out" / "organisms" / "more.csv").write_text("id,genus,species\n100,Genus,again\n")
    with pytest.raises(ValueError, match="organism id '100' occurs 2 times"):
        load_graph(spark, str(tmp_path / "out"))


def test_load_of_odd_rows(spark, tmp_path):
    files = {
        "organisms": "id,genus,species\no1,G,s\n",
        "chromosomes": "id,name,length,organism\nc1,one,12,o1\nc2,two,x,o1\nc3,three,5,missing\n",
        "families": "id,name\nF,F\n",
        "genes": "id,name,fmin,fmax,strand,number,family,chromosome\n"
        "g1,a,1,2,1,0,F,c1\ng2,b,1,2,1,1,none,c1\ng3,c,1,2,1,0,F,c3\n",
    }
    for name, text in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.csv").write_text(text)
    graph = link_tables(read_tables(spark, str(tmp_path)))
    assert rows(graph.chromosomes) == [("c1", "one", 12, "o1"), ("c2", "two", None, "o1")]
    assert [r[0] for r in rows(graph.genes)] == ["g1"]
    assert rows(repeated_keys(graph.genes, "chromosome")) == []
    with pytest.raises(ValueError):
        require_unique(graph.chromosomes, "organism")


def test_read_annotation(spark, annotation, tmp_path):
    for name, df in annotation.tables().items():
        df.write.parquet(str(tmp_path / "p" / name))
        df.write.option("header", True).csv(str(tmp_path / "c" / name))
    for folder, source in (("p", "parquet"), ("c", "csv")):
        again = read_annotation(spark, str(tmp_path / folder), source)
        for name, df in again.tables().items():
            assert df.schema.simpleString() == SCHEMAS[name].simpleString()
            assert len(rows(df.fillna(0))) == len(ROWS[name])
    assert jdbc_options("feature", "jdbc:x", 3, 9, 4) == {
        "url": "jdbc:x",
        "dbtable": "feature",
        "partitionColumn": "feature_id",
        "lowerBound": "3",
        "upperBound": "10",
        "numPartitions": "4",
    }


def test_find_by_name(annotation):
    assert find_by_name(annotation.feature, "chr2") == 2
    with pytest.raises(LookupError):
        find_by_name(annotation.feature, "chr9")
    with pytest.raises(ValueError):
        find_by_name(annotation.feature, "not a name")
    with pytest.raises(ValueError):
        find_by_name(annotation.feature.union(annotation.feature), "chr2")


def test_chain_ends(spark, annotation):
    found = spark.createDataFrame(
        [(1, 2, "+", 0, 1, 5, 6), (1, 2, "-", 0, 2, 5, 6)],
        "ref_chr long, rel_chr long, orientation string, ref_start long, ref_end long, "
        "rel_start long, rel_end long",
    )
    genes = gene_table(annotation)
    ends = [r[:3] for r in rows(interval_genes(found, genes))]
    assert ends == [(1, 0, 10), (1, 1, 11), (2, 5, 13), (2, 6, 14)]
    # No gene of chromosome 1 has number 2.
    blocks = chain_blocks(found, genes).select("orientation", "start", "stop")
    assert rows(blocks) == [("+", 0, 19)]
    with pytest.raises(Exception, match="no gene at 1 2"):
        chain_blocks(found, genes, strict=True).collect()
