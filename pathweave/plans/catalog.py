"""Every operator as a query over the given tables, with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ByteType, IntegerType, ShortType

from pathweave.functions.checks import find_by_name, repeated_keys
from pathweave.operators.anchors import (
    PAIR,
    PairRows,
    anchors,
    family_positions,
    pair_totals,
    path_positions,
    query_families,
    relatives,
)
from pathweave.operators.chains import chain_scores, chains
from pathweave.operators.genes import interval_genes, region_genes, track_organisms
from pathweave.operators.paths import (
    chromosome_paths,
    directed_edges,
    family_graph,
    family_vertices,
    gene_paths,
    undirected_edges,
)
from pathweave.operators.runs import (
    diagonal_runs,
    exact_runs,
    island_sizes,
    merged_runs,
    piece_totals,
    relative_pieces,
)
from pathweave.operators.segments import (
    SEGMENT,
    linked_anchors,
    near_positions,
    sizes_of_segments,
)
from pathweave.operators.support import support_regions
from pathweave.operators.tables import (
    NULL_FAMILY,
    chromosome_table,
    family_table,
    gene_order_table,
    gene_table,
    organism_table,
)
from pathweave.plans import oracle as sql
from pathweave.plans.queries import (
    macro_synteny,
    query_gene_rows,
    query_genes,
    query_intervals,
)
from pathweave.session import materialise, table_path
from pathweave.sources.documents import (
    gene_list_documents,
    region_documents,
    synteny_documents,
    write_documents,
)
from pathweave.sources.annotation import SCHEMAS, Annotation, read_annotation
from pathweave.sources.graph_tables import GeneGraph, export_tables, link_tables, load_graph
from pathweave.sources.sample_tables import (
    event_annotation,
    line_annotation,
    table,
    word_positions,
)

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered queries.
SPARSE = {"intermediate": 10, "matched": 4}
DENSE = {"intermediate": 5, "matched": 10}
DIAGONAL = {"intermediate": 2, "matched": 2}
SUPPORT = 8
INTERVALS = {"matched": 2, "intermediate": 10, "support": 8}
# So few anchors to a task that pairs of chromosomes are cut into blocks and strips.
SMALL_BLOCK = 500
# Rows of a packed CSV file.
CSV_ROWS = 2_000_000
LINE_QUERY = "Supplier.000000001"

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(build: Query) -> Query:
        def widened(spark: SparkSession, folder: str) -> DataFrame:
            return _long(build(spark, folder))

        QUERIES[build.__name__] = widened
        if oracle is not None:
            ORACLES[build.__name__] = oracle
        return build

    return register


def _long(df: DataFrame) -> DataFrame:
    small = (ByteType, ShortType, IntegerType)
    return df.select(
        *[
            F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, small) else f.name
            for f in df.schema.fields
        ]
    )


def _bigint(columns: list[str]) -> str:
    return ", ".join(f'CAST({c} AS BIGINT) AS "{c}"' for c in columns)


def _line_genes(spark: SparkSession, folder: str, dense: bool = False) -> DataFrame:
    return gene_table(line_annotation(spark, folder, dense))


def _line_positions(spark: SparkSession, folder: str, dense: bool = False) -> DataFrame:
    return family_positions(gene_order_table(line_annotation(spark, folder, dense)))


def _listed_line_positions(spark: SparkSession, folder: str) -> DataFrame:
    """For operators that lay positions out as lists, which hold each once."""
    return family_positions(gene_order_table(line_annotation(spark, folder)), distinct=False)


def _named_line_positions(
    spark: SparkSession, folder: str, dense: bool = False
) -> tuple[DataFrame, int]:
    """Positions, and the id of the query chromosome looked up by its name."""
    annotation = line_annotation(spark, folder, dense)
    return (
        family_positions(gene_order_table(annotation)),
        find_by_name(annotation.feature, LINE_QUERY),
    )


# Tables


@query(
    f"WITH {sql.LINES} SELECT {_bigint(['id'])}, name, "
    f"{_bigint(['fmin', 'fmax', 'strand', 'number'])}, family, {_bigint(['chromosome'])} FROM genes"
)
def gene_rows(spark, folder):
    return _line_genes(spark, folder)


@query(f"WITH {sql.LINES} SELECT family AS id, family AS name FROM genes UNION SELECT '-1', '-1'")
def family_rows(spark, folder):
    return family_table(line_annotation(spark, folder))


@query(f"WITH {sql.LINES} SELECT id, name, length, organism FROM chromosomes")
def chromosome_rows(spark, folder):
    return chromosome_table(line_annotation(spark, folder))


@query(f"WITH {sql.LINES} SELECT id, genus, species FROM organisms")
def organism_rows(spark, folder):
    return organism_table(line_annotation(spark, folder))


@query(
    f"""WITH {sql.LINES},
linked AS (SELECT * FROM chromosomes WHERE organism IN (SELECT id FROM organisms)),
kept AS (SELECT * FROM genes WHERE family <> '-1' AND chromosome IN (SELECT id FROM linked))
SELECT 'chromosome_to_organism' AS kind, CAST(id AS VARCHAR) AS src, CAST(organism AS VARCHAR) AS dst FROM linked
UNION ALL SELECT 'gene_to_family', CAST(id AS VARCHAR), family FROM kept
UNION ALL SELECT 'gene_to_chromosome', CAST(id AS VARCHAR), CAST(chromosome AS VARCHAR) FROM kept"""
)
def graph_load_inner(spark, folder):
    """Genes of the null family find no family here and make nothing."""
    annotation = line_annotation(spark, folder)
    graph = link_tables(
        {
            "organisms": organism_table(annotation),
            "chromosomes": chromosome_table(annotation),
            "families": family_table(annotation).filter(F.col("id") != NULL_FAMILY),
            "genes": gene_table(annotation),
        }
    )
    return _typed_edges(graph)


def _typed_edges(graph: GeneGraph) -> DataFrame:
    def edges(kind: str) -> DataFrame:
        df = getattr(graph, kind)
        return df.select(
            F.lit(kind).alias("kind"),
            F.col("src").cast("string").alias("src"),
            F.col("dst").cast("string").alias("dst"),
        )

    return (
        edges("chromosome_to_organism")
        .unionByName(edges("gene_to_family"))
        .unionByName(edges("gene_to_chromosome"))
    )


def _through_files(spark: SparkSession, folder: str, kind: str) -> Annotation:
    """The five mapped annotation tables, written as files and read with ``read_annotation``."""
    target = table_path(spark, f"annotation-{kind}")
    annotation = line_annotation(spark, folder)
    for name in SCHEMAS:
        writer = getattr(annotation, name).write
        path = f"{target}/{name}"
        if kind == "csv":
            # packed files are read whole, so none may be large
            writer = writer.option("compression", "gzip").option("maxRecordsPerFile", CSV_ROWS)
            writer.option("header", True).csv(path)
        else:
            writer.parquet(path)
    return read_annotation(spark, target, kind)


_GENE_TABLE = (
    f"WITH {sql.LINES} SELECT {_bigint(['id'])}, name, "
    f"{_bigint(['fmin', 'fmax', 'strand', 'number'])}, family, {_bigint(['chromosome'])} FROM genes"
)


@query(_GENE_TABLE)
def gene_rows_of_parquet(spark, folder):
    return gene_table(_through_files(spark, folder, "parquet"))


@query(_GENE_TABLE)
def gene_rows_of_csv(spark, folder):
    return gene_table(_through_files(spark, folder, "csv"))


@query(
    f"""WITH {sql.LINES} SELECT CAST(id AS VARCHAR) AS id, name, {_bigint(['fmin', 'fmax', 'strand', 'number'])},
family, CAST(chromosome AS VARCHAR) AS chromosome FROM genes"""
)
def export_and_load(spark, folder):
    target = table_path(spark, "export")
    export_tables(line_annotation(spark, folder), target)
    return load_graph(spark, target).genes


@query(
    """SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id,
count(*) AS occurrences FROM lineitem GROUP BY 1 HAVING count(*) > 1"""
)
def repeated_ids(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id")
    )
    return repeated_keys(lines)


# Paths and graph


@query(
    f"""WITH {sql.LINES} SELECT chromosome, {_bigint(['number'])}, number AS pos, id AS gene_id,
CASE WHEN family = '-1' THEN 'gene:' || id ELSE family END AS family FROM genes"""
)
def line_paths(spark, folder):
    annotation = line_annotation(spark, folder)
    return chromosome_paths(annotation.gene_order, annotation.gene_family_assignment)


@query(
    f"""WITH {sql.EVENTS} SELECT chromosome, pos, pos AS number, event_id AS gene_id, family
FROM event_order"""
)
def event_paths(spark, folder):
    annotation = event_annotation(spark, folder)
    return chromosome_paths(annotation.gene_order, annotation.gene_family_assignment)


@query(
    f"""WITH {sql.EVENTS} SELECT family, chromosome, CAST(pos // 65536 AS BIGINT) AS chunk,
string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
FROM event_order GROUP BY 1, 2, 3"""
)
def vertices_of_families(spark, folder):
    return family_vertices(path_positions(event_paths(spark, folder))).withColumn(
        "positions", F.concat_ws(",", F.col("positions").cast("array<string>"))
    )


@query(
    f"""WITH {sql.LINES} SELECT family, chromosome, CAST(number // 65536 AS BIGINT) AS chunk,
string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) AS positions
FROM genes WHERE family <> '-1' GROUP BY 1, 2, 3"""
)
def vertices_by_number(spark, folder):
    return family_vertices(_line_positions(spark, folder)).withColumn(
        "positions", F.concat_ws(",", F.col("positions").cast("array<string>"))
    )


@query(
    f"""WITH {sql.LINES} SELECT DISTINCT lag_family AS src, family AS dst FROM (
SELECT family, number, lag(family) OVER w AS lag_family, lag(number) OVER w AS lag_number
FROM genes WINDOW w AS (PARTITION BY chromosome ORDER BY number)) WHERE lag_number = number - 1"""
)
def adjacency_directed(spark, folder):
    return directed_edges(gene_paths(_line_genes(spark, folder)))


@query(
    f"""WITH {sql.LINES}, path AS (
SELECT chromosome, number, CASE WHEN family = '-1' THEN 'gene:' || id ELSE family END AS family FROM genes)
SELECT DISTINCT least(f, family) AS src, greatest(f, family) AS dst FROM (
SELECT family, lag(family) OVER (PARTITION BY chromosome ORDER BY number) AS f FROM path)
WHERE f IS NOT NULL"""
)
def adjacency_undirected(spark, folder):
    return undirected_edges(line_paths(spark, folder))


@query(
    f"""WITH {sql.EVENTS},
edges AS (SELECT DISTINCT least(f, family) AS src, greatest(f, family) AS dst FROM (
  SELECT family, lag(family) OVER (PARTITION BY chromosome ORDER BY pos) AS f FROM event_order)
  WHERE f IS NOT NULL),
ends AS (SELECT src AS family FROM edges UNION ALL SELECT dst FROM edges WHERE dst <> src),
degree AS (SELECT family, count(*) AS edges FROM ends GROUP BY family)
SELECT e.family, count(DISTINCT chromosome) AS chromosomes, count(*) AS places, any_value(edges) AS edges
FROM event_order e JOIN degree d ON d.family = e.family GROUP BY e.family"""
)
def graph_of_families(spark, folder):
    """Each family's chromosomes, places and neighbour families (itself among them)."""
    paths = event_paths(spark, folder)
    vertices, edges = family_graph(
        family_vertices(path_positions(paths)), undirected_edges(paths)
    )
    per_family = vertices.groupBy("family").agg(
        F.count_distinct("chromosome").alias("chromosomes"),
        F.sum(F.size("positions")).alias("places"),
    )
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("family"))
    degree = ends.groupBy("family").agg(F.count(F.lit(1)).alias("edges"))
    return per_family.join(degree, "family")


# Anchors


@query(
    f"WITH {sql.LINES} SELECT DISTINCT r.chromosome AS ref_chr, l.chromosome AS rel_chr "
    "FROM (SELECT DISTINCT chromosome, family FROM genes WHERE family <> '-1') r "
    "JOIN (SELECT DISTINCT chromosome, family FROM genes WHERE family <> '-1') l "
    "ON r.family = l.family AND r.chromosome <> l.chromosome"
)
def all_relatives(spark, folder):
    return relatives(_line_positions(spark, folder))


_NAMED = f"(SELECT id FROM chromosomes WHERE name = '{LINE_QUERY}')"


@query(
    f"""WITH {sql.LINES} SELECT DISTINCT q.id AS ref_chr, chromosome AS rel_chr
FROM genes, {_NAMED} q WHERE chromosome <> q.id AND family IN (
SELECT family FROM genes WHERE chromosome = q.id AND family <> '-1')"""
)
def relatives_of_query(spark, folder):
    return relatives(*_named_line_positions(spark, folder))


@query(
    f"""WITH {sql.LINES} SELECT DISTINCT chromosome, number AS pos, family FROM genes
WHERE family <> '-1' AND family IN (SELECT family FROM genes WHERE chromosome = {_NAMED})"""
)
def families_of_query(spark, folder):
    return query_families(*_named_line_positions(spark, folder))


@query(
    f"""WITH {sql.LINE_ANCHORS} SELECT rc AS ref_chr, lc AS rel_chr, rp AS ref_pos, lp AS rel_pos
FROM anchors WHERE rc = {_NAMED}"""
)
def anchors_of_query(spark, folder):
    return anchors(*_named_line_positions(spark, folder))


@query(
    f"""WITH {sql.LINE_ANCHORS} SELECT rc AS ref_chr, lc AS rel_chr, count(*) AS anchors,
{_bigint(['sum(rp)', 'sum(lp)', 'sum(rp * lp)']).replace('"sum(rp)"', 'refs').replace('"sum(lp)"', 'rels').replace('"sum(rp * lp)"', 'products')}
FROM anchors GROUP BY 1, 2"""
)
def anchor_totals(spark, folder):
    return pair_totals(anchors(_listed_line_positions(spark, folder), together=True))


@query("WITH " + sql.LINE_ANCHORS + sql.segments(SPARSE["intermediate"] + 1))
def anchor_segments(spark, folder):
    """Segments of all pairs, with the anchors and the ends of each."""
    reach = SPARSE["intermediate"] + 1
    return sizes_of_segments(_listed_line_positions(spark, folder), reach).drop(*SEGMENT[2:])


@query("WITH " + sql.LINE_ANCHORS + sql.linked(SPARSE["intermediate"] + 1))
def anchors_with_neighbours(spark, folder):
    """Found from neighbours on each chromosome, so that the other anchors are never made."""
    near = near_positions(_line_positions(spark, folder), SPARSE["intermediate"] + 1)
    return linked_anchors(materialise(near, "near"), ("+", "-"))


# Chains

_CHAINS = "WITH RECURSIVE " + sql.LINE_ANCHORS
_BOTH = _CHAINS + sql.both_chains(**SPARSE)


@query(
    _CHAINS
    + sql.chains_from_anchors(**SPARSE, reverse=False, name="fwd")
    + sql.chain_rows("fwd", "+")
)
def chains_forward(spark, folder):
    return chains(_line_positions(spark, folder), **SPARSE, orientations=("+",))


@query(
    _CHAINS
    + sql.chains_from_anchors(**SPARSE, reverse=True, name="rev")
    + sql.chain_rows("rev", "-")
)
def chains_reverse(spark, folder):
    return chains(_line_positions(spark, folder), **SPARSE, orientations=("-",))


@query(
    _CHAINS
    + sql.chains_from_anchors(**SPARSE, reverse=False, name="fwd")
    + sql.chain_rows("fwd", "+")
)
def chains_in_blocks(spark, folder):
    """Forward chains with so few anchors to a task that the largest pairs are cut into segments."""
    return chains(_line_positions(spark, folder), **SPARSE, orientations=("+",), block_anchors=40)


def _score_rows(name: str) -> str:
    return (
        "SELECT rc AS ref_chr, lc AS rel_chr, rp AS ref_pos, lp AS rel_pos, s AS score, "
        f"prp AS ptr_ref, plp AS ptr_rel FROM {name}_ptr"
    )


@query(
    _CHAINS
    + sql.chains_from_anchors(**SPARSE, reverse=False, name="fwd")
    + _score_rows("fwd")
)
def chain_scores_forward(spark, folder):
    return chain_scores(_line_positions(spark, folder), SPARSE["intermediate"])


@query(
    _CHAINS
    + sql.chains_from_anchors(**SPARSE, reverse=True, name="rev")
    + _score_rows("rev")
)
def chain_scores_reverse(spark, folder):
    positions = _line_positions(spark, folder)
    return chain_scores(positions, SPARSE["intermediate"], orientation="-")


@query()
def chains_dense(spark, folder):
    """Chains per pair of the dense families, counted by orientation."""
    found = chains(_line_positions(spark, folder, dense=True), **DENSE)
    return found.groupBy(*PAIR, "orientation").agg(
        F.count(F.lit(1)).alias("chains"),
        F.sum(F.col("ref_end") - F.col("ref_start") + 1).alias("ref_span"),
        F.sum(F.col("rel_end") - F.col("rel_start") + 1).alias("rel_span"),
    )


@query(sql.passages(words=3, matched=10))
def shared_passages(spark, folder):
    return chains(word_positions(spark, folder), 0, 10, orientations=("+",))


@query()
def shared_passages_gapped(spark, folder):
    return chains(word_positions(spark, folder), **DENSE)


# Synteny


@query(
    _BOTH
    + """SELECT DISTINCT g.chromosome, g.number, g.id, CAST(g.strand AS BIGINT) AS strand, g.name, g.fmin, g.fmax
FROM genes g JOIN (
SELECT ref_chr AS c, ref_start AS n FROM chains UNION SELECT ref_chr, ref_end FROM chains
UNION SELECT rel_chr, rel_start FROM chains UNION SELECT rel_chr, rel_end FROM chains) e
ON g.chromosome = e.c AND g.number = e.n"""
)
def genes_at_chain_ends(spark, folder):
    genes = materialise(_line_genes(spark, folder), "genes")
    return interval_genes(chains(family_positions(genes), **SPARSE), genes)


@query(
    f"""WITH {sql.LINES} SELECT c.id AS chromosome, c.name, c.length, o.genus, o.species
FROM chromosomes c JOIN organisms o ON o.id = c.organism"""
)
def organisms_of_tracks(spark, folder):
    annotation = line_annotation(spark, folder)
    return track_organisms(chromosome_table(annotation), organism_table(annotation))


_BLOCK_ROWS = """SELECT ref_chr, rel_chr, orientation, ref_start, ref_end, rel_start, rel_end,
s.fmin AS start, e.fmax AS stop, q.name AS ref_name, q.length AS ref_length,
t.name AS chromosome, o.genus, o.species
FROM chains JOIN genes s ON s.chromosome = ref_chr AND s.number = ref_start
JOIN genes e ON e.chromosome = ref_chr AND e.number = ref_end
JOIN chromosomes q ON q.id = ref_chr JOIN chromosomes t ON t.id = rel_chr
JOIN organisms o ON o.id = t.organism"""


@query(_BOTH + _BLOCK_ROWS)
def synteny_block_rows(spark, folder):
    return macro_synteny(line_annotation(spark, folder), **SPARSE)


@query(
    _BOTH
    + """, blocks AS (
SELECT ref_chr, rel_chr, q.name AS ref_name, q.length, t.name, o.genus, o.species, orientation,
  s.fmin AS start, e.fmax AS stop, ref_end, rel_start, rel_end
FROM chains JOIN genes s ON s.chromosome = ref_chr AND s.number = ref_start
JOIN genes e ON e.chromosome = ref_chr AND e.number = ref_end
JOIN chromosomes q ON q.id = ref_chr JOIN chromosomes t ON t.id = rel_chr
JOIN organisms o ON o.id = t.organism),
tracks AS (
SELECT ref_chr, rel_chr, ref_name, length, '{"genus":"' || genus || '","species":"' || species ||
  '","chromosome":"' || name || '","blocks":[' ||
  string_agg('{"start":' || start || ',"stop":' || stop || ',"orientation":"' || orientation || '"}', ','
    ORDER BY orientation, start, stop, ref_end, rel_start, rel_end) || ']}' AS track
FROM blocks GROUP BY ref_chr, rel_chr, ref_name, length, genus, species, name)
SELECT ref_chr, ref_name, length AS ref_length, rel_chr, track AS document FROM tracks"""
)
def synteny_json(spark, folder):
    blocks = macro_synteny(line_annotation(spark, folder), **SPARSE)
    return synteny_documents(materialise(blocks, "blocks"))


@query(
    "WITH RECURSIVE "
    + sql.DENSE_ANCHORS.format(name=LINE_QUERY)
    + sql.both_chains(**DENSE)
    + _BLOCK_ROWS
)
def synteny_of_query_dense(spark, folder):
    annotation = line_annotation(spark, folder, dense=True)
    named = find_by_name(annotation.feature, LINE_QUERY)
    return macro_synteny(annotation, named, **DENSE)


# Runs, merge and support


@query(
    f"""WITH {sql.EVENTS} SELECT r.chromosome AS ref_chr, l.chromosome AS rel_chr, count(*) AS matched
FROM event_order r JOIN event_order l ON r.family = l.family AND r.chromosome <> l.chromosome
GROUP BY 1, 2"""
)
def run_coverage(spark, folder):
    """Every anchor lies in one run, so run lengths add up to the anchors."""
    positions = path_positions(event_paths(spark, folder))
    return (
        exact_runs(positions)
        .groupBy(*PAIR)
        .agg(F.sum(F.col("ref_end") - F.col("ref_start") + 1).alias("matched"))
    )


_RUNS = "WITH RECURSIVE " + sql.LINE_ANCHORS + sql.runs()
_RUN_ROWS = """SELECT rc AS ref_chr, lc AS rel_chr, rs AS ref_start, ls AS rel_start, re AS ref_end, le AS rel_end
FROM runs"""


@query(_RUNS + _RUN_ROWS + " WHERE re > rs")
def long_runs(spark, folder):
    """Runs of at least two positions between suppliers."""
    positions = path_positions(line_paths(spark, folder))
    return exact_runs(positions, ranks=2).filter("ref_end > ref_start")


@query(_RUNS + _RUN_ROWS)
def all_runs(spark, folder):
    return exact_runs(path_positions(line_paths(spark, folder)))


@query(_RUNS + _RUN_ROWS)
def all_runs_in_strips(spark, folder):
    """The same with pairs so small to a task that the largest are cut."""
    return exact_runs(path_positions(line_paths(spark, folder)), block_anchors=SMALL_BLOCK)


@query("WITH " + sql.LINE_ANCHORS + sql.ISLANDS)
def run_islands(spark, folder):
    """Stretches of consecutive reference ranks with anchors, which no run leaves."""
    return island_sizes(path_positions(line_paths(spark, folder)))


def _diagonals(spark: SparkSession, folder: str, merge: bool = False) -> DataFrame | PairRows:
    """Stretches of one diagonal, to be cut where they are made, or with ``merge`` those it can keep."""
    wanted = (DIAGONAL["intermediate"], DIAGONAL["matched"]) if merge else None
    positions = _listed_line_positions(spark, folder)
    return diagonal_runs(positions, merge=wanted, together=not merge)


@query(sql.merged_diagonals(**DIAGONAL))
def run_merge(spark, folder):
    return merged_runs(materialise(_diagonals(spark, folder, merge=True), "runs"), **DIAGONAL)


@query(sql.merge_pieces(DIAGONAL["intermediate"]))
def merge_pieces(spark, folder):
    """Pieces of the runs of each pair between which nothing merges."""
    pieces = relative_pieces(_diagonals(spark, folder), DIAGONAL["intermediate"])
    return piece_totals(pieces).drop("piece")


@query(sql.merged_diagonals(**DIAGONAL))
def run_merge_in_strips(spark, folder):
    """The merge with so few runs to a task that pairs are cut, and long pieces once more."""
    runs = materialise(_diagonals(spark, folder, merge=True), "runs")
    return merged_runs(runs, **DIAGONAL, runs_per_task=100)


_HULLS = _BOTH + """, hulls AS (
SELECT ref_chr AS c, rel_chr AS l, ref_start AS s, ref_end AS t FROM chains)
"""
_REGIONS = f"SELECT ref_chr, {_bigint(['region_id'])}, start, \"end\" FROM regions"


def _hulls(spark: SparkSession, folder: str) -> DataFrame:
    """Chains of both orientations, as given hulls for the support operators."""
    return chains(_line_positions(spark, folder), **SPARSE)


@query(_HULLS + sql.sweep(SUPPORT) + _REGIONS)
def support_sweep(spark, folder):
    return support_regions(_hulls(spark, folder), SUPPORT)


@query(_HULLS + sql.coverage(SUPPORT) + _REGIONS)
def support_coverage(spark, folder):
    return support_regions(_hulls(spark, folder), SUPPORT, "coverage")


@query(
    _HULLS
    + sql.coverage(SUPPORT)
    + """SELECT ref_chr, CAST(region_id AS BIGINT) AS region_id, number AS pos, name AS gene
FROM regions JOIN genes ON chromosome = ref_chr AND number BETWEEN start AND "end\""""
)
def genes_of_regions(spark, folder):
    annotation = line_annotation(spark, folder)
    regions = support_regions(_hulls(spark, folder), SUPPORT, "coverage")
    return region_genes(regions, line_paths(spark, folder), annotation.feature)


# The support pipeline over the suppliers' lines, from anchors on.

_OF_QUERY = (
    "WITH RECURSIVE "
    + sql.LINE_ANCHORS.replace("r.c <> l.c)", f"r.c <> l.c WHERE r.c = {_NAMED})")
    + sql.runs()
    + sql.merged(INTERVALS["intermediate"], INTERVALS["matched"])
)
_OF_ALL = _RUNS + sql.merged(INTERVALS["intermediate"], INTERVALS["matched"])
_GENE_ROWS = """SELECT ref_chr, CAST(region_id AS BIGINT) AS region_id, number AS pos, name AS gene
FROM regions JOIN genes ON chromosome = ref_chr AND number BETWEEN start AND "end\""""


@query(_OF_QUERY + sql.sweep(INTERVALS["support"]) + _REGIONS)
def intervals_of_query(spark, folder):
    return query_intervals(line_annotation(spark, folder), LINE_QUERY, **INTERVALS)


@query(_OF_ALL + sql.sweep(INTERVALS["support"]) + _REGIONS)
def intervals_of_all(spark, folder):
    return query_intervals(line_annotation(spark, folder), None, **INTERVALS)


@query(_OF_ALL + sql.coverage(INTERVALS["support"]) + _REGIONS)
def coverage_of_all(spark, folder):
    return query_intervals(line_annotation(spark, folder), None, **INTERVALS, mode="coverage")


@query(_OF_QUERY + sql.sweep(INTERVALS["support"]) + _GENE_ROWS)
def genes_of_query(spark, folder):
    return query_gene_rows(line_annotation(spark, folder), LINE_QUERY, **INTERVALS)


def _gene_lists(one: str, named: str) -> str:
    return f"""SELECT ref_chr, region_id, {one} AS {named} FROM ({_GENE_ROWS}) GROUP BY ref_chr, region_id"""


@query(_OF_ALL + sql.sweep(INTERVALS["support"]) + _gene_lists("string_agg(gene, ',' ORDER BY pos)", "genes"))
def gene_lists_of_all(spark, folder):
    lists = query_genes(line_annotation(spark, folder), None, **INTERVALS)
    return lists.withColumn("genes", F.concat_ws(",", "genes"))


@query(
    _OF_ALL
    + sql.sweep(INTERVALS["support"])
    + _gene_lists("""'["' || string_agg(gene, '","' ORDER BY pos) || '"]'""", "document")
)
def gene_list_json(spark, folder):
    return gene_list_documents(query_genes(line_annotation(spark, folder), None, **INTERVALS))


@query(
    _HULLS
    + sql.coverage(SUPPORT)
    + """SELECT ref_chr, CAST(region_id AS BIGINT) AS region_id, '[' || start || ',' || "end" || ']' AS document
FROM regions"""
)
def region_json(spark, folder):
    return region_documents(support_regions(_hulls(spark, folder), SUPPORT, "coverage"))


@query(
    _HULLS
    + sql.coverage(SUPPORT)
    + """SELECT ref_chr, CAST(region_id AS BIGINT) AS region_id, '[' || start || ',' || "end" || ']' AS document
FROM regions"""
)
def region_json_read_back(spark, folder):
    """Documents written with their keys and read again."""
    target = table_path(spark, "documents")
    documents = region_documents(support_regions(_hulls(spark, folder), SUPPORT, "coverage"))
    write_documents(documents, target)
    return spark.read.schema(documents.schema).json(target)
