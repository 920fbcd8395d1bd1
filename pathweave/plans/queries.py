"""Entry points: frequent regions, their genes, and macro-synteny."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pathweave.functions.checks import (
    DEFAULT_INTERMEDIATE,
    DEFAULT_MATCHED,
    check_intermediate,
    check_matched,
    check_support,
    find_by_name,
    int_or_default,
)
from pathweave.operators.anchors import family_positions, path_positions
from pathweave.operators.chains import ORIENTATIONS, chains
from pathweave.operators.genes import (
    chain_blocks,
    region_gene_lists,
    region_genes,
    track_organisms,
)
from pathweave.operators.paths import chromosome_paths
from pathweave.operators.runs import matching_hulls
from pathweave.operators.support import support_regions
from pathweave.operators.tables import (
    NULL_FAMILY,
    chromosome_table,
    gene_table,
    organism_table,
)
from pathweave.session import materialise
from pathweave.sources.annotation import Annotation
from pathweave.sources.graph_tables import GeneGraph


def written_paths(annotation: Annotation) -> DataFrame:
    """The chromosome paths, written once for any number of queries over them."""
    return materialise(
        chromosome_paths(annotation.gene_order, annotation.gene_family_assignment), "paths"
    )


def path_regions(
    paths: DataFrame,
    matched: int,
    intermediate: int,
    support: int,
    query=None,
    mode: str = "sweep",
) -> DataFrame:
    """Frequent regions ``(ref_chr, region_id, start, end)`` over given paths."""
    matched, intermediate = check_matched(matched), check_intermediate(intermediate)
    support = check_support(support)
    hulls = matching_hulls(path_positions(paths), intermediate, matched, query)
    return support_regions(hulls, support, mode)


def query_intervals(
    annotation: Annotation,
    chromosome: str | None,
    matched: int,
    intermediate: int,
    support: int,
    mode: str = "sweep",
    paths: DataFrame | None = None,
) -> DataFrame:
    """Stretches of a named chromosome that recur on at least ``support`` others.

    Without a name every chromosome is the query in turn. ``mode='sweep'`` counts
    matching stretches, ``mode='coverage'`` counts distinct chromosomes.
    """
    check_matched(matched), check_intermediate(intermediate), check_support(support)
    query = None if chromosome is None else find_by_name(annotation.feature, chromosome)
    if paths is None:
        paths = chromosome_paths(annotation.gene_order, annotation.gene_family_assignment)
    return path_regions(paths, matched, intermediate, support, query, mode)


def query_gene_rows(
    annotation: Annotation,
    chromosome: str | None,
    matched: int,
    intermediate: int,
    support: int,
    mode: str = "sweep",
    paths: DataFrame | None = None,
) -> DataFrame:
    """``(ref_chr, region_id, pos, gene)`` of the regions of ``query_intervals``."""
    paths = written_paths(annotation) if paths is None else paths
    regions = query_intervals(
        annotation, chromosome, matched, intermediate, support, mode, paths
    )
    return region_genes(regions, paths, annotation.feature)


def query_genes(
    annotation: Annotation,
    chromosome: str | None,
    matched: int,
    intermediate: int,
    support: int,
    mode: str = "sweep",
    paths: DataFrame | None = None,
) -> DataFrame:
    """``(ref_chr, region_id, genes)``, the genes of each region as a list."""
    return region_gene_lists(
        query_gene_rows(annotation, chromosome, matched, intermediate, support, mode, paths)
    )


def synteny_blocks(
    found: DataFrame,
    genes: DataFrame,
    chromosomes: DataFrame,
    organisms: DataFrame,
    strict: bool = False,
) -> DataFrame:
    """Chains with coordinates, names and organisms: one row per block of a track."""
    owners = track_organisms(chromosomes, organisms)
    ref = owners.select(
        F.col("chromosome").alias("ref_chr"),
        F.col("name").alias("ref_name"),
        F.col("length").alias("ref_length"),
    )
    rel = owners.select(
        F.col("chromosome").alias("rel_chr"),
        F.col("name").alias("chromosome"),
        "genus",
        "species",
    )
    return chain_blocks(found, genes, strict).join(ref, "ref_chr").join(rel, "rel_chr")


def table_synteny(
    genes: DataFrame,
    chromosomes: DataFrame,
    organisms: DataFrame,
    query=None,
    intermediate=DEFAULT_INTERMEDIATE,
    matched=DEFAULT_MATCHED,
    null_family: str | None = NULL_FAMILY,
    orientations: tuple[str, ...] = ORIENTATIONS,
    strict: bool = False,
) -> DataFrame:
    """Macro-synteny blocks over gene, chromosome and organism tables.

    ``query`` is a chromosome id, or ``None`` for every chromosome.
    """
    intermediate = check_intermediate(int_or_default(intermediate, DEFAULT_INTERMEDIATE))
    matched = check_matched(int_or_default(matched, DEFAULT_MATCHED))
    positions = family_positions(genes, null_family)
    found = chains(positions, intermediate, matched, query, orientations)
    return synteny_blocks(found, genes, chromosomes, organisms, strict)


def macro_synteny(
    annotation: Annotation,
    query=None,
    intermediate=DEFAULT_INTERMEDIATE,
    matched=DEFAULT_MATCHED,
    strict: bool = False,
) -> DataFrame:
    """Macro-synteny blocks straight from the annotation tables."""
    genes = materialise(gene_table(annotation), "genes")
    return table_synteny(
        genes,
        chromosome_table(annotation),
        organism_table(annotation),
        query,
        intermediate,
        matched,
        strict=strict,
    )


def graph_synteny(
    graph: GeneGraph, query=None, intermediate=DEFAULT_INTERMEDIATE, matched=DEFAULT_MATCHED
) -> DataFrame:
    """Macro-synteny blocks of a loaded graph, whose ids are strings."""
    return table_synteny(
        graph.genes, graph.chromosomes, graph.organisms, query, intermediate, matched
    )
