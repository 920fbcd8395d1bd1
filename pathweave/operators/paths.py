"""Chromosomes as paths, and the family graph those paths make."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pathweave.functions.prefix import BUCKET, bucket_of, ordered_rank, with_previous
from pathweave.operators.tables import gene_families

# Fixed value: prefix of the private family of a gene without one.
PRIVATE_FAMILY = "gene:"


def chromosome_paths(
    gene_order: DataFrame, assignments: DataFrame, width: int = BUCKET
) -> DataFrame:
    """``(chromosome, pos, number, gene_id, family)``, ``pos`` the 0-based rank.

    A gene without a family is alone in a private one.
    """
    ranked = ordered_rank(
        gene_order.select(
            F.col("chromosome_id").alias("chromosome"), "number", "gene_id", "gene_order_id"
        ),
        ["chromosome"],
        ["number", "gene_order_id"],
        bucket_of(F.col("number"), width),
        "pos",
    )
    private = F.concat(F.lit(PRIVATE_FAMILY), F.col("gene_id").cast("string"))
    return ranked.join(gene_families(assignments), "gene_id", "left").select(
        "chromosome", "pos", "number", "gene_id", F.coalesce("family", private).alias("family")
    )


def gene_paths(genes: DataFrame, width: int = BUCKET) -> DataFrame:
    """Genes of the gene table ranked along their chromosomes."""
    return ordered_rank(
        genes.select("chromosome", "number", "id", "family"),
        ["chromosome"],
        ["number", "id"],
        bucket_of(F.col("number"), width),
        "pos",
    )


def family_vertices(positions: DataFrame, width: int = BUCKET) -> DataFrame:
    """``(family, chromosome, chunk, positions)`` with ascending distinct positions.

    A chunk covers ``width`` positions of the chromosome, so no list grows with the
    family; ordinary chromosomes have chunk 0 only.
    """
    return positions.groupBy(
        "family", "chromosome", bucket_of(F.col("pos"), width).alias("chunk")
    ).agg(F.sort_array(F.collect_set("pos")).alias("positions"))


def directed_edges(paths: DataFrame, width: int = BUCKET) -> DataFrame:
    """Distinct ``(src, dst)`` families of genes whose numbers follow on."""
    return (
        with_previous(paths, ["chromosome"], "pos", ["family", "number"], width)
        .filter(F.col("prev_number") == F.col("number") - 1)
        .select(F.col("prev_family").alias("src"), F.col("family").alias("dst"))
        .distinct()
    )


def undirected_edges(paths: DataFrame, width: int = BUCKET) -> DataFrame:
    """Distinct ``(src, dst)``, ``src <= dst``, of families next to each other."""
    return (
        with_previous(paths, ["chromosome"], "pos", ["family"], width)
        .filter(F.col("prev_family").isNotNull())
        .select(
            F.least("prev_family", "family").alias("src"),
            F.greatest("prev_family", "family").alias("dst"),
        )
        .distinct()
    )


def family_graph(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertex and edge sets in which every edge end is a vertex."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("family")).distinct()
    missing = ends.join(vertices.select("family").distinct(), "family", "left_anti")
    return vertices.unionByName(missing, allowMissingColumns=True), edges
