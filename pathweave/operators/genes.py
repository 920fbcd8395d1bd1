"""From positions back to genes, chromosomes and organisms."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pathweave.functions.prefix import bucket_of
from pathweave.operators.tables import latest
from pathweave.session import materialise


# A region meets its chromosome in cells of so many positions.
REGION_CELL = 1 << 8


def region_places(regions: DataFrame, paths: DataFrame, width: int = REGION_CELL) -> DataFrame:
    """``(ref_chr, region_id, pos, gene_id)``: a range join of regions and path positions.

    A region has a row for each cell that it touches up to the end of its path, a gene one row.
    Regions of a chromosome do not overlap, so few meet in a cell; a hot chromosome spreads over its
    cells.
    """
    regions = materialise(regions, "regions")
    paths = paths.join(
        regions.select(F.col("ref_chr").alias("chromosome")).distinct(), "chromosome", "left_semi"
    )
    tops = paths.groupBy(F.col("chromosome").alias("ref_chr")).agg(F.max("pos").alias("_top"))
    last = F.least("end", "_top")
    cells = F.sequence(bucket_of(F.col("start"), width), bucket_of(last, width))
    touched = regions.join(tops, "ref_chr").filter(F.col("start") <= last).select(
        "ref_chr", "region_id", "start", "end", F.explode(cells).alias("_cell")
    )
    placed = paths.select(
        F.col("chromosome").alias("ref_chr"),
        "pos",
        "gene_id",
        bucket_of(F.col("pos"), width).alias("_cell"),
    )
    return (
        touched.join(placed, ["ref_chr", "_cell"])
        .filter(F.col("pos").between(F.col("start"), F.col("end")))
        .select("ref_chr", "region_id", "pos", "gene_id")
    )


def region_genes(
    regions: DataFrame, paths: DataFrame, features: DataFrame, width: int = REGION_CELL
) -> DataFrame:
    """``(ref_chr, region_id, pos, gene)``: the named genes of each region.

    A gene without a feature fails the job.
    """
    # few genes lie in regions; once written their number is known, and only their names travel
    placed = materialise(region_places(regions, paths, width), "region-places")
    wanted = placed.select("gene_id").distinct()
    names = features.select(
        F.col("feature_id").alias("gene_id"),
        F.col("name").alias("gene"),
        F.lit(True).alias("has_feature"),
    ).join(wanted, "gene_id", "left_semi")
    missing = F.concat(F.lit("no feature for gene "), F.col("gene_id").cast("string"))
    return placed.join(names, "gene_id", "left").select(
        "ref_chr",
        "region_id",
        "pos",
        F.when(F.col("has_feature").isNull(), F.raise_error(missing))
        .otherwise(F.col("gene"))
        .alias("gene"),
    )


def region_gene_lists(named: DataFrame) -> DataFrame:
    """``(ref_chr, region_id, genes)``: gene names in path order, no more than the path has."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "gene")))
    return named.groupBy("ref_chr", "region_id").agg(
        F.transform(ordered, lambda g: g["gene"]).alias("genes")
    )


def genes_by_number(genes: DataFrame) -> DataFrame:
    """One gene per chromosome and number; of several the largest id."""
    return latest(genes, ["chromosome", "number"], "id", ["id", "strand", "name", "fmin", "fmax"])


def interval_genes(chains: DataFrame, genes: DataFrame) -> DataFrame:
    """``(chromosome, number, id, strand, name, fmin, fmax)`` of all chain ends."""
    ends = F.explode(
        F.array(
            F.struct(F.col("ref_chr").alias("chromosome"), F.col("ref_start").alias("number")),
            F.struct(F.col("ref_chr").alias("chromosome"), F.col("ref_end").alias("number")),
            F.struct(F.col("rel_chr").alias("chromosome"), F.col("rel_start").alias("number")),
            F.struct(F.col("rel_chr").alias("chromosome"), F.col("rel_end").alias("number")),
        )
    )
    wanted = chains.select(ends.alias("end")).select("end.*").distinct()
    return genes_by_number(genes).join(wanted, ["chromosome", "number"], "left_semi")


def chain_blocks(chains: DataFrame, genes: DataFrame, strict: bool = False) -> DataFrame:
    """Chains with ``start`` and ``stop``, coordinates of the reference genes at their ends.

    A chain whose end has no gene is dropped; with ``strict`` it fails the job.
    """
    known = genes_by_number(genes).select("chromosome", "number", "fmin", "fmax")
    how = "left" if strict else "inner"

    def at(position: str, coordinate: str, name: str, rows: DataFrame) -> DataFrame:
        side = known.select(
            F.col("chromosome").alias("ref_chr"),
            F.col("number").cast("long").alias(position),
            F.col(coordinate).alias(name),
            F.lit(True).alias("has_gene"),
        )
        joined = rows.join(side, ["ref_chr", position], how)
        if strict:
            missing = F.concat_ws(
                " ", F.lit("no gene at"), F.col("ref_chr").cast("string"), F.col(position).cast("string")
            )
            checked = F.when(F.col("has_gene").isNull(), F.raise_error(missing))
            joined = joined.withColumn(name, checked.otherwise(F.col(name)))
        return joined.drop("has_gene")

    rows = at("ref_end", "fmax", "stop", at("ref_start", "fmin", "start", chains))
    return rows.select(*chains.columns, "start", "stop")


def track_organisms(chromosomes: DataFrame, organisms: DataFrame) -> DataFrame:
    """``(chromosome, name, length, genus, species)`` of chromosomes with an organism."""
    owners = organisms.select(F.col("id").alias("organism"), "genus", "species")
    return chromosomes.join(owners, "organism").select(
        F.col("id").alias("chromosome"), "name", "length", "genus", "species"
    )
