"""Gene, family, chromosome and organism tables made from the annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import AtomicType, BinaryType, StringType

from pathweave.sources.annotation import Annotation

# Fixed value: the family of genes without an assignment.
NULL_FAMILY = "-1"


def latest(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The row with the largest ``order`` for each of ``keys``; of equal ones any whole row.

    Repeated keys shrink before the shuffle either way. Numbers are kept in a hash aggregate, one
    ``max_by`` a column, which all pick the same row as they see the same order. Texts do not fit
    into its buffers: their rows are ranked, with the sort that a join on the keys needs as well.
    """
    if all(_fixed_width(df, c) for c in columns):
        return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in columns])
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    ranked = df.select(*dict.fromkeys([*keys, order, *columns]), F.row_number().over(newest).alias("_rank"))
    return ranked.filter("_rank = 1").select(*keys, *columns)


def _fixed_width(df: DataFrame, column: str) -> bool:
    kind = df.schema[column].dataType
    return isinstance(kind, AtomicType) and not isinstance(kind, (StringType, BinaryType))


def _required(found: Column, value: Column, message: Column, strict: bool) -> Column:
    if not strict:
        return value
    return F.when(found.isNull(), F.raise_error(message)).otherwise(value)


def gene_families(assignments: DataFrame) -> DataFrame:
    """``(gene_id, family)``; of several assignments the latest counts."""
    return latest(
        assignments, ["gene_id"], "gene_family_assignment_id", ["family_label"]
    ).withColumnRenamed("family_label", "family")


def gene_table(annotation: Annotation, strict: bool = True) -> DataFrame:
    """``(id, name, fmin, fmax, strand, number, family, chromosome)`` of ordered genes.

    With ``strict`` a gene without feature or location fails the job; without it
    the missing columns are null.
    """
    ordered = gene_order_table(annotation).withColumnRenamed("id", "gene_id")
    names = annotation.feature.select(
        F.col("feature_id").alias("gene_id"), "name", F.lit(True).alias("has_feature")
    )
    places = latest(
        annotation.featureloc, ["feature_id"], "featureloc_id", ["fmin", "fmax", "strand"]
    ).select(
        F.col("feature_id").alias("gene_id"),
        "fmin",
        "fmax",
        "strand",
        F.lit(True).alias("has_place"),
    )
    joined = ordered.join(names, "gene_id", "left").join(places, "gene_id", "left")
    label = F.col("gene_id").cast("string")
    return joined.select(
        F.col("gene_id").alias("id"),
        _required(
            F.col("has_feature"), F.col("name"), F.concat(F.lit("no feature for gene "), label), strict
        ).alias("name"),
        _required(
            F.col("has_place"), F.col("fmin"), F.concat(F.lit("no location for gene "), label), strict
        ).alias("fmin"),
        "fmax",
        "strand",
        "number",
        "family",
        "chromosome",
    )


def gene_order_table(annotation: Annotation) -> DataFrame:
    """``(id, number, family, chromosome)`` of the gene table, without names and locations.

    Neither is read, so they are not joined and no gene can lack them.
    """
    orders = latest(
        annotation.gene_order, ["gene_id"], "gene_order_id", ["chromosome_id", "number"]
    )
    families = gene_families(annotation.gene_family_assignment)
    return orders.join(families, "gene_id", "left").select(
        F.col("gene_id").alias("id"),
        "number",
        F.coalesce("family", F.lit(NULL_FAMILY)).alias("family"),
        F.col("chromosome_id").alias("chromosome"),
    )


def _ordered_genes(annotation: Annotation) -> DataFrame:
    return annotation.gene_order.select("gene_id").distinct()


def family_table(annotation: Annotation) -> DataFrame:
    """``(id, name)`` of every family assigned to an ordered gene, and the null family."""
    assigned = annotation.gene_family_assignment.join(
        _ordered_genes(annotation), "gene_id", "left_semi"
    ).select(F.col("family_label").alias("id"))
    null_family = annotation.organism.sparkSession.range(1).select(
        F.lit(NULL_FAMILY).alias("id")
    )
    return (
        assigned.distinct().unionByName(null_family).distinct().select("id", F.col("id").alias("name"))
    )


def chromosome_table(annotation: Annotation) -> DataFrame:
    """``(id, name, length, organism)`` of features that locate an ordered gene."""
    located = (
        annotation.featureloc.join(
            _ordered_genes(annotation),
            F.col("feature_id") == F.col("gene_id"),
            "left_semi",
        )
        .select(F.col("srcfeature_id").alias("feature_id"))
        .distinct()
    )
    return annotation.feature.join(located, "feature_id", "left_semi").select(
        F.col("feature_id").alias("id"),
        "name",
        F.col("seqlen").alias("length"),
        F.col("organism_id").alias("organism"),
    )


def organism_table(annotation: Annotation) -> DataFrame:
    """``(id, genus, species)`` of the organisms that own such a chromosome."""
    used = chromosome_table(annotation).select(F.col("organism").alias("organism_id")).distinct()
    return annotation.organism.join(used, "organism_id", "left_semi").select(
        F.col("organism_id").alias("id"), "genus", "species"
    )
