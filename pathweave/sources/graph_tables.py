"""The four exported CSV tables: writing them and loading them as a graph."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pathweave.functions.checks import require_unique_ids
from pathweave.operators.tables import (
    chromosome_table,
    family_table,
    gene_table,
    organism_table,
)
from pathweave.session import materialise
from pathweave.sources.annotation import Annotation

# The tables, their columns in file order, and the integer columns.
TABLES = {
    "organisms": ["id", "genus", "species"],
    "chromosomes": ["id", "name", "length", "organism"],
    "families": ["id", "name"],
    "genes": ["id", "name", "fmin", "fmax", "strand", "number", "family", "chromosome"],
}
INTEGERS = {"length", "fmin", "fmax", "strand", "number"}


@dataclass(frozen=True)
class GeneGraph:
    """Vertices by kind, and the typed edges between them as ``(src, dst)``."""

    organisms: DataFrame
    chromosomes: DataFrame
    families: DataFrame
    genes: DataFrame

    @property
    def chromosome_to_organism(self) -> DataFrame:
        return _edges(self.chromosomes, "organism")

    @property
    def gene_to_family(self) -> DataFrame:
        return _edges(self.genes, "family")

    @property
    def gene_to_chromosome(self) -> DataFrame:
        return _edges(self.genes, "chromosome")


def _edges(df: DataFrame, target: str) -> DataFrame:
    return df.select(F.col("id").alias("src"), F.col(target).alias("dst"))


def export_tables(annotation: Annotation, folder: str) -> None:
    """Writes the four tables as CSV folders with headers; null is the empty field."""
    tables = {
        "organisms": organism_table(annotation),
        "chromosomes": chromosome_table(annotation),
        "families": family_table(annotation),
        "genes": gene_table(annotation),
    }
    for name, columns in TABLES.items():
        tables[name].select(*columns).write.option("header", True).csv(
            f"{folder.rstrip('/')}/{name}"
        )


def _typed(column: str) -> Column:
    return F.col(column).try_cast("int") if column in INTEGERS else F.col(column)


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Reads the CSV tables: ids stay strings, what is not a number becomes null."""

    def read(name: str) -> DataFrame:
        columns = TABLES[name]
        schema = ", ".join(f"`{c}` string" for c in columns)
        raw = spark.read.schema(schema).option("header", True).csv(f"{folder.rstrip('/')}/{name}")
        return raw.select(*[_typed(c).alias(c) for c in columns])

    return {name: read(name) for name in TABLES}


def link_tables(
    tables: dict[str, DataFrame],
    keep: Callable[[DataFrame, str], DataFrame] = lambda vertices, name: vertices,
) -> GeneGraph:
    """Keeps the chromosomes with an organism and the genes with both their ends.

    Chromosomes are linked first, as a gene needs one that was kept. ``keep`` takes each kind of
    vertices on its way, once.
    """
    organisms = keep(tables["organisms"], "organisms")
    families = keep(tables["families"], "families")

    def ids(df: DataFrame, column: str) -> DataFrame:
        return df.select(F.col("id").alias(column))

    linked = tables["chromosomes"].join(ids(organisms, "organism"), "organism")
    chromosomes = keep(linked.select(*TABLES["chromosomes"]), "chromosomes")
    genes = (
        tables["genes"]
        .join(ids(families, "family"), "family")
        .join(ids(chromosomes, "chromosome"), "chromosome")
    )
    return GeneGraph(
        organisms, chromosomes, families, keep(genes.select(*TABLES["genes"]), "genes")
    )


def load_graph(spark: SparkSession, folder: str) -> GeneGraph:
    """Reads and links exported tables; an id that repeats within a kind is an error.

    Each file is parsed once: linked vertices are written as they are found, and one job over the
    written ids of all kinds looks for repeats.
    """
    graph = link_tables(read_tables(spark, folder), materialise)
    require_unique_ids(
        {
            "organism": graph.organisms,
            "family": graph.families,
            "chromosome": graph.chromosomes,
            "gene": graph.genes,
        }
    )
    return graph
