"""The five annotation tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    IntegerType,
    LongType,
    ShortType,
    StringType,
    StructField,
    StructType,
)


def _schema(*columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns])


SCHEMAS = {
    "feature": _schema(
        ("feature_id", LongType()),
        ("organism_id", LongType()),
        ("name", StringType()),
        ("uniquename", StringType()),
        ("seqlen", IntegerType()),
    ),
    "featureloc": _schema(
        ("featureloc_id", LongType()),
        ("feature_id", LongType()),
        ("srcfeature_id", LongType()),
        ("fmin", IntegerType()),
        ("fmax", IntegerType()),
        ("strand", ShortType()),
    ),
    "gene_family_assignment": _schema(
        ("gene_family_assignment_id", LongType()),
        ("gene_id", LongType()),
        ("family_label", StringType()),
    ),
    "gene_order": _schema(
        ("gene_order_id", LongType()),
        ("chromosome_id", LongType()),
        ("gene_id", LongType()),
        ("number", IntegerType()),
    ),
    "organism": _schema(
        ("organism_id", LongType()),
        ("genus", StringType()),
        ("species", StringType()),
    ),
}


@dataclass(frozen=True)
class Annotation:
    """One DataFrame per table, columns as in ``SCHEMAS``."""

    feature: DataFrame
    featureloc: DataFrame
    gene_family_assignment: DataFrame
    gene_order: DataFrame
    organism: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def read_annotation(spark: SparkSession, folder: str, source: str = "parquet") -> Annotation:
    """Reads ``<folder>/<table>`` for each table, as parquet or as CSV with headers."""

    def read(name: str) -> DataFrame:
        reader = spark.read.schema(SCHEMAS[name]).format(source)
        if source == "csv":
            reader = reader.option("header", True)
        return reader.load(f"{folder.rstrip('/')}/{name}")

    return Annotation(**{name: read(name) for name in SCHEMAS})


def jdbc_options(table: str, url: str, low: int, high: int, partitions: int) -> dict[str, str]:
    """Options of a parallel scan, split along the primary key."""
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": f"{table}_id",
        "lowerBound": str(low),
        "upperBound": str(high + 1),
        "numPartitions": str(partitions),
    }


def read_annotation_jdbc(
    spark: SparkSession, url: str, properties: dict[str, str], partitions: int = 64
) -> Annotation:
    """Reads the tables from a relational database, each in ``partitions`` key ranges."""

    def read(name: str) -> DataFrame:
        key = f"{name}_id"
        bounds = (
            spark.read.format("jdbc")
            .options(url=url, **properties)
            .option("query", f"SELECT min({key}) AS low, max({key}) AS high FROM {name}")
            .load()
            .first()
        )
        low, high = (0 if b is None else int(b) for b in bounds)
        scan = spark.read.format("jdbc").options(**properties)
        table = scan.options(**jdbc_options(name, url, low, high, partitions)).load()
        return table.select(
            *[table[f.name].cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields]
        )

    return Annotation(**{name: read(name) for name in SCHEMAS})
