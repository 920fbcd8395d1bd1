"""Tables that one step after another adds to, kept in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from pathweave.session import table_path


class WaveTable:
    """A table written wave by wave; each wave is read back on its own.

    Written tables cut the lineage between waves and outlive lost executors.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = table_path(spark, label)
        self.schema: StructType | None = None
        self.waves: set[int] = set()

    def write(self, wave: int, rows: DataFrame) -> None:
        self.schema = rows.schema
        rows.write.parquet(f"{self.path}/at={wave}")
        self.waves.add(wave)

    def read(self, *waves: int) -> DataFrame | None:
        """Rows of those waves that were written, or ``None``."""
        paths = [f"{self.path}/at={w}" for w in waves if w in self.waves]
        if not paths:
            return None
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read_all(self) -> DataFrame:
        return self.read(*sorted(self.waves))


def split_by_wave(rows: DataFrame, label: str) -> DataFrame:
    """Writes ``rows`` partitioned by their ``wave`` column and reads them back."""
    path = table_path(rows.sparkSession, label)
    rows.write.partitionBy("wave").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def used_waves(rows: DataFrame) -> list[int]:
    """The waves that hold rows, ascending; bounded by the number of waves."""
    return sorted(r[0] for r in rows.select("wave").distinct().collect())
