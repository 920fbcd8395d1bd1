"""Order-dependent sums over groups of any size.

A plain window keeps a whole group in one task. Here every group is cut into
buckets that follow its order, each bucket is summed by itself, and only one
row per bucket goes through the per-group window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pathweave.session import materialise

BUCKET = 1 << 16


def bucket_of(position: Column, width: int = BUCKET) -> Column:
    """Bucket number of an integer position; rises with the position."""
    return F.floor(position / F.lit(width)).cast("long")


def _with_carry(
    local: DataFrame, totals: DataFrame, keys: list[str], sums: list[str]
) -> DataFrame:
    before = (
        Window.partitionBy(*keys)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_carry_{s}") for s in sums],
    )
    return local.join(carry, [*keys, "_bucket"])


def ordered_rank(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str
) -> DataFrame:
    """0-based rank of each row in its group; ``bucket`` must rise with ``order``."""
    bucketed = df.withColumn("_bucket", bucket)
    window = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = bucketed.withColumn("_local", F.row_number().over(window).cast("long"))
    totals = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    return _with_carry(local, totals, keys, ["_rows"]).select(
        *df.columns, (F.col("_local") + F.col("_carry__rows") - 1).alias(name)
    )


def running_sums(
    df: DataFrame, keys: list[str], position: str, sums: list[str], width: int = BUCKET
) -> DataFrame:
    """Adds ``cum_<s>``, the sum of ``s`` up to and including each row's position.

    ``(keys, position)`` must be unique. Rows and bucket totals read the same written
    table, so what is behind ``df`` runs once.
    """
    df = materialise(df, "sums")
    bucketed = df.withColumn("_bucket", bucket_of(F.col(position), width))
    window = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = bucketed.select(
        "*", *[F.sum(s).over(window).alias(f"_local_{s}") for s in sums]
    )
    totals = bucketed.groupBy(*keys, "_bucket").agg(*[F.sum(s).alias(s) for s in sums])
    return _with_carry(local, totals, keys, sums).select(
        *df.columns,
        *[(F.col(f"_local_{s}") + F.col(f"_carry_{s}")).alias(f"cum_{s}") for s in sums],
    )


def with_previous(
    df: DataFrame, keys: list[str], position: str, columns: list[str], width: int = BUCKET
) -> DataFrame:
    """Adds ``prev_<c>``, the values one position earlier in the group.

    Positions must be dense ranks. The last row of a bucket is copied into the
    next one, so no bucket needs its neighbour.
    """
    at = F.col(position)
    homes = F.when(
        at % width == width - 1,
        F.array(bucket_of(at, width), bucket_of(at, width) + 1),
    ).otherwise(F.array(bucket_of(at, width)))
    spread = df.withColumn("_bucket", F.explode(homes))
    window = Window.partitionBy(*keys, "_bucket").orderBy(position)
    return (
        spread.select("*", *[F.lag(c).over(window).alias(f"prev_{c}") for c in columns])
        .filter(F.col("_bucket") == bucket_of(at, width))
        .drop("_bucket")
    )


def stretches(
    df: DataFrame, keys: list[str], position: str, reach: int, name: str, width: int = BUCKET
) -> DataFrame:
    """Adds ``name``, the position at which each row's stretch begins.

    A stretch goes on while the next position of the group is at most ``reach`` further; positions
    may repeat. Stretches cross buckets: a bucket hands on its last position, and where its last
    stretch began, in one row.
    """
    at = F.col(position)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(position)
    before = F.lag(position).over(inside)
    begins = F.when(before.isNull() | (at - before > reach), at)
    local = materialise(
        df.withColumn("_bucket", bucket_of(at, width))
        .withColumn("_begins", begins)
        .withColumn(
            "_local",
            F.last("_begins", ignorenulls=True).over(
                inside.rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .drop("_begins"),
        "stretches",
    )
    along = Window.partitionBy(*keys).orderBy("_bucket")
    buckets = (
        local.groupBy(*keys, "_bucket")
        .agg(
            F.min(position).alias("_first"),
            F.max(position).alias("_last"),
            F.max("_local").alias("_open"),
        )
        .withColumn(
            "_joined",
            F.coalesce(F.col("_first") - F.lag("_last").over(along) <= reach, F.lit(False)),
        )
        .withColumn(
            "_own", F.when(~F.col("_joined") | (F.col("_open") > F.col("_first")), F.col("_open"))
        )
        .select(
            *keys,
            "_bucket",
            "_first",
            F.when(
                F.col("_joined"),
                F.last("_own", ignorenulls=True).over(
                    along.rowsBetween(Window.unboundedPreceding, -1)
                ),
            ).alias("_carry"),
        )
    )
    return local.join(buckets, [*keys, "_bucket"]).select(
        *df.columns,
        F.when(F.col("_local") == F.col("_first"), F.coalesce("_carry", "_local"))
        .otherwise(F.col("_local"))
        .alias(name),
    )
