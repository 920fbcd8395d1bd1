"""Argument and key checks of the entry points."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, functions as F

# Defaults of the batch job, and the shape of a chromosome name.
DEFAULT_INTERMEDIATE = 5
DEFAULT_MATCHED = 10
NAME_PATTERN = r"[\w.\-]+"


def as_count(name: str, value, least: int) -> int:
    """``value`` as an integer of at least ``least``, else ``ValueError``."""
    try:
        number = int(value)
    except (TypeError, ValueError):
        raise ValueError(f"{name!r} must be an integer, got {value!r}") from None
    if number < least:
        raise ValueError(f"{name!r} must be at least {least}, got {number}")
    return number


def check_matched(value) -> int:
    return as_count("matched", value, 1)


def check_intermediate(value) -> int:
    return as_count("intermediate", value, 0)


def check_support(value) -> int:
    return as_count("support", value, 1)


def int_or_default(value, default: int) -> int:
    """Batch-job arguments: what does not parse falls back to the default."""
    try:
        return int(value)
    except (TypeError, ValueError):
        return default


def find_by_name(features: DataFrame, name: str, id_column: str = "feature_id"):
    """Id of the one feature with this exact name."""
    if not re.fullmatch(NAME_PATTERN, name):
        raise ValueError(f"not a chromosome name: {name!r}")
    hits = features.filter(F.col("name") == name).select(id_column).limit(2).collect()
    if not hits:
        raise LookupError(f"no feature is named {name!r}")
    if len(hits) > 1:
        raise ValueError(f"more than one feature is named {name!r}")
    return hits[0][0]


def repeated_keys(df: DataFrame, key: str = "id") -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")
    )


def require_unique_ids(kinds: dict[str, DataFrame]) -> None:
    """Fails when an id repeats within a kind; one job looks at all kinds."""
    ids = [df.select(F.lit(kind).alias("kind"), "id") for kind, df in kinds.items()]
    counts = reduce(DataFrame.unionAll, ids).groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n"))
    worst = counts.filter("n > 1").limit(1).collect()
    if worst:
        raise ValueError(f"{worst[0].kind} id {worst[0].id!r} occurs {worst[0].n} times")


def require_unique(df: DataFrame, key: str = "id") -> DataFrame:
    """``df`` itself, after a job that fails when ``key`` repeats."""
    worst = repeated_keys(df, key).limit(1).collect()
    if worst:
        raise ValueError(f"{key} {worst[0][0]!r} occurs {worst[0][1]} times")
    return df
