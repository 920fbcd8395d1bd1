"""Regions of a reference chromosome that enough hulls cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pathweave.functions.checks import check_support
from pathweave.functions.prefix import BUCKET, bucket_of, ordered_rank, running_sums

MODES = ("sweep", "coverage")


def _marks(hulls: DataFrame, keys: list[str]) -> DataFrame:
    """Hull starts and ends counted per position, so hulls shrink before any window."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    mark = F.explode(
        F.array(
            F.struct(
                F.col("ref_start").alias("pos"), one.alias("starts"), none.alias("ends")
            ),
            F.struct(F.col("ref_end").alias("pos"), none.alias("starts"), one.alias("ends")),
        )
    )
    return (
        hulls.select(*keys, mark.alias("mark"))
        .groupBy(*keys, F.col("mark.pos").alias("pos"))
        .agg(F.sum("mark.starts").alias("starts"), F.sum("mark.ends").alias("ends"))
    )


def _open_counts(hulls: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Per marked position, hulls open ``before`` its own start and ``during`` it."""
    sums = running_sums(_marks(hulls, keys), keys, "pos", ["starts", "ends"], width)
    during = F.col("cum_starts") - F.col("cum_ends") + F.col("ends")
    return sums.select(
        *keys,
        "pos",
        "starts",
        "ends",
        during.alias("during"),
        (during - F.col("starts")).alias("before"),
    )


def sweep_regions(hulls: DataFrame, support: int, width: int = BUCKET) -> DataFrame:
    """``(ref_chr, start, end)`` of the support sweep, which counts hulls.

    A region opens where the number of open hulls reaches ``support``. It closes at
    the first start that finds fewer than ``support - 1`` hulls open, and ends where
    its last ``support`` hulls still overlapped. A start that restores the number
    reopens the region and the former opening is lost.
    """
    support = check_support(support)
    counts = _open_counts(hulls, ["ref_chr"], width).select(
        "ref_chr",
        "pos",
        F.when((F.col("starts") > 0) & (F.col("before") + 1 < support), 1)
        .otherwise(0)
        .alias("closes"),
        (
            (F.col("starts") > 0)
            & (F.col("before") < support)
            & (F.col("during") >= support)
        ).alias("opens"),
        (F.col("during") >= support).alias("held"),
    )
    return (
        running_sums(counts, ["ref_chr"], "pos", ["closes"], width)
        .groupBy("ref_chr", "cum_closes")
        .agg(
            F.max(F.when(F.col("opens"), F.col("pos"))).alias("start"),
            F.max(F.when(F.col("held"), F.col("pos"))).alias("end"),
        )
        .filter(F.col("start").isNotNull())
        .select("ref_chr", "start", "end")
    )


def coverage_regions(hulls: DataFrame, support: int, width: int = BUCKET) -> DataFrame:
    """``(ref_chr, start, end)`` covered by at least ``support`` distinct relatives.

    Each relative's own hulls are united first.
    """
    support = check_support(support)
    own = _open_counts(hulls, ["ref_chr", "rel_chr"], width)
    steps = F.explode(
        F.array_compact(
            F.array(
                F.when(
                    (F.col("before") == 0) & (F.col("starts") > 0),
                    F.struct(F.col("pos"), F.lit(1).cast("long").alias("change")),
                ),
                F.when(
                    F.col("during") == F.col("ends"),
                    F.struct((F.col("pos") + 1).alias("pos"), F.lit(-1).cast("long").alias("change")),
                ),
            )
        )
    )
    changes = (
        own.select("ref_chr", steps.alias("step"))
        .groupBy("ref_chr", F.col("step.pos").alias("pos"))
        .agg(F.sum("step.change").alias("change"))
        .filter("change <> 0")
    )
    covered = running_sums(changes, ["ref_chr"], "pos", ["change"], width)
    now, before = F.col("cum_change"), F.col("cum_change") - F.col("change")
    edges = covered.select(
        "ref_chr",
        "pos",
        F.when((now >= support) & (before < support), 1)
        .when((now < support) & (before >= support), 0)
        .alias("opens"),
    ).filter("opens IS NOT NULL")
    return (
        running_sums(edges, ["ref_chr"], "pos", ["opens"], width)
        .groupBy("ref_chr", "cum_opens")
        .agg(
            F.max(F.when(F.col("opens") == 1, F.col("pos"))).alias("start"),
            F.max(F.when(F.col("opens") == 0, F.col("pos") - 1)).alias("end"),
        )
        .select("ref_chr", "start", "end")
    )


def support_regions(
    hulls: DataFrame, support: int, mode: str = "sweep", width: int = BUCKET
) -> DataFrame:
    """``(ref_chr, region_id, start, end)``, regions numbered along the chromosome."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    find = sweep_regions if mode == "sweep" else coverage_regions
    regions = find(hulls, support, width)
    return ordered_rank(
        regions, ["ref_chr"], ["start"], bucket_of(F.col("start"), width), "region_id"
    ).select("ref_chr", "region_id", "start", "end")
