"""Bounded samples of labelled rows to fit classifiers on; nothing else is ever sampled."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pathweave.session import files_for, materialise

#: Chosen ids are sent to every task up to so many; beyond, they are joined by a shuffle.
BROADCAST_IDS = 65_536


def bounded_sample(rows: DataFrame, size: int, *strata: str) -> DataFrame:
    """At most ``size`` rows of each stratum, the same for the same rows in any order.

    Rows fall into ``size`` buckets by the hash of their ``doc_id``; a bucket gives the row whose
    id and text have the smallest other hashes. The choice is an aggregate with map-side combine,
    so hot strata and ids are no matter, and of rows repeated as they are one comes back. Rows
    without an id are never chosen.
    """
    rows = rows.filter(F.col("doc_id").isNotNull())
    mark = F.struct(F.xxhash64("doc_id", F.lit(11)).alias("order"), F.col("doc_id"), F.xxhash64("text").alias("_text"))
    chosen = (
        rows.groupBy(*strata, F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(size)).alias("bucket"))
        .agg(F.min(mark).alias("mark"))
        .select(*[F.col(c).alias(f"_{c}_") for c in strata], F.col("mark.doc_id").alias("_doc_id"), "mark._text")
    )
    chosen = materialise(chosen, "sample", files_for(size))
    if chosen.count() <= BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    same = (rows["doc_id"] == F.col("_doc_id")) & (F.xxhash64(rows["text"]) == F.col("_text"))
    for c in strata:
        same = same & rows[c].eqNullSafe(F.col(f"_{c}_"))
    return rows.join(chosen, same, "left_semi").dropDuplicates(["doc_id", *strata])
