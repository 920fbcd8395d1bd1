"""JSON documents of the results, and writing them.

A row is one track, one region or one gene list at every size of the result, told apart by its
key columns. Whole-chromosome documents are put together line by line as they are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_JSON = {"ignoreNullFields": "false"}


def synteny_documents(blocks: DataFrame) -> DataFrame:
    """``(ref_chr, ref_name, ref_length, rel_chr, document)``: each track of ``macro_synteny``."""
    block = F.struct("orientation", "start", "stop", "ref_end", "rel_start", "rel_end")
    told = F.transform(
        F.array_sort(F.collect_list(block)),  # '+' sorts before '-'
        lambda b: F.struct(
            b["start"].alias("start"), b["stop"].alias("stop"), b["orientation"].alias("orientation")
        ),
    )
    return (
        blocks.groupBy("ref_chr", "ref_name", "ref_length", "rel_chr", "genus", "species", "chromosome")
        .agg(told.alias("blocks"))
        .select(
            "ref_chr",
            "ref_name",
            "ref_length",
            "rel_chr",
            F.to_json(F.struct("genus", "species", "chromosome", "blocks"), _JSON).alias("document"),
        )
    )


def region_documents(regions: DataFrame) -> DataFrame:
    """``(ref_chr, region_id, document)``: ``[start, end]`` of each region."""
    return regions.select("ref_chr", "region_id", F.to_json(F.array("start", "end")).alias("document"))


def gene_list_documents(lists: DataFrame) -> DataFrame:
    """``(ref_chr, region_id, document)``: the JSON list of each region's gene names."""
    return lists.select("ref_chr", "region_id", F.to_json("genes").alias("document"))


def write_synteny(tracks: DataFrame, folder: str) -> None:
    """One JSON document for each reference chromosome, below ``ref_chr=<id>``.

    A document is a file: its head, a line for each track in order, and its tail. A task sorts and
    streams the lines of a chromosome and never holds them together.
    """
    first = tracks.groupBy("ref_chr").agg(
        F.min("rel_chr").alias("_first"),
        F.first("ref_name").alias("ref_name"),
        F.first("ref_length").alias("ref_length"),
    )
    name = F.to_json(F.array("ref_name"))  # a list, for the quoting of the name in it
    head = F.concat(
        F.lit('{"chromosome":'),
        F.substr(name, F.lit(2), F.length(name) - 2),
        F.lit(',"length":'),
        F.coalesce(F.col("ref_length").cast("string"), F.lit("null")),
        F.lit(',"tracks":['),
    )

    def end(place: int, value) -> DataFrame:
        return first.select("ref_chr", F.lit(place).alias("place"), F.col("_first").alias("rel_chr"), value.alias("value"))

    comma = tracks.join(first.select("ref_chr", "_first"), "ref_chr")
    lines = comma.select(
        "ref_chr",
        F.lit(1).alias("place"),
        "rel_chr",
        F.concat(F.when(F.col("rel_chr") == F.col("_first"), "").otherwise(","), "document").alias("value"),
    )
    (
        lines.unionByName(end(0, head))
        .unionByName(end(2, F.lit("]}")))
        .repartition("ref_chr")
        .sortWithinPartitions("ref_chr", "place", "rel_chr")
        .select("ref_chr", "value")
        .write.partitionBy("ref_chr")
        .text(folder)
    )


def write_documents(documents: DataFrame, folder: str) -> None:
    """Rows as JSON lines with their keys, so that every document can be told from the others."""
    documents.write.json(folder)
