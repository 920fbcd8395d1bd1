"""The operators as queries over the given tables, with their production parameters."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from pathweave.llm import (
    exact_topk,
    group_join,
    language_id,
    language_model,
    merkle,
    minhash_join,
    packing,
    periodic_runs,
    personal_data,
    quality,
    secret_tags,
    sentence_pieces,
    tool_calls,
)
from pathweave.session import materialise


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.find(_table(spark, folder, "documents")).drop("all_spans")


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    return language_id.predict(documents, language_id.fit(documents))


def op3_stupid_backoff(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score_documents(_table(spark, folder, "documents"))


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    return packing.pack_documents(documents, tokenizer_file("word_bpe_49k.json"))


#: Schemas of the tools that the conversations are taken to call.
TOOLS = (
    ("measure", "text", "string", True),
    ("measure", "length", "integer", True),
    ("store", "text", "string", True),
    ("store", "turn", "integer", True),
    ("store", "tags", "array", False),
)


def tool_messages(conversations: DataFrame) -> DataFrame:
    """The conversations as chats with tools: the tables hold plain turns only.

    Every assistant turn becomes a message that calls a tool with its text, needing the result of
    the call two turns before, and a tool message with the result. By the text's length a result
    stands in front of its call, answers an unknown call or is left out, and arguments lack a
    parameter, have a wrong type or an unknown one.
    """
    turns = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    size = F.length("text")
    name = F.when(size % 2 == 0, "measure").otherwise("store")
    arguments = F.struct(
        F.when(size % 11 != 0, F.col("text")).alias("text"),
        F.when((size % 2 == 0) & (size % 3 != 0), size).alias("length"),
        F.when(size % 2 == 1, F.when(size % 5 == 0, F.lit("x")).otherwise(F.col("turn").cast("string"))).alias("turn"),
        F.when(size % 7 == 0, F.array(F.lit("b"), F.lit("a"))).alias("tags"),
    )
    call = F.struct(
        F.concat(F.lit("c"), F.col("turn")).alias("id"),
        name.alias("name"),
        arguments.alias("arguments"),
        F.array(F.concat(F.lit("c"), F.col("turn") - 2)).alias("after"),
    )
    asking = F.to_json(F.struct(F.lit("").alias("content"), F.array(call).alias("tool_calls")))
    answer = F.to_json(
        F.struct(
            F.concat(F.when(size % 13 == 0, "u").otherwise("c"), F.col("turn")).alias("tool_call_id"),
            size.cast("string").alias("content"),
        )
    )
    told = F.col("role") == "assistant"
    first = turns.select(
        "conv_id", (3 * F.col("turn") + 1).alias("turn"), "role",
        F.when(told, asking).otherwise(F.col("text")).alias("text"),
    )
    second = turns.filter(told & (size % 17 != 0)).select(
        "conv_id", (3 * F.col("turn") + F.when(size % 4 == 0, 0).otherwise(2)).alias("turn"),
        F.lit("tool").alias("role"), answer.alias("text"),
    )
    return first.unionByName(second)


def op5_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    rows = ", ".join(f"('{tool}', '{name}', '{kind}', {needed})" for tool, name, kind, needed in TOOLS)
    schemas = spark.sql(f"SELECT * FROM VALUES {rows} AS schemas(tool, parameter, type, required)")
    return tool_calls.format_chats(tool_messages(_table(spark, folder, "conversations")), schemas)


def op6_jaccard_groups(spark: SparkSession, folder: str) -> DataFrame:
    return group_join.jaccard_classes(_table(spark, folder, "documents"), 4, 85, 100)


def op7_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    return secret_tags.scan(documents, secret_tags.fit(documents))


def op8_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    return sentence_pieces.digest(documents, tokenizer_file("piece_bpe_32k.model"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    counted = materialise(quality.count_documents(_table(spark, folder, "documents")), "counts")
    cutoffs = quality.certified_cutoffs(counted, _table(spark, folder, "labels"))
    return quality.judge(counted, cutoffs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "rejected_by",
    )


def op10_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return exact_topk.top_k(_table(spark, folder, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.audit(_table(spark, folder, "documents"))


def op12_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_join.near_duplicates(_table(spark, folder, "documents"), 5, 85, 100)


def planted_repeats(doc_id: int, count: int) -> np.ndarray | None:
    """For a tenth of all ids the end of the text repeats its own first words from some place on."""
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    begin = g % count
    period = 1 + (count - begin) // (3 + g % 8)
    words = np.arange(count)
    words[begin:] = begin + (words[begin:] - begin) % period
    return words


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.find(_table(spark, folder, "documents"), planted_repeats)
    told = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = F.array_join(F.transform(told, lambda line: F.concat(line, F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    build.__name__: build
    for build in (
        op1_personal_data,
        op2_language_id,
        op3_stupid_backoff,
        op4_best_fit_packing,
        op5_tool_calls,
        op6_jaccard_groups,
        op7_secret_scans,
        op8_sentence_pieces,
        op9_quality_rules,
        op10_exact_topk,
        op11_merkle_manifest,
        op12_minhash_near_dedup,
        op13_periodic_runs,
    )
}
