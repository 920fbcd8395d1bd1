"""What must hold at any size: ids, pruning by a query, memory of the chain step, one kernel run."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathweave.operators import anchors as anchor_module
from pathweave.operators.anchors import lay_out, pair_lists, unfold, written_lists
from pathweave.operators.chain_steps import Box, chain_step
from pathweave.operators.chains import chains
from pathweave.operators.runs import exact_runs, matching_hulls, merged_runs
from pathweave.operators.support import support_regions
from pathweave.operators.tables import chromosome_table, gene_table
from pathweave.sources.sample_tables import chromosome_id, gene_id, line_annotation


def test_ids_never_meet(spark, tmp_path):
    lines = spark.range(100_001).select(
        F.lit(0).cast("long").alias("l_suppkey"), F.col("id").alias("l_orderkey")
    ).unionByName(
        spark.range(20).select(F.when(F.col("id") < 10, 1).otherwise(10_000).cast("long").alias("l_suppkey"), F.col("id").alias("l_orderkey"))
    )
    lines.select(
        "*", F.lit(1).alias("l_linenumber"), F.lit(5).cast("long").alias("l_partkey"), F.lit(1.0).alias("l_quantity"),
        F.lit(1.0).alias("l_extendedprice"), F.lit("N").alias("l_returnflag"),
        F.lit("2024-01-01").cast("timestamp").alias("l_shipdate"),
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    source = "/root/testdata/sf0.001"
    supplier = spark.read.parquet(f"{source}/supplier.parquet").limit(1)
    keys = spark.createDataFrame([(0,), (1,), (10_000,)], "s_suppkey long")
    keys.join(supplier.drop("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    for name in ("nation", "region"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    annotation = line_annotation(spark, str(tmp_path))
    genes = gene_table(annotation)
    assert genes.count() == 100_021 == genes.select("id").distinct().count()
    assert {r.id for r in chromosome_table(annotation).select("id").collect()} == {-1, -2, -10_001}


def test_ids_that_do_not_fit_fail(spark):
    rows = spark.createDataFrame([(1 << 31, 1 << 32)], "key long, number long")
    with pytest.raises(Exception, match="32-bit"):
        rows.select(gene_id(F.lit(1), F.col("number"))).collect()
    with pytest.raises(Exception, match="62-bit"):
        rows.select(chromosome_id(F.lit(-3).cast("long"))).collect()


def positions(spark, seed=3, letters="ABCDEF"):
    random.seed(seed)
    rows = [(c, p, random.choice(letters if c < 4 else "XYZ")) for c in range(6) for p in range(30)]
    return spark.createDataFrame(rows, "chromosome long, pos int, family string")


def test_a_query_lays_out_its_own_families_only(spark):
    lists = written_lists(positions(spark), 1)
    assert {r.family for r in lists.select("family").distinct().collect()} <= set("ABCDEF")
    for build in (
        lambda q: chains(positions(spark), 2, 3, query=q),
        lambda q: exact_runs(positions(spark), query=q),
        lambda q: matching_hulls(positions(spark), 1, 2, query=q),
    ):
        named = sorted(map(tuple, build(1).collect()))
        assert named == sorted(map(tuple, build(None).filter("ref_chr = 1").collect())) and named


def test_any_number_of_hot_families_is_spread(spark, monkeypatch):
    lists = written_lists(positions(spark))
    plain = sorted(map(tuple, unfold(pair_lists(lists)).collect()))
    assert sorted(map(tuple, unfold(pair_lists(lists, pairs_per_cell=4)).collect())) == plain


def test_only_giant_pairs_are_cut(spark):
    rows = [(c, p, "A" if p < 40 and c < 2 else f"u{c}-{p % 9}") for c in range(4) for p in range(50)]
    df = spark.createDataFrame(rows, "chromosome long, pos int, family string")
    layout = lay_out(df, 200)
    assert layout.has_giants
    giants = {(r.ref_chr, r.rel_chr) for r in layout.giant_anchors().select("ref_chr", "rel_chr").distinct().collect()}
    assert giants == {(0, 1), (1, 0)}
    runs = exact_runs(positions(spark))
    whole = sorted(map(tuple, merged_runs(runs, 1, 2).collect()))
    sizes = sorted(r["count"] for r in runs.groupBy("ref_chr", "rel_chr").count().collect())
    assert sorted(map(tuple, merged_runs(runs, 1, 2, runs_per_task=sizes[len(sizes) // 2]).collect())) == whole


def brute(ref, rel, reach, reverse):
    order = np.lexsort((ref, rel))
    score, link = {}, {}
    for k in order.tolist():
        best = (0, None)
        for j in order.tolist():
            along = ref[j] - ref[k] if reverse else ref[k] - ref[j]
            up = rel[k] - rel[j]
            if 0 < along <= reach and 0 < up <= reach:
                value = score[j] + reach + 1 - min(along, up)
                if value > best[0]:
                    best = (value, j)
        score[k], link[k] = best
    return {(ref[k], rel[k]): (score[k], None if link[k] is None else (ref[link[k]], rel[link[k]])) for k in score}


@pytest.mark.parametrize("reach", [1, 3, 7, 60])
def test_scores_with_any_reach(reach):
    rng = np.random.default_rng(reach)
    for size in (1, 5, 60, 150):
        points = np.unique(rng.integers(0, 30, (size, 2)), axis=0)
        ref, rel = points[:, 0].astype(np.int64), points[:, 1].astype(np.int64)
        for reverse in (False, True):
            box = Box(np.zeros(len(ref), np.int64), ref, rel, reach)
            score, pointer = box.score(reverse)
            want = brute(ref.tolist(), rel.tolist(), reach, reverse)
            for k in range(len(score)):
                before = None if pointer[k] < 0 else (box.ref[pointer[k]], box.rel[pointer[k]])
                assert want[(box.ref[k], box.rel[k])] == (score[k], before)


def test_memory_of_the_chain_step_is_linear_whatever_the_reach():
    rng = np.random.default_rng(1)
    size = 200_000
    ref, rel = (rng.integers(0, 1 << 28, size) for _ in range(2))
    group = np.sort(rng.integers(0, 50, size))
    tracemalloc.start()
    chain_step(1001, 10, ("+", "-"))(group, {"ref_pos": ref, "rel_pos": rel})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6


def test_the_kernel_runs_once_below_the_support_windows(spark):
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    rows = [(1, rel, s, s + 4) for rel in range(2, 6) for s in range(0, 60, 7)]
    hulls = spark.createDataFrame(rows, "ref_chr long, rel_chr long, ref_start long, ref_end long")
    for mode in ("sweep", "coverage"):
        runs.value = 0
        counted = hulls.mapInArrow(count, hulls.schema)
        assert support_regions(counted, 3, mode).collect()
        assert runs.value == len(rows)
