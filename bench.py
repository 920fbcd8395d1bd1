"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

from pyspark.sql import DataFrame

from pathweave.operators.anchors import path_positions
from pathweave.operators.chains import chains
from pathweave.operators.runs import exact_runs
from pathweave.plans import catalog
from pathweave.plans.queries import query_gene_rows, query_intervals
from pathweave.session import local_session, remove_tables
from pathweave.sources.sample_tables import event_annotation, line_annotation

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def sparse_regions(spark, folder) -> DataFrame:
    """The full support pipeline for every chromosome, one family per part."""
    return query_intervals(line_annotation(spark, folder), None, 2, 10, 20)


def dense_regions_of_query(spark, folder) -> DataFrame:
    annotation = event_annotation(spark, folder)
    return query_intervals(annotation, "u1", 4, 1, 8)


def dense_genes_of_query(spark, folder) -> DataFrame:
    return query_gene_rows(event_annotation(spark, folder), "u1", 4, 1, 8)


def sparse_runs(spark, folder) -> DataFrame:
    return exact_runs(path_positions(catalog.line_paths(spark, folder)))


def dense_chains_of_query(spark, folder) -> DataFrame:
    positions, named = catalog._named_line_positions(spark, folder, dense=True)
    return chains(positions, **catalog.DENSE, query=named)


QUERIES = {
    "gene_table": catalog.gene_rows,
    "paths": catalog.line_paths,
    "family_graph_edges": catalog.adjacency_directed,
    "chains_sparse_all": catalog.chains_forward,
    "chains_dense_query": dense_chains_of_query,
    "synteny_dense_query": catalog.synteny_of_query_dense,
    "shared_passages": catalog.shared_passages,
    "runs_sparse_all": sparse_runs,
    "regions_sparse_all": sparse_regions,
    "regions_dense_query": dense_regions_of_query,
    "genes_dense_query": dense_genes_of_query,
}


def main() -> None:
    spark = local_session(CPUS, int(CPUS), tempfile.mkdtemp(prefix="bench-"))
    spark.sparkContext.setLogLevel("ERROR")
    catalog.gene_rows(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    times = {}
    for name, build in QUERIES.items():
        if sys.argv[1:] and name not in sys.argv[1:]:
            continue
        began = time.time()
        build(spark, FOLDER).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 2)
        remove_tables(spark)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([\d.]+)", FOLDER)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 2),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
