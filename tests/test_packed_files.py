"""The annotation written as CSV is packed, in files of bounded size, and reads back the same."""

import glob
from datetime import datetime, timedelta

from pathweave.plans import catalog


def test_annotation_through_packed_csv(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    tables = {
        "region": ([(0, "R0")], "r_regionkey int, r_name string"),
        "nation": ([(0, "N0", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(s, f"S#{s}", 0) for s in (1, 2)], "s_suppkey long, s_name string, s_nationkey int"),
        "lineitem": (
            [
                (o, o % 3, 1 + o % 2, 1 + o % 7, float(o), 1.5, "R" if o % 2 else "N", datetime(2024, 1, 1) + timedelta(o))
                for o in range(40)
            ],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
            "l_extendedprice double, l_returnflag string, l_shipdate timestamp",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    target = str(tmp_path / "files")
    monkeypatch.setattr(catalog, "table_path", lambda *_: target)
    monkeypatch.setattr(catalog, "CSV_ROWS", 15)
    found = sorted(map(tuple, catalog.QUERIES["gene_rows_of_csv"](spark, folder).collect()))
    files = [f for f in glob.glob(f"{target}/featureloc/part-*")]
    assert len(files) >= 3 and all(f.endswith(".csv.gz") for f in files)
    assert found and found == sorted(map(tuple, catalog.QUERIES["gene_rows"](spark, folder).collect()))
