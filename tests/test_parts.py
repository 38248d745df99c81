"""Files that are written in parts are read as one file, in their order."""

from __future__ import annotations

import glob

import pytest

from workload import files, load
from workload.registry import Tables


@pytest.fixture
def folder(spark, tmp_path):
    lines = [(o, (o * 7 + n) % 40, n, float(o % 5 + n)) for o in range(300) for n in (1, 2, 3)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double").repartition(4).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, "12"[o % 2] + "-ANY") for o in range(300)], "o_orderkey bigint, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(p,) for p in range(40)], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    # small tables would be broadcast, and what is left may be one partition
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield str(tmp_path), lines
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def sums(lines, key):
    out = {}
    for row in lines:
        out[key(row)] = out.get(key(row), 0.0) + row[3]
    return out


def test_a_trio_in_parts(spark, folder):
    path, lines = folder
    written = files.write_trios(Tables(spark, path))
    for kind in ("matrix.mtx/sample_id=1-ANY/o=2", "barcodes.tsv/sample_id=1-ANY", "features.tsv/sample_id=2-ANY"):
        assert len(glob.glob(f"{written}/{kind}/part-*")) > 1, kind
    got = {(r["prefix"], r["cell_id"], r["feature_id"]): r["count"] for r in load()["src1_read_mtx"](spark, path).collect()}
    assert got == sums(lines, lambda r: ("12"[r[0] % 2] + "-ANY_", str(r[0]), str(r[1])))
    bulk = {(r["sample"], r["feature_id"]): r["count"] for r in load()["src2_mtx_pseudobulk"](spark, path).collect()}
    assert bulk == sums(lines, lambda r: ("12"[r[0] % 2] + "-ANY", str(r[1])))


def test_files_per_sample_in_parts(spark, folder):
    path, lines = folder
    written = files.per_sample_path(Tables(spark, path))
    assert len(glob.glob(f"{written}/s=1-ANY/o=2/part-*")) > 1
    got = {r["gene"]: (r["n_files"], r["value"]) for r in load()["src6_src7_src8_per_sample"](spark, path).collect()}
    both = {}
    for r in lines:
        both.setdefault(str(r[1]), set()).add(r[0] % 2)
    want = sums(lines, lambda r: str(r[1]))
    assert got == {g: (len(both[g]), v) for g, v in want.items()}
