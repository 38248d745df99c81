"""Properties of the physical plans that matter at scale."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from shiftgrid.operators import intervals, ranks, stats

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    li = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    plan = plan_of(stats.pearson(li.where("l_discount > 0.05"), "l_quantity", "l_tax", ["l_returnflag"]))
    assert "PushedFilters" in plan and "l_extendedprice" not in plan and "l_shipdate" not in plan


def test_no_cartesian_product_in_overlaps(spark):
    ev = spark.read.parquet(f"{FOLDER}/events.parquet").select(
        F.lit("c").alias("chrom"), F.col("event_id").alias("start"), (F.col("event_id") + 5).alias("end"))
    plan = plan_of(intervals.overlaps_any(ev, ev.where("start % 7 = 0")))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_large_rank_never_sorts_a_whole_group(spark):
    """Every window is partitioned by the slice as well, or runs over per-slice totals."""
    li = spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_returnflag", "l_quantity")
    plan = plan_of(ranks.tie_totals(li, ["l_returnflag"], "l_quantity", {"n": F.lit(1)}))
    windows = [line for line in plan.splitlines() if "+- Window" in line or line.strip().startswith("Window")]
    assert windows and all("_slice" in line for line in windows)


def test_top_rows_limits_before_the_shuffle(spark):
    li = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    assert "WindowGroupLimit" in plan_of(ranks.top_rows(li, ["l_returnflag"], ["-l_quantity", "l_orderkey"], 5))


def test_screen_null_rules(spark):
    """Only usable variants of the mode count, factors under test do not, the sign turns shifts, and 19 are no null."""
    import pytest
    from pyspark.sql import functions as F

    from shiftgrid.operators.filters import GuardError
    from shiftgrid.operators.resample import screen_null, usable_variants

    n = 26
    status = spark.createDataFrame(
        [(i, i, "oe" if i == 0 else "ko", None if i == 1 else i != 2) for i in range(n)], "variant int, tf int, mode string, usable boolean")
    assert {r[0] for r in usable_variants(status, "ko", [3]).collect()} == set(range(4, n))
    genes = spark.range(30).withColumnRenamed("id", "gene").withColumn("scope", F.lit("s"))
    measured = genes.withColumn("real", F.col("gene").cast("double"))
    # variants up to 14 follow the measured shift, the others oppose it
    screen = genes.join(status.select("variant"), F.lit(True)).withColumn("shift", F.when(F.col("variant") < 15, F.col("gene")).otherwise(-F.col("gene")).cast("double"))
    observed = spark.createDataFrame([("s", 0.5)], "scope string, rho double")
    row = screen_null(measured, screen, status, ["scope"], "gene", "real", "shift", observed, "ko", [3]).first()
    assert (row.null_n, row.null_pctile) == (22, 0.5)
    row = screen_null(measured, screen, status, ["scope"], "gene", "real", "shift", observed, "ko", [3, 4], -1.0).first()
    assert (row.null_n, round(row.null_pctile * 21)) == (21, 10)
    with pytest.raises(GuardError, match="fewer than 20"):
        screen_null(measured, screen, status, ["scope"], "gene", "real", "shift", observed, "ko", range(3, 7))
    with pytest.raises(GuardError):
        screen_null(measured, screen, status, ["scope"], "gene", "real", "shift", spark.createDataFrame([("t", 0.5)], observed.schema), "ko")
