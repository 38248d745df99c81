"""JSON specs, wide draws, ranks of NaN rows and large k."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from shiftgrid.functions import scalars as X
from shiftgrid.operators import ranks


def test_variant_problems(spark):
    text = '[{"id":"a","tfs":["x"],"mode":"ko"},{"id":null,"tfs":["x"],"mode":"ko"},{"id":"b","tfs":[],"mode":"oe"},{"id":"c","tfs":["x"],"mode":"up"}]'
    specs = spark.createDataFrame([(text,), ("not json",), (None,)], "t string").select(X.json_list("t", X.VARIANT_SPEC).alias("s"))
    got = [r[0] for r in specs.select(X.variant_problem(F.col("s"))).collect()]
    assert got == [None, "id is missing or reserved", "tfs is empty", "mode is neither ko nor oe"]
    assert spark.createDataFrame([('{"k": 3}',), ("x",)], "t string").select(X.json_spec("t", "k bigint")["k"]).collect()[0][0] == 3


def test_draws_reach_positions_beyond_32_bits(spark):
    n = 1 << 40
    drawn = [r[0] for r in spark.range(2_000).select(X.draw(F.lit(n), F.lit("seed"), F.col("id"))).collect()]
    assert 0 <= min(drawn) and max(drawn) < n
    assert sum(d > (1 << 32) for d in drawn) > 1_980 and abs(sum(drawn) / len(drawn) / n - 0.5) < 0.03


def test_nan_is_never_a_top_row(spark):
    df = spark.createDataFrame([("g", 1, math.nan), ("g", 2, 5.0), ("g", 3, -9.0), ("g", 4, None)], "g string, id int, v double")
    assert [r["id"] for r in ranks.top_abs(df, "v", ["g"], "id", 1).collect()] == [3]
    labels = {r["id"]: r["is_top"] for r in ranks.top_abs_label(df, "v", ["g"], 2).collect()}
    assert labels == {1: 0, 2: 0, 3: 1, 4: 0}


def test_large_k_is_numbered_in_slices(spark):
    df = spark.range(3_000).select(F.lit("g").alias("g"), F.col("id"), (F.col("id") % 50).alias("v"))
    kept = ranks.top_rows(df, ["g"], ["-v", "id"], 1_500, "place")
    rows = sorted(kept.collect(), key=lambda r: r["place"])
    want = sorted(range(3_000), key=lambda i: (-(i % 50), i))[:1_500]
    assert [r["id"] for r in rows] == want and [r["place"] for r in rows] == list(range(1, 1_501))
