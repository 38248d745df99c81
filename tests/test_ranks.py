from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shiftgrid.operators import ranks, stats
from shiftgrid.operators.ordered import running


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    n = 400
    pdf = pd.DataFrame({
        "g": rng.choice(["a", "b"], n, p=[0.9, 0.1]), "id": np.arange(n), "v": rng.integers(0, 25, n).astype(float),
        "w": rng.normal(size=n), "y": rng.integers(0, 2, n),
    })
    return pdf, spark.createDataFrame(pdf)


def by_id(df, column):
    return df.select("id", column).toPandas().set_index("id").sort_index()[column]


def test_average_and_min_rank(table, mode):
    pdf, df = table
    want = pdf.set_index("id").groupby("g")["v"].rank()
    assert np.allclose(by_id(ranks.average_rank(df, "v", ["g"]), "rank"), want)
    low = pdf.set_index("id").groupby("g")["v"].rank(ascending=False, method="min")
    assert np.allclose(by_id(ranks.min_rank(df, "v", ["g"]), "rank"), low)
    down = pdf.set_index("id").groupby("g")["v"].rank(ascending=False)
    assert np.allclose(by_id(ranks.average_rank(df, "v", ["g"], descending=True), "rank"), down)


def test_null_and_nan_have_no_rank(spark, mode):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, float("nan")), (4, 5.0)], "id int, v double")
    got = {r["id"]: r["rank"] for r in ranks.average_rank(df, "v").collect()}
    assert got == {1: 1.5, 2: None, 3: None, 4: 1.5}


@pytest.mark.parametrize("n", [1, 2, 11, 37, 100])
def test_deciles_equal_quantile_cut(spark, mode, n):
    values = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id int, v double")
    got = by_id(ranks.deciles(df, "v", [], "id"), "decile").to_numpy()
    if n == 1:
        assert list(got) == [0]
    else:
        want = pd.qcut(pd.Series(values).rank(method="first"), 10, labels=False, duplicates="drop")
        assert list(got) == list(want)


def test_percentiles_interpolate(table, mode):
    pdf, df = table
    got = ranks.percentiles(df, "w", ["g"], {"a": 0.025, "b": 0.5, "c": 0.99}).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g")["w"].quantile([0.025, 0.5, 0.99]).unstack()
    assert np.allclose(got.to_numpy(), want.to_numpy())


def test_top_abs_label_takes_ties_and_halves_small_groups(spark, mode):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, -3.0, 2.0, 1.0, 0.5])], "id int, v double")
    got = by_id(ranks.top_abs_label(df, "v", [], 1), "is_top")
    assert list(got) == [1, 1, 0, 0, 0]
    got = by_id(ranks.top_abs_label(df, "v", [], 200), "is_top")
    assert got.sum() == 2


def test_top_rows_larger_than_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "g string, id int")
    assert ranks.top_rows(df, ["g"], ["-id"], 10).count() == 3


def test_rank_percentile_single_row(spark, mode):
    df = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("b", 3, 3), ("b", 4, None)], "g string, id int, r int")
    got = {r["id"]: r["rank_pct"] for r in ranks.rank_percentile(df, "r", ["g"]).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: -1.0, 4: None}


def test_spearman_constant_side_is_null(spark, mode):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0)], "a double, b double")
    assert stats.spearman(df, "a", "b").first()["rho"] is None


def test_roc_pr_against_pairs(table, mode):
    pdf, df = table
    got = stats.roc_pr(df, "y", "v", ["g"]).toPandas().set_index("g")
    for g, d in pdf.groupby("g"):
        pos, neg = d.v[d.y == 1].to_numpy(), d.v[d.y == 0].to_numpy()
        wins = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
        assert np.isclose(got.loc[g, "auroc"], wins)
    flipped = stats.roc_pr(df.withColumn("v", -F.col("v")), "y", "v", ["g"]).toPandas().set_index("g")
    assert np.allclose(got["auroc"] + flipped["auroc"], 1.0)


def test_single_class_is_null(spark, mode):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "y int, s double")
    row = stats.roc_pr(df, "y", "s").first()
    assert row["auroc"] is None and row["aupr"] is None and row["n"] == 2


def test_positional_metrics_by_hand(spark, mode):
    df = spark.createDataFrame([(1, 1, 9.0), (2, 0, 8.0), (3, 1, 7.0), (4, 0, 6.0)], "id int, y int, s double")
    row = stats.positional_metrics(df, "y", "s", [], "id", [2]).first()
    assert np.isclose(row["ap"], (1 + 2 / 3) / 2) and np.isclose(row["recall_at_2"], 0.5)
    assert np.isclose(row["ndcg_at_2"], 1 / (1 + 1 / np.log2(3)))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-5, 5)), min_size=1, max_size=40))
def test_running_sum_and_max(spark, mode, rows):
    data = [(g, i, v) for i, (g, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "g string, id int, v int")
    out = running(df, ["g"], ["id"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, inclusive=False).toPandas().set_index("id")
    pdf = pd.DataFrame(data, columns=["g", "id", "v"]).set_index("id")
    before = pdf.groupby("g")["v"].cumsum() - pdf["v"]
    assert (out["s"].sort_index() == before).all()
    top = pdf.groupby("g")["v"].cummax().groupby(pdf["g"]).shift(1)
    assert np.allclose(out["m"].sort_index().astype(float), top.astype(float), equal_nan=True)


def test_paired_ranks_of_small_and_large_groups(spark, mode):
    """Ties, zeros of both signs, infinities, a null group and a null beside it: the ranks of the sliced form, whatever the group's size."""
    inf = float("inf")
    rows = [("a", k, x, y) for k in (1, None) for x, y in ((0.0, 1.0), (-0.0, 1.0), (5.0, inf), (5.0, -inf), (5.0, 1.0), (-2.0, 3.0))]
    rows += [(None, 1, 7.0, 1.0), (None, 1, 8.0, 1.0), ("b", 2, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, k int, x double, y double")
    values = {"rx": "x", "ry": "y"}
    want = sorted(map(str, ranks.average_ranks(df, values, ["g", "k"]).collect()))
    assert sorted(map(str, ranks.paired_ranks(df, values, ["g", "k"]).collect())) == want and len(want) == 15
    assert sorted(map(str, ranks.paired_ranks(df, values, []).collect())) == sorted(map(str, ranks.average_ranks(df, values).collect()))


def test_sanity_evaluates_its_tables_once_for_the_correlation(spark):
    """The correlations are written: what is left of the tables in the plan is the count of the samples."""
    from shiftgrid.operators import aggregates

    predicted = spark.range(137).selectExpr("'s' AS scope", "id % 5 AS gene", "id AS sample", "CAST(id AS DOUBLE) AS value")
    measured = predicted.withColumn("value", F.when(F.col("gene") == 4, -F.col("value")).otherwise(F.col("value") * 2))
    out = aggregates.sanity(predicted, measured, ["scope"], "gene", "sample", "value")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 137") == 1
    row = out.first()
    assert (row.sanity_rho, row.sanity_frac, row.n_genes, row.sanity_n_samples, row.sanity_pass) == (1.0, 0.8, 5, 137, True)
