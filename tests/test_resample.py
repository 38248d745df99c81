from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftgrid.operators import enrichment, resample
from shiftgrid.plans import metrics, validation


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=60)
    rows = [("x" if i < 45 else "y", i, float(a[i]), float(a[i] + rng.normal()), float(i % 7), int(i % 3 == 0)) for i in range(60)]
    return spark.createDataFrame(rows, "g string, id int, real double, pred double, level double, y int")


def test_bootstrap_draws_n_of_n(pairs, mode):
    drawn = resample.bootstrap(pairs, ["g"], "id", ["real"], 5, 0)
    sums = {(r["g"], r["b"]): r["s"] for r in drawn.groupBy("g", "b").agg(F.sum("w").alias("s")).collect()}
    assert sums == {(g, b): n for g, n in (("x", 45.0), ("y", 15.0)) for b in range(1, 6)}


def test_paths_and_partitionings_agree(spark, pairs):
    def run(df):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in resample.bootstrap_spearman(
            df, ["g"], "id", {"rho": ("real", "pred"), "lev": ("real", "level")}, 6, 1).collect())

    first = run(pairs)
    assert run(pairs.repartition(7)) == first
    assert run(pairs.coalesce(1)) == first


def test_bootstrap_rank_correlation_matches_expanded_rows(pairs, mode):
    drawn = resample.bootstrap(pairs, ["g"], "id", ["real", "level"], 3, 2).toPandas()
    got = resample.bootstrap_spearman(pairs, ["g"], "id", {"rho": ("real", "level")}, 3, 2).toPandas().set_index(["g", "b"])
    for key, d in drawn.groupby(["g", "b"]):
        e = d.loc[d.index.repeat(d["w"].astype(int))]
        assert np.isclose(got.loc[key, "rho"], e["real"].rank().corr(e["level"].rank()))


def test_permutation_keeps_values(pairs, mode):
    moved = resample.permuted_pairs(pairs, ["g"], "id", ["real"], "pred", 2, 0)
    want = {r["g"]: r["s"] for r in pairs.groupBy("g").agg(F.round(F.sum("pred"), 9).alias("s")).collect()}
    for r in moved.groupBy("g", "b").agg(F.round(F.sum("moved"), 9).alias("s"), F.count_distinct("id").alias("n")).collect():
        assert r["s"] == want[r["g"]] and r["n"] in (45, 15)


def test_stratified_permutation_keeps_counts(pairs, mode):
    d = pairs.withColumn("stratum", F.col("id") % 4)
    moved = resample.permuted_labels(d, ["g"], "stratum", "id", "y", 3, 0)
    want = {(r["g"], r["stratum"]): r["s"] for r in d.groupBy("g", "stratum").agg(F.sum("y").alias("s")).collect() if r["s"]}
    for b in (1, 2, 3):
        got = {(r["g"], r["stratum"]): r["n"] for r in moved.where(f"b = {b}").groupBy("g", "stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert got == want


def test_matched_sets_stay_in_their_stratum(pairs, mode):
    d = pairs.withColumns({"stratum": F.col("id") % 3, "v": (F.col("id") % 3).cast("double")})
    out = resample.matched_sets(d, ["g"], "stratum", "id", "v", F.col("id") % 3 == 1, 4, 0)
    assert {r["mean"] for r in out.collect()} == {1.0} and out.count() == 8


def test_enrichment_extremes(spark, mode):
    df = spark.createDataFrame([("g%02d" % i, float(20 - i)) for i in range(41)], "gene string, s double")
    sets = spark.createDataFrame([("top", "g%02d" % i) for i in range(5)] + [("low", "g%02d" % i) for i in range(36, 41)], "set_name string, gene string")
    es = {r["set_name"]: r["es"] for r in enrichment.enrichment(df, [], "gene", "s", sets).collect()}
    assert np.isclose(es["top"], 1.0) and np.isclose(es["low"], -1.0)


def test_small_sets_are_skipped(spark, mode):
    df = spark.createDataFrame([("g%02d" % i, float(i)) for i in range(20)], "gene string, s double")
    sets = spark.createDataFrame([("few", "g00"), ("few", "g01")], "set_name string, gene string")
    assert enrichment.enrichment(df, [], "gene", "s", sets).count() == 0


def test_verdicts(spark):
    rows = [(150, 1.0, 0.1, 0.2, "PASS"), (150, 1.0, -0.1, 0.01, "FAIL"), (150, 1.0, 0.0, 0.2, "INCONCLUSIVE"), (50, 1.0, 0.1, 0.2, "NOT_EVALUABLE"),
            (150, 0.0, 0.1, 0.2, "NOT_EVALUABLE")]
    df = spark.createDataFrame(rows, "n_genes int, pred_shift_sd double, excess_ci_lo double, excess_ci_hi double, want string").withColumns(
        {"rho_ci_lo": F.col("excess_ci_lo"), "rho_ci_hi": F.col("excess_ci_hi")})
    for r in validation.judged(df).collect():
        assert r["verdict"] == r["want"]
    flipped = {r["want"]: r["verdict"] for r in validation.judged(df.where("n_genes = 150 AND pred_shift_sd > 0"), invert=F.lit(True)).collect()}
    assert flipped == {"PASS": "FAIL", "FAIL": "PASS", "INCONCLUSIVE": "INCONCLUSIVE"}
    assert {r["verdict"] for r in validation.judged(df, scored=F.lit(False)).collect()} == {"not_scored"}


def test_screen_null_decides_negative_control(spark):
    df = spark.createDataFrame([(150, 1.0, 0.1, 0.2, 0.1, 0.2, 0.5), (150, 1.0, 0.1, 0.2, 0.1, 0.2, 0.99)],
                               "n_genes int, pred_shift_sd double, excess_ci_lo double, excess_ci_hi double, rho_ci_lo double, rho_ci_hi double, null_pctile double")
    got = [(r["verdict"], r["verdict_basis"]) for r in validation.judged(df, invert=F.lit(True)).orderBy("null_pctile").collect()]
    assert got == [("PASS", "empirical_null"), ("FAIL", "empirical_null")]


def test_contrast_metrics_notes_small_contrasts(pairs, mode):
    shifts = pairs.selectExpr("g AS scope", "id AS gene", "real AS real_shift", "pred AS predicted_shift", "level")
    out = {r["scope"]: r for r in metrics.contrast_metrics(shifts, ["scope"], "gene", B=5, n_perm=5, min_genes=20, ks=(5,)).collect()}
    assert out["y"]["note"] and out["y"]["pcc"] is None and out["x"]["note"] is None and out["x"]["pcc"] is not None
    assert np.isclose(out["x"]["nochange_rel_rmse"], 1.0)


def test_blocks_of_many_rows_and_hot_ties(spark):
    """Several blocks per group and a tie longer than a block: the counts and ranks of the written-out draws."""
    rng = np.random.default_rng(11)
    n = 20_000
    real, level = rng.normal(size=n), np.where(rng.random(n) < 0.6, 0.0, rng.integers(1, 500, n))
    df = spark.createDataFrame([("x", i, float(a), float(v)) for i, (a, v) in enumerate(zip(real, level))], "g string, id int, real double, level double")
    drawn = resample.bootstrap(df, ["g"], "id", ["real", "level"], 2, 5).toPandas()
    rho = resample.bootstrap_spearman(df, ["g"], "id", {"rho": ("real", "level")}, 2, 5).toPandas().set_index("b")["rho"]
    mean = resample.bootstrap_mean(df, ["g"], "id", "real", 2, 5).toPandas().set_index("b")["mean"]
    for b, d in drawn.groupby("b"):
        e = d.loc[d.index.repeat(d["w"].astype(int))]
        assert len(e) == n and np.isclose(mean[b], e["real"].mean())
        assert np.isclose(rho[b], e["real"].rank().corr(e["level"].rank()))


def test_packed_permutations_equal_written_out_pairs(spark):
    rng = np.random.default_rng(12)
    rows = [("x" if i < 18_000 else "y", i, float(a), float(p)) for i, (a, p) in enumerate(zip(rng.normal(size=18_050), rng.integers(-2, 3, 18_050)))]
    df = spark.createDataFrame(rows, "g string, id int, real double, pred double")
    pairs = resample.permuted_pairs(df, ["g"], "id", ["real"], "pred", 2, 7).toPandas()
    got = resample.shuffle_null(df, ["g"], "id", "real", "pred", 2, 7).toPandas().set_index(["g", "b"])["projection"]
    for at, d in pairs.groupby(["g", "b"]):
        assert np.isclose(got[at], (d["real"] * d["moved"]).sum() / np.sqrt((d["moved"] ** 2).sum()))
    null = resample.permutation_null(df, ["g"], "id", "real", "pred", 2, 7, (10,)).toPandas().set_index("g")
    for g, d in pairs.groupby("g"):
        top = [e.assign(a=e["real"].abs()).nlargest(10, "a") for _, e in d.groupby("b")]
        conc = [(np.sign(e["moved"]) == np.sign(e["real"]))[e["moved"] != 0].mean() for e in top]
        assert np.isclose(null.loc[g, "perm_pcc_mean"], np.mean([e["real"].corr(e["moved"]) for _, e in d.groupby("b")]))
        assert np.isclose(null.loc[g, "perm_rmse_mean"], np.mean([np.sqrt(((e["real"] - e["moved"]) ** 2).mean()) for _, e in d.groupby("b")]))
        assert np.isclose(null.loc[g, "perm_deg_conc_10_p95"], np.quantile(conc, 0.95))
