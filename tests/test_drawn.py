"""Replicates whose draws never move: the same figures as rows per replicate, and no such rows in the plan."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shiftgrid.operators import drawn, resample
from shiftgrid.plans import metrics


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=60)
    rows = [("x" if i < 45 else None, i * 37, float(a[i]), float(a[i] + rng.normal()), int(i % 3 == 0), i % 4, float(i % 11)) for i in range(60)]
    return spark.createDataFrame(rows, "g string, id int, real double, pred double, y int, stratum int, score double")


def rows_of(df, *first):
    found = sorted((tuple(r[c] for c in df.columns) for r in df.select(*first, *[c for c in df.columns if c not in first]).select(*df.columns).collect()), key=repr)
    return [tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in r) for r in found]


def same(got, want):
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        assert all(x == y or (x is not None and y is not None and np.isclose(x, y)) if isinstance(x, float) or isinstance(y, float) else x == y for x, y in zip(a, b)), (a, b)


def test_digests_are_those_of_md5():
    texts = [f"|{i}" for i in range(5, 3_000)] + [None, "|" + "ä" * 40, "|x"]
    for ends, each in ((drawn.Texts.of(pa.array(texts)), texts), (drawn.Texts.numbers(12_345), [f"|{i}" for i in range(1, 12_346)])):
        for head in (b"7|F|1", b"7|F|12", b"", b"a scope of a longer name, beyond one word of the block|3", b"h" * 70):
            want = [int(hashlib.md5(head + (t or "").encode()).hexdigest()[:15], 16) for t in each]
            assert ends.hashes(head).tolist() == want


def test_equal_hashes_stay_in_the_order_of_the_rows():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 60, 5_000)
    h[7], h[4_000], h[4_001] = h[4_002], h[4_002], h[4_002]
    # told apart by bits that the row number takes the place of
    h[11] = h[4_002] ^ 1
    for some in (h, h % 50, h[:1]):
        assert drawn.in_order(some).tolist() == np.lexsort((np.arange(len(some)), some)).tolist()


def listed(pairs):
    s = metrics.listed_cases(pairs.withColumnsRenamed({"id": "tf", "score": "rank_score"}).withColumn("centrality", F.col("tf") % 7), ["g"])
    return s[0]


STATISTICS = {
    "shuffle": lambda p: resample.shuffle_null(p, ["g"], "id", "real", "pred", 5, 3),
    "permutation": lambda p: resample.permutation_null(p, ["g"], "id", "real", "pred", 5, 3, (4, 9)),
    "null_ranking": lambda p: metrics.null_ranking(listed(p), ["g"], "_decile", "tf", (3, 10), 5, 2),
    "bootstrap_ranking": lambda p: metrics.bootstrap_ranking(listed(p), ["g"], "tf", (3, 10), 5, 2),
    "null_curves": lambda p: metrics.null_curves(listed(p), ["g"], "_decile", "tf", 20, 5, 2),
    "bootstrap_curves": lambda p: metrics.bootstrap_curves(listed(p), ["g"], "tf", 20, 5, 2),
}


@pytest.mark.parametrize("name", STATISTICS)
def test_held_groups_equal_written_rows(pairs, monkeypatch, name):
    held = STATISTICS[name](pairs)
    plan = held._jdf.queryExecution().executedPlan().toString()
    # a draw as a row would be numbered in a window, or counted in an aggregation over the replicates
    assert "MapInArrow" in plan and "Window" not in plan and "SortMergeJoin" not in plan
    got = rows_of(held)
    monkeypatch.setattr(drawn, "HELD", 20)  # one group is held, the other is not
    same(got, rows_of(STATISTICS[name](pairs)))


def test_blocks_of_a_bootstrap_add_up(pairs, monkeypatch):
    def run():
        return rows_of(resample.bootstrap_projection(pairs, ["g"], "id", "real", "pred", 6, 4))

    whole = run()
    monkeypatch.setattr(drawn, "BLOCK", 7)
    same(whole, run())
    told = {(r["g"], r["b"]): r for r in resample.bootstrap(pairs, ["g"], "id", ["real", "pred"], 6, 4).groupBy("g", "b").agg(
        F.sum(F.col("w") * F.col("real") * F.col("pred")).alias("sa"), F.sum(F.col("w") * F.col("pred") * F.col("pred")).alias("aa")).collect()}
    for g, b, projection in whole:
        assert np.isclose(projection, told[g, b]["sa"] / np.sqrt(told[g, b]["aa"]))


def test_a_null_value_pairs_with_nothing(spark, pairs, monkeypatch):
    some = pairs.withColumns({"real": F.expr("CASE WHEN id % 5 <> 0 THEN real END"), "pred": F.expr("CASE WHEN id % 4 <> 0 THEN pred END")})
    got = rows_of(resample.permutation_null(some, ["g"], "id", "real", "pred", 5, 3, (4,)))
    monkeypatch.setattr(drawn, "HELD", 0)
    same(got, rows_of(resample.permutation_null(some, ["g"], "id", "real", "pred", 5, 3, (4,))))


def test_agreement_of_resampled_rows(pairs, monkeypatch):
    shifts = pairs.where("g = 'x'").selectExpr("g AS scope", "id AS gene", "real AS real_shift", "pred AS predicted_shift", "score AS level")
    monkeypatch.setattr(drawn, "BLOCK", 7)
    got = metrics.bootstrap_contrast(shifts, ["scope"], "gene", 5, 4, (6,)).first()
    each = []
    for _, d in resample.bootstrap(shifts, ["scope"], "gene", ["real_shift", "predicted_shift"], 5, 4).toPandas().groupby("b"):
        e = d.loc[d.index.repeat(d["w"].astype(int))]
        e = e.assign(a=-e["real_shift"].abs()).sort_values(["a", "gene"]).head(6)
        each.append((np.sign(e["real_shift"]) == np.sign(e["predicted_shift"]))[e["predicted_shift"] != 0].mean())
    assert np.allclose([got["deg_conc_6_ci_lo"], got["deg_conc_6_ci_hi"]], np.quantile(each, [0.025, 0.975]))
