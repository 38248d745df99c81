from __future__ import annotations

import numpy as np
import pytest

from shiftgrid.operators import intervals as iv


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"chrom string, start bigint, end bigint{extra}")


def test_merge_touching_nested_and_gap(spark, mode):
    df = frame(spark, [("c", 0, 10), ("c", 10, 20), ("c", 12, 15), ("c", 25, 30), ("d", 0, 1), ("c", 0, 4)])
    got = sorted((r["chrom"], r["start"], r["end"], r["members"]) for r in iv.merge_intervals(df).collect())
    assert got == [("c", 0, 20, 4), ("c", 25, 30, 1), ("d", 0, 1, 1)]
    assert iv.merge_intervals(df, gap=5).where("chrom = 'c'").count() == 1


def test_merge_output_is_disjoint(spark, mode):
    rng = np.random.default_rng(0)
    s = rng.integers(0, 2000, 500)
    df = frame(spark, [("c", int(a), int(a + w)) for a, w in zip(s, rng.integers(1, 30, 500))])
    out = sorted((r["start"], r["end"]) for r in iv.merge_intervals(df).collect())
    assert all(a[1] < b[0] for a, b in zip(out, out[1:]))
    covered = np.zeros(2100, bool)
    for r in df.collect():
        covered[r["start"]:r["end"]] = True
    assert covered.sum() == sum(e - a for a, e in out)


def test_overlaps_any_against_brute_force(spark, mode):
    rng = np.random.default_rng(2)

    def make(n):
        s = rng.integers(0, 300, n)
        return [("c%d" % (i % 2), int(a), int(a + w)) for i, (a, w) in enumerate(zip(s, rng.integers(1, 25, n)))]

    edges, truth = make(80), make(15)
    got = iv.overlaps_any(frame(spark, edges).distinct(), frame(spark, truth)).collect()
    for r in got:
        want = any(c == r["chrom"] and r["start"] < e and r["end"] > s for c, s, e in truth)
        assert r["hit"] == int(want)


def test_touching_is_no_overlap(spark, mode):
    e = frame(spark, [("c", 10, 20), ("c", 5, 6)])
    t = frame(spark, [("c", 20, 30), ("c", 0, 5)])
    assert {r["hit"] for r in iv.overlaps_any(e, t).collect()} == {0}


def test_overlap_sets(spark, mode):
    regions = frame(spark, [("c", 0, 10), ("c", 20, 30), ("d", 0, 10)])
    truth = frame(spark, [("c", 5, 6, "x"), ("c", 9, 25, "y"), ("c", 30, 40, "x")], ", s string")
    got = sorted((r["start"], r["s"]) for r in iv.overlap_sets(regions, truth, "s", ["x", "y"]).collect())
    assert got == [(0, "x"), (0, "y"), (20, "y")]


@pytest.mark.parametrize("unit,salt", [("fragment", 1), ("fragment", 4), ("insertion", 3)])
def test_count_overlaps(spark, mode, unit, salt):
    rng = np.random.default_rng(3)
    frags = [("c", int(a), int(a + w), int(k)) for a, w, k in zip(rng.integers(0, 200, 120), rng.integers(1, 40, 120), rng.integers(0, 5, 120))]
    peaks = [("c", s, s + 9, s) for s in range(0, 200, 12)]
    got = {(r["cell"], r["peak"]): r["n"] for r in iv.count_overlaps(
        frame(spark, frags, ", cell int"), frame(spark, peaks, ", peak int"), "cell", "peak", unit, salt).collect()}
    want = {}
    for _, s, e, k in frags:
        for a, b in ([(s, e)] if unit == "fragment" else [(s, s + 1), (e - 1, e)]):
            for _, ps, pe, p in peaks:
                if a < pe and b > ps:
                    want[(k, p)] = want.get((k, p), 0) + 1
    assert got == want


def test_unknown_unit(spark):
    with pytest.raises(ValueError):
        iv.count_overlaps(frame(spark, []), frame(spark, []), "cell", "peak", "reads")


def test_near_join(spark):
    e = spark.createDataFrame([("c", 0, 10, "e1"), ("c", 500, 510, "e2"), ("d", 0, 10, "e3")], "chrom string, start bigint, end bigint, e string")
    s = spark.createDataFrame([("c", 105, "g")], "chrom string, tss bigint, g string")
    assert [(r["e"], r["distance"]) for r in iv.near_join(e, s, 100, "e", "g").collect()] == [("e1", 100)]


def test_wide_fragments_make_few_rows(spark):
    """One interval of a million positions over peaks of one: the interval has one or two bins, each peak one per level."""
    peaks = frame(spark, [("c", p, p + 1, p) for p in range(0, 1_000_000, 50_000)], ", peak int")
    long = frame(spark, [("c", 7, 1_000_007, 1)], ", cell int")
    assert iv.tiered(long, iv.levels(peaks), min(iv.levels(peaks))).count() <= 2
    assert iv.tiered(peaks, iv.levels(long), min(iv.levels(long))).count() <= 2 * 20
    got = {r["peak"]: r["n"] for r in iv.count_overlaps(long, peaks, "cell", "peak", salt=2).collect()}
    assert got == {p: 1 for p in range(50_000, 1_000_000, 50_000)}


def test_overlap_pairs_of_all_lengths(spark):
    rng = np.random.default_rng(8)
    def some(n, far):
        return [("c", int(s), int(s + w), i) for i, (s, w) in enumerate(zip(rng.integers(-50, far, n), np.exp2(rng.uniform(0, 9, n)).astype(int), strict=True))]
    a, b = some(60, 900), some(70, 900)
    got = sorted((r["x"], r["y"]) for r in iv.overlap_pairs(frame(spark, a, ", x int"), frame(spark, b, ", y int"), ["chrom"], ["x"], ["y"]).collect())
    assert got == sorted((x, y) for _, s, e, x in a for _, t, f, y in b if s < f and e > t)


def test_near_join_as_brute_force(spark, mode):
    rng = np.random.default_rng(4)
    e = [("c" if i % 3 else "d", int(p), int(p) + 4, f"e{i}") for i, p in enumerate(rng.integers(0, 400, 60))]
    s = [("c" if i % 2 else "d", int(p), f"g{i}") for i, p in enumerate(rng.integers(0, 400, 50))] + [("c", 200, "g_same")] * 3
    elements = spark.createDataFrame(e, "chrom string, start bigint, end bigint, e string")
    sites = spark.createDataFrame(s, "chrom string, tss bigint, g string")
    got = sorted((r["e"], r["g"], r["distance"]) for r in iv.near_join(elements, sites, 30, "e", "g").collect())
    assert got == sorted((n, g, abs(p + 2 - t)) for c, p, _, n in e for k, t, g in s if c == k and abs(p + 2 - t) <= 30)


def test_crowded_place_is_many_slices(spark):
    """A third of all sites within one band: they fall into many slices, each of about the asked size."""
    from pyspark.sql import functions as F

    from shiftgrid.operators.ordered import borders, with_slices
    from shiftgrid.session import ROWS_KEY, SLICES_KEY

    sites = spark.range(3_000).selectExpr("'c' AS chrom", "CASE WHEN id % 3 = 0 THEN 500 ELSE id * 1000 END AS _pos", "xxhash64(id) AS _tie")
    spark.conf.set(ROWS_KEY, "100")
    spark.conf.set(SLICES_KEY, "40")
    try:
        key = {"_own": "named_struct('k0', _pos, 'k1', _tie)"}
        hot = with_slices(sites, ["chrom"], borders(sites, ["chrom"], ["_pos", "_tie"]), key).where("_pos = 500")
        per = [r["n"] for r in hot.groupBy("_own.at").agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset(ROWS_KEY)
        spark.conf.set(SLICES_KEY, "0")
    assert len(per) >= 6 and max(per) <= 300


def test_count_overlaps_repeats_no_peak_outside_crowded_places(spark, mode):
    rng = np.random.default_rng(8)
    lengths = 2 ** rng.integers(0, 14, 400)
    frags = [("c%d" % (i % 2), int(a), int(a + w), i % 3) for i, (a, w) in enumerate(zip(rng.integers(0, 40_000, 400), lengths))]
    peaks = [("c%d" % (i % 2), int(a), int(a + w), i) for i, (a, w) in enumerate(zip(rng.integers(0, 40_000, 60), 2 ** rng.integers(0, 12, 60)))]
    df, at = frame(spark, frags, ", cell int"), frame(spark, peaks, ", peak int")
    got = {(r["cell"], r["peak"]): r["n"] for r in iv.count_overlaps(df, at, "cell", "peak", salt=16).collect()}
    want = {}
    for c, s, e, k in frags:
        for pc, ps, pe, p in peaks:
            if c == pc and s < pe and e > ps:
                want[(k, p)] = want.get((k, p), 0) + 1
    assert got == want
    # a row has at most two bins at each of few levels, and the exploded sides meet in a shuffle, never in the driver
    assert max(r["count"] for r in iv.tiered(df, iv.levels(at), 0).groupBy("cell", "start", "end").count().collect()) <= 2 * len(iv.levels(at)) + 2
    assert len(iv.levels(df)) <= 6
    plan = iv.count_overlaps(df, at, "cell", "peak")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
