"""What-if inputs of several scopes, and the agreement of the screen with single perturbations."""

from __future__ import annotations

import math

import pytest

from shiftgrid.operators.filters import GuardError
from shiftgrid.plans import scoring, whatif


def test_scopes_stay_apart_and_share_the_reference(spark):
    """A scope's rows, samples and shifts are its own; a scope alone gives the same as beside others."""
    expr = spark.createDataFrame(
        [("a", "f", "s1", 5.0), ("a", "f", "s2", 9.0), ("b", "f", "s1", 0.0), ("b", "g", "s3", 4.0), ("b", "f", "s4", 1.0)],
        "scope string, gene string, sample string, value double")
    reference = spark.createDataFrame([("f", f"r{i}", float(i)) for i in range(1, 6)], "gene string, sample string, value double")
    variants = whatif.make_variants(spark.createDataFrame([("f",)], "tf string"))
    weights = spark.createDataFrame([("f", "t", 2.0), ("f", "f", 9.0)], "gene string, target string, weight double")
    n = spark.createDataFrame([("a", 2), ("b", 3)], "scope string, n_samples int")
    inputs = whatif.whatif_inputs(expr, reference, variants, "gene", "sample", "value", by=["scope"])
    rows = {(r["scope"], r["mode"], r["sample"]): (r["old"], r["new"]) for r in inputs.collect()}
    assert rows[("a", "ko", "s1")] == (5.0, 0.0) and rows[("a", "oe", "s2")] == (9.0, 9.0)
    assert rows[("b", "oe", "s1")][1] == pytest.approx(4.96) and len(rows) == 8
    response = whatif.whatif_response(inputs, weights, n, "gene", "sample", by=["scope"])
    shift = {(r["scope"], r["variant"]): r["shift"] for r in response.collect()}
    sd = math.sqrt(2.5) + 1e-6
    assert shift[("a", "ko__f")] == pytest.approx(-14 / sd * 2 / 2) and shift[("b", "ko__f")] == pytest.approx(-1 / sd * 2 / 3)
    status = {(r["scope"], r["variant"]): r for r in whatif.whatif_status(inputs, response, by=["scope"]).collect()}
    assert status[("a", "oe__f")]["noop"] and not status[("b", "oe__f")]["noop"]
    assert status[("b", "ko__f")]["n_samples_changed"] == 1
    one = expr.where("scope = 'b'").drop("scope")
    alone = whatif.baseline_response(one, reference, weights, "gene", "sample", "value").first()
    many = whatif.baseline_response(expr, reference, weights, "gene", "sample", "value", by=["scope"]).where("scope = 'b'").first()
    assert alone["baseline"] == pytest.approx(many["baseline"])


def test_sums_of_inputs_serve_response_and_status(spark):
    """Variants of one and of several features, weights that come twice, null scopes and values: sums give what the rows give, and a
    variant of one feature takes no second aggregation."""
    schema = "scope string, variant string, mode string, gene string, sample string, old double, new double, z_shift double, is_flat boolean"
    rows = [(s, v, "ko", g, f"s{i}", 2.0, 0.0, z * (i + 1), False) for s in ("a", None) for v, g, z in (("one", "f", -1.0), ("two", "f", -1.0), ("two", "g", 3.0))
            for i in range(3)] + [("a", "gap", "oe", "f", "s0", None, None, None, False), ("a", "flat", "ko", "g", "s0", 1.0, 1.0, 0.0, True)]
    inputs = spark.createDataFrame(rows, schema)
    weights = spark.createDataFrame(
        [("f", "t", 2.0), ("f", "t", 1.0), ("f", "f", 9.0), ("f", "u", None), ("g", "t", 0.5), (None, "t", 5.0), ("f", None, 5.0)],
        "gene string, target string, weight double")
    n = spark.createDataFrame([("a", 2), (None, 3)], "scope string, n_samples int")
    sums = whatif.input_sums(inputs, "gene", ["scope"])
    assert sums.count() == 8 and whatif.input_sums(sums, "gene", ["scope"]) is sums
    response = whatif.whatif_response(sums, weights, n, "gene", "sample", by=["scope"])
    got = {(r["scope"], r["variant"], r["gene"]): r["shift"] for r in response.collect()}
    assert got[("a", "one", "t")] == -9.0 and got[(None, "one", "t")] == -6.0
    assert got[("a", "two", "t")] == -4.5 and got[(None, "two", "t")] == -3.0
    assert got[("a", "two", "u")] is None and got[("a", "gap", "t")] is None and got[("a", "flat", "t")] == 0.0 and len(got) == 11
    raw = whatif.whatif_response(inputs, weights, n, "gene", "sample", by=["scope"])
    assert {(r["scope"], r["variant"], r["gene"]): r["shift"] for r in raw.collect()} == got
    assert response._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    known = response.where("gene = 't' AND shift IS NOT NULL")
    status = [whatif.whatif_status(x, known, by=["scope"]).collect() for x in (inputs, sums)]
    assert sorted(map(str, status[0])) == sorted(map(str, status[1]))
    flags = {(r["scope"], r["variant"]): (r["n_samples_changed"], r["noop"]) for r in status[1]}
    assert flags[("a", "two")] == (6, False) and flags[("a", "flat")] == (0, True) and len(flags) == 6


def test_tasks_grow_with_the_rows(spark):
    from shiftgrid.session import TASK_ROWS, tasks_for

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks_for(spark, 0) == tasks_for(spark, least * TASK_ROWS) == least
    assert tasks_for(spark, 300 * TASK_ROWS + 1) == 301


def test_an_undefined_response_stops_the_status(spark):
    inputs = spark.createDataFrame([("v", "ko", "f", "s", 1.0, 0.0, -1.0, False)],
                                   "variant string, mode string, gene string, sample string, old double, new double, z_shift double, is_flat boolean")
    response = spark.createDataFrame([("v", "t", None), ("v", "u", 1.0)], "variant string, gene string, shift double")
    with pytest.raises(GuardError):
        whatif.whatif_status(inputs, response)


def test_agreement_of_screen_and_single_perturbations(spark):
    """Correlation only from 11 shared values on; no sign or ratio without both scores; factors without a partner are absent."""
    shift = "scope string, {} string, tf int, shift double"
    ours = [("s", "ko__1", i, float(i)) for i in range(12)] + [("s", "ko__2", i, float(i)) for i in range(10)]
    ours += [("s", "ko__3", 99, 1.0), ("s", "oe__1", 1, 1.0), ("s", "ko__5", 1, 1.0), ("s", "ko__1", 50, None)]
    theirs = [("s", "K1", i, -2.0 * i) for i in range(12)] + [("s", "K2", i, 1.0) for i in range(20)] + [("s", "K3", 1, 1.0), ("s", "K1", 50, 1.0)]
    screen = spark.createDataFrame([("s", "ko__1", 2.0, "ok"), ("s", "ko__2", 1.0, "ok")], "scope string, variant string, score double, status string")
    single = spark.createDataFrame([("s", "K1", -4.0, "ok"), ("s", "K2", 0.0, "no_op")], "scope string, ko_id string, score double, status string")
    known = spark.createDataFrame([(i, f"K{i}") for i in (1, 2, 3, 4, 5)], "tf int, ko_id string")
    got = {r["tf"]: r for r in scoring.screen_consistency(
        screen, spark.createDataFrame(ours, shift.format("variant")), single, spark.createDataFrame(theirs, shift.format("ko_id")), known).collect()}
    assert set(got) == {"1", "2", "3"}
    assert got["1"]["shift_rho"] == pytest.approx(-1) and got["1"]["sign_agrees"] is False and got["1"]["score_ratio"] == -0.5
    assert got["1"]["shift_l2_single"] == pytest.approx(2 * got["1"]["shift_l2_screen"])
    assert got["2"]["shift_rho"] is None and got["2"]["score_ratio"] is None and got["2"]["sign_agrees"] is False
    assert got["3"]["shift_l2_screen"] == 0.0 and got["3"]["score_screen"] is None and got["3"]["sign_agrees"] is None
    assert got["3"]["status_single"] == ""


def test_screen_consistency_reads_its_shifts_once_for_the_pairs(spark):
    """Pairs are written once for correlation and norms; the shifts appear again only for the list of pairs."""
    ours = spark.range(137).selectExpr("'s' AS scope", "'ko__1' AS variant", "id AS tf", "CAST(id AS DOUBLE) AS shift")
    theirs = spark.range(139).selectExpr("'s' AS scope", "'K1' AS ko_id", "id AS tf", "-2.0D * id AS shift")
    screen = spark.createDataFrame([("s", "ko__1", 2.0, "ok")], "scope string, variant string, score double, status string")
    single = spark.createDataFrame([("s", "K1", -4.0, "ok")], "scope string, ko_id string, score double, status string")
    known = spark.createDataFrame([(1, "K1")], "tf int, ko_id string")
    out = scoring.screen_consistency(screen, ours, single, theirs, known)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 137") == plan.count("Range (0, 139") == 1
    row = out.first()
    assert row.shift_rho == pytest.approx(-1) and row.shift_l2_single == pytest.approx(2 * row.shift_l2_screen)


def test_grid_meets_every_label_once(spark):
    """More labels than blocks, a null label, repeated rows, and no labels at all."""
    from shiftgrid.operators.ordered import grid

    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "id int, _label string")
    labels = spark.createDataFrame([(i, f"n{i}") for i in range(50)] + [(None, None)], "k int, name string")
    got = grid(rows, labels)
    assert got.columns == ["id", "_label", "k", "name"]
    assert got.count() == 3 * 51 and got.distinct().count() == 2 * 51
    assert grid(rows, labels.limit(0)).count() == 0
    assert grid(rows.limit(0), labels).count() == 0
