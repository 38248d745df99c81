"""Activities and screens whose pairs mostly share no gene."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shiftgrid.operators import matrix, stats
from shiftgrid.operators.ordered import attach
from shiftgrid.plans import scoring

EDGES = "scope string, tf string, target int, weight double"


def network_rows():
    draw = random.Random(3)
    edges = [(s, f"t{f}", g, draw.uniform(0.5, 2)) for s in "ab" for f in range(12) for g in range(40) if draw.random() < 0.1]
    edges += [("a", None, 3, 1.0), ("a", "zero", 4, 1.0), ("a", "zero", 5, -1.0), ("a", "t1", 6, None), ("a", "t1", 7, 1.0), ("a", "t1", 7, 2.0)]
    values = [(s, g, draw.uniform(1, 5)) for s in "ab" for g in range(40)]
    return edges, values


def test_pairs_without_a_shared_gene_are_no_rows_of_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(matrix, "FACTORS", 3)
    edges, values = network_rows()
    draw = random.Random(4)
    expr = [(s, n, g, v) for s, g, v in values for n in ("x", "y", None, "z") if draw.random() < 0.3]
    got = matrix.regulon_activity(spark.createDataFrame(expr, "scope string, sample string, gene int, value double"),
                                  spark.createDataFrame(edges, EDGES), ["scope"], "sample", "gene", "value", min_genes=1)
    assert "array_except" in got._jdf.queryExecution().toString()
    rows = {(r["scope"], r["sample"], r["tf"]): r["activity"] for r in got.collect()}
    genes = {(s, g) for s, _, g, _ in expr}
    kept = [e for e in edges if (e[0], e[2]) in genes]
    expected = 0
    for s in "ab":
        own = [e for e in kept if e[0] == s]
        row, col = {}, {}
        for _, f, g, w in own:
            row[g] = row.get(g, 0.0) + (w or 0.0)
            col[f] = col.get(f, 0.0) + (w or 0.0)
        mean_row, mean_col = sum(row.values()) / len(row), sum(col.values()) / len(col)
        row = {g: r + mean_row * 1e-6 for g, r in row.items()}
        col = {f: c + mean_col * 1e-6 for f, c in col.items()}
        for n in {n for t, n, _, _ in expr if t == s}:
            x = {g: v for t, m, g, v in expr if (t, m) == (s, n) and g in row}
            if not x:
                continue
            total = sum(x.values())
            share = sum(row[g] * v / total for g, v in x.items()) / sum(row.values())
            for f in col:
                num = sum((w or 0.0) * x.get(g, 0.0) / total for _, h, g, w in own if h == f)
                assert rows[(s, n, f)] == pytest.approx((num - col[f] * share) / (col[f] * share), rel=1e-6)
                expected += 1
    assert len(rows) == expected == got.count()


def test_a_screen_in_parts_is_the_screen_in_rows(spark):
    edges, values = network_rows()
    draw = random.Random(5)
    screen = [(s, f"ko__t{f}", g, -w * 0.5) for s, t, g, w in edges if w and t and t.startswith("t") for f in [t[1:]]]
    screen += [("a", "oe__t1", g, 0.3) for g in range(40)] + [("b", "ko__t90", 99, 1.0), ("c", "ko__t1", 1, 1.0), ("a", "ko__t91", 1, None)]
    screen += [("b", "oe__t2", g, -v) for s, g, v in values if s == "b"]  # nothing is left of the expression
    vector = [(s, f"t{f}", draw.uniform(-1, 1)) for s in "ab" for f in range(11)] + [("a", "t11", None), ("b", "t11", float("nan")), ("a", None, 1.0)]
    args = (spark.createDataFrame(screen, "scope string, variant string, gene int, shift double"),
            spark.createDataFrame(values, "scope string, gene int, value double"), spark.createDataFrame(edges, EDGES))
    vec = spark.createDataFrame(vector, "scope string, tf string, vector double")
    parts = scoring.screen_activity_shift(*args, min_genes=1, parts=True)
    dense = scoring.screen_activity_shift(*args, min_genes=1)
    without = {"_excl": F.col("tf").isin("t3", "t4")}
    pairs = attach(dense, vec, ["scope", "tf"])
    want = {(r["scope"], r["variant"]): r for r in stats.project(pairs, "shift", "vector", ["scope", "variant"], without).collect()}
    found = parts.project(vec, without).withColumnRenamed("ko_id", "variant")
    got = {(r["scope"], r["variant"]): r for r in found.collect()}
    assert set(got) == set(want) and len(want) > 20
    for key, row in want.items():
        for c in found.columns:
            assert got[key][c] == (pytest.approx(row[c], rel=1e-6, abs=1e-9) if isinstance(row[c], float) else row[c]), (key, c)
