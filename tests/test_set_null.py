"""Size-matched nulls of gene sets: one row per hit, however many sizes it serves."""

from __future__ import annotations

import hashlib

import pytest

from shiftgrid.operators import enrichment, replicates


def walk(hits, n):
    """Signed extreme of the running sum over (position, weight)."""
    total, hi, lo, so_far = sum(w for _, w in hits), 0.0, 0.0, 0.0
    for i, (p, w) in enumerate(sorted(hits), 1):
        miss = (p - i) / (n - len(hits))
        lo = min(lo, so_far / total - miss)
        so_far += w
        hi = max(hi, so_far / total - miss)
    return hi if abs(hi) >= abs(lo) else lo


@pytest.mark.parametrize("width", [7, 65_536])
def test_null_of_several_sizes_is_the_plain_one(spark, monkeypatch, width):
    """Also over several blocks, with a gene that many rows share, a null group, and a group without sizes."""
    monkeypatch.setattr(replicates, "WALK", width)
    rows = [(g, i if i % 4 else 0, p + 1, 60, abs(float(60 - 2 * p)) + 0.5) for g in ("x", None, "y") for p, i in enumerate(range(60))]
    listed = spark.createDataFrame(rows, "g string, gene int, position bigint, n_list bigint, weight double")
    sizes = spark.createDataFrame([("x", 5), ("x", 9), (None, 20), ("x", 5)], "g string, size bigint")
    null = enrichment.null_of_list(listed.where("gene > 0"), ["g"], "gene", sizes, 6, 3)
    got = {(r["g"], r["set_size"], r["b"]): r["null_es"] for r in null.collect()}
    assert set(got) == {(g, s, b) for g, s in (("x", 5), ("x", 9), (None, 20)) for b in range(1, 7)}
    for (g, size, b), es in got.items():
        def key(gene):
            return hashlib.md5("|".join(str(v) for v in (3, g, b, gene) if v is not None).encode()).hexdigest()[:15]
        order = sorted((key(r[1]), r[1], r[2], r[4]) for r in rows if r[0] == g and r[1] > 0)
        assert es == pytest.approx(walk([(p, w) for _, _, p, w in order[:size]], 60))
    assert null._jdf.queryExecution().toString().count("set_size") and "FlatMapCoGroupsInArrow" in null._jdf.queryExecution().toString()
    # a gene that most rows share: the first guess of the bound may hold none of it, the result is complete all the same
    many = enrichment.null_of_list(listed.withColumn("gene", listed["gene"] * 0), ["g"], "gene", sizes, 6, 3)
    assert many.count() == 18
