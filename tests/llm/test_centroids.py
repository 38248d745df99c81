"""Dimension-sharded k-means against plain Python whole numbers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from shiftgrid.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<float>, label int, id int, chunk string, block int, cluster int, distance string, data int"


def brute(rows, dim, k, rounds, scale=1024, seed=3):
    vectors = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows
               if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(vectors, key=lambda x: (x[0] is None, hashlib.sha256(f"{seed}:{x[0]}".encode()).hexdigest() * (x[0] is not None), x[1]))
    centres = [v for _, v in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        labels = [nearest(v)[1] for _, v in vectors]
        for j in range(len(centres)):
            own = [v for (_, v), at in zip(vectors, labels, strict=True) if at == j]
            if own:
                centres[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return sorted((repr(i), j, d) for (i, _), (d, j) in zip(vectors, [nearest(v) for _, v in vectors], strict=True)), centres


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "c", 2, 3, "d", 4) for i, v in rows], SCHEMA)


def check(spark, rows, dim, k, rounds, **kw):
    members, figures = centroids.cluster(frame(spark, rows), dim=dim, k=k, rounds=rounds, **kw)
    got = sorted((repr(r.vec_id), r.cluster, r.distance) for r in members.collect())
    want, centres = brute(rows, dim, k, rounds)
    assert got == want
    by = {r.cluster: r for r in figures.collect()}
    assert [list(by[j].centroid) for j in range(len(centres))] == centres
    for j in range(len(centres)):
        own = [d for _, c, d in want if c == j]
        assert (by[j].vectors, by[j].inertia) == (len(own), sum(own))


@pytest.mark.parametrize(("n", "dim", "k", "chunk", "width"), [(90, 6, 3, 7, 2), (60, 5, 4, 1, 3), (40, 4, 2, 1_000, 4), (5, 3, 8, 2, 1)])
def test_as_brute_force(spark, n, dim, k, chunk, width):
    rng = random.Random(n)
    rows = [(i, [rng.gauss(i % 3, 0.4) for _ in range(dim)]) for i in range(n)]
    check(spark, rows, dim, k, 4, chunk=chunk, width=width)


def test_left_out_repeated_and_tied(spark):
    good = [0.25, -0.5, 1.0]
    rows = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 2.0]), (5, [1.0, float("nan"), 0.0]), (6, [float("inf"), 0.0, 0.0]),
            (7, good), (7, good), (7, [9.0, 9.0, 9.0]), (None, good), (None, [0.0, 0.0, -3.0]), *[(20, good)] * 30, (9, [-0.0, -1e-9, 1e-30])]
    check(spark, rows, 3, 4, 3, chunk=4, width=2)


def test_empty_tables(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        members, figures = centroids.cluster(frame(spark, rows), dim=2)
        assert members.count() == 0 and figures.count() == 0


def test_values_beyond_exact_range_raise(spark):
    with pytest.raises(Exception, match="exceeds"):
        centroids.cluster(frame(spark, [(1, [1e30, 0.0]), (2, [0.0, 0.0])]), dim=2)[0].count()


def test_large_whole_numbers_stay_exact(spark):
    rng = random.Random(8)
    rows = [(i, [float(rng.randint(-100_000, 100_000)) for _ in range(3)]) for i in range(30)]
    check(spark, rows, 3, 3, 3, chunk=5, width=2)


def test_blocks_do_not_move_between_rounds(spark, capsys):
    """The table of column blocks is read by its buckets: only labels are exchanged for the join."""
    rng = random.Random(1)
    df = frame(spark, [(i, [rng.random() for _ in range(4)]) for i in range(50)])
    vectors = df.where(centroids.usable("embedding", 4)).select("vec_id", centroids.scaled("embedding", 1024).alias("whole"))
    shards = centroids.shard(vectors, "vec_id", 4, chunk=5, width=2)
    labels = spark.range(10).withColumnRenamed("id", "cell").hint("merge")
    shards.cells.join(labels, "cell").explain()
    plan = capsys.readouterr().out
    side = plan[plan.index("Bucketed: true") - 400:plan.index("Bucketed: true")]
    assert "Exchange" not in side


def test_query(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(64)]) for i in range(40)]
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op13_centroids"](spark, str(tmp_path)).collect()
    want, centres = brute(rows, 64, 8, 10)
    assert sorted((repr(r.vec_id), r.cluster, r.distance) for r in got) == want
    for r in got:
        assert r.inertia == sum(d for _, _, d in want) and r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()
