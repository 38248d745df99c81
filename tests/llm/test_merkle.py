"""Merkle manifest against hashlib."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from shiftgrid.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, _by int, _leaf string, at int, n int, hash int, block int"


def hashed(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes: list[str], arity: int) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([hashed(*below[i:i + arity]) for i in range(0, len(below), arity)])
    return levels


def path_of(levels: list[list[str]], i: int, arity: int) -> list[tuple]:
    out = []
    for level in levels[:-1]:
        a = i // arity * arity
        out.append(("".join(level[a:i]), "".join(level[i + 1:a + arity])))
        i //= arity
    return out


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute(rows, arity=8):
    """(doc_id, leaf, subroot, root, path) rows."""
    by: dict = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, hashed(*map(field, r[:5])), r[0]))
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([x[2] for x in sorted(by[g], key=lambda x: x[:3])], arity) for g in langs}
    top = levels_of([trees[g][-1][0] for g in langs], arity)
    return [
        (x[3], x[2], trees[g][-1][0], top[-1][0], path_of(trees[g], i, arity) + path_of(top, at, arity))
        for at, g in enumerate(langs) for i, x in enumerate(sorted(by[g], key=lambda x: x[:3]))
    ]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5) for r in rows], SCHEMA)


def proofs(df, **kw):
    leaf = merkle.leaf_of(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    return merkle.manifest(df, "lang", "doc_id", leaf, **kw)


def key(r):
    return repr((r[0] is not None, r[0] or 0, *r[1:]))


def rows_of(sizes: dict, seed=1):
    rng = random.Random(seed)
    ids = list(range(sum(sizes.values())))
    rng.shuffle(ids)
    return [(ids.pop(), rng.choice(["a", "é", None]), g, rng.choice([None, 3, -12]), rng.choice([None, "", "Tëxt", "AB" * 50]))
            for g, n in sizes.items() for _ in range(n)]


@pytest.mark.parametrize(("arity", "depth", "sizes"), [
    (8, 4, {"en": 1}), (8, 4, {"en": 70, None: 8, "": 9, "de": 65, "fr": 1}), (2, 1, {"en": 13, "de": 1, "fr": 2, None: 3}),
    (3, 2, {"en": 100, "de": 10, "zh": 82}), (2, 3, {f"g{i:02d}": i % 4 + 1 for i in range(20)}), (8, 1, {"en": 520, "de": 64}),
])
def test_as_brute_force(spark, mode, arity, depth, sizes):
    rows = rows_of(sizes)
    got = proofs(frame(spark, rows), arity=arity, depth=depth).collect()
    found = [(r.doc_id, r.leaf, r.subroot, r.root, [(bytes(s.left).decode(), bytes(s.right).decode()) for s in r.path]) for r in got]
    assert sorted(found, key=key) == sorted(brute(rows, arity), key=key)


def test_repeated_and_null_ids(spark, mode):
    rows = [(None, "s", "en", 1, "a"), (None, "s", "en", 1, "b"), *[(7, "s", "en", 1, "same")] * 40, (7, "t", "en", 1, "other"), (8, None, None, None, None)]
    got = proofs(frame(spark, rows), arity=4, depth=2).collect()
    found = [(r.doc_id, r.leaf, r.subroot, r.root, [(bytes(s.left).decode(), bytes(s.right).decode()) for s in r.path]) for r in got]
    assert sorted(found, key=key) == sorted(brute(rows, 4), key=key)


def test_empty(spark):
    assert proofs(frame(spark, [])).count() == 0


def test_paths_lead_to_the_root_and_changes_do_not(spark):
    rows = rows_of({"en": 30, "de": 4}, seed=4)
    df = proofs(frame(spark, rows), carry={"other": F.sha2(F.col("doc_id").cast("string"), 256)}, arity=4, depth=1)
    df = df.select("root", merkle.folded(F.col("leaf"), F.col("path")).alias("same"), merkle.folded(F.col("other"), F.col("path")).alias("wrong"))
    for r in df.collect():
        assert r.same == r.root != r.wrong


def test_query_columns(spark, tmp_path):
    rows = rows_of({"en": 20, None: 3, "de": 1}, seed=9) + [(900, "S", "en", 4, "ALL Capitals"), (None, None, "en", None, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.leaf): r for r in queries.QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = {hashed(*map(field, r[:5])): r for r in rows}
    for doc_id, leaf, subroot, root, path in brute(rows):
        r = got[doc_id, leaf]
        row = list(texts[leaf][:5])
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and row[4] is not None:
            row[4] = row[4].translate(low)
        node = hashed(*map(field, row))
        for a, b in path:
            node = hashed(a, node, b)
        assert (r.subroot, r.root, r.proof_sha256) == (subroot, root, hashed(*[a + b for a, b in path]))
        assert (r.folded_root, r.verified) == (node, node == root)
