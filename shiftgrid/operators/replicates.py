"""Replicates as arrays: beside each row stand its B counts or B ranks, and numpy works on blocks of rows inside the tasks.

B replicates of n rows written out as rows are B x n rows in every shuffle and sort. Here a draw travels once, packed into a few
bytes, to the block of positions it falls on; from there on a row carries all its replicates. A block holds about ``BLOCK`` rows of
a group, whatever the size of the group: ties of more rows than that are dealt to several blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgrid.operators.ordered import attach, group_size, numbered
from shiftgrid.session import cut

# Rows of a group that one block holds; offsets in a block travel as two bytes.
BLOCK = 8192
# Draws that a task deals out at a time.
AT_ONCE = 2_000_000
COUNT, OFFSET = np.dtype("<u2"), np.dtype("<u2")
HASH_BITS = 60


def short(B: int) -> np.dtype:
    return np.dtype("<u2") if B < 1 << 16 else np.dtype("<u4")


def ddl(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def binary(rows: np.ndarray) -> pa.Array:
    """One binary value per row of a two-dimensional array."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize if rows.ndim == 2 else 0
    ends = np.arange(len(rows) + 1, dtype=np.int64) * width
    if width * len(rows) >= 1 << 31:
        return pa.array([r.tobytes() for r in rows], pa.large_binary())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(rows.tobytes())])


def matrix(column, kind: np.dtype, B: int) -> np.ndarray:
    """The binary values of a column as rows of B numbers."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), B)


def doubles(column) -> np.ndarray:
    """Numbers of a column; NULL as NaN."""
    return np.asarray(column.cast(pa.float64()).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array)
                      else column.cast(pa.float64()).combine_chunks().to_numpy(zero_copy_only=False), dtype=float)


def codes_of(batch: pa.RecordBatch, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number from 0 on for each distinct combination of the named columns (NULL is a value), and its first row."""
    codes = np.zeros(batch.num_rows, np.int64)
    for name in names:
        found = batch.column(name).dictionary_encode(null_encoding="encode")
        codes = np.unique(codes * max(len(found.dictionary), 1) + found.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1].reshape(-1)
    return codes, np.unique(codes, return_index=True)[1]


def pieces(group: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that gathers equal (group, block), the start of each piece, and its end."""
    key = group * (int(block.max()) + 1) + block
    order = np.argsort(key, kind="stable")
    there = key[order]
    starts = np.flatnonzero(np.r_[True, there[1:] != there[:-1]])
    return order, starts, np.r_[starts[1:], len(there)]


def even(df: DataFrame, spread: Sequence[str]) -> DataFrame:
    """Rows spread over all tasks: few input partitions may hold little data and B times as much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[F.col(c) for c in spread])


def key_text(before: Sequence[Column], after: Column) -> list[Column]:
    """The text of a draw's key but for the replicate number, as columns ``_pre`` and ``_post``; NULL parts are left out as in ``hash_key``."""
    return [F.concat_ws("|", *[c.cast("string") for c in before], F.lit("")).alias("_pre"), F.concat(F.lit("|"), after.cast("string")).alias("_post")]


def hashes(batch: pa.RecordBatch, B: int) -> np.ndarray:
    """``hash_key`` of every row and replicate."""
    numbers = [str(b).encode() for b in range(1, B + 1)]
    md5, out = hashlib.md5, []
    for pre, post in zip(batch.column("_pre").to_pylist(), batch.column("_post").to_pylist()):
        head, tail = pre.encode(), b"" if post is None else post.encode()
        out += [md5(head + b + tail).digest()[:8] for b in numbers]
    return (np.frombuffer(b"".join(out), ">u8") >> np.uint64(64 - HASH_BITS)).astype(np.int64).reshape(batch.num_rows, B)


# ------------------------------------------------------------------------------------------------------------ bootstrap
def drawn_counts(rows: DataFrame, by: Sequence[str], pos: str, drawing: DataFrame, B: int, out: str = "w") -> DataFrame:
    """``rows`` with how often each replicate drew them: B counts of two bytes.

    ``rows`` have positions 1..n in their group. Each row of ``drawing`` (group, ``_n``, ``key_text``) makes one draw a replicate.
    """
    by, wide = list(by), short(B)
    dealt_names = [*by, "_block"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, AT_ONCE // B)
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                to = hashes(batch, B) % batch.column("_n").to_numpy(zero_copy_only=False).astype(np.int64)[:, None]
                codes, first = codes_of(batch, by)
                group, which = np.repeat(codes, B), np.tile(np.arange(B, dtype=wide), len(to))
                to = to.reshape(-1)
                order, starts, ends = pieces(group, to // BLOCK)
                offset, which = (to % BLOCK).astype(OFFSET)[order], which[order]
                owner = first[group[order[starts]]]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(pa.array(owner)) for c in by], pa.array((to[order[starts]] // BLOCK).astype(np.int64)),
                     pa.array([offset[s:e].tobytes() + which[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary())],
                    names=[*by, "_block", "_hits"])

    dealt = drawing.mapInArrow(deal, f"{ddl(drawing, by)}{', ' if by else ''}`_block` bigint, `_hits` binary")
    placed = rows.withColumn("_block", F.floor((F.col(pos) - F.lit(1)) / F.lit(BLOCK)).cast("bigint"))
    size = OFFSET.itemsize + wide.itemsize

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        hits = np.zeros(BLOCK * B, np.int64)
        for piece in right.column("_hits").to_pylist():
            m = len(piece) // size
            offset = np.frombuffer(piece, OFFSET, m).astype(np.int64)
            np.add.at(hits, offset * B + np.frombuffer(piece, wide, m, m * OFFSET.itemsize), 1)
        if hits.max(initial=0) > np.iinfo(COUNT).max:
            raise OverflowError("a row was drawn more often than two bytes count")
        own = (left.column(pos).to_numpy() - 1) % BLOCK
        table = left.drop_columns(["_block"])
        return table.append_column(out, binary(hits.reshape(BLOCK, B)[own].astype(COUNT)))

    return placed.groupBy(*dealt_names).cogroup(dealt.groupBy(*dealt_names)).applyInArrow(
        count, f"{ddl(rows, rows.columns)}, `{out}` binary")


def positions(df: DataFrame, by: Sequence[str], key: str, values: Sequence[str]) -> DataFrame:
    """Rows with their position in the order of the key, and the size of their group."""
    return cut(group_size(numbered(df.select(*by, key, *[v for v in values if v != key]), by, [key], "_pos"), by, "_n"))


def bootstrap_counts(df: DataFrame, by: Sequence[str], key: str, values: Sequence[str], B: int, seed: int) -> DataFrame:
    """n of n rows with replacement, B times: every row once, with its B counts ``w``, its position and the size of its group."""
    rows = positions(df, by, key, values)
    drawing = even(rows.select(*by, "_pos", "_n"), [*by, "_pos"]).select(*by, "_n", *key_text([F.lit(seed), *[F.col(c) for c in by]], F.col("_pos")))
    return drawn_counts(rows, by, "_pos", drawing, B)


def weighted_sums(counted: DataFrame, by: Sequence[str], sums: dict[str, Column], B: int, w: str = "w") -> DataFrame:
    """One row per (group, b): ``_w``, the number of draws, and the sum of each column over them; NULL adds nothing."""
    by, names = list(by), list(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def told():
            keys = list(held)
            columns = [pa.array([k[i] for k in keys for _ in range(B)], kinds[i]) for i in range(len(by))]
            totals = np.concatenate([held[k] for k in keys])
            held.clear()
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.tile(np.arange(1, B + 1, dtype=np.int32), len(keys))), *[pa.array(totals[:, i].copy()) for i in range(len(names) + 1)]],
                names=[*by, "b", "_w", *names])

        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in by]
            counts = matrix(batch.column(w), COUNT, B).astype(float)
            given = np.column_stack([np.ones(batch.num_rows), *[np.where(batch.column(n).is_null().to_numpy(zero_copy_only=False), 0.0, doubles(batch.column(n))) for n in names]])
            codes, first = codes_of(batch, by)
            for code, at in enumerate(first):
                mine = codes == code
                mine_counts, mine_given = counts[mine], given[mine]
                if np.isfinite(mine_given).all():
                    found = mine_counts.T @ mine_given
                else:  # a row that was not drawn adds nothing, whatever it holds
                    found = np.column_stack([np.where(mine_counts > 0, mine_counts * x[:, None], 0.0).sum(axis=0) for x in mine_given.T])
                key = tuple(batch.column(c)[int(at)].as_py() for c in by)
                held[key] = held[key] + found if key in held else found
            if len(held) * B > 100_000:
                yield told()
        if held:
            yield told()

    given = counted.select(*by, w, *[c.cast("double").alias(n) for n, c in sums.items()])
    parts = given.mapInArrow(add, f"{ddl(counted, by)}{', ' if by else ''}b int, _w double" + "".join(f", `{n}` double" for n in names))
    return parts.groupBy(*by, "b").agg(F.sum("_w").alias("_w"), *[F.sum(n).alias(n) for n in names])


def pair_sums(pairs: dict[str, tuple[str, str]]) -> dict[str, Column]:
    """The sums that ``corr_of_sums`` needs."""
    one = {c: F.col(c) for p in pairs.values() for c in p}
    out = {f"_s_{c}": x for c, x in one.items()} | {f"_q_{c}": x * x for c, x in one.items()}
    return out | {f"_p_{n}": one[x] * one[y] for n, (x, y) in pairs.items()}


def corr_of_sums(name: str, x: str, y: str) -> Column:
    """Weighted correlation from the sums of ``pair_sums``; NULL where a side is constant."""
    n, sa, sb, saa, sbb, sab = (F.col(c) for c in ("_w", f"_s_{x}", f"_s_{y}", f"_q_{x}", f"_q_{y}", f"_p_{name}"))
    va, vb, tiny = n * saa - sa * sa, n * sbb - sb * sb, F.lit(1e-12)
    varies = (va > tiny * n * saa) & (vb > tiny * n * sbb)
    return F.when(varies, F.try_divide(n * sab - sa * sb, F.sqrt(F.abs(va)) * F.sqrt(F.abs(vb)))).alias(name)


# --------------------------------------------------------------------------------------------------------------- orders
def segments(counted: DataFrame, by: Sequence[str], columns: Sequence[str], B: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of the rows in the order of each column, and what the replicates drew before each block.

    Columns are whole numbers that grow by two per row (twice the average rank). Returns the rows with ``_seg_<column>`` and
    ``_deal_<column>``, and rows (column, group, segment, ``_parts``, ``_before``, ``_here``). A tie of more than ``BLOCK`` rows is a
    segment of its own, dealt to ``_parts`` blocks: its rows share one rank, so none has to see the others.
    """
    by = list(by)
    listed = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("bigint").alias("v")) for c in columns])).alias("_x")
    ties = counted.select(*by, listed).select(*by, F.col("_x.c").alias("_c"), F.col("_x.v").alias("_v")).groupBy(*by, "_c", "_v").agg(F.count(F.lit(1)).alias("_m"))
    # two such ties lie more than a slice apart, and there are fewer than rows / BLOCK
    hot = cut(ties.where(F.col("_m") > BLOCK).select(
        *by, "_c", F.floor(F.col("_v") / F.lit(2 * BLOCK)).cast("bigint").alias("_slice"), F.col("_v").alias("_hot"), F.ceil(F.col("_m") / F.lit(BLOCK)).cast("int").alias("_parts")))
    rows = counted
    for c in columns:
        own = F.broadcast(hot.where(F.col("_c") == c).drop("_c"))
        met = attach(rows.withColumn("_slice", F.floor(F.col(c) / F.lit(2 * BLOCK)).cast("bigint")), own, [*by, "_slice"])
        inside = F.col(c) == F.col("_hot")
        code = F.col("_slice") * 3 + F.when(F.col("_hot").isNull() | (F.col(c) < F.col("_hot")), 0).when(inside, 1).otherwise(2)
        deal = F.when(inside, F.pmod(F.col("_pos"), F.col("_parts")).cast("int")).otherwise(0)
        rows = met.select(*rows.columns, code.cast("bigint").alias(f"_seg_{c}"), deal.alias(f"_deal_{c}"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = matrix(batch.column("w"), COUNT, B)
            for c in columns:
                codes, first = codes_of(batch, [*by, f"_seg_{c}"])
                order = np.argsort(codes, kind="stable")
                sums = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(np.r_[True, np.diff(codes[order]) > 0]), axis=0)
                took = pa.array(first)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(took) for k in by], pa.array([c] * len(first)), batch.column(f"_seg_{c}").take(took),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * B), pa.array(sums.reshape(-1)))],
                    names=[*by, "_c", "_seg", "_t"])

    keys = [*by, "_c", "_seg"]
    # in order of one column few rows of a batch share a segment of it, so the sums of a task are gathered before the shuffle
    parts = rows.select(*by, "w", *[f"_seg_{c}" for c in columns]).mapInArrow(add, f"{ddl(rows, by)}{', ' if by else ''}_c string, _seg bigint, _t array<bigint>")
    totals = parts.select(*keys, F.posexplode("_t").alias("_b", "_t")).groupBy(*keys, "_b").agg(F.sum("_t").alias("_t"))
    names = ", ".join(f"`{c}`" for c in [*by, "_c", "_b"])
    before = F.expr(f"coalesce(sum(_t) OVER (PARTITION BY {names} ORDER BY _seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    packed = totals.withColumn("_o", before).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_b", "_o", "_t"))).alias("_a"))
    slice_of = F.floor(F.col("_seg") / F.lit(3)).cast("bigint")
    sized = attach(packed.withColumn("_slice", slice_of), F.broadcast(hot.drop("_hot")), [*by, "_c", "_slice"])
    return rows, sized.select(
        *keys, F.when(F.col("_seg") % 3 == 1, F.col("_parts")).otherwise(F.lit(1)).alias("_parts"),
        F.transform("_a", lambda x: x["_o"]).alias("_before"), F.transform("_a", lambda x: x["_t"]).alias("_here"))


def walk(rows: DataFrame, by: Sequence[str], column: str, offsets: DataFrame, keep: Sequence[str], fn, schema: str) -> DataFrame:
    """``fn(rows of a block, what was drawn before it, what its whole tie drew or None)`` for every block of a column's order."""
    by = list(by)
    places = offsets.where(F.col("_c") == column).select(
        *by, F.col("_seg").alias("_at"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_deal"), "_before", "_here")
    keys = [*by, "_at", "_deal"]
    laid = rows.select(*by, *[c for c in keep if c not in by], F.col(column).alias("_o"), F.col(f"_seg_{column}").alias("_at"), F.col(f"_deal_{column}").alias("_deal"))

    def of_block(left: pa.Table, right: pa.Table) -> pa.Table:
        # offsets that were left out belong to blocks that nobody asked for
        if right.num_rows == 0 or left.num_rows == 0:
            return fn(left.slice(0, 0), np.zeros(0, np.int64), None)
        before, here = (np.asarray(right.column(c)[0].as_py(), np.int64) for c in ("_before", "_here"))
        return fn(left, before, here if left.column("_at")[0].as_py() % 3 == 1 else None)

    return laid.groupBy(*keys).cogroup(places.groupBy(*keys)).applyInArrow(of_block, schema)


def ranks_of(table: pa.Table, before: np.ndarray, tie: np.ndarray | None, B: int) -> np.ndarray:
    """Twice the average-tie rank of each row in each replicate, less one."""
    if tie is not None:
        return np.broadcast_to(2 * before + tie, (table.num_rows, B))
    counts = matrix(table.column("w"), COUNT, B)
    value = table.column("_o").to_numpy()
    order = np.argsort(value, kind="stable")
    opens = np.r_[True, np.diff(value[order]) != 0]
    block = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(opens), axis=0)
    rank = 2 * (np.cumsum(block, axis=0) - block + before) + block
    out = np.empty((table.num_rows, B), np.int64)
    out[order] = rank[np.cumsum(opens) - 1]
    return out


def rank_correlations(counted: DataFrame, by: Sequence[str], pairs: dict[str, tuple[str, str]], B: int) -> DataFrame:
    """Spearman correlations of named column pairs in every replicate: one row per (group, b).

    Columns hold twice the average rank among all rows. Each but the last gets its B ranks written beside the row in a walk through its
    own order; the walk through the last one sums.
    """
    by = list(by)
    columns = sorted({c for p in pairs.values() for c in p}, key=lambda c: (sum(c in p for p in pairs.values()), c))
    rows, offsets = segments(cut(counted), by, columns, B)
    offsets = cut(offsets)
    largest = rows.agg(F.max("_n").alias("m")).first()["m"] or 0
    kind = np.dtype("<i4") if 2 * largest < 1 << 31 else np.dtype("<i8")
    carried = [*by, "_pos", "w", *[f"{p}{c}" for c in columns for p in ("", "_seg_", "_deal_")]]
    for c in columns[:-1]:

        def ranked(table: pa.Table, before, tie, c=c) -> pa.Table:
            out = table.drop_columns(["_o", "_at", "_deal"])
            return out.append_column(f"_r_{c}", binary(ranks_of(table, before, tie, B).astype(kind)) if table.num_rows else pa.array([], pa.binary()))

        keep = [x for x in carried if x not in (c, f"_seg_{c}", f"_deal_{c}")]
        types = ddl(rows, [x for x in keep if not x.startswith("_r_")]) + "".join(f", `{x}` binary" for x in keep if x.startswith("_r_"))
        rows = walk(rows, by, c, offsets, keep, ranked, f"{types}, `_r_{c}` binary")
        carried = [*keep, f"_r_{c}"]
    last = columns[-1]
    sums = [f"_s_{c}" for c in columns] + [f"_q_{c}" for c in columns] + [f"_p_{n}" for n in pairs]
    schema = ddl(rows, by) + (", " if by else "") + "b int, _w double" + "".join(f", `{n}` double" for n in sums)

    def summed(table: pa.Table, before, tie) -> pa.Table:
        if not table.num_rows:
            return pa.table({**{c: table.column(c) for c in by}, "b": pa.array([], pa.int32()), **{n: pa.array([], pa.float64()) for n in ("_w", *sums)}})
        w = matrix(table.column("w"), COUNT, B).astype(float)
        r = {c: matrix(table.column(f"_r_{c}"), kind, B).astype(float) for c in columns[:-1]} | {last: ranks_of(table, before, tie, B).astype(float)}
        r = {c: (x + 1.0) / 2.0 for c, x in r.items()}
        weighted = {c: w * x for c, x in r.items()}
        found = {"_w": w.sum(axis=0)} | {f"_s_{c}": weighted[c].sum(axis=0) for c in columns}
        found |= {f"_q_{c}": np.einsum("ij,ij->j", weighted[c], r[c]) for c in columns}
        found |= {f"_p_{n}": np.einsum("ij,ij->j", weighted[x], r[y]) for n, (x, y) in pairs.items()}
        own = {c: table.column(c).take(pa.array(np.zeros(B, np.int64))) for c in by}
        return pa.table({**own, "b": pa.array(np.arange(1, B + 1, dtype=np.int32)), **{n: pa.array(found[n]) for n in ("_w", *sums)}})

    parts = walk(rows, by, last, offsets, [x for x in carried if x not in (last, f"_seg_{last}", f"_deal_{last}")], summed, schema)
    total = parts.groupBy(*by, "b").agg(F.sum("_w").alias("_w"), *[F.sum(n).alias(n) for n in sums])
    return total.select(*by, "b", *[corr_of_sums(n, x, y) for n, (x, y) in pairs.items()])


def top_agreement(counted: DataFrame, by: Sequence[str], place: str, pred: str, real: str, ks: Sequence[int], B: int) -> DataFrame:
    """Sign agreement among the k first draws of each replicate in the order of ``place``: one row per (group, b).

    Copies count, so the last row may count in part; a prediction of zero does not count. Blocks that no replicate needs for the
    largest k are not walked.
    """
    by = list(by)
    rows, offsets = segments(cut(counted.withColumn("_top2", F.col(place).cast("bigint") * 2)), by, ["_top2"], B)
    needed = cut(offsets.where(F.array_min("_before") < int(max(ks))))
    wanted = F.broadcast(needed.select(*by, F.col("_seg").alias("_seg__top2")))
    near = attach(rows, wanted, [*by, "_seg__top2"], "inner")
    names = [f"_{side}_{k}" for k in ks for side in ("num", "den")]
    schema = ddl(rows, by) + (", " if by else "") + "b int" + "".join(f", `{n}` double" for n in names)

    def agreed(table: pa.Table, before, tie) -> pa.Table:
        found = {n: np.zeros(B if table.num_rows else 0) for n in names}
        if table.num_rows:
            order = np.argsort(table.column("_o").to_numpy(), kind="stable")
            w = matrix(table.column("w"), COUNT, B).astype(float)[order]
            above = np.cumsum(w, axis=0) - w + before
            p, r = (np.sign(doubles(table.column(c)))[order] for c in ("_pred", "_real"))
            signed, agree = (p != 0)[:, None], (p == r)[:, None]
            for k in ks:
                inside = np.where(signed, np.clip(np.minimum(w, k - above), 0.0, None), 0.0)
                found[f"_num_{k}"], found[f"_den_{k}"] = (inside * agree).sum(axis=0), inside.sum(axis=0)
        n = B if table.num_rows else 0
        columns = {c: table.column(c).take(pa.array(np.zeros(n, np.int64))) for c in by}
        return pa.table({**columns, "b": pa.array(np.arange(1, n + 1, dtype=np.int32)), **{k: pa.array(v) for k, v in found.items()}})

    given = near.withColumns({"_pred": F.col(pred).cast("double"), "_real": F.col(real).cast("double")})
    parts = walk(given, by, "_top2", needed, [*by, "w", "_pred", "_real"], agreed, schema)
    return parts.groupBy(*by, "b").agg(*[F.try_divide(F.sum(f"_num_{k}"), F.sum(f"_den_{k}")).alias(f"deg_conc_{k}") for k in ks])


# ----------------------------------------------------------------------------------------------------------- enrichment
# Positions of a list that one task walks.
WALK = 65_536


def walked_sets(taken: DataFrame, by: Sequence[str], sizes: DataFrame) -> DataFrame:
    """Enrichment scores of random sets of several sizes: rows (group, set_size, b, null_es).

    ``taken``: group, b, position, weight, n_list and ``_at``; the hits with ``_at`` up to a size are the set of that size. ``sizes``: group,
    ``_size``. A hit is one row whatever the sizes it belongs to: a task walks a block of positions once a size, after one pass has
    told what lies before each block.
    """
    by = list(by)
    keys = [*by, "b", "_blk"]
    blocked = taken.select(*by, "b", "position", "weight", "_at", "n_list", F.floor((F.col("position") - 1) / F.lit(WALK)).cast("bigint").alias("_blk"))
    asked = sizes.groupBy(*by).agg(F.array_sort(F.collect_set(F.col("_size").cast("bigint"))).alias("_sizes"))
    places = cut(attach(blocked.groupBy(*keys).agg(F.max("n_list").alias("_n")), asked, by, "inner"))

    def hits_of(left: pa.Table):
        order = np.argsort(left.column("position").to_numpy(), kind="stable")
        return [doubles(left.column(c))[order] for c in ("position", "weight", "_at")]

    def key_row(table: pa.Table) -> dict:
        return {c: table.column(c).slice(0, 1) for c in keys}

    def listed(values: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.array([values], pa.list_(kind))

    head = ddl(blocked, keys)

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        _, weight, at = hits_of(left)
        asked = np.asarray(right.column("_sizes")[0].as_py(), float)
        inside = at[:, None] <= asked[None, :]
        return pa.table({**key_row(right), "_t": listed(weight @ inside, pa.float64()), "_c": listed(inside.sum(axis=0), pa.int64())})

    totals = blocked.drop("n_list").groupBy(*keys).cogroup(places.groupBy(*keys)).applyInArrow(add, f"{head}, _t array<double>, _c array<bigint>")
    each = totals.select(*keys, F.posexplode(F.arrays_zip("_t", "_c")).alias("_i", "_x")).select(*keys, "_i", F.col("_x._t").alias("_t"), F.col("_x._c").alias("_c"))
    each = cut(each)
    names = ", ".join(f"`{c}`" for c in [*by, "b", "_i"])
    before = f"OVER (PARTITION BY {names} ORDER BY _blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    laid = each.selectExpr("*", f"coalesce(sum(_t) {before}, 0D) AS _tb", f"coalesce(sum(_c) {before}, 0) AS _cb",
                           f"sum(_t) OVER (PARTITION BY {names}) AS _ta", f"sum(_c) OVER (PARTITION BY {names}) AS _ca")
    packed = laid.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_tb", "_cb", "_ta", "_ca"))).alias("_a"))
    offsets = attach(places, packed, keys, "inner").select(*keys, "_sizes", "_n", *[F.col(f"_a.{c}").alias(c) for c in ("_tb", "_cb", "_ta", "_ca")])

    def walk_block(left: pa.Table, right: pa.Table) -> pa.Table:
        position, weight, at = hits_of(left)
        asked, n = np.asarray(right.column("_sizes")[0].as_py(), float), right.column("_n")[0].as_py()
        tb, cb, ta, ca = (np.asarray(right.column(c)[0].as_py(), float) for c in ("_tb", "_cb", "_ta", "_ca"))
        hi, lo = np.zeros(len(asked)), np.zeros(len(asked))
        for i, size in enumerate(asked):
            inside = at <= size
            if ta[i] <= 0 or ca[i] >= n or not inside.any():
                continue
            p, w = position[inside], weight[inside]
            so_far = tb[i] + np.cumsum(w)
            miss = (p - (cb[i] + np.arange(1, len(p) + 1))) / (n - ca[i])
            hi[i], lo[i] = max(0.0, (so_far / ta[i] - miss).max()), min(0.0, ((so_far - w) / ta[i] - miss).min())
        return pa.table({**key_row(right), "_sizes": listed(asked.astype(np.int64), pa.int64()), "_hi": listed(hi, pa.float64()), "_lo": listed(lo, pa.float64()),
                         "_ca": listed(ca.astype(np.int64), pa.int64())})

    walked = blocked.drop("n_list").groupBy(*keys).cogroup(offsets.groupBy(*keys)).applyInArrow(
        walk_block, f"{head}, _sizes array<bigint>, _hi array<double>, _lo array<double>, _ca array<bigint>")
    each = walked.select(*by, "b", F.explode(F.arrays_zip("_sizes", "_hi", "_lo", "_ca")).alias("_x")).select(*by, "b", "_x.*").where("_ca > 0")
    ends = each.groupBy(*by, F.col("_sizes").alias("set_size"), "b").agg(F.max("_hi").alias("_hi"), F.min("_lo").alias("_lo"))
    return ends.select(*by, "set_size", "b", F.when(F.abs("_hi") >= F.abs("_lo"), F.col("_hi")).otherwise(F.col("_lo")).alias("null_es"))
