"""Replicates whose draws never move: a task holds a group, or a block of its positions, and makes the draws itself.

Draws are keyed by text, so every task can make them again. A row travels once, packed with its neighbours, to each of the tasks that
share the replicates of its group (``DEALT`` at most), and what leaves a task is one row per replicate. Groups of more than ``HELD``
rows are not held: callers keep a form with rows per replicate for them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftgrid.operators.ordered import group_size, numbered
from shiftgrid.operators.replicates import HASH_BITS, codes_of, ddl, doubles, key_text
from shiftgrid.session import cut

# Rows of a group that one task holds, and of a block of it where blocks can stand alone.
HELD, BLOCK = 8_000_000, 3_000_000
# Tasks that share the replicates of a group; a row travels to each of them.
DEALT = 8
# Texts whose digests are taken together, fewest for which that pays, and bytes that one block of the digest holds.
AT_ONCE, FEW, ONE_BLOCK = 32_768, 512, 55
# Rows of a held group that one step of an addition takes, so that its products stay small.
STEP = 1 << 20

SINES = np.array([int(abs(np.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)], np.uint32)
TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
WORDS = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def digests(words: list, n: int) -> np.ndarray:
    """The first 60 bits of the md5 of n texts of one block: 16 words, each an array or, where all texts share it, a number."""
    a, b, c, d = (np.full(n, s, np.uint32) for s in START)
    f, turned = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        word = words[WORDS[i]]
        if isinstance(word, np.ndarray):
            f += word
            f += SINES[i]
        else:
            f += np.uint32((int(SINES[i]) + word) & 0xFFFFFFFF)
        f += a
        np.left_shift(f, np.uint32(TURNS[i]), out=turned)
        f >>= np.uint32(32 - TURNS[i])
        f |= turned
        f += b
        a, d, c, b, f = d, c, b, f, a
    a += np.uint32(START[0])
    b += np.uint32(START[1])
    whole = (a.byteswap().astype(np.uint64) << np.uint64(32)) | b.byteswap()
    return (whole >> np.uint64(64 - HASH_BITS)).astype(np.int64)


class Texts:
    """Ends of texts, whose digests are taken behind a head: ``hashes(head)`` is ``hash_key`` of head + end for every one."""

    def __init__(self, parts: list[tuple[slice | np.ndarray, np.ndarray]], n: int):
        self.parts, self.n, self.width, self.laid = parts, n, -1, []

    @classmethod
    def numbers(cls, n: int) -> Texts:
        """``|1`` to ``|n``."""
        parts, at = [], 1
        while at <= n:
            length = len(str(at))
            end = min(at + AT_ONCE, n + 1, 10**length)
            number = np.arange(at, end, dtype=np.int64)
            text = np.empty((len(number), length + 1), np.uint8)
            text[:, 0] = ord("|")
            for i in range(length):
                text[:, length - i] = number // 10**i % 10 + ord("0")
            parts.append((slice(at - 1, end - 1), text))
            at = end
        return cls(parts, n)

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        """The texts of a column, or ``|`` and its whole numbers; NULL is empty."""
        parts = []
        for at in range(0, len(column), AT_ONCE):
            some = column.slice(at, AT_ONCE)
            if pa.types.is_integer(some.type):
                some = pc.binary_join_element_wise("", some.cast(pa.string()), "|")
            some = pa.concat_arrays([some.fill_null("").cast(pa.large_binary())])  # of its own, not a part of a longer one
            begin = np.frombuffer(some.buffers()[1], np.int64, len(some) + 1)
            data = np.frombuffer(some.buffers()[2] or b"", np.uint8)
            lengths = np.diff(begin)
            for length in np.unique(lengths):
                mine = np.flatnonzero(lengths == length)
                where = slice(at, at + len(lengths)) if len(mine) == len(lengths) else (mine + at).astype(np.int32)
                parts.append((where, data[begin[mine][:, None] + np.arange(length)]))
        return cls(parts, len(column))

    def ends(self) -> Iterator[tuple[slice | np.ndarray, np.ndarray]]:
        """The texts by length. Once they are laid out as words, they are only kept there."""
        yield from self.parts
        for where, n, words, texts, length in self.laid:
            if words is None:
                yield where, np.frombuffer(b"".join(texts), np.uint8).reshape(n, length)
            else:
                first = self.width // 4
                own = [w for w in words if isinstance(w, np.ndarray)]
                yield where, np.ascontiguousarray(np.column_stack(own)).view(np.uint8)[:, self.width - 4 * first:][:, :length]

    def lay(self, width: int) -> None:
        """The words of every text behind a head of ``width`` bytes."""
        laid = []
        for where, text in self.ends():
            n, length = text.shape
            end = width + length
            if n < FEW or end > ONE_BLOCK:
                laid.append((where, n, None, [t.tobytes() for t in text], length))
                continue
            block = np.zeros((n, 64), np.uint8)
            block[:, width:end] = text
            block[:, end] = 0x80
            words = block.view("<u4")
            own = range(width // 4, end // 4 + 1)
            laid.append((where, n, [np.ascontiguousarray(words[:, i]) if i in own else 8 * end if i == 14 else 0 for i in range(16)], None, length))
        self.width, self.laid, self.parts = width, laid, []

    def hashes(self, head: bytes) -> np.ndarray:
        if self.width != len(head):
            self.lay(len(head))
        first = np.frombuffer(head.ljust(-(-len(head) // 64) * 64 or 64, b"\0"), "<u4")
        out = np.empty(self.n, np.int64)
        for where, n, words, texts, _ in self.laid:
            if words is None:
                md5 = hashlib.md5
                found = np.frombuffer(b"".join([md5(head + t).digest()[:8] for t in texts]), ">u8") >> np.uint64(64 - HASH_BITS)
                out[where] = found.astype(np.int64)
            else:
                out[where] = digests([w | first[i] if isinstance(w, np.ndarray) else w | int(first[i]) for i, w in enumerate(words)], n)
        return out


def in_order(h: np.ndarray) -> np.ndarray:
    """Numbers of the rows in the order of their hash; equal hashes stay in the order of the rows."""
    bits = np.uint64(max(len(h) - 1, 1).bit_length())
    # the row number takes the place of the last bits of the hash: sorting values is several times faster than sorting numbers of rows
    packed = h.astype(np.uint64)
    packed <<= np.uint64(64 - HASH_BITS)
    packed >>= bits
    packed <<= bits
    packed |= np.arange(len(h), dtype=np.uint64)
    packed.sort()
    equal = np.concatenate([at + np.flatnonzero((packed[at + 1:at + STEP + 1] ^ packed[at:at + STEP][:len(packed) - 1 - at]) >> bits == 0)
                            for at in range(0, len(packed), STEP)])
    if len(equal) > 1_000:
        return np.argsort(h, kind="stable")
    packed &= (np.uint64(1) << bits) - np.uint64(1)
    rows = packed.view(np.int64)
    for run in np.split(equal, np.flatnonzero(np.diff(equal) > 1) + 1):
        if len(run):
            mine = rows[run[0]:run[-1] + 2]
            rows[run[0]:run[-1] + 2] = mine[np.lexsort((mine, h[mine]))]
    return rows


def positioned(df: DataFrame, by: Sequence[str], key: str, values: dict[str, Column], seed: int) -> DataFrame:
    """``by``, position in the order of the key (``_pos``), size of the group (``_n``), ``values``, and the two sides of the text of a
    draw's key around the replicate number (``_pre``, ``_post``)."""
    asked = df.select(*by, F.col(key).alias("_key"), *[c.alias(n) for n, c in values.items()])
    rows = cut(group_size(numbered(asked, by, ["_key"], "_pos"), by, "_n"))
    before, after = key_text([F.lit(seed), *[F.col(c) for c in by]], F.col("_key"))
    # a whole number is shorter than its text
    whole = isinstance(df.schema[key].dataType, T.IntegralType)
    return rows.select(*by, "_pos", "_n", *values, before, F.col("_key").cast("bigint").alias("_post") if whole else after)


def text_of(rows: DataFrame) -> Column:
    """The text of the key of a draw that rows of ``positioned`` make in replicate ``b``."""
    after = F.col("_post") if isinstance(rows.schema["_post"].dataType, T.StringType) else F.concat(F.lit("|"), F.col("_post").cast("string"))
    return F.concat("_pre", F.col("b").cast("string"), F.coalesce(after, F.lit("")))


def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """The rows of groups that a task can hold, those of the other groups if there are any, and the number of groups."""
    told = rows.agg(F.max("_n").alias("most"), F.count(F.when(F.col("_pos") == 1, 1)).alias("groups")).first()
    if (told["most"] or 0) <= HELD:
        return rows, None, told["groups"]
    return rows.where(F.col("_n") <= HELD), rows.where(F.col("_n") > HELD), told["groups"]


def each_replicate(
    rows: DataFrame, by: Sequence[str], values: Sequence[str], B: int, groups: int, work: Callable, schema: dict[str, str],
    texts: bool = True, block: int | None = None,
) -> DataFrame:
    """``work(columns, texts, head, n, replicates, low)`` of every group: columns of one value or list per replicate, by name.

    ``rows`` come from ``positioned``. ``work`` gets the named ``values`` (Arrow arrays in the order of the positions), the ends of the texts (None
    without ``texts``), the text before the replicate number as bytes, the size of the group and the replicates it is to make. With
    ``block``, it gets the rows of that many positions at a time, which start behind ``low``. ``schema`` has the types of what it returns; the result has ``by``, ``b`` and
    that. No columns, or shorter ones, stand for replicates without a result.
    """
    spark, by = rows.sparkSession, list(by)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = max(1, min(DEALT, B, -(-2 * partitions // max(groups, 1))))
    keys = [*by, "_n", "_pre", "_block"]
    kept = ["_pos", *values, *(["_post"] if texts else [])]
    names = list(schema)
    place = F.floor((F.col("_pos") - 1) / F.lit(block)) if block else F.lit(0)
    within = (F.col("_pos") - 1 - F.col("_block") * F.lit(block or 0)).cast("int").alias("_pos")
    laid = rows.withColumn("_block", place.cast("bigint")).select(*keys, within, *kept[1:]).sortWithinPartitions(*by, "_block")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, first = codes_of(batch, keys)
            own, packed = batch.select(kept), []
            for code in range(len(first)):
                piece = own.filter(pa.array(codes == code))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema) as stream:
                    stream.write_batch(piece)
                packed.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(first)) for c in keys], pa.array(packed, pa.binary())], names=[*keys, "_rows"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at: tuple = ()
        kinds: list[pa.DataType] = []

        def done() -> pa.RecordBatch:
            pos = np.concatenate([piece.column("_pos").to_numpy() for piece in held])
            order = pa.array(np.argsort(pos, kind="stable"))
            del pos
            columns = {}
            for c in kept[1:]:
                columns[c] = pa.concat_arrays([piece.column(c) for piece in held]).take(order)
            held.clear()
            del order
            ends = Texts.of(columns.pop("_post")) if texts else None
            *group, n, head, number, part = at
            some = range(part + 1, B + 1, dealt)
            found = work(columns, ends, head.encode(), n, some, number * (block or 0))
            length = len(next(iter(found.values())))
            return pa.RecordBatch.from_arrays(
                [*[pa.array([g] * length, k) for g, k in zip(group, kinds)], pa.array(list(some)[:length], pa.int32()), *[found[c] for c in names]], names=[*by, "b", *names])

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in by]
            for i, key in enumerate(zip(*[batch.column(c).to_pylist() for c in [*keys, "_part"]])):
                if held and repr(key) != repr(at):
                    yield done()
                at = key
                held += pa.ipc.open_stream(batch.column("_rows")[i].as_buffer())
        if held:
            yield done()

    packed = laid.mapInArrow(pack, f"{ddl(laid, keys)}, _rows binary").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(dealt - 1))))
    met = packed.repartition(partitions, *keys, "_part").sortWithinPartitions(*keys, "_part")
    return met.mapInArrow(gather, f"{ddl(rows, by)}{', ' if by else ''}b int" + "".join(f", `{c}` {kind}" for c, kind in schema.items()))


def head_of(before: bytes, b: int) -> bytes:
    return before + str(b).encode()


def known(values, where) -> pa.Array:
    """Doubles that are NULL where ``where`` does not hold."""
    return pa.array(np.asarray(values, float), pa.float64(), mask=~np.broadcast_to(where, len(values)))


def counts_of(ends: Texts, before: bytes, b: int, n: int, low: int, size: int) -> np.ndarray:
    """How often replicate b of a bootstrap draws each of the ``size`` positions from ``low`` on (0-based)."""
    to = ends.hashes(head_of(before, b))
    to %= n
    if size == n:
        return np.bincount(to, minlength=size)
    counts = np.zeros(size, np.int64)
    for at in range(0, n, STEP):
        some = to[at:at + STEP] - low
        np.add.at(counts, some[(some >= 0) & (some < size)], 1)
    return counts


# ------------------------------------------------------------------------------------------------------------ bootstrap
def resampled_sums(
    df: DataFrame, by: Sequence[str], key: str, columns: dict[str, Column], terms: dict[str, Sequence[str]], B: int, seed: int,
    listed: tuple[str, Sequence[str]] | None = None, most: int = 0,
) -> DataFrame:
    """n of n rows with replacement, B times: per (group, b) the number of draws ``_w`` and, for each term, the sum of the product of its
    columns over the draws; NULL adds nothing.

    ``listed`` (a column of numbers, others): ``_listed`` has the draws of the rows whose number is at most ``most``, as an array of
    (``at``, ``w``, others). A group is resampled in blocks of positions, so it may have any size.
    """
    values = {n: c.cast("double") for n, c in columns.items()}
    place, others = listed or (None, ())
    schema = {"_w": "double"} | {n: "double" for n in terms}
    if listed:
        values |= {"_at": F.col(place).cast("bigint")} | {f"_o_{c}": F.col(c).cast("double") for c in others}
        schema["_listed"] = "array<struct<at:bigint,w:bigint" + "".join(f",`{c}`:double" for c in others) + ">>"
    rows = positioned(df, by, key, values, seed)
    kind = pa.list_(pa.struct([("at", pa.int64()), ("w", pa.int64()), *[(c, pa.float64()) for c in others]]))
    held, read, inputs, products = BLOCK, bool(listed), list(columns), {n: list(c) for n, c in terms.items()}

    def work(found: dict, _, before: bytes, n: int, some: range, low: int) -> dict:
        size, ends = min(n - low, held), Texts.numbers(n)
        given = {c: doubles(found[c]) for c in inputs}
        absent = {c: found[c].is_null().to_numpy(zero_copy_only=False) for c in inputs}
        sums, total, lists = np.zeros((len(some), len(products))), np.zeros(len(some)), []
        absent = {c: x for c, x in absent.items() if x.any()}
        if read:
            at = found["_at"].to_numpy(zero_copy_only=False)
            near = np.flatnonzero(at <= most)
            beside = [doubles(found[f"_o_{c}"])[near] for c in others]
        found.clear()
        for i, b in enumerate(some):
            w = counts_of(ends, before, b, n, low, size)
            total[i] = w.sum()
            for start in range(0, size, STEP):
                part = slice(start, start + STEP)
                times = w[part].astype(float)
                for j, product in enumerate(products.values()):
                    x = given[product[0]][part]
                    for c in product[1:]:
                        x = x * given[c][part]
                    if np.isfinite(x).all():
                        sums[i, j] += times @ x
                        continue
                    # a row that was not drawn adds nothing, whatever it holds
                    counted = times > 0
                    for c in product:
                        counted &= ~absent[c][part] if c in absent else True
                    sums[i, j] += np.where(counted, times * x, 0.0).sum()
            if read:
                drawn = np.flatnonzero(w[near])
                lists.append([dict(zip(("at", "w", *others), row)) for row in zip(
                    at[near][drawn].tolist(), w[near][drawn].tolist(), *[x[drawn].tolist() for x in beside])])
        out = {"_w": pa.array(total)} | {n: pa.array(sums[:, j].copy()) for j, n in enumerate(products)}
        return out | ({"_listed": pa.array(lists, kind)} if read else {})

    parts = each_replicate(rows, by, list(values), B, rows.where("_pos = 1").count(), work, schema, texts=False, block=held)
    return parts.groupBy(*by, "b").agg(
        F.sum("_w").alias("_w"), *[F.sum(n).alias(n) for n in terms], *([F.flatten(F.collect_list("_listed")).alias("_listed")] if listed else []))


def listed_agreement(sums: DataFrame, by: Sequence[str], pred: str, real: str, ks: Sequence[int], most: int) -> DataFrame:
    """Sign agreement among the k first draws of each replicate, from the ``_listed`` of ``resampled_sums``: one row per (group, b).

    Copies count, so the last row may count in part; a prediction of zero does not count.
    """
    by = [*by, "b"]
    each = sums.select(*by, "_w", F.explode("_listed").alias("_x")).select(
        *by, "_w", F.col("_x.at").alias("_at"), F.col("_x.w").alias("_c"), F.signum(f"_x.{pred}").alias("_p"), F.signum(f"_x.{real}").alias("_r"))
    names = ", ".join(f"`{c}`" for c in by)
    above = F.expr(f"coalesce(sum(_c) OVER (PARTITION BY {names} ORDER BY _at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    aggs = []
    for k in ks:
        inside = F.when(F.col("_p") != 0, F.greatest(F.least(F.col("_c"), F.lit(int(k)) - F.col("_above")), F.lit(0)))
        aggs.append(F.try_divide(F.sum(F.when(F.col("_p") == F.col("_r"), inside).otherwise(0)).cast("double"), F.sum(inside).cast("double")).alias(f"deg_conc_{k}"))
    # the rows listed are drawn more often than the largest k, or they are the whole group; nothing else is right
    short = (F.sum("_c") < int(max(ks))) & (F.max("_w") > int(most))
    found = each.withColumn("_above", above).groupBy(*by).agg(*aggs, short.alias("_short"))
    checked = F.when(F.col("_short"), F.raise_error(F.lit("the listed rows were drawn too rarely")).cast("double"))
    return found.select(*by, *[F.coalesce(checked, F.col(f"deg_conc_{k}")).alias(f"deg_conc_{k}") for k in ks])


# --------------------------------------------------------------------------------------------------------- permutations
def permuted_statistics(
    rows: DataFrame, by: Sequence[str], groups: int, B: int, fixed: str, moved: str, ks: Sequence[int] = (), top: str = "", sign: str = "",
) -> DataFrame:
    """Random pairings of two columns, per (group, b): ``pcc``, ``rmse`` and ``projection`` (of the fixed on the moved column), and ``conc_<k>``, the
    agreement of the moved value with the sign of ``sign`` among the rows whose number in ``top`` is at most k.

    ``rows`` come from ``positioned``. Replicate b lays the moved values out in the order of the hash of (seed, group, b, key), beside the
    fixed values in the order of the key.
    """
    values = list(dict.fromkeys([fixed, moved, *([top, sign] if ks else [])]))
    schema = dict.fromkeys(["pcc", "rmse", "projection", *[f"conc_{k}" for k in ks]], "double")
    ks = [int(k) for k in ks]

    def work(found: dict, ends: Texts, before: bytes, n: int, some: range, low: int) -> dict:
        r, m = doubles(found[fixed]), doubles(found[moved])
        r_there, m_there = (found[c].is_valid().to_numpy(zero_copy_only=False) for c in (fixed, moved))
        whole = bool(r_there.all() and m_there.all())
        out = {c: np.zeros(len(some)) for c in schema}
        has = {c: np.zeros(len(some), bool) for c in schema}

        def put(name: str, i: int, above: float, below: float) -> None:
            if below != 0:
                out[name][i], has[name][i] = above / below, True

        if ks:
            number = found[top].to_numpy(zero_copy_only=False)
            listed = np.flatnonzero(number <= max(ks))
            number, side = number[listed], np.sign(doubles(found[sign]))[listed]
        if whole:
            mr, mm = r.mean(), m.mean()
            rc, mc = r - mr, m - mm
            # equal values vary by nothing, whatever the last bits of their mean
            vr, vm = (x @ x / n if np.ptp(v) != 0 else 0.0 for x, v in ((rc, r), (mc, m)))
            length = np.sqrt(m @ m)
            del r, m_there, r_there
            if not ks:
                del m
        found.clear()
        for i, b in enumerate(some):
            order = in_order(ends.hashes(head_of(before, b)))
            if whole:
                cov = sum(float(rc[at:at + STEP] @ mc[order[at:at + STEP]]) for at in range(0, n, STEP)) / n
                put("pcc", i, cov, np.sqrt(vr) * np.sqrt(vm))
                out["rmse"][i], has["rmse"][i] = np.sqrt(max(vr + vm - 2 * cov + (mr - mm) ** 2, 0.0) if np.isfinite(cov) else cov), True
                put("projection", i, n * (cov + mr * mm), length)
            else:  # NULL takes part in nothing, and which pairs have one depends on the replicate
                x, there = m[order], m_there[order]
                both = there & r_there
                if both.any():
                    xb, rb = x[both], r[both]
                    put("pcc", i, ((xb - xb.mean()) * (rb - rb.mean())).mean(), x[there].std() * r[r_there].std())
                    out["rmse"][i], has["rmse"][i] = np.sqrt(((xb - rb) ** 2).mean()), True
                    put("projection", i, (xb * rb).sum(), np.sqrt((x[there] ** 2).sum()))
            for k in ks:
                mine = listed[number <= k]
                p, s = np.sign(m[order[mine]]), side[number <= k]
                used = (p != 0) & ~np.isnan(s) & (whole or m_there[order[mine]])
                put(f"conc_{k}", i, float((p[used] == s[used]).sum()), float(used.sum()))
        return {c: known(out[c], has[c]) for c in schema}

    return each_replicate(rows, by, values, B, groups, work, schema)


# ---------------------------------------------------------------------------------------------------------- ranked lists
def permuted_hits(rows: DataFrame, by: Sequence[str], groups: int, B: int, stratum: str, told: Callable, schema: dict[str, str]) -> DataFrame:
    """``told(positions, n)`` of labels permuted within strata, per (list, b): the positions of the positives in ascending order.

    ``rows`` come from ``positioned``, with ``_position`` in the list, the label ``y`` and the stratum. A stratum with P positives gives
    them to the first P rows in the order of the hash. A list without positives has no rows.
    """
    names = list(schema)

    def work(found: dict, ends: Texts, before: bytes, n: int, some: range, low: int) -> dict:
        place = found["_position"].to_numpy(zero_copy_only=False).astype(np.int64)
        positive = found["y"].fill_null(0).to_numpy(zero_copy_only=False) == 1
        codes = np.unique(found[stratum].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        strata = [(rows, int(positive[rows].sum())) for rows in (np.flatnonzero(codes == c) for c in range(codes.max() + 1))]
        strata = [(rows, wanted) for rows, wanted in strata if wanted]
        each = []
        for b in some if strata else ():
            h = ends.hashes(head_of(before, b))
            each.append(told(np.sort(np.concatenate([place[rows[in_order(h[rows])[:wanted]]] for rows, wanted in strata])), n))
        return {c: pa.array([e[c] for e in each], types[c]) for c in names}

    types = {c: arrow_type(kind) for c, kind in schema.items()}
    return each_replicate(rows, by, ["_position", "y", stratum], B, groups, work, schema)


def resampled_hits(rows: DataFrame, by: Sequence[str], groups: int, B: int, told: Callable, schema: dict[str, str]) -> DataFrame:
    """``told(positions, n)`` of resampled lists, per (list, b): the positions of the positives, each copy one; NULL where none was drawn.

    ``rows`` come from ``positioned``, with ``_position`` in the list and the label ``y``. Copies stay beside each other in the order of the list.
    """
    names = list(schema)

    def work(found: dict, _, before: bytes, n: int, some: range, low: int) -> dict:
        place = np.argsort(found["_position"].to_numpy(zero_copy_only=False), kind="stable")
        positive = np.flatnonzero((found["y"].fill_null(0).to_numpy(zero_copy_only=False) == 1)[place])
        ends, each = Texts.numbers(n), []
        for b in some:
            w = counts_of(ends, before, b, n, 0, n)[place]
            first, copies = (np.cumsum(w) - w)[positive], w[positive]
            hits = np.cumsum(copies)
            total = int(hits[-1]) if len(hits) else 0
            # the copies of a row follow its first position
            at = np.repeat(first - (hits - copies), copies) + np.arange(1, total + 1)
            each.append(told(at, n) if total else dict.fromkeys(names))
        return {c: pa.array([e[c] for e in each], types[c]) for c in names}

    types = {c: arrow_type(kind) for c, kind in schema.items()}
    return each_replicate(rows, by, ["_position", "y"], B, groups, work, schema, texts=False)


def arrow_type(kind: str) -> pa.DataType:
    return {"double": pa.float64(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}[kind]
