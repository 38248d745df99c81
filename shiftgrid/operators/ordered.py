"""Running totals over an ordered group, for groups of any size.

``Window.partitionBy(key).orderBy(value)`` sorts each group in one task and fails when one group holds a large part of the
data. Every rank, percentile, precision curve and interval merge here is a running
sum or maximum, so they all share this module's two-level form:

1. borders: a group of more than ``spark.shiftgrid.rows`` rows is cut into slices of about that many. A sample of its order keys, as
   many as it has slices times a constant, gives the borders; every row finds its slice by comparing its key with them;
2. running totals inside each (group, slice);
3. totals per (group, slice) give each slice but the first its offset.

Borders and offsets are small: there are fewer than rows of the input / ``spark.shiftgrid.rows``, and that is what is broadcast. Groups
below that size are one slice, for which neither a sample nor totals are taken. It is one plan whatever the input.

The sample takes keys by their hash. It depends on the keys alone, not on partitions or the order of arrival, so borders come out the
same whenever they are computed, also after a lost executor, and nothing has to be written. The input must likewise give the same
values whenever it is evaluated: tables, whole numbers, draws, or a result that was ``cut``; sums of doubles, whose last bits depend
on the order of arrival, are cut first.

Callers make the order key unique inside a group, by pre-aggregating ties where a tie can be hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftgrid.session import cut, rows_per_slice, slices

SLICE = "_slice"
# Sampled keys per slice: with 32, a slice rarely holds more than twice its share.
SAMPLED = 32


def sort_keys(order: Sequence[str]) -> list[Column]:
    """Column names, with a leading minus for descending."""
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]


# Long expressions are written as SQL text: every call of a column function is a round trip to the JVM.
def named(columns: Sequence[str]) -> list[str]:
    return [f"`{c}`" for c in columns]


def key_of(df: DataFrame, order: Sequence[str]) -> str:
    """SQL text of a struct whose ascending order is ``order``, nulls and NaN included."""
    out = []
    for o in order:
        c = f"`{o.removeprefix('-')}`"
        kind = df.schema[o.removeprefix("-")].dataType
        if not o.startswith("-"):
            out.append(c)
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            out += [f"CASE WHEN {c} IS NULL THEN 2 WHEN isnan({c}) THEN 0 ELSE 1 END", f"CASE WHEN NOT isnan({c}) THEN -{c} END"]
        elif isinstance(kind, T.DecimalType):
            out += [f"{c} IS NULL", f"-{c}"]
        elif isinstance(kind, T.IntegralType):
            out += [f"{c} IS NULL", f"~{c}"]
        else:
            raise TypeError(f"{o[1:]}: descending order of {kind.simpleString()} is not supported")
    return "named_struct(" + ", ".join(f"'k{i}', {e}" for i, e in enumerate(out)) + ")"


def borders(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per group of more than a slice: ``by``, _fine (borders, ascending) and _coarse (about every square root-th of them)."""
    spark = df.sparkSession
    rows, most = rows_per_slice(spark), slices(spark)
    sizes = df.groupBy(*by).agg(F.expr("count(1) AS _n")).where(f"_n > {rows}")
    parts = sizes.selectExpr(*named(by), "_n", f"CAST(least({most}, ceil(_n / {rows})) AS INT) AS _parts")
    keyed = df.selectExpr(*named(by), f"{key_of(df, order)} AS _k")
    # fewer than rows of the input / rows of a slice
    sampled = attach(keyed, F.broadcast(parts), by, "inner").where(
        f"shiftrightunsigned(xxhash64(_k), 11) / {1 << 53}D * _n < _parts * {SAMPLED}")
    found = sampled.groupBy(*by).agg(F.expr("max(_parts) AS _parts"), F.expr("array_sort(collect_set(_k)) AS _a"))
    fine = found.where("_parts > 1").selectExpr(
        *named(by), "array_distinct(transform(sequence(1, greatest(_parts - 1, 1)), i -> get(_a, CAST(floor(i * size(_a) / _parts) AS INT)))) AS _fine")
    return fine.selectExpr("*", "CAST(floor(sqrt(size(_fine))) AS INT) AS _step").selectExpr("*", "filter(_fine, (x, i) -> i % _step = 0) AS _coarse")


def with_slices(df: DataFrame, by: Sequence[str], found: DataFrame, keys: dict[str, str]) -> DataFrame:
    """``df`` with the slice of each key (SQL text of a struct in the order of the borders): number of borders before it (``at``), and
    slices of its group (``parts``).

    The search looks at the coarse borders first, then at those of one step.
    """
    # fewer borders than rows of the input / rows of a slice
    met = attach(df.selectExpr("*", *[f"{k} AS `_key{name}`" for name, k in keys.items()]), F.broadcast(found), by)
    met = met.selectExpr("*", *[f"greatest(size(filter(_coarse, b -> b < `_key{name}`)) - 1, 0) * _step AS `_block{name}`" for name in keys])
    return met.selectExpr(*named(df.columns), *[
        f"named_struct('at', CASE WHEN _fine IS NULL THEN 0 ELSE `_block{name}` + size(filter(slice(_fine, `_block{name}` + 1, _step), b -> b < `_key{name}`)) END, "
        f"'parts', CASE WHEN _fine IS NULL THEN 1 ELSE size(_fine) + 1 END) AS `{name}`" for name in keys])


def order_once(df: DataFrame, by: Sequence[str], order: Sequence[str], sample: DataFrame | None = None) -> DataFrame:
    """Give each row its slice, for one or more ``running`` calls over the same order.

    ``sample`` may name another frame with the same (by, order) keys from which borders are cheaper to take.
    """
    if SLICE in df.columns:
        return df
    return with_slices(df, by, borders(df if sample is None else sample, by, order), {SLICE: key_of(df, order)})


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    totals: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    sample: DataFrame | None = None,
) -> DataFrame:
    """Add running ``sum`` / ``max`` columns: ``totals = {name: ("sum" | "max", column)}``.

    Exclusive totals cover the rows before the current one (0 for a sum, NULL for a maximum at the first row).
    """
    laid = order_once(df, by, order, sample)
    # no more offsets than borders
    return _two_level(laid, by, order, totals, inclusive, F.broadcast, laid.where(F.col(SLICE)["parts"] > 1))


def running_whole(
    df: DataFrame, by: Sequence[str], at: str, totals: dict[str, tuple[str, Column]], inclusive: bool = True, reach: Column | None = None,
    width: int = 100_000,
) -> DataFrame:
    """``running`` in the order of whole numbers from 0 on, spread over their range: ``width`` of them are a slice, without a sample.

    ``reach``, where known, is an upper bound of the numbers of a row's group: a group that stays below ``width`` is one slice, and
    its totals are not counted. The frame must give the same rows whenever it is evaluated.
    """
    laid = df.withColumn(SLICE, F.floor(F.col(at) / F.lit(int(width))).cast("int"))
    counted = laid if reach is None else laid.where(reach >= int(width))
    return _two_level(laid, by, [at], totals, inclusive, lambda offsets: offsets, counted).drop(SLICE)


def _two_level(df, by, order, totals, inclusive, placed, counted=None) -> DataFrame:
    keys = named([*by, SLICE])
    sort = ", ".join(f"`{o[1:]}` DESC" if o.startswith("-") else f"`{o}`" for o in order)
    frame = "UNBOUNDED PRECEDING AND " + ("CURRENT ROW" if inclusive else "1 PRECEDING")
    over = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {sort} ROWS BETWEEN {frame})"
    names = [c for c in df.columns if c not in totals]
    values = [c.alias(f"_a_{name}") for name, (_, c) in totals.items()]

    def total(f: str, argument: str, window: str) -> str:
        return f"coalesce(sum({argument}) {window}, 0)" if f == "sum" else f"max({argument}) {window}"

    local = df.select(*names, *values).selectExpr(*named(names), *[f"{total(f, f'`_a_{name}`', over)} AS `{name}`" for name, (f, _) in totals.items()])
    source = (df if counted is None else counted).select(*by, SLICE, *values)
    per_slice = source.groupBy(*by, SLICE).agg(*[F.expr(f"{f}(`_a_{name}`) AS `_t_{name}`") for name, (f, _) in totals.items()])
    in_order = "OVER (" + (f"PARTITION BY {', '.join(named(by))} " if by else "") + f"ORDER BY {SLICE}"
    before = f"{in_order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    offsets = per_slice.selectExpr(
        *keys, f"row_number() {in_order}) AS _nth", *[f"{f}(`_t_{name}`) {before} AS `_o_{name}`" for name, (f, _) in totals.items()],
    ).where("_nth > 1").drop("_nth")
    joined = attach(local, placed(offsets), [*by, SLICE])
    return joined.selectExpr(*named(names), *[
        f"`{name}` + coalesce(`_o_{name}`, 0) AS `{name}`" if f == "sum" else f"greatest(`{name}`, `_o_{name}`) AS `{name}`"
        for name, (f, _) in totals.items()])


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """1-based position in each group; the order must end in an id."""
    return running(df, by, order, {out: ("sum", F.lit(1).cast("bigint"))}).drop(SLICE)


def numbered_by_hash(df: DataFrame, by: Sequence[str], hashed: str, key: str, size: str, out: str, width: int = 100_000) -> DataFrame:
    """1-based position in the order of a uniform hash of 60 bits, then ``key``; ``size`` is the number of rows of the group.

    The leading bits of the hash are the slice, about ``width`` rows each, so nothing is sampled. Only groups of several slices
    count what lies before a slice.
    """
    laid = df.selectExpr("*", f"CAST(greatest(ceil(log2(`{size}` / {float(width)}D)), 0) AS INT) AS _bits").selectExpr(
        "*", f"shiftright(`{hashed}`, 60 - _bits) AS {SLICE}")
    keys = ", ".join(named([*by, SLICE]))
    local = laid.selectExpr("*", f"row_number() OVER (PARTITION BY {keys} ORDER BY `{hashed}`, `{key}`) AS _local")
    counts = laid.where("_bits > 0").groupBy(*by, SLICE).agg(F.expr("count(1) AS _t"))
    part = f"PARTITION BY {', '.join(named(by))} " if by else ""
    starts = counts.selectExpr(*named([*by, SLICE]), f"sum(_t) OVER ({part}ORDER BY {SLICE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _start")
    return attach(local, starts, [*by, SLICE]).selectExpr(*named(df.columns), f"_local + coalesce(_start, 0) AS `{out}`")


def group_size(df: DataFrame, by: Sequence[str], out: str, value: Column | None = None) -> DataFrame:
    """Per-group count joined back; unlike a window it never gathers a group in one task."""
    size = df.groupBy(*by).agg((F.count(F.lit(1)) if value is None else F.sum(value)).alias(out))
    return attach_stats(df, size, by)


def attach_stats(df: DataFrame, stats: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Join of a few figures per group.

    An aggregate looks as large as its input to the planner, which would shuffle ``df`` by a possibly hot group key. The
    figures are written first: their size is then known, and Spark broadcasts them if that is small.
    """
    return attach(df, cut(stats), by, how)


def with_each(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row with every row of a short label table (scopes, tiers): the grid of a dense report.

    The labels travel as one array in a one-row table; ``grid`` takes label tables of any length.
    """
    one = labels.agg(F.collect_list(F.struct(*labels.columns)).alias("_labels"))
    grid = attach(df, one, []).select(*df.columns, F.explode("_labels").alias("_label"))
    return grid.select(*df.columns, *[F.col(f"_label.{c}").alias(c) for c in labels.columns])


def grid(df: DataFrame, labels: DataFrame) -> DataFrame:
    """As ``with_each``, for labels that grow with the data (clusters, factors, samples).

    Labels are dealt to as many blocks as there are shuffle partitions, every row goes once to each block that holds a label, and
    they meet in an equi-join on the block: the only array holds the numbers of the blocks.
    """
    blocks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(labels.withColumn("_block", F.pmod(F.xxhash64(*labels.columns), F.lit(blocks)).cast("int")))
    used = dealt.agg(F.collect_set("_block").alias("_blocks"))
    spread = attach(df, used, []).withColumn("_block", F.explode("_blocks")).drop("_blocks")
    return spread.join(dealt, "_block").select(*df.columns, *labels.columns)


def attach(df: DataFrame, right: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join that keeps NULL keys and the columns of ``df`` first; an empty key joins the one-row side."""
    if not by:
        return df.join(F.broadcast(right), F.lit(True), "inner" if how == "inner" else "left")
    match = " AND ".join(f"_l.{c} <=> _r.{c}" for c in named(by))
    joined = df.alias("_l").join(right.alias("_r"), F.expr(match), how)
    return joined.selectExpr("_l.*", *[f"_r.{c}" for c in named([c for c in right.columns if c not in by])])
