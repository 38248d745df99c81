"""Half-open genomic intervals: merging and any-match by running maxima, counting and distance joins by position bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgrid.operators.ordered import SLICE, attach, borders, order_once, running, with_slices
from shiftgrid.operators.ranks import percentiles, tie_totals
from shiftgrid.session import cut, rows_per_slice

BIN = "_bin"
# Levels lie so many powers of two apart: fewer levels mean fewer copies of a row, and at most 2 ** TIER as many candidates.
TIER = 3
# Crowding is counted in windows of 2 ** WINDOW positions.
WINDOW = 12


def merge_intervals(df: DataFrame, by: Sequence[str] = ("chrom",), gap: int = 0) -> DataFrame:
    """Fuse intervals that overlap, touch, or lie within ``gap``: ``start <= running maximum end + gap``.

    Equal starts are collapsed first, so the order inside a chromosome is unique and repeated intervals cost nothing.
    """
    starts = df.groupBy(*by, "start").agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("_members"))
    order = ["start"]
    laid = order_once(starts, by, order)
    reach = running(laid, by, order, {"_reach": ("max", F.col("end"))}, inclusive=False)
    opens = F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + F.lit(int(gap)))
    flagged = reach.withColumn("_open", opens.cast("bigint"))
    islands = running(flagged, by, order, {"_island": ("sum", F.col("_open"))}).drop(SLICE)
    return islands.groupBy(*by, "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("_members").alias("members")
    ).drop("_island")


def reach_of(regions: DataFrame, truth: DataFrame, by: Sequence[str], cases: dict[str, Column]) -> DataFrame:
    """Distinct regions with, per case, the largest end among the truth intervals that start before the region ends.

    A region overlaps some truth interval exactly when that end lies beyond its start. So one running maximum over starts
    and ends in position order answers any-match: no bins, no pairs, and a crowded chromosome spreads over many slices.
    ``cases = {name: condition on truth rows}`` asks about several truth sets in the same pass.
    """
    ends = regions.select(*by, "start", "end").distinct().select(
        *by, F.col("end").alias("_pos"), F.lit(0).alias("_kind"), "start", "end",
        *[F.lit(None).cast("bigint").alias(name) for name in cases],
    )
    # truth intervals with one start act as the longest of them; at equal positions regions come first (start < end)
    starts = truth.groupBy(*by, F.col("start").alias("_pos")).agg(
        *[F.max(F.when(cond, F.col("end"))).cast("bigint").alias(name) for name, cond in cases.items()]
    ).select(*by, "_pos", F.lit(1).alias("_kind"), F.lit(0).cast("bigint").alias("start"),
             F.lit(0).cast("bigint").alias("end"), *cases)
    laid = ends.unionByName(starts)
    walked = running(laid, by, ["_pos", "_kind", "start"], {f"_reach_{n}": ("max", F.col(n)) for n in cases})
    return walked.where(F.col("_kind") == 0).select(
        *by, "start", "end", *[F.coalesce(F.col(f"_reach_{n}") > F.col("start"), F.lit(False)).alias(n) for n in cases]
    )


def overlaps_any(edges: DataFrame, truth: DataFrame, by: Sequence[str] = ("chrom",), out: str = "hit") -> DataFrame:
    """1 when the row's interval overlaps any truth interval of its chromosome, else 0.

    Regions are tested once each, however many edges share them.
    """
    hits = reach_of(edges, truth, by, {"_hit": F.lit(True)})
    return edges.join(hits, [*by, "start", "end"], "left").select(
        *edges.columns, F.coalesce(F.col("_hit").cast("int"), F.lit(0)).alias(out)
    )


def overlap_sets(
    regions: DataFrame, truth: DataFrame, set_name: str, names: Sequence[str], by: Sequence[str] = ("chrom",)
) -> DataFrame:
    """The named truth sets that each distinct region overlaps, as rows (region, set); regions without any do not appear."""
    cases = {f"_set{i}": F.col(set_name) == F.lit(n) for i, n in enumerate(names)}
    found = reach_of(regions, truth, by, cases)
    listed = F.filter(F.array(*[F.when(F.col(c), F.lit(n)) for c, n in zip(cases, names)]), lambda x: x.isNotNull())
    return found.select(*by, "start", "end", F.explode(listed).alias(set_name))


def level(df: DataFrame) -> Column:
    """The smallest power of ``2 ** TIER`` that is at least as long as the interval, as its exponent of two."""
    exact = F.log2(F.greatest(F.col("end") - F.col("start"), F.lit(1)).cast("double"))
    return (F.ceil(exact / F.lit(TIER)) * F.lit(TIER)).cast("int")


def levels(df: DataFrame) -> list[int]:
    """The levels that occur: at most one for each power of ``2 ** TIER`` up to the longest interval."""
    return sorted(r[0] for r in df.select(level(df)).distinct().collect() if r[0] is not None)


def tiered(df: DataFrame, others: Sequence[int], least: int) -> DataFrame:
    """Bins at the interval's own level and at the higher levels of the other side: one or two per level, whatever the length.

    A pair meets at the level of its longer interval, so no interval is cut into bins that are smaller than itself. ``least`` is
    the lowest level of the other side: below it, an interval is longer than nothing and keeps no bin of its own.
    """
    own = F.col("_level")
    wanted = F.filter(F.array(*[F.lit(n) for n in others]), lambda n: n > own) if others else F.array().cast("array<int>")
    at = F.concat(F.when(own >= F.lit(int(least)), F.array(own)).otherwise(F.array().cast("array<int>")), wanted)
    last = F.greatest(F.col("start"), F.col("end") - F.lit(1))
    met = df.withColumn("_level", level(df)).select("*", F.explode(at).alias("_at"))

    def bin_of(position: Column) -> Column:
        return F.call_function("shiftright", position.cast("bigint"), F.col("_at"))

    return met.select("*", F.explode(F.sequence(bin_of(F.col("start")), bin_of(last))).alias(BIN))


def bin_unit() -> Column:
    """Where a bin is counted: in the window it lies in, or for itself when it is wider than a window."""
    return F.call_function("shiftright", F.col(BIN), F.greatest(F.lit(WINDOW) - F.col("_at"), F.lit(0)))


def crowded(df: DataFrame, by: Sequence[str], at: Sequence[int]) -> DataFrame:
    """Places (level, unit of its bins) with more rows of ``df`` than one task should pair; fewer than rows / that number times levels."""
    window = F.call_function("shiftright", F.col("start").cast("bigint"), F.lit(WINDOW))
    counts = df.groupBy(*by, window.alias("_w")).agg(F.count(F.lit(1)).alias("_n"))
    each = counts.select(*by, "_w", "_n", F.explode(F.array(*[F.lit(int(n)) for n in at])).alias("_at"))
    unit = F.call_function("shiftright", F.col("_w"), F.greatest(F.col("_at") - F.lit(WINDOW), F.lit(0)))
    sums = each.groupBy(*by, "_at", unit.alias("_unit")).agg(F.sum("_n").alias("_n"))
    return cut(sums.where(F.col("_n") > rows_per_slice(df.sparkSession)).drop("_n"))


def overlap_pairs(
    a: DataFrame, b: DataFrame, by: Sequence[str], keep_a: Sequence[str], keep_b: Sequence[str], salt: int = 1,
    of_a: Sequence[int] | None = None, of_b: Sequence[int] | None = None,
) -> DataFrame:
    """All overlapping pairs, each at the level of the longer interval, in the bin where the later one starts.

    In crowded places the rows of ``a`` are dealt to ``salt`` tasks and those of ``b`` repeated for each; elsewhere nothing is repeated.
    ``of_a`` and ``of_b`` are the levels of the sides, where known.
    """
    in_a, in_b = (levels(x) if known is None else list(known) for x, known in ((a, of_a), (b, of_b)))
    left = tiered(a, in_b, min(in_b, default=0)).select(
        *by, F.col("start").alias("_as"), F.col("end").alias("_ae"), *[F.col(c) for c in keep_a], F.col("_level").alias("_al"), "_at", BIN)
    right = tiered(b, in_a, min(in_a, default=0)).select(
        *by, F.col("start").alias("_bs"), F.col("end").alias("_be"),
        *[F.col(c) for c in keep_b], F.col("_level").alias("_bl"), "_at", BIN)
    places = sorted({*in_a, *in_b})
    if salt > 1 and places:
        # fewer places than rows of the input / rows of a slice
        hot = F.broadcast(crowded(a, by, places).withColumn("_hot", F.lit(True)))
        own = F.pmod(F.xxhash64("_as", "_ae", *keep_a), F.lit(int(salt))).cast("int")
        every = F.sequence(F.lit(0), F.lit(int(salt) - 1))
        left = attach(left.withColumn("_unit", bin_unit()), hot, [*by, "_at", "_unit"]).withColumn("_salt", F.when(F.col("_hot"), own).otherwise(0))
        right = attach(right.withColumn("_unit", bin_unit()), hot, [*by, "_at", "_unit"]).withColumn(
            "_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0)))))
    else:
        left, right = left.withColumn("_salt", F.lit(0)), right.withColumn("_salt", F.lit(0))
    left = left.select(*by, "_salt", "_as", "_ae", *keep_a, "_al", "_at", BIN)
    right = right.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_salt").alias("_bsalt"), "_bs", "_be", *keep_b, "_bl",
                         F.col("_at").alias("_bt"), F.col(BIN).alias("_bb"))
    match = (F.col("_at") == F.col("_bt")) & (F.col(BIN) == F.col("_bb")) & (F.col("_salt") == F.col("_bsalt"))
    match = match & (F.col("_as") < F.col("_be")) & (F.col("_ae") > F.col("_bs"))
    for c in by:
        match = match & (F.col(c) == F.col(f"_b_{c}"))
    first = F.call_function("shiftright", F.greatest("_as", "_bs").cast("bigint"), F.col("_at"))
    # the planner does not see how many rows an explode makes and would send the exploded side through the driver
    pairs = left.join(right.hint("merge"), match & (F.col("_at") == F.greatest("_al", "_bl")) & (F.col(BIN) == first))
    return pairs.select(*by, *keep_a, *keep_b)


def count_overlaps(
    fragments: DataFrame, peaks: DataFrame, cell: str, peak: str, unit: str = "fragment", salt: int = 16,
) -> DataFrame:
    """Fragments (or their two cut ends) per cell and peak; a cell without any overlap does not appear.

    Equal fragments of a cell are counted before they are binned. Where fragments are crowded, the peaks are repeated ``salt`` times, so a bin that holds a large share of all fragments is worked on by that many tasks.
    """
    if unit not in ("fragment", "insertion"):
        raise ValueError(f"unit must be 'fragment' or 'insertion', got {unit!r}")
    counted = fragments.groupBy("chrom", "start", "end", F.col(cell).alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    of_a = [0]  # cut ends are one position long
    if unit == "insertion":
        ends = F.array(
            F.struct(F.col("start").alias("s"), (F.col("start") + 1).alias("e")),
            F.struct((F.col("end") - 1).alias("s"), F.col("end").alias("e")),
        )
        counted = counted.select("chrom", "_cell", "_n", F.explode(ends).alias("_x")).select(
            "chrom", "_cell", "_n", F.col("_x.s").alias("start"), F.col("_x.e").alias("end")
        )
    else:
        of_a = levels(fragments)
    named = peaks.select("chrom", "start", "end", F.col(peak).alias("_peak"))
    pairs = overlap_pairs(counted, named, ["chrom"], ["_cell", "_n"], ["_peak"], int(salt), of_a)
    return pairs.groupBy(F.col("_cell").alias(cell), F.col("_peak").alias(peak)).agg(F.sum("_n").alias("n"))


def near_join(elements: DataFrame, sites: DataFrame, max_bp: int, element: str, gene: str) -> DataFrame:
    """Elements whose midpoint lies within ``max_bp`` of a start site on the same chromosome, with the distance.

    A band join over slices of equal counts: both sides are ordered by position (ties by a hash of their name) and cut into slices,
    so that a crowded place is spread over many of them. A row goes to its own slice, and to every slice of the other side that the
    band around it (``max_bp`` to both sides) meets; a row is repeated only as often as it finds that many rows of the other side.
    """
    mid = F.floor((F.col("start") + F.col("end")) / F.lit(2))
    left = elements.select("chrom", F.col(element), mid.alias("_pos"), F.xxhash64(element).alias("_tie")).where(F.col("_pos").isNotNull())
    right = sites.select("chrom", F.col(gene), F.col("tss").cast("bigint").alias("_pos"), F.xxhash64(gene).alias("_tie")).where(F.col("_pos").isNotNull())
    of_left, of_right = (borders(side, ["chrom"], ["_pos", "_tie"]) for side in (left, right))

    def laid(side: DataFrame, own: DataFrame, other: DataFrame) -> DataFrame:
        here = with_slices(side, ["chrom"], own, {"_own": "named_struct('k0', _pos, 'k1', _tie)"})
        reach = {"_from": f"named_struct('k0', _pos - {int(max_bp)}, 'k1', {-(1 << 63) + 1}L)", "_to": f"named_struct('k0', _pos + {int(max_bp)}, 'k1', {(1 << 63) - 1}L)"}
        return with_slices(here, ["chrom"], other, reach).selectExpr(
            *[f"`{c}`" for c in side.columns], "_own.at AS _own", "explode(sequence(_from.at, _to.at)) AS _other")

    def number(offset: int = 0) -> Column:
        return F.floor(F.col("_pos") / F.lit(max_bp)) + F.lit(offset)

    a = laid(left, of_left, of_right).select("chrom", element, F.col("_pos").alias("_mid"), F.col("_own").alias("_sa"), F.col("_other").alias("_sb"), number().alias(BIN))
    b = laid(right, of_right, of_left).select(
        F.col("chrom").alias("_c"), gene, F.col("_pos").alias("tss"), F.col("_other").alias("_ta"), F.col("_own").alias("_tb"),
        F.explode(F.sequence(number(-1), number(1))).alias("_bb"))
    distance = F.abs(F.col("_mid") - F.col("tss"))
    near = a.join(b, (F.col("chrom") == F.col("_c")) & (F.col("_sa") == F.col("_ta")) & (F.col("_sb") == F.col("_tb"))
                  & (F.col(BIN) == F.col("_bb")) & (distance <= F.lit(int(max_bp))))
    return near.select("chrom", element, gene, distance.alias("distance"))


def width_stats(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Width minimum, true median, maximum and mean."""
    wide = df.select(*by, (F.col("end") - F.col("start")).cast("double").alias("_w"))
    middle = percentiles(wide, "_w", by, {"width_median": 0.5})
    rest = wide.groupBy(*by).agg(
        F.min("_w").alias("width_min"), F.max("_w").alias("width_max"), F.avg("_w").alias("width_mean")
    )
    return attach(rest, middle, by)


def lower_median(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The element at position ``int(n / 2)`` of the sorted widths (NULL when there is one interval only)."""
    wide = df.select(*by, (F.col("end") - F.col("start")).alias("_w"))
    ties = tie_totals(wide, by, "_w", {"_n": F.lit(1).cast("bigint")})
    sized = attach(ties, ties.groupBy(*by).agg(F.sum("_n").alias("_total")), by)
    at = F.floor(F.col("_total") / F.lit(2))
    inside = (at > F.col("cum__n") - F.col("_n")) & (at <= F.col("cum__n"))
    return sized.groupBy(*by).agg(F.max(F.when(inside, F.col("_w"))).alias("median_shell"))


def union_intervals(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
