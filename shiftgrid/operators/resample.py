"""Bootstrap intervals, permutation nulls and matched random sets.

All draws are keyed by text (seed, group, replicate, id), never by a generator state: the same rows come out for any
partitioning, after a lost executor, and in another SQL engine. Replicates are rows with a replicate number ``b``, so the
work of B replicates spreads over the cluster; only per-replicate results (at most B rows per group) are ever aggregated
into one buffer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgrid.functions.scalars import key_hash
from shiftgrid.operators import drawn, replicates
from shiftgrid.operators.ordered import attach, attach_stats, group_size, numbered, numbered_by_hash
from shiftgrid.operators.ranks import average_ranks
from shiftgrid.operators.stats import corr_expr, finite, rel_rmse_expr
from shiftgrid.session import cut


def replicate(df: DataFrame, B: int, spread: Sequence[str], out: str = "b") -> DataFrame:
    """Every row once per replicate number 1..B.

    The rows are spread over all tasks first: few input partitions may hold little data and B times as much work.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    even = df.repartition(n, *[F.col(c) for c in spread])
    return even.select("*", F.explode(F.sequence(F.lit(1), F.lit(int(B)))).alias(out))


def _group_text(by: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in by]


def bootstrap(
    df: DataFrame, by: Sequence[str], key: str, values: Sequence[str], B: int, seed: int, weight: str = "w"
) -> DataFrame:
    """n of n rows with replacement, B times: one row per (group, b, drawn row) with its multiplicity.

    Draw j of a replicate belongs to the row at position j, so the draw list is as distributed as the rows. Draws meet the
    rows by position first, and the multiplicity count reuses that partitioning.
    """
    rows = drawn.positioned(df, by, key, {c: F.col(c) for c in dict.fromkeys([key, *values])}, seed)
    return written_draws(rows, by, list(dict.fromkeys([key, *values])), B, weight)


def written_draws(rows: DataFrame, by: Sequence[str], values: Sequence[str], B: int, weight: str = "w") -> DataFrame:
    """``bootstrap`` of rows that ``drawn.positioned`` gave their position."""
    text = F.concat("_pre", F.col("b").cast("string"), F.lit("|"), F.col("_pos").cast("string"))
    draws = replicate(rows.select(*by, "_pos", "_n", "_pre"), B, [*by, "_pos"]).select(
        *[F.col(c).alias(f"_d_{c}") for c in by], "b", (F.pmod(key_hash(text), F.col("_n")) + 1).alias("_idx"))
    match = F.col("_idx") == F.col("_pos")
    for c in by:
        match = match & F.col(f"_d_{c}").eqNullSafe(F.col(c))
    count = F.count(F.lit(1)).cast("double").alias(weight)
    # the planner does not see how many rows an explode makes and would send the draws through the driver
    picked = draws.hint("merge").join(rows.select(*by, "_pos", *values), match)
    return picked.groupBy(*by, "_pos", "b", *values).agg(count).drop("_pos")


def intervals(
    stats: DataFrame, by: Sequence[str], columns: Sequence[str], lo: float = 0.025, hi: float = 0.975
) -> DataFrame:
    """Percentile interval of per-replicate statistics (at most B rows per group; undefined replicates drop out)."""
    return stats.groupBy(*by).agg(
        *[F.percentile(c, F.lit(q)).alias(f"{c}_{s}") for c in columns for s, q in (("ci_lo", lo), ("ci_hi", hi))]
    )


def bootstrap_spearman(
    df: DataFrame, by: Sequence[str], key: str, pairs: dict[str, tuple[str, str]], B: int, seed: int
) -> DataFrame:
    """Spearman correlations of named column pairs in every replicate: one row per (group, b)."""
    columns = sorted({c for p in pairs.values() for c in p})
    # twice the average rank is a whole number with the order and the ties of the value: ranked once, compared cheaply
    base = average_ranks(df.select(*by, key, *columns), {f"_o_{c}": c for c in columns}, by)
    base = base.select(*by, key, *[(F.col(f"_o_{c}") * 2).cast("bigint").alias(f"_o_{c}") for c in columns])
    counted = replicates.bootstrap_counts(base, by, key, [f"_o_{c}" for c in columns], B, seed)
    return replicates.rank_correlations(counted, by, {n: (f"_o_{x}", f"_o_{y}") for n, (x, y) in pairs.items()}, B)


def bootstrap_mean(df: DataFrame, by: Sequence[str], key: str, value: str, B: int, seed: int) -> DataFrame:
    """Mean of each replicate. A mean needs multiplicities only, so nothing is ordered."""
    counted = replicates.bootstrap_counts(df, by, key, [value], B, seed)
    sums = replicates.weighted_sums(counted, by, {"_sum": F.col(value)}, B)
    return sums.select(*by, "b", (F.col("_sum") / F.col("_w")).alias("mean"))


def bootstrap_panels(
    df: DataFrame, by: Sequence[str], panel: str, first: str, second: str, key: str, value: str, B: int, seed: int
) -> DataFrame:
    """Difference of two panel means, each panel resampled on its own: one row per (group, b)."""
    means = bootstrap_mean(df.where(F.col(panel).isin(first, second)), [*by, panel], key, value, B, seed)
    return means.groupBy(*by, "b").agg(
        (F.max(F.when(F.col(panel) == first, F.col("mean"))) - F.max(F.when(F.col(panel) == second, F.col("mean"))))
        .alias("difference")
    )


def permuted_pairs(
    df: DataFrame, by: Sequence[str], key: str, fixed: Sequence[str], moved: str, B: int, seed: int, out: str = "moved"
) -> DataFrame:
    """Every replicate pairs the fixed columns of a row with the moved column of the row at its shuffled position."""
    rows = drawn.positioned(df, by, key, {c: F.col(c) for c in dict.fromkeys([key, *fixed, moved])}, seed)
    return placed_pairs(rows, by, [key, *fixed], moved, B, seed, out)


def placed_pairs(rows: DataFrame, by: Sequence[str], fixed: Sequence[str], moved: str, B: int, seed: int, out: str = "moved") -> DataFrame:
    """``permuted_pairs`` of rows that ``drawn.positioned`` gave their position; a pair is a row."""
    shuffled = replicate(rows.select(*by, moved, "_pos", "_pre", "_post", "_n"), B, [*by, "_pos"]).withColumn("_h", key_hash(drawn.text_of(rows)))
    # equal hashes are in the order of the key
    placed = numbered_by_hash(shuffled.withColumnRenamed("_pos", "_own"), [*by, "b"], "_h", "_own", "_n", "_pos").select(*by, "b", F.col(moved).alias(out), "_pos")
    return attach(placed, rows.select(*by, "_pos", *fixed), [*by, "_pos"], "inner").drop("_pos")


def permutation_null(
    df: DataFrame, by: Sequence[str], key: str, real: str, pred: str, B: int, seed: int, ks: Sequence[int] = (),
    measured: str | None = None,
) -> DataFrame:
    """Shuffled predictions: mean, 5th and 95th percentile of correlation and relative error, 95th of the sign concordance.

    The concordance looks at the ``ks`` rows of largest magnitude of ``measured`` (``real`` before it was standardised), which
    no shuffle moves: they are placed once.
    """
    rows = df.select(*by, key, F.col(real).alias("_r"), F.col(pred).alias("_x"), F.col(measured or real).alias("_m"))
    if ks:
        rows = numbered(rows.withColumn("_a", F.abs("_m")), by, ["-_a", key], "_top")
    values = {c: F.col(c) for c in ("_r", "_x", "_m", *(["_top"] if ks else []))}
    held, large, groups = drawn.parted(drawn.positioned(rows, by, key, values, seed))
    names = ["pcc", "rmse", *[f"conc_{k}" for k in ks]]
    each = drawn.permuted_statistics(held, by, groups, B, "_r", "_x", ks, "_top", "_m").select(*by, "b", *names)
    if large is not None:
        fixed = ["_r", "_m", *(["_top"] if ks else [])]
        moved = placed_pairs(large, by, fixed, "_x", B, seed)
        signed = F.signum("moved") != 0
        agree = (F.signum("moved") == F.signum("_m")).cast("double")
        each = each.unionByName(moved.groupBy(*by, "b").agg(
            corr_expr(F.col("moved"), F.col("_r")).alias("pcc"), rel_rmse_expr(F.col("moved"), F.col("_r")).alias("rmse"),
            *[F.avg(F.when(signed & (F.col("_top") <= int(k)), agree)).alias(f"conc_{k}") for k in ks],
        ))
    return each.groupBy(*by).agg(
        F.avg("pcc").alias("perm_pcc_mean"), F.percentile("pcc", F.lit(0.95)).alias("perm_pcc_p95"),
        F.avg("rmse").alias("perm_rmse_mean"), F.percentile("rmse", F.lit(0.05)).alias("perm_rmse_p05"),
        *[F.percentile(f"conc_{k}", F.lit(0.95)).alias(f"perm_deg_conc_{k}_p95") for k in ks],
    )


def permuted_labels(
    df: DataFrame, by: Sequence[str], stratum: str, key: str, label: str, B: int, seed: int
) -> DataFrame:
    """Labels shuffled inside each stratum: the rows that carry a positive label in replicate b.

    A 0/1 label shuffled over a stratum with P positives lands on the first P rows of a random order, so no labels have
    to be moved by a join, and only the positives (the rows every metric needs) come out.
    """
    kept = [c for c in df.columns if c not in by]
    rows = drawn.positioned(df, by, key, {c: F.col(c) for c in kept}, seed)
    return written_labels(rows, by, stratum, label, B).select(*by, *[c for c in kept if c != label], "b")


def written_labels(rows: DataFrame, by: Sequence[str], stratum: str, label: str, B: int) -> DataFrame:
    """``permuted_labels`` of rows that ``drawn.positioned`` gave their position."""
    y = F.coalesce((F.col(label) == 1).cast("bigint"), F.lit(0))
    counts = rows.groupBy(*by, stratum).agg(F.sum(y).alias("_pos_n"), F.count(F.lit(1)).alias("_size"))
    some = attach_stats(rows, counts, [*by, stratum]).where(F.col("_pos_n") > 0).drop(label)
    hashed = replicate(some, B, [*by, "_pos"]).withColumn("_h", key_hash(drawn.text_of(rows)))
    # equal hashes are in the order of the key
    placed = numbered_by_hash(hashed, [*by, stratum, "b"], "_h", "_pos", "_size", "_at")
    return placed.where(F.col("_at") <= F.col("_pos_n")).drop("_at", "_h", "_pos_n", "_size", "_pre", "_post", "_pos")


def null_summary(observed: DataFrame, null: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Observed value, null mean, enrichment and ``p = (#null >= observed + 1) / (B + 1)``."""
    # equal values may differ in the last bits, having been summed in another order
    both = attach(null, observed.select(*by, (F.col(value) - F.lit(1e-12)).alias("_low"), F.col(value).alias("_obs")), by, "inner")
    return both.groupBy(*by).agg(
        F.max("_obs").alias("observed"), F.avg(value).alias("null_mean"),
        F.try_divide(F.max("_obs"), F.avg(value)).alias("enrichment"),
        ((F.sum((F.col(value) >= F.col("_low")).cast("bigint")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"),
    )


def matched_sets(
    df: DataFrame, by: Sequence[str], stratum: str, key: str, value: str, in_panel: Column, B: int, seed: int
) -> DataFrame:
    """Mean of a random set that takes, for each panel member, a row of the same stratum (with replacement).

    One row per (group, b). The pool is addressed by position: a draw travels to its block, where the draws of a row are counted.
    """
    part = [*by, stratum]
    flagged = df.select(*part, key, value, in_panel.alias("_in"))
    pool = cut(group_size(numbered(flagged, part, [key], "_pos"), part, "_n"))
    wanted = replicates.even(pool.where("_in").select(*part, key, "_n"), [*by, key]).select(
        *part, "_n", *replicates.key_text([F.lit(seed), *_group_text(by)], F.col(key)))
    counted = replicates.drawn_counts(pool.select(*part, "_pos", value), part, "_pos", wanted, B)
    known = F.col(value).isNotNull().cast("double")
    sums = replicates.weighted_sums(counted, by, {"_sum": F.col(value), "_known": known}, B)
    return sums.where("_w > 0").select(*by, "b", F.try_divide("_sum", "_known").alias("mean"))


def shuffle_null(
    pairs: DataFrame, by: Sequence[str], key: str, shift: str, vector: str, B: int, seed: int
) -> DataFrame:
    """Projection of the shift on a vector whose entries are shuffled over the items: one row per (group, b)."""
    known = pairs.where(finite(shift, vector))
    held, large, groups = drawn.parted(drawn.positioned(known, by, key, {"_s": F.col(shift), "_v": F.col(vector)}, seed))
    each = drawn.permuted_statistics(held, by, groups, B, "_s", "_v").select(*by, "b", "projection")
    if large is None:
        return each
    return each.unionByName(placed_pairs(large, by, ["_s"], "_v", B, seed).groupBy(*by, "b").agg(
        F.try_divide(F.sum(F.col("_s") * F.col("moved")), F.sqrt(F.sum(F.col("moved") * F.col("moved")))).alias("projection")))


def bootstrap_projection(
    pairs: DataFrame, by: Sequence[str], key: str, shift: str, vector: str, B: int, seed: int
) -> DataFrame:
    columns = {"_s": F.col(shift), "_a": F.col(vector)}
    sums = drawn.resampled_sums(pairs.where(finite(shift, vector)), by, key, columns, {"_sa": ("_s", "_a"), "_aa": ("_a", "_a")}, B, seed)
    return sums.select(*by, "b", F.try_divide("_sa", F.sqrt("_aa")).alias("projection"))


def usable_variants(status: DataFrame, mode: str, exclude: Sequence = ()) -> DataFrame:
    """Variants of a screen that may form a null: of one mode, usable, and of none of the factors under test.

    ``status``: variant, tf, mode, usable. A missing flag is not usable.
    """
    kept = (F.col("mode") == mode) & F.coalesce(F.col("usable").cast("boolean"), F.lit(False))
    own = F.coalesce(F.col("tf").isin(list(exclude)), F.lit(False)) if exclude else F.lit(False)
    return status.where(kept & ~own).select("variant").distinct()


def screen_null(
    measured: DataFrame, screen: DataFrame, status: DataFrame, scope: Sequence[str], key: str, real: str, shift: str, observed: DataFrame,
    mode: str = "ko", exclude: Sequence = (), sign: float = 1.0, least: int = 20, rho: str = "rho",
) -> DataFrame:
    """Where an observed correlation stands among the correlations of all screened variants: per scope their number, median, 95th
    percentile, and the share strictly below (``null_pctile``).

    ``screen``: scope, variant, key, shift. Only variants that ``usable_variants`` of ``status`` keeps take part; their shift takes the
    ``sign`` of the tested contrast. A variant without a correlation does not count. A scope of ``observed`` with fewer than ``least``
    correlations has no null: that is an error, not a weak one.
    """
    from shiftgrid.operators.filters import require_empty
    from shiftgrid.operators.stats import spearman

    used = screen.join(usable_variants(status, mode, exclude), "variant", "left_semi")
    pairs = used.select(*scope, key, "variant", (F.col(shift) * F.lit(float(sign))).alias("_s")).join(measured.select(*scope, key, real), [*scope, key])
    each = cut(spearman(cut(pairs), real, "_s", [*scope, "variant"], "_null").where(F.col("_null").isNotNull()))
    counts = each.groupBy(*scope).agg(F.count(F.lit(1)).alias("_k"))
    few = attach(observed.select(*scope), counts, scope).where(F.coalesce("_k", F.lit(0)) < int(least))
    require_empty(few, f"fewer than {least} usable variants of mode {mode!r} are no null")
    both = attach(each, observed.select(*scope, F.col(rho).alias("_obs")), scope, "inner")
    return both.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("null_n"), F.percentile("_null", F.lit(0.5)).alias("null_median"),
        F.percentile("_null", F.lit(0.95)).alias("null_p95"),
        F.avg((F.col("_null") < F.col("_obs")).cast("double")).alias("null_pctile"),
    )
