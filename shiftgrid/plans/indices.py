"""Panel indices (identity, damage, rejuvenation) with their calls, classes and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrid.functions.scalars import is_clear, wilson
from shiftgrid.operators.filters import floor_filter
from shiftgrid.operators.ordered import attach
from shiftgrid.operators.ranks import deciles
from shiftgrid.operators.resample import (
    bootstrap_mean, bootstrap_panels, bootstrap_projection, intervals, matched_sets, shuffle_null,
)
from shiftgrid.operators.stats import finite, project, spearman, zscore
from shiftgrid.session import cut


def panel_members(df: DataFrame, panels: DataFrame, gene: str) -> DataFrame:
    """Rows of the panel genes (case-insensitive), once per panel."""
    wanted = panels.select("panel", F.upper("gene").alias("_up")).distinct()
    return df.withColumn("_up", F.upper(gene)).join(wanted, "_up").drop("_up")


def panel_indices(
    shifts: DataFrame, panels: DataFrame, by: Sequence[str], gene: str, shift: str, level: str, first: str, second: str,
    damage: str, B: int = 1000, seed: int = 0, floor: float = 0.25, min_tested: int = 200, min_panel: int = 3,
    min_damage: int = 10, toward: tuple[str, str] | None = None,
) -> DataFrame:
    """Identity index (mean z of two panels apart), damage index (mean z of one panel), intervals, nulls and calls.

    A call needs an interval off zero and a value beyond the 95th percentile of sets matched by level decile. Beside the signed
    identity index stand its magnitude, its direction (in the words ``toward``, of the first and the second panel), and the panels'
    mean z and mean shift.
    """
    toward = toward or (f"toward {first}", f"toward {second}")
    by = list(by)
    clean = shifts.where(finite(shift, level))
    tested = cut(floor_filter(clean, level, by, floor).select(*by, gene, shift, level))
    size = tested.groupBy(*by).agg(F.count(F.lit(1)).alias("n_genes_tested"), F.stddev_samp(shift).alias("_sd"))
    enough = F.col("n_genes_tested") >= int(min_tested)
    flat = F.coalesce(F.col("_sd"), F.lit(0.0)) == 0
    z = cut(deciles(zscore(tested, shift, by, "z"), level, by, gene, "decile").select(*by, gene, "z", "decile", F.col(shift).alias("raw")))
    members = cut(panel_members(z, panels, gene))
    means = members.groupBy(*by).agg(
        *[F.sum((F.col("panel") == p).cast("bigint")).alias(f"n_{n}") for n, p in
          (("first", first), ("second", second), ("damage", damage))],
        *[F.avg(F.when(F.col("panel") == p, F.col(c))).alias(f"{name}_{n}") for name, c in (("mean", "z"), ("raw", "raw")) for n, p in
          (("first", first), ("second", second), ("damage", damage))],
    )
    i_ci = intervals(bootstrap_panels(members, by, "panel", first, second, gene, "z", B, seed), by, ["difference"])
    d_ci = intervals(bootstrap_mean(members.where(F.col("panel") == damage), by, gene, "z", B, seed), by, ["mean"])
    null = {}
    for name, p, s in (("first", first, 1), ("second", second, 2), ("damage", damage, 3)):
        flagged = attach(z, members.where(F.col("panel") == p).select(*by, gene, F.lit(True).alias("_in")), [*by, gene])
        null[name] = matched_sets(
            flagged.withColumn("_in", F.coalesce("_in", F.lit(False))), by, "decile", gene, "z", F.col("_in"), B, seed + s
        )
    i_null = null["first"].withColumnRenamed("mean", "_m1").join(
        null["second"].withColumnRenamed("mean", "_m2"), [*by, "b"]
    ).groupBy(*by).agg(F.percentile(F.abs(F.col("_m1") - F.col("_m2")), F.lit(0.95)).alias("i_null_p95_abs"))
    d_null = null["damage"].groupBy(*by).agg(F.percentile("mean", F.lit(0.95)).alias("d_null_p95"))
    j = attach(size, means, by)
    for part in (i_ci, d_ci, i_null, d_null):
        j = attach(j, part, by)
    zero = F.lit(0).cast("bigint")
    n1, n2, nd = (F.coalesce(f"n_{n}", zero) for n in ("first", "second", "damage"))
    has_i, has_d = (n1 >= int(min_panel)) & (n2 >= int(min_panel)), nd >= int(min_damage)
    assessed = enough & ~flat
    status = (
        F.when(~enough, "too_few_genes").when(flat, "no_op").when(~has_i, "identity_panel_too_small")
        .when(~has_d, "damage_panel_too_small").otherwise("ok")
    )
    i = F.when(assessed & has_i, F.col("mean_first") - F.col("mean_second"))
    d = F.when(assessed & has_d, F.col("mean_damage"))
    off = is_clear(F.col("difference_ci_lo"), F.col("difference_ci_hi"))
    return j.select(
        *by, "n_genes_tested", n1.alias("n_first"), n2.alias("n_second"), nd.alias("n_damage"), status.alias("status"),
        i.alias("i_signed"), F.abs(i).alias("i_abs"), F.when(i > 0, toward[0]).when(i.isNotNull(), toward[1]).alias("direction"),
        *[F.when(i.isNotNull(), F.col(c)).alias(c) for c in ("mean_first", "mean_second", "raw_first", "raw_second")],
        F.when(d.isNotNull(), F.col("raw_damage")).alias("raw_damage"), F.when(i.isNotNull(), F.col("difference_ci_lo")).alias("i_ci_lo"),
        F.when(i.isNotNull(), F.col("difference_ci_hi")).alias("i_ci_hi"),
        F.when(i.isNotNull(), F.col("i_null_p95_abs")).alias("i_null_p95_abs"),
        F.coalesce(off & (F.abs(i) > F.col("i_null_p95_abs")), F.lit(False)).alias("i_call"),
        d.alias("d"), F.when(d.isNotNull(), F.col("mean_ci_lo")).alias("d_ci_lo"),
        F.when(d.isNotNull(), F.col("mean_ci_hi")).alias("d_ci_hi"),
        F.when(d.isNotNull(), F.col("d_null_p95")).alias("d_null_p95"),
        F.coalesce((F.col("mean_ci_lo") > 0) & (d > F.col("d_null_p95")), F.lit(False)).alias("d_call"),
    )


def rejuvenation(pairs: DataFrame, by: Sequence[str], item: str, shift: str, vector: str, B: int, seed: int,
                 min_items: int = 10) -> DataFrame:
    """Negative projection on the unit vector, its interval, and the null of shuffled vector entries."""
    pairs = cut(pairs.select(*by, item, shift, vector))
    point = project(pairs, shift, vector, by)
    boot = bootstrap_projection(pairs, by, item, shift, vector, B, seed).select(*by, "b", (-F.col("projection")).alias("r"))
    null = shuffle_null(pairs, by, item, shift, vector, B, seed + 1).select(*by, (-F.col("projection")).alias("_r0"))
    band = null.groupBy(*by).agg(
        F.percentile("_r0", F.lit(0.95)).alias("r_null_p95"), F.percentile("_r0", F.lit(0.05)).alias("r_null_p05")
    )
    j = attach(attach(point, intervals(boot, by, ["r"]), by), band, by)
    known = (F.col("n_common") >= int(min_items)) & F.col("projection").isNotNull()
    keep = {c: F.when(known, F.col(c)) for c in ("r_ci_lo", "r_ci_hi", "r_null_p95", "r_null_p05")}
    return j.withColumns(keep).select(
        *by, F.when(known, -F.col("projection")).alias("r"), *keep, F.col("n_common").alias("n_items"),
        known.alias("r_assessed"),
        F.coalesce(known & (F.col("r_ci_lo") > 0) & (-F.col("projection") > F.col("r_null_p95")), F.lit(False)).alias("r_call"),
    )


def classify(rows: DataFrame) -> DataFrame:
    """Class in fixed order; needs status, d_call, i_call, r_assessed and r_call."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.withColumn(
        "ird_class",
        F.when(F.col("status") == "no_op", "no-op")
        .when(F.col("status").isNull() | (F.col("status") == "too_few_genes"), "not assessed")
        .when(yes("d_call"), "non-specific damage").when(yes("i_call"), "identity reprogramming")
        .when(yes("r_assessed") & yes("r_call"), "identity-preserving rejuvenation").otherwise("no clear effect"),
    )


def index_validation(rows: DataFrame, reference: str) -> DataFrame:
    """Sign agreement of predicted with measured indices where the measured interval is off zero, for three subsets.

    ``rows``: scope, contrast, axis, real, real_lo, real_hi, pred.
    """
    subsets = F.array(F.lit("all_contrasts"), F.when(F.col("scope") == reference, F.lit("population_scope")).otherwise(
        F.lit("cell_type_scopes")))
    d = rows.where(finite("real", "pred")).select("*", F.explode(subsets).alias("subset"))
    clear = is_clear(F.col("real_lo"), F.col("real_hi"))
    agree = clear & (F.signum("real") == F.signum("pred"))
    key = ["subset", "axis"]
    t = d.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_contrasts"), F.sum(F.coalesce(clear, F.lit(False)).cast("bigint")).alias("n_real_clear"),
        F.sum(F.coalesce(agree, F.lit(False)).cast("bigint")).alias("n_sign_agree"),
    )
    lo, hi = wilson(F.col("n_sign_agree"), F.col("n_real_clear"))
    rho = spearman(d, "real", "pred", key, "rho", min_n=5).drop("n")
    return attach(t, rho, key).select(
        *key, "n_contrasts", "n_real_clear", "n_sign_agree",
        F.try_divide("n_sign_agree", "n_real_clear").alias("sign_agreement"), lo.alias("ci_lo"), hi.alias("ci_hi"), "rho",
    )
