"""Measured and predicted shifts, their agreement, and the verdict on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgrid.operators.aggregates import mean_profile, sum_duplicates
from shiftgrid.operators.filters import GuardError, require_empty
from shiftgrid.operators.matrix import ln_cp10k
from shiftgrid.operators.ordered import attach
from shiftgrid.operators.ranks import top_abs_label
from shiftgrid.operators.resample import bootstrap_spearman, intervals
from shiftgrid.operators.stats import finite, roc_pr, spearman
from shiftgrid.session import cut


def pick_cells(clusters: DataFrame, plate: str, names: Sequence[str], side: str) -> DataFrame:
    """Cells of the named clusters on one plate (the plate is the cell id up to the first ``_``)."""
    on_plate = clusters.withColumn("plate", F.substring_index("cell_id", "_", 1)).where(F.col("plate") == plate)
    have = {r[0] for r in on_plate.where(F.col("cluster").isin(*names)).select("cluster").distinct().limit(len(names)).collect()}
    missing = sorted(set(names) - have)
    if missing:
        raise GuardError(f"[{side}] cluster name(s) {missing} not found on plate {plate!r}")
    return on_plate.where(F.col("cluster").isin(*names)).select("cell_id").withColumn("side", F.lit(side))


def real_shift(
    counts: DataFrame, target: DataFrame, reference: DataFrame, checks: Sequence[str] = (), min_lfc: float = 0.5
) -> DataFrame:
    """Mean ln(1 + CP10k) of the target cells minus that of the reference cells, for every gene of the matrix.

    ``counts``: cell_id, gene, count. Rows with one symbol are summed first. The check genes must rise by ``min_lfc``.
    """
    require_empty(target.select("cell_id").intersect(reference.select("cell_id")), "target and reference share cells")
    sides = target.unionByName(reference)
    absent = sides.select("cell_id").join(counts.select("cell_id"), "cell_id", "left_anti")
    require_empty(absent, "labelled cells missing from the matrix")
    summed, _ = sum_duplicates(counts, "gene", ["cell_id"], "count")
    ln = ln_cp10k(summed.join(sides, "cell_id"), ["side", "cell_id"])
    means = mean_profile(ln, ["side"], "gene", ["cell_id"], "value")
    wide = means.groupBy("gene").agg(
        F.max(F.when(F.col("side") == "target", F.col("mean"))).alias("_t"),
        F.max(F.when(F.col("side") == "reference", F.col("mean"))).alias("_r"),
    )
    out = attach(counts.select("gene").distinct(), wide, ["gene"]).select(
        "gene", F.coalesce("_t", F.lit(0.0)).alias("target_mean"), F.coalesce("_r", F.lit(0.0)).alias("reference_mean"),
    ).withColumn("real_shift", F.col("target_mean") - F.col("reference_mean"))
    if checks:
        found = {r["gene"]: r["real_shift"] for r in out.where(F.col("gene").isin(*checks)).limit(len(checks)).collect()}
        bad = [g for g in checks if found.get(g) is None or found[g] < min_lfc]
        if bad:
            raise GuardError(f"self-check genes {bad} do not rise by {min_lfc}")
    return out


def predicted_shift(
    perturbed: DataFrame, baseline: DataFrame, components: DataFrame, by: Sequence[str], component: str, gene: str,
    sample: str, value: str,
) -> DataFrame:
    """Sum over components of sign x (mean perturbed - mean baseline), on the genes every component predicts."""
    n = components.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    p = perturbed.join(components, [*by, component]).groupBy(*by, component, "sign", gene).agg(F.avg(value).alias("_p"))
    b = baseline.groupBy(*by, gene).agg(F.avg(value).alias("_b"))
    parts = p.join(b, [*by, gene])
    summed = parts.groupBy(*by, gene).agg(
        F.sum(F.col("sign") * (F.col("_p") - F.col("_b"))).alias("predicted_shift"), F.max("_b").alias("level"),
        F.count(F.lit(1)).alias("_k"),
    )
    return attach(summed, n, by, "inner").where(F.col("_k") == F.col("_n")).drop("_k", "_n")


def excess(
    shifts: DataFrame, by: Sequence[str], gene: str, B: int, seed: int, real: str = "real_shift",
    pred: str = "predicted_shift", level: str = "level", min_genes: int = 100, min_sd: float = 1e-6,
) -> DataFrame:
    """Correlation, level-only null, their difference, and bootstrap intervals of correlation and difference.

    Groups that are not evaluable (too few genes, a constant prediction) keep their correlation only and are not resampled.
    """
    known = cut(shifts.where(finite(real, pred, level)).select(*by, gene, real, pred, level))
    sizes = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_genes"), F.stddev_samp(pred).alias("pred_shift_sd")
    )
    able = evaluable(min_genes, min_sd)
    used = cut(attach(known, sizes.where(able).select(*by), by, "inner")) if by else known
    rho = spearman(known, real, pred, by, "rho").drop("n")
    null = spearman(used, real, level, by, "_level").drop("n")
    point = attach(attach(sizes, rho, by), null, by).select(
        *by, "n_genes", "pred_shift_sd", "rho", F.when(able, F.abs("_level")).alias("level_null"),
        F.when(able, F.col("rho") - F.coalesce(F.abs("_level"), F.lit(0.0))).alias("excess"),
    )
    each = bootstrap_spearman(used, by, gene, {"rho": (real, pred), "_level": (real, level)}, B, seed)
    each = each.withColumn("excess", F.col("rho") - F.coalesce(F.abs("_level"), F.lit(0.0))).where(
        F.col("excess").isNotNull()
    )
    return attach(point, intervals(each, by, ["rho", "excess"]), by)


def evaluable(min_genes: int, min_sd: float) -> Column:
    """Enough genes, and a prediction that is not constant."""
    return (F.col("n_genes") >= int(min_genes)) & F.coalesce(F.col("pred_shift_sd") >= F.lit(min_sd), F.lit(False))


def verdict(
    scored: Column, evaluable: Column, lo: Column, hi: Column, invert: Column, threshold: float = 0.05
) -> Column:
    """Interval against the threshold; a negative control passes below it."""
    t = F.lit(float(threshold))
    return (
        F.when(~scored, "not_scored").when(~evaluable, "NOT_EVALUABLE")
        .when(F.when(invert, hi < t).otherwise(lo > t), "PASS")
        .when(F.when(invert, lo > t).otherwise(hi < t), "FAIL").otherwise("INCONCLUSIVE")
    )


def judged(
    rows: DataFrame, min_genes: int = 100, min_sd: float = 1e-6, threshold: float = 0.05,
    scored: Column | None = None, invert: Column | None = None, null_quantile: float = 0.95,
) -> DataFrame:
    """``excess`` rows with their verdict and what it rests on; a negative control is judged on the raw correlation.

    Where a screen null is joined in (``null_pctile``), it decides a scored negative control instead: below ``null_quantile``
    of the screened variants it passes.
    """
    scored = F.lit(True) if scored is None else scored
    invert = F.lit(False) if invert is None else invert
    able = evaluable(min_genes, min_sd)
    lo = F.when(invert, F.col("rho_ci_lo")).otherwise(F.col("excess_ci_lo"))
    hi = F.when(invert, F.col("rho_ci_hi")).otherwise(F.col("excess_ci_hi"))
    call = verdict(scored, able, lo, hi, invert, threshold)
    basis = F.when(invert, "bootstrap_raw_rho").otherwise("bootstrap_excess")
    if "null_pctile" in rows.columns:
        by_screen = scored & invert & able & F.col("null_pctile").isNotNull()
        call = F.when(by_screen, F.when(F.col("null_pctile") < float(null_quantile), "PASS").otherwise("FAIL")).otherwise(call)
        basis = F.when(by_screen, "empirical_null").otherwise(basis)
    return rows.withColumns({"verdict": call, "verdict_basis": basis})


def top_recovery(
    shifts: DataFrame, by: Sequence[str], truth: str, score: str, k: int = 200, min_n: int = 10
) -> DataFrame:
    """AUROC / AUPR of the score magnitude against the k largest truth magnitudes (ties included)."""
    known = shifts.where(finite(truth, score))
    size = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    labelled = top_abs_label(known, truth, by, k).withColumn("_s", F.abs(score))
    found = attach(roc_pr(labelled, "is_top", "_s", by), size, by)
    ok = (F.col("_n") >= int(min_n)) & (F.least(F.lit(int(k)), F.floor(F.col("_n") / 2)) >= 2)
    return found.select(
        *by, F.col("n"), F.when(ok, F.col("auroc")).alias("auroc"), F.when(ok, F.col("aupr")).alias("aupr")
    )


def gate(rows: DataFrame, call: str = "verdict", passed: str = "sanity_pass") -> DataFrame:
    """A scored verdict of a scope that fails its sanity check does not stand."""
    scored = F.col(call).isin("PASS", "FAIL", "INCONCLUSIVE")
    stands = F.coalesce(F.col(passed), F.lit(False))
    return rows.withColumn("pass_fail", F.when(scored & ~stands, "SCOPE_FAILS_SANITY").otherwise(F.col(call)))


def vector_support(reference: DataFrame, others: DataFrame, scope: str, item: str, value: str, k: int = 200) -> DataFrame:
    """Each other vector against the reference vector: correlation, and recovery of the reference's largest items.

    ``shiftgrid.functions.pvalue.with_p_value`` adds the test of zero correlation to any such report row.
    """
    ref = reference.select(item, F.col(value).alias("_ref"))
    pairs = others.select(scope, item, F.col(value).alias("_own")).join(ref, item)
    rho = spearman(pairs, "_ref", "_own", [scope], "rho", min_n=10)
    return attach(rho, top_recovery(pairs, [scope], "_ref", "_own", k).drop("n"), [scope])
