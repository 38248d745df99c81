"""Metric tables: contrasts against baselines, pathways, ranking against curated tiers, edges against truth sets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgrid.functions.scalars import region_chrom, region_end, region_start
from shiftgrid.operators import drawn, replicates
from shiftgrid.operators.enrichment import normalised_enrichment
from shiftgrid.operators.intervals import overlap_sets
from shiftgrid.operators.joins import leave_source_out
from shiftgrid.operators.ordered import SLICE, attach, attach_stats, numbered, running, running_whole, with_each
from shiftgrid.operators.ranks import decile_of, percent_of_rank, tie_totals, top_abs
from shiftgrid.operators.resample import intervals, permutation_null, written_draws, written_labels
from shiftgrid.operators.stats import (
    agree_expr, corr_expr, curve_of, finite, metrics_of_hits, rel_rmse_expr, sign_accuracy,
    spearman, zscore_many,
)
from shiftgrid.session import cut


def standardised(shifts: DataFrame, by: Sequence[str], loco: bool = False) -> DataFrame:
    """z-scored measured, predicted and level columns; the level takes the sign that agrees with the measured shift."""
    columns = {"zr": "real_shift", "zp": "predicted_shift", "zl": "level", **({"zc": "loco"} if loco else {})}
    z = zscore_many(shifts, columns, by)
    side = z.groupBy(*by).agg(corr_expr(F.col("zl"), F.col("zr")).alias("_pl"))
    return attach_stats(z, side, by).withColumn(
        "zs", F.when(F.coalesce(F.col("_pl"), F.lit(0.0)) >= 0, F.col("zl")).otherwise(-F.col("zl"))
    ).drop("_pl")


def baselines(shifts: DataFrame, by: Sequence[str], gene: str, ks: Sequence[int] = (100, 300), loco: bool = False) -> DataFrame:
    """Model, no-change, level-only and leave-one-out values of correlation, relative error and sign concordance."""
    z = cut(standardised(shifts, by, loco))
    r, p, s = F.col("zr"), F.col("zp"), F.col("zs")
    aggs = [
        F.count(F.lit(1)).alias("n_genes"), corr_expr(p, r).alias("pcc"), rel_rmse_expr(p, r).alias("rel_rmse"),
        rel_rmse_expr(F.lit(0.0), r).alias("nochange_rel_rmse"), F.abs(corr_expr(s, r)).alias("level_pcc"),
        rel_rmse_expr(s, r).alias("level_rel_rmse"),
    ]
    if loco:
        c = F.col("zc")
        aggs += [
            corr_expr(c, r).alias("loco_pcc"), rel_rmse_expr(c, r).alias("loco_rel_rmse"),
            corr_expr(p - c, r - c).alias("pcc_centroid"),
        ]
    out = z.groupBy(*by).agg(*aggs)
    ranked = top_abs(z, "real_shift", by, gene, max(ks), "_top")
    real = F.col("real_shift")
    for k in ks:
        inside = F.col("_top") <= int(k)
        models = [("deg_conc", F.col("predicted_shift")), ("level_deg_conc", s)] + ([("loco_deg_conc", F.col("zc"))] if loco else [])
        conc = ranked.where(inside).groupBy(*by).agg(*[agree_expr(m, real).alias(f"{n}_{k}") for n, m in models])
        out = attach(out, conc, by)
    return out


def bootstrap_contrast(
    shifts: DataFrame, by: Sequence[str], gene: str, B: int, seed: int, ks: Sequence[int] = (100, 300), loco: bool = False
) -> DataFrame:
    """Intervals of the model's metrics, of the best baseline (level, no change, leave-one-out), and of their distance.

    The z-scores of a replicate are linear in its weighted moments, so correlation and error follow from sums: for two
    standardised vectors the mean squared difference is ``2 - 2 * correlation``. A constant vector standardises to zeros: it
    has no correlation, and an error of 1.
    """
    wanted = finite("real_shift", "predicted_shift", "level", *(["loco"] if loco else []))
    z = zscore_many(shifts.where(wanted), {"zr": "real_shift", "zp": "predicted_shift", "zl": "level", **({"zc": "loco"} if loco else {})}, by)
    columns = ["zr", "zp", "zl", *(["zc"] if loco else []), "real_shift", "predicted_shift"]
    # the k largest measured magnitudes of a replicate are looked for in the order of all rows
    placed = numbered(z.select(*by, gene, *columns, F.abs("real_shift").alias("_a")), by, ["-_a", gene], "_place")
    pairs = {"_pr": ("zp", "zr"), "_lr": ("zl", "zr"), **({"_cr": ("zc", "zr"), "_pc": ("zp", "zc")} if loco else {})}
    scaled = list(dict.fromkeys(c for p in pairs.values() for c in p))
    terms = {f"_s_{c}": (c,) for c in scaled} | {f"_q_{c}": (c, c) for c in scaled} | {f"_p_{n}": p for n, p in pairs.items()}
    # the largest k is found among twice as many rows and some, of which a replicate draws as many on average
    most = 2 * int(max(ks)) + 100
    drawn_sums = cut(drawn.resampled_sums(
        placed, by, gene, {c: F.col(c) for c in columns}, terms, B, seed, ("_place", ["predicted_shift", "real_shift"]), most))
    sums = drawn_sums.drop("_listed")
    sums = sums.select(*by, "b", *[replicates.corr_of_sums(n, x, y) for n, (x, y) in pairs.items()])

    def error(rho: str):
        return F.when(F.col(rho).isNull(), F.lit(1.0)).otherwise(F.sqrt(F.greatest(F.lit(2.0) - F.lit(2.0) * F.col(rho), F.lit(0.0))))

    level = F.abs("_lr")
    side = F.when(F.col("_lr").isNull(), F.lit(1.0)).otherwise(F.sqrt(F.greatest(F.lit(2.0) - F.lit(2.0) * level, F.lit(0.0))))
    best = F.greatest(level, F.col("_cr")) if loco else level
    least = F.least(side, F.lit(1.0), *([error("_cr")] if loco else []))
    each = sums.select(*by, "b", F.col("_pr").alias("pcc"), error("_pr").alias("rel_rmse"), best.alias("best_baseline_pcc"),
                       least.alias("best_baseline_rel_rmse"), (F.col("_pr") - best).alias("d_pcc"), (error("_pr") - least).alias("d_rel_rmse"),
                       *([F.try_divide(F.col("_pr") - F.col("_pc") - F.col("_cr") + 1,
                                       F.sqrt((F.lit(2.0) - 2 * F.col("_pc")) * (F.lit(2.0) - 2 * F.col("_cr")))).alias("pcc_centroid")] if loco else []))
    each = attach(each, drawn.listed_agreement(drawn_sums, by, "predicted_shift", "real_shift", ks, most), [*by, "b"])
    return intervals(each, by, [c for c in each.columns if c not in {*by, "b"}])


def contrast_metrics(
    shifts: DataFrame, by: Sequence[str], gene: str, B: int = 300, n_perm: int = 200, seed: int = 0,
    ks: Sequence[int] = (100, 300), min_genes: int = 200, loco: bool = False,
) -> DataFrame:
    """One row per contrast: model, four baselines, intervals; too small or constant ones carry a note only."""
    known = cut(shifts.where(finite("real_shift", "predicted_shift", "level")))
    size = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.stddev_pop("predicted_shift").alias("_sd"))
    ok = (F.col("_n") >= int(min_genes)) & (F.col("_sd") > 0)
    used = cut(known.join(size.where(ok).select(*by), list(by), "left_semi"))
    z = zscore_many(used, {"zr": "real_shift", "zp": "predicted_shift"}, by)
    out = attach(size.select(*by, F.when(~ok, F.lit("too few genes or a no-op prediction")).alias("note")),
                 baselines(used, by, gene, ks, loco), by)
    out = attach(out, permutation_null(z, by, gene, "zr", "zp", n_perm, seed, ks, "real_shift"), by)
    return attach(out, bootstrap_contrast(used, by, gene, B, seed, ks, loco), by)


def interaction_metrics(residuals: DataFrame, by: Sequence[str], gene: str, real: str, pred: str, B: int, seed: int) -> DataFrame:
    """Correlation of predicted with measured interaction residuals, its interval, and the size of the residual."""
    known = cut(residuals.where(finite(real, pred)))
    point = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_genes"), F.stddev_pop(real).alias("real_eps_sd"), F.stddev_pop(pred).alias("pred_eps_sd"),
        corr_expr(F.col(pred), F.col(real)).alias("pcc_eps"),
        F.try_divide(F.stddev_pop(real), F.greatest(F.stddev_pop("additive"), F.lit(1e-12))).alias("eps_to_sum_sd_ratio"),
    )
    z = zscore_many(known, {"_zr": real, "_zp": pred}, by)
    pairs = {"pcc_eps": ("_zp", "_zr")}
    counted = replicates.bootstrap_counts(z, by, gene, ["_zr", "_zp"], B, seed)
    each = replicates.weighted_sums(counted, by, replicates.pair_sums(pairs), B).select(*by, "b", replicates.corr_of_sums("pcc_eps", "_zp", "_zr"))
    return attach(point, intervals(each, by, ["pcc_eps"]), by)


def pathway_agreement(
    shifts: DataFrame, by: Sequence[str], gene: str, sets: DataFrame, B: int, seed: int, strong: float = 1.5
) -> DataFrame:
    """Agreement of the normalised enrichment of measured and predicted shifts over gene sets."""
    z = cut(zscore_many(shifts, {"zr": "real_shift", "zp": "predicted_shift"}, by).select(*by, gene, "zr", "zp"))
    a = normalised_enrichment(z, by, gene, "zr", sets, B, seed).select(*by, "set_name", F.col("nes").alias("_a"))
    b = normalised_enrichment(z, by, gene, "zp", sets, B, seed + 1).select(*by, "set_name", F.col("nes").alias("_b"))
    j = cut(a.join(b, [*by, "set_name"]).where(finite("_a", "_b")))
    rho = spearman(j, "_a", "_b", by, "nes_spearman", min_n=4).withColumnRenamed("n", "n_sets")
    big = F.abs("_a") >= F.lit(strong)
    enough = F.count(F.lit(1)) > 3  # with three sets or fewer nothing is compared
    extra = j.groupBy(*by).agg(
        F.when(enough, F.sum(big.cast("bigint"))).otherwise(F.lit(0).cast("bigint")).alias("n_strong_real"),
        F.when(enough, F.avg(F.when(big, (F.signum("_a") == F.signum("_b")).cast("double")))).alias("nes_sign_agree_strong"),
    )
    return attach(rho, extra, by)


# ---------------------------------------------------------------------------------------------------- curated tiers
def consensus_scope(scores: DataFrame, name: str = "consensus_headline") -> DataFrame:
    """Median over headline scopes of the within-scope percentile rank, centred at 0.5."""
    ok = (F.col("status") == "ok") & (F.col("gate_verdict") == "PASS") & finite("score")
    ranked = percent_of_rank(scores.where(ok), "score", ["scope"], "_pct")
    # a factor has one row per scope, so its medians are small
    return ranked.groupBy("tf").agg(
        (F.percentile("_pct", F.lit(0.5)) - F.lit(0.5)).alias("score"),
        F.percentile("centrality", F.lit(0.5)).alias("centrality"), F.count(F.lit(1)).alias("n_scopes"),
    ).withColumn("scope", F.lit(name))


def screen_scores(screen: DataFrame, name: str = "consensus_headline") -> DataFrame:
    """Scores that may be ranked: knock-outs with status ok, and the consensus scope where two scopes or more pass the gate.

    ``screen``: scope, tf, mode, status, gate_verdict, score, centrality.
    """
    knocked = screen.where(F.col("mode") == "ko")
    usable = knocked.where(F.col("status") == "ok").select("scope", "tf", "score", "centrality")
    passing = knocked.where((F.col("status") == "ok") & (F.col("gate_verdict") == "PASS"))
    enough = passing.agg(F.count_distinct("scope").alias("_scopes"))
    chained = attach(consensus_scope(knocked, name), enough, []).where(F.col("_scopes") >= 2)
    return usable.unionByName(chained.select("scope", "tf", "score", "centrality"))


def tier_cases(scores: DataFrame, gold: DataFrame, min_ranked: int = 50) -> DataFrame:
    """Every (scope, tier, direction, subset) list to be ranked: tf, rank score, 0/1 label, centrality.

    ``scores`` are those of ``screen_scores``: a failed or over-expressed row never enters a list. Signed tiers give two
    directions (the score is negated for the lowering one); the membership tier ranks by magnitude. The subset without the
    other source drops the factors of the other signed tier.
    """
    known = scores.where(finite("score")).select("scope", "tf", "score", "centrality")
    enough = known.groupBy("scope").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= int(min_ranked))
    known = known.join(enough.select("scope"), "scope", "left_semi")
    base = with_each(known, gold.select("tier").distinct())
    labelled = attach(base, gold.select("tier", "tf", "expected_ko_sign"), ["tier", "tf"])
    cases = F.when(F.col("tier") == "D", F.array(F.struct(
        F.lit("membership").alias("direction"), F.abs("score").alias("rank_score"),
        F.col("expected_ko_sign").isNotNull().cast("int").alias("y"),
    ))).otherwise(F.array(
        F.struct(F.lit("raises").alias("direction"), F.col("score").alias("rank_score"),
                 F.coalesce((F.col("expected_ko_sign") == 1).cast("int"), F.lit(0)).alias("y")),
        F.struct(F.lit("lowers").alias("direction"), (-F.col("score")).alias("rank_score"),
                 F.coalesce((F.col("expected_ko_sign") == -1).cast("int"), F.lit(0)).alias("y")),
    ))
    whole = labelled.select("scope", "tier", "tf", "score", "centrality", "expected_ko_sign", F.explode(cases).alias("c")).select(
        "scope", "tier", "tf", "score", "centrality", "expected_ko_sign", "c.direction", "c.rank_score", "c.y",
        F.lit("all").alias("subset"),
    )
    parts = whole
    for own, other in (("B", "C"), ("C", "B")):
        out = leave_source_out(whole.where(F.col("tier") == own), gold, "tf", "tier", own, ["B", "C"])
        parts = parts.unionByName(out.withColumn("subset", F.lit("leave_source_out")))
    return parts


CASE = ["scope", "tier", "direction", "subset"]


def listed_cases(cases: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Lists with both classes, one row per factor with position, hit number, centrality decile, list size and positives; and the
    size and positives of every list."""
    # scores are averages: written, so that every order is taken of the same values
    known = cut(cases)
    totals = cut(known.groupBy(*by).agg(F.count(F.lit(1)).alias("n_ranked"), F.sum("y").cast("bigint").alias("n_pos")))
    used = attach(known, totals, by).where((F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n_ranked")))
    binned = cut(numbered(used, by, ["centrality", "tf"], "_c").withColumn("_decile", decile_of(F.col("_c"), F.col("n_ranked"))).drop("_c"))
    places = {"_position": ("sum", F.lit(1).cast("bigint")), "_hit": ("sum", F.col("y").cast("bigint"))}
    return cut(running(binned, by, ["-rank_score", "tf"], places).drop(SLICE)), totals


def rank_against_gold(cases: DataFrame, ks: Sequence[int] = (10, 20, 50), B_null: int = 1000, seed: int = 0,
                      min_tier: int = 10, B_boot: int = 500) -> DataFrame:
    """Average precision, nDCG and recall with bootstrap intervals, and their nulls with labels permuted in centrality deciles.

    A list of one class only gets its counts and no metrics. Intervals need more than 20 replicates with a positive. One set of
    permutations serves average precision and every recall; recalls take the first fifth of them, 200 at least. ``null_hits_<k>``
    counts the positives within k over those replicates, so the mean recall is a quotient of whole numbers.
    """
    listed, totals = listed_cases(cases, CASE)
    hits = listed.where("y = 1").select(*CASE, F.col("_position").alias("position"), F.col("_hit").alias("hit"))
    metrics = metrics_of_hits(hits, totals, CASE, ks)
    out = metrics.withColumn("prevalence", F.when(F.col("ap").isNotNull(), F.col("n_pos") / F.col("n_ranked")))
    first = max(200, B_null // 5)
    null = null_ranking(listed, CASE, "_decile", "tf", ks, max(B_null, first), seed)
    known = [f"_obs_{c}" for c in ("ap", *[f"recall_at_{k}" for k in ks])]
    both = attach(null, metrics.select(*CASE, F.col("n_pos").alias("_np"), *[F.col(c.removeprefix("_obs_")).alias(c) for c in known]), CASE, "inner")
    in_ap, in_recall = F.col("b") <= int(B_null), F.col("b") <= first
    # equal values may differ in the last bits, having been summed in another order
    reached = {"_obs_ap": F.col("ap") >= F.col("_obs_ap") - 1e-12} | {
        f"_obs_recall_at_{k}": F.col(f"hits_{k}") / F.col("_np") >= F.col(f"_obs_recall_at_{k}") - 1e-12 for k in ks}

    def share(value: Column, within: Column) -> Column:
        return (F.sum(F.when(within, value.cast("bigint"))) + 1) / (F.sum(F.when(within, 1)) + 1)

    summary = both.groupBy(*CASE).agg(
        F.avg(F.when(in_ap, F.col("ap"))).alias("null_mean"), F.try_divide(F.max("_obs_ap"), F.avg(F.when(in_ap, F.col("ap")))).alias("enrichment"),
        share(reached["_obs_ap"], in_ap).alias("p_value"),
        *[c for k in ks for c in (
            F.sum(F.when(in_recall, F.col(f"hits_{k}"))).alias(f"null_hits_{k}"),
            (F.sum(F.when(in_recall, F.col(f"hits_{k}"))) / F.sum(F.when(in_recall, F.col("_np")))).alias(f"recall_at_{k}_null_mean"),
            share(reached[f"_obs_recall_at_{k}"], in_recall).alias(f"recall_at_{k}_p"))])
    out = attach(out, summary, CASE)
    each = bootstrap_ranking(listed, CASE, "tf", ks, B_boot, seed + 7)
    columns = ["ap", *[f"ndcg_at_{k}" for k in ks], *[f"recall_at_{k}" for k in ks]]
    bands = each.groupBy(*CASE).agg(F.count("ap").alias("_b"), *[
        F.percentile(c, F.lit(q)).alias(f"{c}_{side}") for c in columns for side, q in (("ci_lo", 0.025), ("ci_hi", 0.975))])
    return attach(out, bands.where(F.col("_b") > 20).drop("_b"), CASE).withColumn("underpowered", F.col("n_pos") < int(min_tier))


def listed_rows(listed: DataFrame, by: Sequence[str], key: str, seed: int, more: Sequence[str] = ()) -> DataFrame:
    return drawn.positioned(listed, by, key, {c: F.col(c) for c in ("_position", "y", *more)}, seed)


def told_ranking(ks: Sequence[int]):
    """Average precision, nDCG@k and Recall@k of the positions of a list's positives, which are in order."""

    def told(at: np.ndarray, n: int) -> dict:
        hit = np.arange(1, len(at) + 1)
        out = {"ap": float((hit / at).mean())}
        for k in ks:
            gained = (1.0 / np.log2(at[at <= k] + 1.0)).sum()
            out[f"ndcg_at_{k}"] = float(gained / (1.0 / np.log2(hit[:k] + 1.0)).sum())
            out[f"recall_at_{k}"] = float((at <= k).mean())
        return out

    ks = [int(k) for k in ks]
    return told


def told_hits(ks: Sequence[int]):
    """Average precision and the positives within each k."""

    def told(at: np.ndarray, n: int) -> dict:
        return {"ap": float((np.arange(1, len(at) + 1) / at).mean())} | {f"hits_{k}": int((at <= k).sum()) for k in ks}

    ks = [int(k) for k in ks]
    return told


def told_curve(kmax: int):
    """The positives up to each k, and their number."""

    def told(at: np.ndarray, n: int) -> dict:
        return {"_hits": np.searchsorted(at, np.arange(1, min(kmax, n) + 1), "right").tolist(), "n_pos": len(at)}

    kmax = int(kmax)
    return told


CURVE = {"_hits": "array<bigint>", "n_pos": "bigint"}


def curves_of(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """The curves of ``told_curve``, one row per (list, b, k)."""
    each = found.where("n_pos > 0").select(*by, "b", "n_pos", F.posexplode("_hits").alias("_i", "hits"))
    return each.select(*by, "b", (F.col("_i") + 1).cast("bigint").alias("k"), "hits", (F.col("hits") / F.col("n_pos")).alias("recall"), "n_pos")


def written_hits(rows: DataFrame, by: Sequence[str], B: int) -> tuple[DataFrame, DataFrame]:
    """Positives of every resampled list with position and hit number (each copy a row), and positives and size per replicate.

    ``rows`` are those of lists that no task holds; copies stay in their order, so nothing but multiplicities is summed.
    """
    resampled = written_draws(rows, by, ["_position", "y", "_n"], B)
    w = F.col("w").cast("bigint")
    walked = running_whole(resampled, [*by, "b"], "_position", {"_above": ("sum", w), "_hits": ("sum", w * F.col("y"))}, False, F.col("_n"))
    hits = walked.where("y = 1").select(*by, "b", "_above", "_hits", F.explode(F.sequence(F.lit(1).cast("bigint"), w)).alias("_copy")).select(
        *by, "b", (F.col("_above") + F.col("_copy")).alias("position"), (F.col("_hits") + F.col("_copy")).alias("hit"))
    totals = resampled.groupBy(*by, "b").agg(F.sum(w * F.col("y")).alias("n_pos"), F.sum(w).alias("n_ranked"))
    return hits, totals


def bootstrap_ranking(listed: DataFrame, by: Sequence[str], key: str, ks: Sequence[int], B: int, seed: int) -> DataFrame:
    """Average precision, nDCG@k and Recall@k of each resampled list; NULL where it holds no positive."""
    held, large, groups = drawn.parted(listed_rows(listed, by, key, seed))
    names = ["ap", *[f"{c}_at_{k}" for k in ks for c in ("ndcg", "recall")]]
    each = drawn.resampled_hits(held, by, groups, B, told_ranking(ks), dict.fromkeys(names, "double"))
    if large is None:
        return each
    hits, _ = written_hits(large, by, B)
    gain, best = F.lit(1.0) / F.log2(F.col("position") + F.lit(1.0)), F.lit(1.0) / F.log2(F.col("hit") + F.lit(1.0))
    aggs = [F.avg(F.col("hit") / F.col("position")).alias("ap")]
    for k in ks:
        within = F.col("position") <= int(k)
        aggs.append((F.sum(F.when(within, gain).otherwise(0.0)) / F.sum(F.when(F.col("hit") <= int(k), best).otherwise(0.0))).alias(f"ndcg_at_{k}"))
        aggs.append(F.avg(within.cast("double")).alias(f"recall_at_{k}"))
    return each.unionByName(hits.groupBy(*by, "b").agg(*aggs))


def null_ranking(listed: DataFrame, by: Sequence[str], stratum: str, key: str, ks: Sequence[int], B: int, seed: int) -> DataFrame:
    """Average precision and the positives within each k, per replicate of labels permuted within strata.

    ``listed`` has positions (``_position``, ranked once).
    """
    held, large, groups = drawn.parted(listed_rows(listed, by, key, seed, [stratum]))
    each = drawn.permuted_hits(held, by, groups, B, stratum, told_hits(ks), {"ap": "double"} | {f"hits_{k}": "bigint" for k in ks})
    if large is None:
        return each
    hits = running_whole(written_labels(large, by, stratum, "y", B), [*by, "b"], "_position", {"_hit": ("sum", F.lit(1).cast("bigint"))}, reach=F.col("_n"))
    return each.unionByName(hits.groupBy(*by, "b").agg(
        F.avg(F.col("_hit") / F.col("_position")).alias("ap"),
        *[F.sum((F.col("_position") <= int(k)).cast("bigint")).alias(f"hits_{k}") for k in ks]))


def null_curves(listed: DataFrame, by: Sequence[str], stratum: str, key: str, kmax: int, B: int, seed: int) -> DataFrame:
    """Recall at every k of labels permuted within strata, per replicate."""
    held, large, groups = drawn.parted(listed_rows(listed, by, key, seed, [stratum]))
    each = curves_of(drawn.permuted_hits(held, by, groups, B, stratum, told_curve(kmax), CURVE), by)
    if large is None:
        return each
    moved = written_labels(large, by, stratum, "y", B).withColumnRenamed("_position", "position")
    # every replicate has the positives of its list, and the size comes with its rows
    totals = moved.groupBy(*by, "b").agg(F.count(F.lit(1)).alias("n_pos"), F.max("_n").alias("n_ranked"))
    return each.unionByName(curve_of(moved, totals, [*by, "b"], kmax).select(*each.columns))


def bootstrap_curves(listed: DataFrame, by: Sequence[str], key: str, kmax: int, B: int, seed: int) -> DataFrame:
    """Recall at every k of each resampled list that holds a positive."""
    held, large, groups = drawn.parted(listed_rows(listed, by, key, seed))
    each = curves_of(drawn.resampled_hits(held, by, groups, B, told_curve(kmax), CURVE), by)
    if large is None:
        return each
    hits, totals = written_hits(large, by, B)
    return each.unionByName(curve_of(hits, totals, [*by, "b"], kmax).select(*each.columns))


def signs_against_gold(cases: DataFrame) -> DataFrame:
    one = cases.where((F.col("direction") == "raises"))
    return sign_accuracy(one, "score", "expected_ko_sign", ["scope", "tier", "subset"])


def recall_report(cases: DataFrame, kmax: int = 200, B_null: int = 200, seed: int = 0, B_boot: int = 300) -> DataFrame:
    """Observed recall curve, mean and 5th / 95th percentile of the permuted ones, and a bootstrap interval.

    Lists of one class only have no curve; replicates without a positive drop out of the interval. ``null_hits`` counts the
    positives up to k over all replicates, so that the mean is a quotient of whole numbers: null_hits / (B_null * n_pos); the
    percentiles are reported of these counts too (``null_hits_p05``, ``null_hits_p95``).
    """
    by = ["scope", "tier", "direction"]
    listed, totals = listed_cases(cases.where(F.col("subset") == "all"), by)
    hits = listed.where("y = 1").select(*by, F.col("_position").alias("position"), F.col("_hit").alias("hit"))
    observed = curve_of(hits, attach(totals, listed.select(*by).distinct(), by, "inner"), by, kmax)
    curves = null_curves(listed, by, "_decile", "tf", kmax, B_null, seed)
    band = curves.groupBy(*by, "k").agg(
        F.sum("hits").alias("null_hits"), (F.sum("hits") / F.sum("n_pos")).alias("null_mean"),
        *[F.percentile(c, F.lit(q)).alias(f"{name}_{side}") for name, c in (("null", "recall"), ("null_hits", "hits"))
          for side, q in (("p05", 0.05), ("p95", 0.95))],
    )
    resampled = bootstrap_curves(listed, by, "tf", kmax, B_boot, seed).groupBy(*by, "k").agg(
        F.percentile("recall", F.lit(0.025)).alias("ci_lo"), F.percentile("recall", F.lit(0.975)).alias("ci_hi"))
    return attach(attach(observed.drop("hits"), band, [*by, "k"]), resampled, [*by, "k"])


# ------------------------------------------------------------------------------------------------------------- edges
def benchmark_edges(
    edges: DataFrame, truth: DataFrame, scope: str, region: str, score: str, truth_set: str, names: Sequence[str],
    kind: str = "edge_type", only: DataFrame | None = None,
) -> DataFrame:
    """AUROC / AUPR of edge scores against overlap with each truth set, per scope and edge type; one-class cases drop out.

    ``only`` (scope, kind, truth set) names the cases to be scored; without it, all are.

    ``edges``: scope, edge_type, region text, score. ``truth``: set name, chrom, start, end. The scores are laid out once
    for all truth sets; each set then adds its positives only, so edges are never repeated per set.
    """
    case = [scope, kind]
    place = ["chrom", "start", "end"]
    parsed = cut(edges.select(
        *case, F.col(score).alias("_s"), region_chrom(F.col(region)).alias("chrom"), region_start(F.col(region)).alias("start"),
        region_end(F.col(region)).alias("end"),
    ).where(F.col("chrom").isNotNull() & finite("_s")))
    ties = tie_totals(parsed, case, "_s", {"_all": F.lit(1.0)}, descending=True)
    hits = overlap_sets(parsed, truth, truth_set, names)
    met = parsed.join(hits, place)
    met = met if only is None else met.join(only, [*case, truth_set], "left_semi")
    positives = met.groupBy(*case, truth_set, "_s").agg(F.count(F.lit(1)).cast("double").alias("_p"))
    by = [*case, truth_set]
    at = cut(attach(positives, ties, [*case, "_s"]))
    walked = running(at, by, ["-_s"], {"_cum_p": ("sum", F.col("_p"))})
    n = parsed.groupBy(*case).agg(F.count(F.lit(1)).cast("double").alias("_all_n"))
    sizes = attach(at.groupBy(*by).agg(F.sum("_p").alias("_pos_n")), n, case)
    j = attach_stats(walked, sizes, by)
    below = (F.col("_all_n") - F.col("cum__all")) - (F.col("_pos_n") - F.col("_cum_p"))
    wins = F.col("_p") * (below + (F.col("_all") - F.col("_p")) * F.lit(0.5))
    found = j.groupBy(*by).agg(
        F.max("_all_n").alias("_all_n"), F.max("_pos_n").alias("_pos_n"), F.sum(wins).alias("_wins"),
        F.sum(F.col("_p") * F.col("_cum_p") / F.col("cum__all")).alias("_area"),
    ).where(F.col("_pos_n") < F.col("_all_n"))
    return found.select(
        *case, F.col(truth_set).alias("ground_truth"), F.col("_all_n").cast("bigint").alias("n_edges"),
        F.col("_pos_n").cast("bigint").alias("n_hits"), (F.col("_wins") / (F.col("_pos_n") * (F.col("_all_n") - F.col("_pos_n")))).alias("auroc"),
        (F.col("_area") / F.col("_pos_n")).alias("aupr"),
    )


def routed_cases(edges: DataFrame, routes: DataFrame, scope: str, factor: str, truth_set: str) -> DataFrame:
    """(scope, factor, truth set) to be scored, with ``fallback``.

    ``routes`` (truth set, own): a truth set that belongs to a factor is held against that factor's edges alone. Where a scope has
    no edges of it, all its factors are scored, marked as a fallback; a truth set without a factor is held against all, unmarked.
    """
    known = cut(edges.select(scope, factor).distinct())
    asked = with_each(known.select(scope).distinct(), routes.select(truth_set, "own"))
    own = known.select(F.col(scope).alias("_scope"), F.col(factor).alias("_factor"))
    found = asked.join(own, (F.col(scope) == F.col("_scope")) & (F.col("own") == F.col("_factor")), "left").select(
        scope, truth_set, "own", F.col("_factor").isNotNull().alias("_has"))
    every = found.join(known, scope).where(~F.col("_has") | (F.col(factor) == F.col("own")))
    return every.select(scope, factor, truth_set, (F.col("own").isNotNull() & ~F.col("_has")).alias("fallback"))


def benchmark_factor_edges(
    edges: DataFrame, truth: DataFrame, routes: DataFrame, scope: str, factor: str, region: str, score: str, truth_set: str, names: Sequence[str],
) -> DataFrame:
    """``benchmark_edges`` per factor, each truth set against its own factor, and ``n_fallbacks``: how many (scope, truth set) pairs of
    the whole report had to take all factors instead; such rows are to be read with care."""
    cases = cut(routed_cases(edges, routes.where(F.col(truth_set).isin(list(names))), scope, factor, truth_set))
    rows = benchmark_edges(edges, truth, scope, region, score, truth_set, names, factor, cases)
    marked = rows.join(cases.withColumnRenamed(truth_set, "ground_truth"), [scope, factor, "ground_truth"])
    missed = cases.where("fallback").agg(F.count_distinct(F.struct(scope, truth_set)).alias("n_fallbacks"))
    return attach(marked, missed, []).withColumn("edge_type", F.concat(F.lit("TF_RE_binding["), F.col(factor), F.lit("]"))).drop(factor)


def pooled(truth: DataFrame, truth_set: str, names: Sequence[str], into: str = "hic_loops") -> DataFrame:
    """Truth intervals in which the named sets are one set: loops of several sources are one truth for region-gene edges."""
    return truth.withColumn(truth_set, F.when(F.col(truth_set).isin(list(names)), into).otherwise(F.col(truth_set)))
