"""Correlations, classification curves, standardisation and projections, one row per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgrid.operators.ordered import SLICE, attach, attach_stats, running
from shiftgrid.operators.ranks import paired_ranks, tie_totals, top_abs
from shiftgrid.session import cut


def finite(*cols: str) -> Column:
    """Neither NULL nor NaN nor infinite in any of the columns."""
    out = F.lit(True)
    for c in cols:
        v = F.col(c).cast("double")
        out = out & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return out


# ------------------------------------------------------------------------------------------- correlation expressions
def corr_expr(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate; NULL where a side is constant (the built-in raises there under ANSI)."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def weighted_corr_expr(a: Column, b: Column, w: Column) -> Column:
    """The same for rows that count ``w`` times; meant for centred values or ranks, where the sums keep their digits."""
    n, sa, sb = F.sum(w), F.sum(w * a), F.sum(w * b)
    saa, sbb, sab = F.sum(w * a * a), F.sum(w * b * b), F.sum(w * a * b)
    va, vb = n * saa - sa * sa, n * sbb - sb * sb
    tiny = F.lit(1e-12)
    varies = (va > tiny * n * saa) & (vb > tiny * n * sbb)
    return F.when(varies, F.try_divide(n * sab - sa * sb, F.sqrt(F.abs(va)) * F.sqrt(F.abs(vb))))


def pearson(df: DataFrame, a: str, b: str, by: Sequence[str] = (), out: str = "pearson") -> DataFrame:
    return df.where(finite(a, b)).groupBy(*by).agg(
        corr_expr(F.col(a), F.col(b)).alias(out), F.count(F.lit(1)).alias("n")
    )


def spearman(
    df: DataFrame, a: str, b: str, by: Sequence[str] = (), out: str = "rho", min_n: int = 0, also: dict[str, Column] | None = None
) -> DataFrame:
    """Pearson correlation of average-tie ranks over the rows where both sides are finite; NULL below ``min_n`` rows.

    The pairs are written first: they are read for the sizes of the groups and for the ranks. ``also`` names more aggregates, over the
    two values as ``_a`` and ``_b``.
    """
    both = cut(df.where(finite(a, b)).select(*by, F.col(a).alias("_a"), F.col(b).alias("_b")))
    ranked = paired_ranks(both, {"_ra": "_a", "_rb": "_b"}, by)
    found = ranked.groupBy(*by).agg(
        corr_expr(F.col("_ra"), F.col("_rb")).alias(out), F.count(F.lit(1)).alias("n"),
        *[c.alias(name) for name, c in (also or {}).items()],
    )
    return found.withColumn(out, F.when(F.col("n") >= F.lit(int(min_n)), F.col(out))) if min_n else found


# ------------------------------------------------------------------------------------------------- standardisation
def zscore(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "z") -> DataFrame:
    """Population z-score per group; a constant group gives zeros."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"))
    scaled = F.when(F.col("_sd") > 0, F.try_divide(F.col(value) - F.col("_mu"), F.col("_sd")))
    return attach_stats(df, stats, by).withColumn(
        out, F.when(F.col(value).isNotNull(), F.coalesce(scaled, F.lit(0.0)))
    ).drop("_mu", "_sd")


def zscore_many(df: DataFrame, values: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """``zscore`` for several columns with one aggregation and one join: ``values = {out: column}``."""
    stats = df.groupBy(*by).agg(
        *[F.avg(c).alias(f"_mu_{o}") for o, c in values.items()],
        *[F.stddev_pop(c).alias(f"_sd_{o}") for o, c in values.items()],
    )
    joined = attach_stats(df, stats, by)
    scaled = {
        o: F.when(
            F.col(c).isNotNull(),
            F.coalesce(
                F.when(F.col(f"_sd_{o}") > 0, F.try_divide(F.col(c) - F.col(f"_mu_{o}"), F.col(f"_sd_{o}"))),
                F.lit(0.0),
            ),
        )
        for o, c in values.items()
    }
    return joined.withColumns(scaled).drop(*[f"_mu_{o}" for o in values], *[f"_sd_{o}" for o in values])


def zscore_ref(
    df: DataFrame, reference: DataFrame, value: str, feature: Sequence[str], out: str = "z", eps: float = 1e-6
) -> DataFrame:
    """``(x - mean_ref) / (sd_ref + eps)`` with the reference's sample deviation; flat features give 0.

    A feature the reference does not hold has no spread there, so it counts as flat.
    """
    stats = reference.groupBy(*feature).agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"))
    return attach(df, stats, feature).select(*df.columns, zscore_of(F.col(value), eps).alias(out), flat_expr(eps).alias("is_flat"))


def zscore_of(value: Column, eps: float = 1e-6) -> Column:
    """z-score of a value beside the mean ``_mu`` and deviation ``_sd`` of its reference."""
    return F.when(F.col("_sd") > F.lit(eps), (value - F.col("_mu")) / (F.col("_sd") + F.lit(eps))).otherwise(F.lit(0.0))


def flat_expr(eps: float = 1e-6) -> Column:
    return ~F.coalesce(F.col("_sd") > F.lit(eps), F.lit(False))


# -------------------------------------------------------------------------------------------------------- agreement
def rel_rmse_expr(a: Column, b: Column) -> Column:
    return F.sqrt(F.avg((a - b) * (a - b)))


def agree_expr(pred: Column, real: Column) -> Column:
    """Share of equal signs among the rows whose prediction is not zero; NULL when there is none."""
    return F.avg(F.when(F.signum(pred) != 0, (F.signum(pred) == F.signum(real)).cast("double")))


def sign_concordance(
    df: DataFrame, pred: str, real: str, by: Sequence[str], key: str, k: int, out: str = "concordance"
) -> DataFrame:
    """Sign agreement among the k rows of largest measured magnitude."""
    top = top_abs(df, real, by, key, k)
    return top.groupBy(*by).agg(agree_expr(F.col(pred), F.col(real)).alias(out))


def pearson_centroid(df: DataFrame, pred: str, real: str, common: str, by: Sequence[str], out: str) -> DataFrame:
    """Correlation after the shared vector is taken off both sides."""
    known = df.where(finite(pred, real, common))
    return known.groupBy(*by).agg(
        corr_expr(F.col(pred) - F.col(common), F.col(real) - F.col(common)).alias(out)
    )


def loco_mean(vecs: DataFrame, value: str, contrast: str, dataset: str, gene: str, min_shared: int = 100) -> DataFrame:
    """Mean of the z-scored vectors of every other dataset, per contrast and gene.

    Each other vector is standardised on the genes it shares with the contrast, so the pair (contrast, other) is the
    unit; a gene meets at most as many vectors as there are contrasts.
    """
    own = vecs.select(F.col(contrast).alias("_c"), F.col(dataset).alias("_d"), F.col(gene).alias("_g"))
    other = vecs.where(finite(value)).select(
        F.col(contrast).alias("_oc"), F.col(dataset).alias("_od"), F.col(gene).alias("_og"), F.col(value).alias("_v")
    )
    shared = own.join(other, (F.col("_g") == F.col("_og")) & (F.col("_d") != F.col("_od")))
    stats = shared.groupBy("_c", "_oc").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("_mu"), F.stddev_pop("_v").alias("_sd")
    ).where(F.col("_n") > F.lit(int(min_shared)))
    joined = attach(shared, stats, ["_c", "_oc"], "inner")
    z = F.coalesce(F.when(F.col("_sd") > 0, F.try_divide(F.col("_v") - F.col("_mu"), F.col("_sd"))), F.lit(0.0))
    return joined.groupBy(F.col("_c").alias(contrast), F.col("_g").alias(gene)).agg(F.avg(z).alias("loco"))


# ------------------------------------------------------------------------------------------- ranking of binary labels
def roc_pr(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under ROC (ties count half) and under precision-recall (equal scores enter together), in one pass.

    Both need only the positives and negatives per distinct score in descending order, so no row is ranked.
    """
    known = df.where(finite(label, score))
    y = (F.col(label) == 1).cast("double")
    table = tie_totals(known, by, score, {"_p": y, "_all": F.lit(1.0)}, descending=True)
    size = table.groupBy(*by).agg(F.sum("_p").alias("_ptot"), F.sum("_all").alias("_atot"))
    t = attach_stats(table, size, by)
    negatives_below = F.col("_atot") - F.col("_ptot") - (F.col("cum__all") - F.col("cum__p"))
    negatives_here = F.col("_all") - F.col("_p")
    agg = t.groupBy(*by).agg(
        F.max("_atot").cast("bigint").alias("n"),
        F.max("_ptot").cast("bigint").alias("n_pos"),
        F.sum(F.col("_p") * (negatives_below + negatives_here * F.lit(0.5))).alias("_wins"),
        F.sum(F.col("_p") * F.col("cum__p") / F.col("cum__all")).alias("_area"),
    )
    single = (F.col("n_pos") == 0) | (F.col("n_pos") == F.col("n"))
    return agg.select(
        *by, "n", "n_pos",
        F.when(~single, F.try_divide(F.col("_wins"), F.col("n_pos") * (F.col("n") - F.col("n_pos")).cast("double")))
        .alias("auroc"),
        F.when(~single, F.try_divide(F.col("_area"), F.col("n_pos").cast("double"))).alias("aupr"),
    )


def hit_positions(df: DataFrame, label: str, score: str, by: Sequence[str], key: str, descending: bool = True):
    """Positives with their list position and hit number, and the group totals.

    The list order is score, then ``key`` (the positional metrics depend on the order of ties, so it must be named).
    """
    order = [f"-{score}" if descending else score, key]
    known = df.where(finite(score))
    y = F.coalesce((F.col(label) == 1).cast("bigint"), F.lit(0))
    placed = running(
        known, by, order, {"position": ("sum", F.lit(1).cast("bigint")), "hit": ("sum", y)}
    )
    totals = known.groupBy(*by).agg(F.sum(y).alias("n_pos"), F.count(F.lit(1)).alias("n_ranked"))
    return placed.where(y == 1).drop(SLICE), totals


def average_precision(df: DataFrame, label: str, score: str, by: Sequence[str], key: str) -> DataFrame:
    hits, totals = hit_positions(df, label, score, by, key)
    ap = hits.groupBy(*by).agg(F.avg(F.col("hit") / F.col("position")).alias("ap"))
    return attach(totals, ap, by)


def positional_metrics(
    df: DataFrame, label: str, score: str, by: Sequence[str], key: str, ks: Sequence[int]
) -> DataFrame:
    """Average precision, nDCG@k and Recall@k of one ordered list per group; NULL without positives."""
    hits, totals = hit_positions(df, label, score, by, key)
    return metrics_of_hits(hits, totals, by, ks)


def metrics_of_hits(hits: DataFrame, totals: DataFrame, by: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """The positional metrics of positives with position and hit number."""
    gain = F.lit(1.0) / F.log2(F.col("position") + F.lit(1.0))
    aggs = [F.avg(F.col("hit") / F.col("position")).alias("ap")]
    for k in ks:
        within = F.col("position") <= int(k)
        aggs.append(F.sum(F.when(within, gain).otherwise(0.0)).alias(f"_dcg_{k}"))
        aggs.append(F.sum(within.cast("double")).alias(f"_in_{k}"))
        ideal = F.when(F.col("hit") <= int(k), F.lit(1.0) / F.log2(F.col("hit") + F.lit(1.0))).otherwise(0.0)
        aggs.append(F.sum(ideal).alias(f"_ideal_{k}"))
    found = attach(totals, hits.groupBy(*by).agg(*aggs), by)
    return found.select(
        *by, "n_ranked", "n_pos", "ap",
        *[F.try_divide(F.col(f"_dcg_{k}"), F.col(f"_ideal_{k}")).alias(f"ndcg_at_{k}") for k in ks],
        *[F.try_divide(F.col(f"_in_{k}"), F.col("n_pos").cast("double")).alias(f"recall_at_{k}") for k in ks],
    )


def recall_curve(df: DataFrame, label: str, score: str, by: Sequence[str], key: str, kmax: int = 200) -> DataFrame:
    """Recall at every K up to ``kmax`` (or the list length)."""
    hits, totals = hit_positions(df, label, score, by, key)
    return curve_of(hits, totals, by, kmax).drop("hits")


def curve_of(hits: DataFrame, totals: DataFrame, by: Sequence[str], kmax: int) -> DataFrame:
    """Spread hit positions over the grid of K; only positions up to ``kmax`` take part, so a group has few rows."""
    early = hits.where(F.col("position") <= int(kmax)).groupBy(*by).agg(
        F.array_sort(F.collect_list("position")).alias("_at")
    )
    grid = attach(totals.where(F.col("n_pos") > 0), early, by).select(
        "*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(int(kmax)).cast("bigint"), F.col("n_ranked"))))
        .alias("k")
    )
    found = F.size(F.filter(F.coalesce(F.col("_at"), F.array().cast("array<bigint>")), lambda x: x <= F.col("k")))
    return grid.select(*by, "k", found.cast("bigint").alias("hits"), (found / F.col("n_pos")).alias("recall"), "n_pos", "n_ranked")


# ---------------------------------------------------------------------------------------------------------- geometry
def project(
    pairs: DataFrame, shift: str, vector: str, by: Sequence[str] = (), exclude: dict[str, Column] | None = None
) -> DataFrame:
    """Projection of a shift on the unit vector, cosine, norm and number of shared finite items.

    ``exclude = {suffix: condition}`` adds projections without some items; these leave both sides, so the vector is
    normalised again. NULL below two shared items or for a zero vector. All in one aggregation; ``shift_l2`` is the norm
    over every finite shift, also of items that the vector does not hold.
    """
    usable = finite(shift, vector)
    cases = {"": usable, **{suffix: usable & ~cond for suffix, cond in (exclude or {}).items()}}
    aggs = [F.sqrt(F.sum(F.when(finite(shift), F.col(shift) * F.col(shift)))).alias("shift_l2")]
    for suffix, ok in cases.items():
        # rows stay in the group even when none of them is usable, so that the group is reported
        s, a = F.when(ok, F.col(shift)), F.when(ok, F.col(vector))
        aggs += [
            F.sum(s * a).alias(f"_sa{suffix}"), F.sum(a * a).alias(f"_aa{suffix}"), F.sum(s * s).alias(f"_ss{suffix}"),
            F.count(s).alias(f"n_common{suffix}"),
        ]
    return projected(pairs.groupBy(*by).agg(*aggs), by, list(cases))


def projected(sums: DataFrame, by: Sequence[str], suffixes: Sequence[str]) -> DataFrame:
    """The columns of ``project`` from its sums: ``shift_l2``, and ``_sa``, ``_aa``, ``_ss``, ``n_common`` of each suffix."""
    out = [*by, "shift_l2"]
    for suffix in suffixes:
        enough = (F.col(f"n_common{suffix}") >= 2) & (F.col(f"_aa{suffix}") > 0)
        proj = F.when(enough, F.try_divide(F.col(f"_sa{suffix}"), F.sqrt(f"_aa{suffix}")))
        out += [
            proj.alias(f"projection{suffix}"), F.try_divide(proj, F.sqrt(f"_ss{suffix}")).alias(f"cosine{suffix}"),
            F.sqrt(f"_ss{suffix}").alias(f"shift_norm{suffix}"), f"n_common{suffix}",
        ]
    return sums.select(*out)


def norm_share(vec: DataFrame, value: str, listed: Column, by: Sequence[str] = (), out: str = "share") -> DataFrame:
    """Share of the squared norm that the listed items hold."""
    sq = F.col(value) * F.col(value)
    return vec.where(finite(value)).groupBy(*by).agg(
        F.try_divide(F.sum(F.when(listed, sq).otherwise(0.0)), F.sum(sq)).alias(out)
    )


def sign_accuracy(df: DataFrame, score: str, expected: str, by: Sequence[str] = ()) -> DataFrame:
    """Agreement with the expected sign (+1 / -1), its Wilson interval and the rate of the majority class."""
    from shiftgrid.functions.scalars import wilson

    d = df.where(finite(score, expected) & (F.col(expected) != 0))
    t = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_signed"),
        F.sum((F.signum(score) == F.col(expected)).cast("bigint")).alias("n_correct"),
        F.greatest(F.avg((F.col(expected) == 1).cast("double")), F.avg((F.col(expected) == -1).cast("double")))
        .alias("majority_class_rate"),
    )
    lo, hi = wilson(F.col("n_correct"), F.col("n_signed"))
    return t.select(
        *by, "n_signed", "n_correct", F.try_divide("n_correct", "n_signed").alias("sign_accuracy"),
        lo.alias("ci_lo"), hi.alias("ci_hi"), "majority_class_rate",
    )


def interaction(arms: DataFrame, value: str, gene: str, arm: str, single_1: str, single_2: str, double: str,
                out: str = "residual") -> DataFrame:
    """``double - (single_1 + single_2)`` on the genes measured in all three arms."""
    wide = arms.where(F.col(arm).isin(single_1, single_2, double)).groupBy(gene).agg(
        *[F.max(F.when(F.col(arm) == a, F.col(value))).alias(n) for n, a in
          (("_s1", single_1), ("_s2", single_2), ("_d", double))]
    )
    return wide.where(finite("_s1", "_s2", "_d")).select(
        gene, (F.col("_d") - (F.col("_s1") + F.col("_s2"))).alias(out), (F.col("_s1") + F.col("_s2")).alias("additive")
    )


def consistency(a: DataFrame, b: DataFrame, key: Sequence[str], value: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation, sign agreement and ratio of two score tables on their shared keys, for each group ``by`` of ``a``."""
    pairs = a.select(*by, *key, F.col(value).alias("_x")).join(b.select(*key, F.col(value).alias("_y")), list(key))
    rho = spearman(pairs, "_x", "_y", by)
    both = finite("_x", "_y")
    ratio = F.when(both & (F.col("_y") != 0), F.try_divide(F.col("_x"), F.col("_y")))
    other = pairs.groupBy(*by).agg(
        F.avg(F.when(both, (F.signum("_x") == F.signum("_y")).cast("double"))).alias("sign_agrees"),
        F.avg(ratio).alias("mean_ratio"),
        F.sqrt(F.sum(F.when(both, F.col("_x") * F.col("_x")))).alias("norm_a"),
        F.sqrt(F.sum(F.when(both, F.col("_y") * F.col("_y")))).alias("norm_b"),
    )
    return attach(rho, other, by)


def pairwise_spearman(
    vecs: DataFrame, scope: str, item: str, value: str, min_shared: int = 10
) -> DataFrame:
    """Correlation of every pair of scopes on their shared finite items (each unordered pair once).

    The pair list is the result itself; one item meets as many rows as there are scopes.
    """
    left = vecs.where(finite(value)).select(F.col(scope).alias("scope_a"), F.col(item).alias("_i"), F.col(value).alias("_x"))
    right = vecs.where(finite(value)).select(F.col(scope).alias("scope_b"), F.col(item).alias("_k"), F.col(value).alias("_y"))
    pairs = left.join(right, (F.col("_i") == F.col("_k")) & (F.col("scope_a") < F.col("scope_b")))
    return spearman(pairs, "_x", "_y", ["scope_a", "scope_b"], min_n=min_shared).where(F.col("rho").isNotNull())


def scope_structure(vecs: DataFrame, scope: str, item: str, value: str, reference: str, min_shared: int = 10) -> DataFrame:
    """Per scope: median correlation with the other scopes, correlation with the reference scope, median magnitude."""
    from shiftgrid.operators.ranks import percentiles

    pairs = pairwise_spearman(vecs, scope, item, value, min_shared)
    both_ways = pairs.select(F.col("scope_a").alias(scope), F.col("scope_b").alias("_o"), "rho").unionByName(
        pairs.select(F.col("scope_b").alias(scope), F.col("scope_a").alias("_o"), "rho")
    )
    middle = both_ways.groupBy(scope).agg(
        F.percentile(F.when(F.col("_o") != reference, F.col("rho")), F.lit(0.5)).alias("structure_rho"),
        F.max(F.when(F.col("_o") == reference, F.col("rho"))).alias("reference_rho"),
    )
    sized = vecs.withColumn("_abs", F.abs(value))
    scale = percentiles(sized, "_abs", [scope], {"vector_scale": 0.5})
    return attach(scale, middle, [scope])
