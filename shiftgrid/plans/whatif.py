"""What-if inputs (knock-out, over-expression), the linear response to them, variants and eligibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrid.operators.filters import require_empty
from shiftgrid.operators.ordered import attach, attach_stats, with_each
from shiftgrid.operators.ranks import percentiles
from shiftgrid.operators.stats import flat_expr, zscore_of, zscore_ref
from shiftgrid.session import cut, tasks_for

BASELINE = "__baseline_mean__"


def make_variants(tfs: DataFrame, modes: Sequence[str] = ("ko", "oe"), tf: str = "tf") -> DataFrame:
    """One variant per factor and mode, named ``mode__tf``."""
    each = tfs.select(F.col(tf).cast("string").alias("tf")).distinct().select(
        "tf", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode")
    )
    return each.select(F.concat_ws("__", "mode", "tf").alias("variant"), "mode", F.array("tf").alias("tfs"))


def check_variants(variants: DataFrame, expr: DataFrame, feature: str) -> None:
    """Unknown modes, empty or unknown factor lists and repeated or reserved ids stop the run."""
    require_empty(variants.where(~F.col("mode").isin("ko", "oe")).select("variant"), "mode must be ko or oe")
    require_empty(variants.where(F.size("tfs") <= 0).select("variant"), "empty factor list")
    require_empty(variants.where(F.col("variant") == BASELINE).select("variant"), "reserved variant id")
    repeated = variants.groupBy("variant").count().where(F.col("count") > 1).select("variant")
    require_empty(repeated, "duplicate variant ids")
    known = expr.select(F.col(feature).alias("_f")).distinct()
    named = variants.select("variant", F.explode("tfs").alias("_f"))
    require_empty(named.join(known, "_f", "left_anti").select("variant", "_f"), "factors without an expression row")


def whatif_inputs(
    expr: DataFrame, reference: DataFrame, variants: DataFrame, feature: str, sample: str, value: str, q: float = 0.99,
    eps: float = 1e-6, by: Sequence[str] = (),
) -> DataFrame:
    """Changed input rows only: (by, variant, mode, feature, sample, old, new, z_shift, is_flat).

    ``by`` are columns of ``expr`` that keep several data sets apart, such as its scope; all are set against one reference. Knock-out sets 0; over-expression raises to at least the factor's reference quantile. Rows a variant leaves alone equal
    the baseline, so they are never copied per variant. ``z_shift`` is the change in reference z-score units.

    What the reference says of a feature joins its variants first, so the rows of ``expr`` are shuffled once. They are counted
    before: ``expr`` and ``reference`` are best tables or ``cut``.
    """
    cap = percentiles(reference, value, [feature], {"_cap": q})
    stats = reference.groupBy(feature).agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"))
    each = variants.select("variant", "mode", F.explode("tfs").alias(feature))
    named = attach(attach(each, stats, [feature]), cap, [feature])
    tasks = tasks_for(expr.sparkSession, expr.count())
    own = expr.select(*by, feature, sample, F.col(value).alias("old")).repartition(tasks, feature)
    new = F.when(F.col("mode") == "ko", F.lit(0.0)).otherwise(F.greatest("old", "_cap"))
    rows = named.repartition(tasks, feature).join(own, feature).withColumn("new", new)
    z_shift = zscore_of(F.col("new"), eps) - zscore_of(F.col("old"), eps)
    return rows.select(
        *by, "variant", "mode", feature, sample, "old", "new", z_shift.alias("z_shift"), flat_expr(eps).alias("is_flat")
    )


def input_sums(inputs: DataFrame, feature: str, by: Sequence[str] = ()) -> DataFrame:
    """All that response and status take from the changed rows, a row for each (by, variant, feature): written once, read by both.

    Rows that are summed already pass as they are.
    """
    if "_dz" in inputs.columns:
        return inputs
    return cut(inputs.groupBy(*by, "variant", "mode", feature).agg(
        F.sum("z_shift").alias("_dz"), F.sum((F.col("new") != F.col("old")).cast("bigint")).alias("_changed"),
        F.min(F.col("is_flat").cast("int")).alias("_flat"),
    ))


def whatif_response(
    inputs: DataFrame, weights: DataFrame, n_samples: DataFrame, feature: str, sample: str, target: str = "target",
    weight: str = "weight", by: Sequence[str] = (),
) -> DataFrame:
    """Mean shift of every target gene against the baseline under a linear response.

    response(gene, sample) = sum over features of weight x z-scored input, the gene's own feature left out. The response is
    linear, so the shift needs the changed rows only; ``n_samples`` holds the column ``n_samples``, one row
    for each group ``by``. ``inputs`` may be summed (``input_sums``).

    A variant of one feature has its result where the feature meets its weights: only variants of several features are shuffled
    again and added up.
    """
    key = [*by, "variant"]
    sums = input_sums(inputs, feature, by).select(*key, feature, "_dz")
    w = cut(weights.where(F.col(feature) != F.col(target)).groupBy(feature, target).agg(F.sum(weight).alias("_w")))
    several = cut(sums.groupBy(*key).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > 1).select(*key))
    change = attach_stats(sums, n_samples, by)
    tasks = tasks_for(sums.sparkSession, sums.count() + w.count())
    there = w.repartition(tasks, feature)

    def terms(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, feature).join(there, feature).select(
            *key, target, (F.col("_dz") * F.col("_w")).alias("_s"), "n_samples")

    added = terms(attach(change, several, key, "left_semi")).groupBy(*key, target).agg(
        F.sum("_s").alias("_s"), F.max("n_samples").alias("n_samples"))
    return terms(attach(change, several, key, "left_anti")).unionByName(added).select(
        *key, F.col(target).alias("gene"), F.try_divide("_s", "n_samples").alias("shift")
    )


def baseline_response(
    expr: DataFrame, reference: DataFrame, weights: DataFrame, feature: str, sample: str, value: str,
    target: str = "target", weight: str = "weight", by: Sequence[str] = (),
) -> DataFrame:
    """Mean baseline response per target gene and group ``by`` of ``expr``."""
    z = zscore_ref(expr, reference, value, [feature], "_z")
    n = expr.groupBy(*by).agg(F.countDistinct(sample).alias("_n"))
    zsum = z.groupBy(*by, feature).agg(F.sum("_z").alias("_zs"))
    w = weights.where(F.col(feature) != F.col(target))
    total = w.join(zsum, feature).groupBy(*by, F.col(target).alias("gene")).agg(
        F.sum(F.col("_zs") * F.col(weight)).alias("_s")
    )
    return attach(total, n, by).select(*by, "gene", F.try_divide("_s", "_n").alias("baseline"))


def whatif_status(inputs: DataFrame, response: DataFrame, noop_below: float = 1e-6, by: Sequence[str] = ()) -> DataFrame:
    """Per variant: changed samples, shift norm, largest shift, no-op flag. An exact no-op counts with zero shift.

    Raises where a shift is undefined. The response is evaluated once; ``inputs`` that feed it as well are best summed before
    (``input_sums``).
    """
    summed = "_dz" in inputs.columns
    moved = F.col("_changed") if summed else (F.col("new") != F.col("old")).cast("bigint")
    changed = inputs.groupBy(*by, "variant").agg(
        F.first("mode").alias("mode"), F.sum(moved).alias("n_samples_changed"),
        F.min(F.col("_flat" if summed else "is_flat").cast("int")).alias("_all_flat"),
    )
    exact = (F.col("n_samples_changed") == 0) | (F.col("_all_flat") == 1)
    size = cut(response.groupBy(*by, "variant").agg(
        F.sqrt(F.sum(F.col("shift") * F.col("shift"))).alias("_l2"), F.max(F.abs("shift")).alias("_max"),
        F.count(F.when(F.col("shift").isNull(), 1)).alias("_undefined"),
    ))
    require_empty(size.where(F.col("_undefined") > 0).select(*by, "variant"), "undefined response")
    j = attach(changed, size, [*by, "variant"])
    l2 = F.when(exact, F.lit(0.0)).otherwise(F.coalesce("_l2", F.lit(0.0)))
    top = F.when(exact, F.lit(0.0)).otherwise(F.coalesce("_max", F.lit(0.0)))
    return j.select(
        *by, "variant", "mode", "n_samples_changed", l2.alias("shift_l2"), top.alias("shift_max_abs"),
        (exact | (top < F.lit(noop_below))).alias("noop"),
    )


def gene_match(genes: DataFrame, index: DataFrame, gene: str, tf: str) -> DataFrame:
    """Exact match, match in another case, or not found."""
    exact = index.select(F.col(tf).alias(gene)).distinct().withColumn("_exact", F.lit(True))
    folded = index.groupBy(F.lower(tf).alias("_low")).agg(F.array_join(F.array_sort(F.collect_set(tf)), "; ").alias("_m"))
    j = attach(attach(genes.withColumn("_low", F.lower(gene)), exact, [gene]), folded, ["_low"])
    hit = F.coalesce("_exact", F.lit(False))
    return j.select(
        *genes.columns,
        F.when(hit, "ELIGIBLE").when(F.col("_m").isNotNull(), "CASING_MISMATCH_CHECK_MANUALLY")
        .otherwise("NOT_FOUND_NOT_ELIGIBLE").alias("verdict"),
        F.coalesce("_m", F.lit("")).alias("case_insensitive_matches"),
    )


def eligibility(
    genes: DataFrame, expr: DataFrame, edges: DataFrame, reference: DataFrame, gene: str, sample: str, value: str,
    n_samples: DataFrame, min_mean: float = 0.0, q: float = 0.99,
) -> DataFrame:
    """Per gene and scope: expression, network membership, whether a knock-out can do anything, over-expression cap.

    ``n_samples``: scope, n_samples (absent entries of the long table are zeros).
    """
    stats = expr.groupBy("scope", gene).agg(
        F.sum(value).alias("_s"), F.sum((F.col(value) > 0).cast("bigint")).alias("_pos")
    )
    net = edges.groupBy("scope", F.col("tf").alias(gene)).agg(F.sum(F.abs("weight")).alias("_w"))
    cap = percentiles(reference, value, [gene], {"oe_cap": q})
    grid = with_each(genes.select(gene).distinct(), n_samples)
    j = attach(attach(attach(grid, stats, ["scope", gene]), net, ["scope", gene]), cap, [gene])
    mean, frac = F.col("_s") / F.col("n_samples"), F.col("_pos") / F.col("n_samples")
    in_net = F.coalesce(F.col("_w"), F.lit(0.0)) > 0
    return j.select(
        gene, "scope", in_net.alias("in_network"), mean.alias("mean_expr"), frac.alias("frac_samples_expressed"),
        (in_net & F.coalesce(mean > F.lit(min_mean), F.lit(False))).alias("expressed_in_scope"),
        (~in_net | ~F.coalesce(frac > 0, F.lit(False))).alias("ko_noop_expected"), "oe_cap",
        (in_net & F.coalesce(F.col("oe_cap") > 0, F.lit(False))).alias("oe_possible"),
    )
