"""Group profiles, collapses, cross-tabulations, funnels and consensus rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgrid.operators.filters import GuardError
from shiftgrid.operators.ordered import attach, attach_stats, grid, numbered
from shiftgrid.operators.ranks import average_rank, percent_of_rank
from shiftgrid.session import cut


def pseudobulk(counts: DataFrame, sample: Sequence[str], feature: str, value: str = "count") -> DataFrame:
    """All cells of a sample summed per feature."""
    return counts.groupBy(*sample, feature).agg(F.sum(value).alias(value))


def sum_duplicates(df: DataFrame, symbol: str, cell: Sequence[str], value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Rows with one symbol summed per cell, and how many surplus rows each symbol had."""
    summed = df.groupBy(symbol, *cell).agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("_n"))
    surplus = summed.groupBy(symbol).agg(F.max(F.col("_n") - 1).alias("n_duplicates"))
    return summed.drop("_n"), surplus


def make_unique(names: DataFrame, name: str, position: Sequence[str], by: Sequence[str] = (), out: str = "unique_name"):
    """First occurrence keeps its name, later ones get ``-1``, ``-2``, ... in order of position."""
    placed = numbered(names, [*by, name], position, "_k")
    suffix = F.when(F.col("_k") == 1, F.lit("")).otherwise(F.concat(F.lit("-"), (F.col("_k") - 1).cast("string")))
    return placed.withColumn(out, F.concat(F.col(name).cast("string"), suffix)).drop("_k")


def marker_means(
    expr: DataFrame, cells: DataFrame, markers: DataFrame, cell: Sequence[str], cluster: str, gene: str, value: str
) -> DataFrame:
    """Mean of each marker over all cells of a cluster; zeros count, absent markers are reported as such."""
    sizes = cells.groupBy(cluster).agg(F.countDistinct(*cell).alias("n_cells"))
    wanted = expr.join(markers.select(gene).distinct(), gene, "left_semi").join(cells, list(cell))
    sums = wanted.groupBy(cluster, gene).agg(F.sum(value).alias("_s"))
    present = expr.select(gene).distinct().join(markers.select(gene), gene, "left_semi")
    # clusters x markers is the size of the report itself; every present marker is reported for every cluster
    means = attach(grid(present, sizes), sums, [cluster, gene]).select(
        cluster, gene, (F.coalesce("_s", F.lit(0.0)) / F.col("n_cells")).alias("mean_expr"), F.lit(True).alias("present")
    )
    absent = markers.select(gene).distinct().join(present, gene, "left_anti").select(
        F.lit(None).cast(means.schema[cluster].dataType).alias(cluster), gene,
        F.lit(None).cast("double").alias("mean_expr"), F.lit(False).alias("present"),
    )
    return means.unionByName(absent)


def mean_profile(expr: DataFrame, by: Sequence[str], gene: str, sample: Sequence[str], value: str) -> DataFrame:
    """Mean over all samples of a group per gene; a sample without the gene counts as zero."""
    n = expr.groupBy(*by).agg(F.countDistinct(*sample).alias("n_samples"))
    sums = expr.groupBy(*by, gene).agg(F.sum(value).alias("_s"))
    return attach_stats(sums, n, by).select(*by, gene, (F.col("_s") / F.col("n_samples")).alias("mean"), "n_samples")


def crosstab(cells: DataFrame, rows: str, column: str, values: Sequence) -> DataFrame:
    """Counts of rows x column values, zero-filled. The values are given, so no extra job looks them up."""
    return cells.groupBy(rows).pivot(column, list(values)).count().na.fill(0)


def centrality(edges: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Column sum per factor and its average-tie rank divided by the number of factors."""
    sums = edges.groupBy(*scope, "tf").agg(F.sum("weight").alias("colsum"))
    return percent_of_rank(sums, "colsum", scope, "centrality")


def resolve_conflicts(df: DataFrame, key: Sequence[str], sign: str, texts: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Keys with one sign, their distinct texts sorted and joined by ``;`` - and the conflicting keys."""
    agg = df.groupBy(*key).agg(
        F.min(sign).alias("_lo"), F.max(sign).alias("_hi"),
        *[
            F.array_join(F.array_sort(F.collect_set(F.when(F.col(t) != "", F.col(t)))), ";").alias(t)
            for t in texts
        ],
    )
    kept = agg.where(F.col("_lo") == F.col("_hi")).select(*key, F.col("_lo").alias(sign), *texts)
    return kept, agg.where(F.col("_lo") != F.col("_hi")).select(*key)


def funnel(labels: DataFrame, label: str, stages: dict[str, DataFrame | None]) -> DataFrame:
    """Per label: rows, one flag per stage (NULL = the stage was not run), and the last stage reached."""
    trimmed = labels.withColumn(label, F.trim(label)).where(F.col(label) != "")
    out = trimmed.groupBy(label).agg(F.count(F.lit(1)).alias("n_clusters"))
    last = F.lit("labelled")
    for name, reached in stages.items():
        if reached is None:
            out = out.withColumn(name, F.lit(None).cast("boolean"))
        else:
            seen = reached.select(F.col(label)).distinct().withColumn(name, F.lit(True))
            out = attach(out, seen, [label]).withColumn(name, F.coalesce(F.col(name), F.lit(False)))
        last = F.when(F.coalesce(F.col(name), F.lit(False)), F.lit(name)).otherwise(last)
    return out.withColumn("last_stage", last)


def funnel_summary(funnel_rows: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Rows (stage, n); a stage that was not run has NULL, which the text sink writes as NA."""
    agg = funnel_rows.agg(
        F.sum("n_clusters").alias("clusters_annotated"), F.count(F.lit(1)).alias("labelled"),
        *[F.sum(F.col(s).cast("bigint")).alias(s) for s in stages],
    )
    names = ["clusters_annotated", "labelled", *stages]
    return agg.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("n")) for s in names])).alias("x")) \
        .select("x.stage", "x.n")


def coverage_summary(units: DataFrame, dims: str, cls: str, status: str, verdict: Column, dimensions: Sequence[str],
                     classes: Sequence[str]) -> DataFrame:
    """Counts per (dimension, class), and the tally ``verdict=n`` of the scored units, most frequent first."""
    d = units.select(
        F.explode(F.split(F.col(dims), ",")).alias("dimension"), F.col(cls).alias("class"), F.col(status).alias("_s"),
        verdict.alias("_v"),
    ).where(F.col("dimension").isin(*dimensions) & F.col("class").isin(*classes))
    scored = F.startswith(F.col("_s"), F.lit("scored"))
    cases = [F.struct(F.lit(x).alias("dimension"), F.lit(c).alias("class")) for x in dimensions for c in classes]
    grid = units.sparkSession.range(1).select(F.explode(F.array(*cases)).alias("x")).select("x.dimension", "x.class")
    counts = d.groupBy("dimension", "class").agg(
        F.count(F.lit(1)).alias("n_units"), F.sum(scored.cast("bigint")).alias("n_scored"),
        F.sum((F.col("_s") == "tf_not_in_network").cast("bigint")).alias("n_tf_not_in_network"),
        F.sum((F.col("_s") == "not_a_tf").cast("bigint")).alias("n_not_a_tf"),
        F.sum(F.col("_s").isin("not_run_array", "epsilon_exploratory").cast("bigint")).alias("n_other_na"),
    )
    tallies = d.where(scored).groupBy("dimension", "class", "_v").agg(F.count(F.lit(1)).alias("_n"))
    folded = tallies.groupBy("dimension", "class").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("m"), F.col("_v").alias("v")))),
                lambda s: F.concat(s["v"], F.lit("="), (-s["m"]).cast("string")),
            ), ";",
        ).alias("verdicts_of_scored")
    )
    out = attach(attach(grid, counts, ["dimension", "class"]), folded, ["dimension", "class"])
    return out.na.fill(0, ["n_units", "n_scored", "n_tf_not_in_network", "n_not_a_tf", "n_other_na"]).na.fill(
        "", ["verdicts_of_scored"]
    )


def consensus(report: DataFrame, key: str, reference: str, screen_ranks: DataFrame | None = None) -> DataFrame:
    """One row per key over its headline scopes: medians, majority sign, agreement, with the reference scope beside.

    ``report``: scope, key, tfs, status, score, score_excl, rank_in_scope, rank_pct, headline, control_verdict,
    control_difference, gate_verdict. A key has at most one row per scope, so its medians and scope list are small.
    """
    head = F.col("headline")
    sign = F.signum("score")
    pos, neg = F.sum((head & (sign > 0)).cast("bigint")), F.sum((head & (sign < 0)).cast("bigint"))

    def middle(c: str) -> Column:
        return F.percentile(F.when(head, F.col(c)), F.lit(0.5))

    is_ref = F.col("scope") == reference
    out = report.groupBy(key).agg(
        F.min_by(F.when(head, F.col("tfs")), F.when(head, F.col("scope"))).alias("tfs"),
        F.sum(head.cast("bigint")).alias("n_headline_scopes"),
        F.array_join(F.array_sort(F.collect_list(F.when(head, F.col("scope")))), ",").alias("headline_scopes"),
        middle("rank_in_scope").alias("median_rank"), middle("score").alias("median_score"),
        middle("score_excl").alias("median_score_excl"),
        F.when(pos > neg, 1).when(neg > pos, -1).otherwise(0).alias("majority_sign"),
        F.try_divide(F.greatest(pos, neg), F.sum(head.cast("bigint"))).alias("sign_agreement"),
        F.sum((F.col("status") == "ok").cast("bigint")).alias("n_ok_scopes"),
        F.max(F.when(is_ref, F.col("score"))).alias("reference_score"),
        F.max(F.when(is_ref, F.col("rank_in_scope"))).alias("reference_rank"),
        F.max(F.when(is_ref, F.col("gate_verdict"))).alias("reference_gate_verdict"),
        middle("rank_pct").alias("median_rank_pct"),
        F.sum((head & (F.col("control_verdict") == "PASS")).cast("bigint")).alias("n_control_pass"),
        middle("control_difference").alias("median_control_difference"),
    ).where(F.col("n_headline_scopes") > 0)
    if screen_ranks is None:
        return out
    # only a single-factor key has a place among the screened factors
    single = screen_ranks.select(F.col("tf").alias("tfs"), "screen_rank", "screen_n")
    return attach(out, single, ["tfs"])


def check_difference(report: DataFrame, scope: str, check: str, value: str, order: Sequence[str], a: str, b: str) -> DataFrame:
    """First value of check ``a`` minus first value of check ``b`` per scope; an absent check is an error."""
    seen = {r[0] for r in report.where(F.col(check).isin(a, b)).select(check).distinct().limit(2).collect()}
    if seen != {a, b}:
        raise GuardError(f"check(s) {sorted({a, b} - seen)} not found in the report")
    first = report.where(F.col(check).isin(a, b) & F.col(value).isNotNull()).groupBy(scope, check).agg(
        F.min_by(F.col(value), F.struct(*order)).alias("_v")
    )
    return first.groupBy(scope).agg(
        (F.max(F.when(F.col(check) == a, F.col("_v"))) - F.max(F.when(F.col(check) == b, F.col("_v")))).alias("difference")
    )


def sanity(
    predicted: DataFrame, measured: DataFrame, scope: Sequence[str], gene: str, sample: str, value: str,
    min_median: float = 0.5, min_frac: float = 0.7, floor: float = 0.3,
) -> DataFrame:
    """Median over genes of the correlation across samples, share above ``floor``, number of samples, gate."""
    from shiftgrid.operators.ranks import percentiles
    from shiftgrid.operators.stats import spearman

    key = [*scope, gene, sample]
    pairs = predicted.select(*key, F.col(value).alias("_p")).join(measured.select(*key, F.col(value).alias("_m")), key)
    # read by the percentile, several times, and by the shares
    rho = cut(spearman(pairs, "_p", "_m", [*scope, gene]).where(F.col("rho").isNotNull()))
    middle = percentiles(rho, "rho", scope, {"sanity_rho": 0.5})
    rest = rho.groupBy(*scope).agg(
        F.avg((F.col("rho") > F.lit(floor)).cast("double")).alias("sanity_frac"), F.count(F.lit(1)).alias("n_genes")
    )
    n = predicted.groupBy(*scope).agg(F.countDistinct(sample).alias("sanity_n_samples"))
    out = attach(attach(middle, rest, scope), n, scope)
    return out.withColumn(
        "sanity_pass", (F.col("sanity_rho") >= F.lit(min_median)) & (F.col("sanity_frac") >= F.lit(min_frac))
    )


def sample_report(
    rna_cells: DataFrame, atac_cells: DataFrame, before: DataFrame, features: DataFrame, doublets: DataFrame,
    expected_features: int, expected_rate: float = 0.06, multiplier: float = 2.0,
) -> DataFrame:
    """Per sample: match of the two cell lists (with order), feature count, retention and doublet flag.

    Cell tables: sample_id, cell_id, position. Equal sets in equal order differ nowhere on (position, cell).
    """
    r = rna_cells.select("sample_id", "cell_id", F.col("position").alias("_rp"))
    a = atac_cells.select("sample_id", "cell_id", F.col("position").alias("_ap"))
    match = r.join(a, ["sample_id", "cell_id"], "full_outer").groupBy("sample_id").agg(
        F.sum(F.col("_rp").isNotNull().cast("bigint")).alias("n_obs_rna"),
        F.sum(F.col("_ap").isNotNull().cast("bigint")).alias("n_obs_atac"),
        F.sum((F.col("_rp").isNull() | F.col("_ap").isNull()).cast("bigint")).alias("_single"),
        F.sum(F.coalesce((F.col("_rp") != F.col("_ap")).cast("bigint"), F.lit(0))).alias("_moved"),
    )
    status = F.when(F.col("_single") > 0, "MISMATCH").when(F.col("_moved") > 0, "SAME_SET_DIFF_ORDER").otherwise("OK")
    n_feat = features.groupBy("sample_id").agg(F.countDistinct("feature_id").alias("n_features"))
    n_before = before.groupBy("sample_id").agg(F.countDistinct("cell_id").alias("n_before"))
    out = attach(attach(attach(match, n_feat, ["sample_id"]), n_before, ["sample_id"]), doublets, ["sample_id"])
    return out.select(
        "sample_id", status.alias("barcodes_match"), "n_obs_rna", "n_obs_atac", "n_features",
        (F.coalesce("n_features", F.lit(0)) == int(expected_features)).alias("n_features_ok"),
        F.round(F.try_divide(F.col("n_obs_atac") * F.lit(100.0), F.col("n_before")), 2).alias("pct_retained"),
        F.round("doublet_rate", 4).alias("doublet_rate"),
        (F.col("doublet_rate") > F.lit(multiplier * expected_rate)).alias("doublet_flag"),
    )


def labels_with_support(clusters: DataFrame, label: str, n_cells: str, n: int = 100) -> DataFrame:
    """Cells per label over all of its clusters, labels with at least n cells."""
    named = clusters.where(F.trim(label) != "")
    return named.groupBy(label).agg(F.sum(n_cells).alias("n_cells")).where(F.col("n_cells") >= int(n))


def rank_genes(expr: DataFrame, cells: DataFrame, cell: Sequence[str], group: str, gene: str, value: str, k: int = 15):
    """Rank-sum test of every group against the rest on non-zero entries; zeros are one tie block.

    With z zeros in a gene the zeros share rank (z + 1) / 2 and a non-zero entry ranks z above its rank among the
    non-zero ones, so the zeros never have to be written out. Scores use the normal approximation without tie correction.
    """
    from shiftgrid.operators.ranks import top_rows

    total = cells.agg(F.count(F.lit(1)).alias("_N"))
    sizes = attach(cells.groupBy(group).agg(F.count(F.lit(1)).alias("_ng")), total, [])
    seen = expr.where(F.col(value) > 0).join(cells, list(cell))
    ranked = average_rank(seen, value, [gene], "_r")
    per_gene = seen.groupBy(gene).agg(F.count(F.lit(1)).alias("_nz"))
    sums = ranked.groupBy(group, gene).agg(F.sum("_r").alias("_s"), F.count(F.lit(1)).alias("_k"))
    j = attach(grid(per_gene, sizes), sums, [group, gene])
    zeros = F.col("_N") - F.col("_nz")
    k_in = F.coalesce("_k", F.lit(0))
    rank_sum = F.coalesce("_s", F.lit(0.0)) + k_in * zeros + (F.col("_ng") - k_in) * (zeros + 1) / F.lit(2.0)
    mean = F.col("_ng") * (F.col("_N") + 1) / F.lit(2.0)
    sd = F.sqrt(F.col("_ng").cast("double") * (F.col("_N") - F.col("_ng")) * (F.col("_N") + 1) / F.lit(12.0))
    scored = j.select(group, gene, F.try_divide(rank_sum - mean, sd).alias("score"))
    return top_rows(scored, [group], ["-score", gene], k, "rank")
