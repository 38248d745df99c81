"""Quality filters and row predicates on sparse counts, vectors and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrid.functions.scalars import is_erythroid, is_mitochondrial
from shiftgrid.operators.ordered import attach, attach_stats
from shiftgrid.operators.ranks import percentiles
from shiftgrid.operators.stats import finite
from shiftgrid.session import cut


class GuardError(ValueError):
    """An input breaks a rule under which a result would be meaningless."""


def require_empty(df: DataFrame, message: str, show: int = 20) -> None:
    """Raise with a few example rows when ``df`` has any row; reads at most ``show`` rows."""
    rows = df.limit(int(show)).collect()
    if rows:
        raise GuardError(f"{message}: {[tuple(r) for r in rows]}")


# ----------------------------------------------------------------------------------------------------------- features
def split_by_type(
    counts: DataFrame, features: DataFrame, rna: str = "Gene Expression", peaks: str = "Peaks"
) -> tuple[DataFrame, DataFrame]:
    """Expression and accessibility counts; an empty accessibility side is an error."""
    typed = counts.join(features.select("feature_id", "feature_type"), "feature_id")
    if features.where(F.col("feature_type") == peaks).limit(1).count() == 0:
        raise GuardError(f"no {peaks!r} features found")
    return (
        typed.where(F.col("feature_type") == rna).drop("feature_type"),
        typed.where(F.col("feature_type") == peaks).drop("feature_type"),
    )


def flag_features(features: DataFrame, name: str = "symbol") -> DataFrame:
    return features.withColumns({"is_mt": is_mitochondrial(F.col(name)), "is_hb": is_erythroid(F.col(name))})


# ------------------------------------------------------------------------------------------------------------- cells
def cell_metrics(counts: DataFrame, cell: Sequence[str], is_mt: str = "is_mt") -> DataFrame:
    """Genes detected, total count and mitochondrial percentage per cell (NULL for a cell without counts)."""
    total = F.sum("count")
    mt = F.sum(F.when(F.col(is_mt), F.col("count")).otherwise(0.0))
    return counts.groupBy(*cell).agg(
        F.sum((F.col("count") > 0).cast("bigint")).alias("n_genes"), total.alias("total_counts"),
        F.try_divide(mt * F.lit(100.0), total).alias("pct_mt"),
    )


def gene_cells(counts: DataFrame, gene: Sequence[str]) -> DataFrame:
    """Number of cells in which each gene is seen."""
    return counts.groupBy(*gene).agg(F.sum((F.col("count") > 0).cast("bigint")).alias("n_cells"))


def qc_rna(
    counts: DataFrame, cell: Sequence[str], gene: Sequence[str], min_genes: int = 200, min_cells: int = 3,
    max_pct_mt: float = 15.0, remove_mt: bool = True, remove_hb: bool = True,
) -> DataFrame:
    """Expression filter; ``counts`` carries ``is_mt`` and ``is_hb``.

    The order matters: the mitochondrial share is measured on all genes, cells are counted per gene after the gene-count
    gate and before the mitochondrial gate, flagged genes go last.
    """
    metrics = cell_metrics(counts, cell).where(F.col("n_genes") >= int(min_genes))
    # read by the gene support and by the result, so the join of all counts is done once
    kept = cut(counts.join(metrics.select(*cell, "pct_mt"), list(cell)))
    genes = gene_cells(kept, gene).where(F.col("n_cells") >= int(min_cells)).select(*gene)
    out = kept.where(F.col("pct_mt") < F.lit(float(max_pct_mt))).join(genes, list(gene), "left_semi").drop("pct_mt")
    drop = F.lit(False)
    if remove_mt:
        drop = drop | F.col("is_mt")
    if remove_hb:
        drop = drop | F.col("is_hb")
    return out.where(~drop)


def qc_atac(
    counts: DataFrame, cell: Sequence[str], peak: Sequence[str], min_peaks: int = 500, min_cells: int = 3
) -> DataFrame:
    """Accessibility filter: cells with enough non-zero peaks, then peaks in enough of the kept cells."""
    seen = F.sum((F.col("count") > 0).cast("bigint"))
    cells = counts.groupBy(*cell).agg(seen.alias("_p")).where(F.col("_p") >= int(min_peaks)).select(*cell)
    kept = cut(counts.join(cells, list(cell), "left_semi"))
    peaks = kept.groupBy(*peak).agg(seen.alias("_c")).where(F.col("_c") >= int(min_cells)).select(*peak)
    return kept.join(peaks, list(peak), "left_semi")


def flag_doublets(cells: DataFrame, sample: str, score: str, thresholds: DataFrame) -> DataFrame:
    """Doublet flag from the first threshold that applies: manual, automatic (when it flags anything), fallback.

    ``thresholds``: sample, manual, automatic, fallback (NULL = not given).
    """
    joined = attach_stats(cells, thresholds, [sample])
    by_auto = joined.groupBy(sample).agg(
        F.sum((F.col(score) > F.col("automatic")).cast("bigint")).alias("_auto_n")
    )
    j = attach_stats(joined, by_auto, [sample])
    auto_works = F.coalesce(F.col("_auto_n"), F.lit(0)) > 0
    source = (
        F.when(F.col("manual").isNotNull(), "manual")
        .when(auto_works | F.col("fallback").isNull(), "automatic").otherwise("fallback")
    )
    used = F.when(source == "manual", F.col("manual")).when(source == "automatic", F.col("automatic")).otherwise(
        F.col("fallback")
    )
    return j.select(
        *cells.columns, source.alias("threshold_source"),
        F.coalesce(F.col(score) > used, F.lit(False)).alias("is_doublet"),
    )


def doublet_report(flagged: DataFrame, sample: str) -> DataFrame:
    """Counts and rate before the doublets are removed."""
    return flagged.groupBy(sample).agg(
        F.max("threshold_source").alias("threshold_source"),
        F.sum(F.col("is_doublet").cast("bigint")).alias("n_doublets"),
        F.count(F.lit(1)).alias("n_cells_before"), F.avg(F.col("is_doublet").cast("double")).alias("doublet_rate"),
    )


# ---------------------------------------------------------------------------------------------------------- predicates
def usable_variants(variants: DataFrame, edges: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Adds ``tf_in_network`` (non-zero column sum) and ``usable`` (in the network and not a no-op)."""
    sums = edges.groupBy(*scope, "tf").agg(F.sum("weight").alias("_colsum"))
    in_net = F.coalesce(F.col("_colsum"), F.lit(0.0)) > 0
    return attach(variants, sums, [*scope, "tf"]).select(
        *variants.columns, in_net.alias("tf_in_network"), (in_net & ~F.col("noop")).alias("usable")
    )


def floor_filter(df: DataFrame, level: str, by: Sequence[str], pct: float = 0.25) -> DataFrame:
    """Rows at or above the given percentile of the level."""
    floor = percentiles(df, level, by, {"_floor": pct})
    return attach_stats(df, floor, by, "inner").where(F.col(level) >= F.col("_floor")).drop("_floor")


def min_support(df: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """Rows of the groups with at least n rows."""
    groups = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= int(n)).select(*key)
    return df.join(groups, list(key), "left_semi")


def support_status(df: DataFrame, key: Sequence[str], n: int, spread: str, min_sd: float = 1e-6) -> DataFrame:
    """Per group: ``too_few``, ``no_op`` (no spread) or ``ok``."""
    sd = F.stddev_samp(spread)
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), sd.alias("sd")).withColumn(
        "status",
        F.when(F.col("n") < int(n), "too_few")
        .when(F.coalesce(F.col("sd"), F.lit(0.0)) < F.lit(min_sd), "no_op").otherwise("ok"),
    )


def route_by_role(entries: DataFrame, roles: dict[str, str], role: str = "role") -> DataFrame:
    """Adds the route of each role; ``skip`` keeps its reason, roles without a route are out of scope."""
    route = F.when(F.col(role) == "skip", F.lit("skipped"))
    for name, target in roles.items():
        route = route.when(F.col(role) == name, F.lit(target))
    return entries.withColumn("route", route.otherwise("out_of_scope"))


def exclude_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def drop_nonfinite(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The finite rows, and per group the kept and dropped counts."""
    ok = finite(*cols)
    counts = df.groupBy(*by).agg(
        F.sum(ok.cast("bigint")).alias("n_kept"), F.sum((~ok).cast("bigint")).alias("n_dropped")
    )
    return df.where(ok), counts
