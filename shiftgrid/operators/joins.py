"""Keyed joins with guards, id mapping, and set operations on ids and reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgrid.operators.filters import GuardError, require_empty
from shiftgrid.operators.ordered import attach, attach_stats


# ---- fixed values: final texts of the units that are not scored -----------------------------------------------------
UNSCORED_TEXT = {
    "epsilon_exploratory": "epsilon only: see metrics_epsilon.tsv",
    "tf_not_in_network": "N/A: TF not in trained network (descriptive only)",
    "not_a_tf": "N/A: not a transcription factor",
    "not_run_array": "N/A: array data not supported",
}
# ---- end fixed values ------------------------------------------------------------------------------------------------


def align(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Inner join on the labels; everything that compares two vectors starts here."""
    return a.join(b, list(key))


def pair_cells(rna: DataFrame, atac: DataFrame, cell: Sequence[str], sample: Sequence[str], warn_below: int = 50):
    """Cells present in both assays, plus a report; a sample without any shared cell keeps both sides unpaired."""
    r, a = rna.select(*sample, *cell).distinct(), atac.select(*sample, *cell).distinct()
    keys = [*sample, *cell]
    shared = r.join(a, keys, "left_semi")
    n = shared.groupBy(*sample).agg(F.count(F.lit(1)).alias("n_shared"))
    samples = r.select(*sample).distinct().unionByName(a.select(*sample).distinct()).distinct()
    report = attach(samples, n, sample).select(
        *sample, F.coalesce("n_shared", F.lit(0)).alias("n_shared"),
        (F.coalesce("n_shared", F.lit(0)) < int(warn_below)).alias("few_shared"),
    )
    unpaired = report.where(F.col("n_shared") == 0).select(*sample)

    def keep(df: DataFrame) -> DataFrame:
        paired = df.join(shared, keys, "left_semi")
        return paired.unionByName(df.join(unpaired, list(sample), "left_semi")) if sample else paired

    return keep(rna), keep(atac), report


def sync_subset(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``a`` for the ids of ``b``; every id of ``b`` must exist in ``a``."""
    ids = b.select(*key).distinct()
    require_empty(ids.join(a.select(*key), list(key), "left_anti"), "ids of the second set are missing in the first")
    return a.join(ids, list(key), "left_semi")


def apply_labels(cells: DataFrame, labels: DataFrame, cluster: str, label: str) -> DataFrame:
    """Cluster -> label; a blank label or an uncovered cluster stops with the list of clusters."""
    blank = labels.where(F.col(label).isNull() | (F.trim(label) == "")).select(cluster)
    require_empty(blank, "clusters without a label")
    uncovered = cells.select(cluster).distinct().join(labels.select(cluster), cluster, "left_anti")
    require_empty(uncovered, "clusters without a row in the label table")
    return attach(cells, labels.select(cluster, label), [cluster])


def map_ids(df: DataFrame, mapping: DataFrame, id_col: str, map_id: str, symbol: str, min_frac: float = 0.5) -> DataFrame:
    """Adds ``symbol`` for the id without its version suffix; unmapped ids keep themselves.

    Mapping fewer than ``min_frac`` of the distinct ids means the wrong species or kind of id, and stops.
    """
    bare = F.substring_index(F.col(id_col).cast("string"), ".", 1)
    one = mapping.select(F.col(map_id).cast("string").alias("_id"), F.col(symbol).alias("_symbol")).groupBy("_id").agg(
        F.max("_symbol").alias("_symbol")
    )
    keyed = df.withColumn("_id", bare)
    share = attach(keyed.select("_id").distinct(), one, ["_id"]).agg(
        F.avg(F.col("_symbol").isNotNull().cast("double")).alias("s"), F.count(F.lit(1)).alias("n")
    ).first()
    if share["n"] and share["s"] < min_frac:
        raise GuardError(f"only {share['s']:.1%} of {share['n']} ids have a symbol")
    return attach(keyed, one, ["_id"]).select(
        *df.columns, F.coalesce("_symbol", "_id").alias("symbol"), F.col("_symbol").isNotNull().alias("is_mapped")
    )


def map_symbols_first(df: DataFrame, id_col: str, symbol: str, order: Sequence[str], out: str = "final_symbol") -> DataFrame:
    """Symbol of an id from its first occurrence in (file, line) order; ids without one keep themselves."""
    first = df.where(F.col(symbol).isNotNull()).groupBy(id_col).agg(
        F.min_by(F.col(symbol), F.struct(*order)).alias("_s")
    )
    return attach(df, first, [id_col]).withColumn(out, F.coalesce(F.col("_s"), F.col(id_col).cast("string"))).drop("_s")


def match_symbol(df: DataFrame, index: DataFrame, symbol: str, index_symbol: str, position: str) -> DataFrame:
    """Case-insensitive match to an index of symbols; the first index symbol of an upper-case form wins."""
    first = index.groupBy(F.upper(index_symbol).alias("_up")).agg(
        F.min_by(index_symbol, position).alias("matched")
    )
    keyed = df.withColumn("_up", F.upper(F.trim(symbol)))
    return attach(keyed, first, ["_up"]).drop("_up")


def tf_universe(expr_genes: DataFrame, motifs: DataFrame, gene: str, motif_tf: str) -> DataFrame:
    """Factors that are both expressed genes and in the motif table."""
    return expr_genes.select(F.col(gene).alias("tf")).intersect(motifs.select(F.col(motif_tf).alias("tf")))


def diff_reports(
    before: DataFrame, after: DataFrame, key: Sequence[str], verdict: str, value: str, tol: float = 0.02
) -> DataFrame:
    """Row-level comparison of two reports: side, change of verdict, moved value."""
    b = before.select(*key, F.col(verdict).alias("verdict_before"), F.col(value).alias("value_before"), F.lit(1).alias("_b"))
    a = after.select(*key, F.col(verdict).alias("verdict_after"), F.col(value).alias("value_after"), F.lit(1).alias("_a"))
    m = b.join(a, list(key), "full_outer")
    both = F.col("_b").isNotNull() & F.col("_a").isNotNull()
    delta = F.col("value_after") - F.col("value_before")
    return m.select(
        *key, "verdict_before", "verdict_after",
        F.when(both, "both").when(F.col("_b").isNotNull(), "before_only").otherwise("after_only").alias("side"),
        F.when(both, ~F.col("verdict_before").eqNullSafe(F.col("verdict_after"))).alias("verdict_changed"),
        delta.alias("delta"), F.when(both, F.coalesce(F.abs(delta) > F.lit(tol), F.lit(False))).alias("moved"),
    )


def attach_meta(rows: DataFrame, meta: DataFrame, key: str, descriptive: DataFrame | None = None) -> DataFrame:
    """Metadata by id; an unknown id is an error, and entries that never ran get a descriptive row."""
    require_empty(rows.select(key).distinct().join(meta.select(key), key, "left_anti"), "ids without metadata")
    out = attach(rows, meta, [key])
    if descriptive is not None:
        extra = descriptive.withColumn("verdict", F.lit("descriptive_only"))
        out = out.unionByName(extra, allowMissingColumns=True)
    return out.withColumn("pass_fail", F.col("verdict"))


def coverage(
    units: DataFrame, report: DataFrame, unit: str, ids: str, status: str, report_id: str, verdict: str, value: str
) -> DataFrame:
    """One row per unit: its listed results folded back in list order, missing ids, and the final status text.

    A unit lists a handful of ids, so the ordered fold is bounded by its own text.
    """
    wanted = units.select(unit, F.posexplode(F.filter(F.split(F.coalesce(ids, F.lit("")), ";"), lambda x: x != "")).alias("_p", "_id"))
    found = attach(
        wanted, report.select(F.col(report_id).alias("_id"), verdict, value, F.lit(True).alias("_hit")), ["_id"]
    )

    def fold(col: Column, keep: Column) -> Column:
        pairs = F.array_sort(F.collect_list(F.when(keep, F.struct(F.col("_p"), col.alias("x")))))
        return F.transform(pairs, lambda s: s["x"])

    hit = F.coalesce(F.col("_hit"), F.lit(False))
    text = F.when(F.col(value).isNull(), F.lit("")).otherwise(F.format_string("%.3f", F.col(value)))
    folded = found.groupBy(unit).agg(
        fold(F.coalesce(F.col(verdict), F.lit("")), hit).alias("_v"), fold(text, hit).alias("_x"),
        fold(F.col("_id"), ~hit).alias("_m"),
    )
    j = attach(units, folded, [unit])
    verdicts = F.coalesce(F.col("_v"), F.array().cast("array<string>"))
    missing = F.coalesce(F.col("_m"), F.array().cast("array<string>"))
    scored = F.startswith(F.col(status), F.lit("scored"))
    final = (
        F.when(scored & (F.size(verdicts) == 0),
               F.concat(F.col(status), F.lit(": panel row missing ("), F.array_join(missing, ","), F.lit(")")))
        .when(scored, F.concat(F.col(status), F.lit(": "), F.array_join(verdicts, "/")))
    )
    for code, words in UNSCORED_TEXT.items():
        final = final.when(F.col(status) == code, words)
    final = final.otherwise(F.col(status))
    return j.select(
        *units.columns, final.alias("final_status"), F.array_join(verdicts, ";").alias("verdicts"),
        F.array_join(F.coalesce("_x", F.array().cast("array<string>")), ";").alias("values"),
        F.array_join(missing, ";").alias("missing"),
    )


def first_per_scope(df: DataFrame, scope: Sequence[str], value: str, order: Sequence[str], out: str) -> DataFrame:
    """First non-null value per scope in the given order."""
    return df.where(F.col(value).isNotNull()).groupBy(*scope).agg(F.min_by(F.col(value), F.struct(*order)).alias(out))


def attach_scope(df: DataFrame, scalars: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Per-scope scalars onto every row. Spark broadcasts the scalar table when its measured size allows."""
    return attach_stats(df, scalars, scope)


def columns_of_group(expr: DataFrame, cells: DataFrame, sample: str, group: str):
    """Expression rows with the group of their column, and the columns no cell explains."""
    labelled = expr.join(cells.select(sample, group), sample)
    unresolved = expr.select(sample).distinct().join(cells.select(sample), sample, "left_anti")
    return labelled, unresolved


# -------------------------------------------------------------------------------------------------------- set operations
def pool(samples: dict[str, DataFrame], cell: str = "cell_id") -> DataFrame:
    """Union of long count tables; absent features are zero by absence, cell ids carry the sample."""
    parts = [
        df.withColumn(cell, F.concat_ws("-", F.col(cell).cast("string"), F.lit(name))).withColumn("sample_id", F.lit(name))
        for name, df in samples.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def pool_long(counts: DataFrame, sample: str, cell: str) -> DataFrame:
    """The same when the samples already share one table."""
    return counts.withColumn(cell, F.concat_ws("-", F.col(cell).cast("string"), F.col(sample)))


def stack(reports: Sequence[DataFrame], cols: Sequence[str]) -> DataFrame:
    """Reports under one column list; absent columns are NULL."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports)
    have = set(out.columns)
    return out.select(*[F.col(c) if c in have else F.lit(None).alias(c) for c in cols])


def id_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Every id with the side that holds it: both, a_only, b_only."""
    left = a.select(key).distinct().withColumn("_a", F.lit(1))
    right = b.select(key).distinct().withColumn("_b", F.lit(1))
    return left.join(right, key, "full_outer").select(
        key, F.when(F.col("_a").isNull(), "b_only").when(F.col("_b").isNull(), "a_only").otherwise("both").alias("side")
    )


def leave_source_out(df: DataFrame, tiers: DataFrame, key: str, tier: str, own: str, others: Sequence[str]) -> DataFrame:
    """Rows whose id is in none of the other tiers."""
    other = tiers.where(F.col(tier).isin(*[t for t in others if t != own]))
    return df.join(other.select(key).distinct(), key, "left_anti")


def panel(sets: DataFrame, names: Sequence[str], minus: Sequence[DataFrame], gene: str = "gene") -> DataFrame:
    """Union of the named gene sets without the excluded genes."""
    out = sets.where(F.col("set_name").isin(*names)).select(gene).distinct()
    for ids in minus:
        out = out.join(ids.select(gene), gene, "left_anti")
    return out
