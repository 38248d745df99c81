"""Table-quality checks: mixed conditions, table regression, keyword triage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgrid.functions.scalars import (
    GENOTYPE_PATTERNS, TREATMENT_PATTERNS, accessions, ages_of, buckets_of, is_barcode, name_prefix,
)
from shiftgrid.operators.ordered import attach
from shiftgrid.session import cut, tasks_for


def audit_mixing(
    names: DataFrame, entry: str, name: str, columns: DataFrame | None = None, threshold: float = 0.8
) -> DataFrame:
    """Per entry: barcode-like names, prefix clusters, condition tokens, and a status.

    Prefixes and ages are counted (``prefix_clusters`` and ``age_values`` list them as rows); only named buckets become text.
    ``columns``: entry, column, n_distinct (see ``column_cardinality``). A condition-shaped column has 2 to 30 values.
    """
    n = F.col(name)
    flagged = names.select(
        entry, is_barcode(n).cast("double").alias("_bc"), name_prefix(n).alias("_prefix"),
        buckets_of(n, GENOTYPE_PATTERNS).alias("_g"), buckets_of(n, TREATMENT_PATTERNS).alias("_t"), ages_of(n).alias("_a"),
    )
    base = flagged.groupBy(entry).agg(
        F.count(F.lit(1)).alias("n_samples"), (F.avg("_bc") >= F.lit(threshold)).alias("looks_like_barcodes"),
        F.count_distinct("_prefix").alias("n_prefixes"),
    )

    def buckets(c: str, out: str) -> DataFrame:
        # a handful of named buckets
        each = flagged.select(entry, F.explode(c).alias("_x")).distinct()
        return each.groupBy(entry).agg(F.array_join(F.array_sort(F.collect_list("_x")), ",").alias(out),
                                       F.count(F.lit(1)).alias(f"_n_{out}"))

    j = attach(attach(base, buckets("_g", "genotype"), [entry]), buckets("_t", "treatment"), [entry])
    ages = flagged.select(entry, F.explode("_a").alias("_x")).groupBy(entry).agg(F.count_distinct("_x").alias("_ages"))
    j = attach(j, ages, [entry])
    if columns is not None:
        shaped = columns.where(F.col("n_distinct").between(2, 30)).groupBy(entry).agg(F.count(F.lit(1)).alias("n_shaped"))
        j = attach(j, shaped, [entry])
    else:
        j = j.withColumn("n_shaped", F.lit(0))
    bc = F.col("looks_like_barcodes")

    def axis(out: str) -> Column:
        return F.when(~bc & (F.coalesce(f"_n_{out}", F.lit(0)) >= 2), F.col(out)).otherwise(F.lit(""))

    n_ages = F.when(bc, F.lit(0)).otherwise(F.coalesce("_ages", F.lit(0)))
    tokens = (axis("genotype") != "") | (axis("treatment") != "") | (n_ages >= 2)
    prefix = ~bc & (F.col("n_prefixes") >= 2)
    shaped = F.coalesce("n_shaped", F.lit(0)) > 0
    status = (
        F.when(tokens | prefix | shaped, "FLAGGED_LIKELY_MIXED").when(bc, "barcode_based_no_condition_signal_found")
        .otherwise("looks_single_condition")
    )
    return j.select(
        entry, "n_samples", "looks_like_barcodes", F.when(bc, F.lit(0)).otherwise(F.col("n_prefixes")).alias("n_prefixes"),
        axis("genotype").alias("genotype"), axis("treatment").alias("treatment"), n_ages.alias("n_ages"),
        F.coalesce("n_shaped", F.lit(0)).alias("n_shaped"), status.alias("status"),
    )


def age_values(names: DataFrame, entry: str, name: str) -> DataFrame:
    """The distinct age texts per entry, one per row (their number has no bound)."""
    return names.select(entry, F.explode(ages_of(F.col(name))).alias("age")).distinct()


def prefix_clusters(names: DataFrame, entry: str, name: str) -> DataFrame:
    return names.groupBy(entry, name_prefix(F.col(name)).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def column_cardinality(table: DataFrame, entry: str, columns: Sequence[str]) -> DataFrame:
    """Distinct values per entry and column, in one aggregation."""
    counts = table.groupBy(entry).agg(*[F.count_distinct(F.col(c).cast("string")).alias(c) for c in columns])
    return counts.unpivot([entry], list(columns), "column", "n_distinct")


def compare_tables(a: DataFrame, b: DataFrame, by: Sequence[str], row: str, column: str, value: str, tol: float = 1e-8) -> DataFrame:
    """Status per table: shape, labels, positions of undefined values, largest difference.

    Long tables hold one row per cell; an undefined value is a NULL (or NaN) row. Both are written first, so that their rows are known:
    cells and labels meet in tasks of a bounded number of them.
    """
    key = [*by, row, column]

    def side(df: DataFrame, tag: str) -> DataFrame:
        v = F.col(value).cast("double")
        return cut(df.select(*key, F.when(~F.isnan(v), v).alias(f"_{tag}"), F.lit(True).alias(f"_has_{tag}")))

    left, right = side(a, "a"), side(b, "b")
    tasks = tasks_for(a.sparkSession, left.count() + right.count())

    def labels(df: DataFrame, label: str, out: str) -> DataFrame:
        each = df.select(*by, label).repartition(tasks, *by, label).distinct()
        return each.groupBy(*by).agg(F.count(label).alias(out))

    def shape(df: DataFrame, tag: str) -> DataFrame:
        return attach(labels(df, row, f"_rows_{tag}"), labels(df, column, f"_cols_{tag}"), by)

    m = left.repartition(tasks, *key).join(right.repartition(tasks, *key), key, "full_outer")
    both = F.col("_has_a").isNotNull() & F.col("_has_b").isNotNull()
    cells = m.groupBy(*by).agg(
        F.max(F.col("_has_a").isNotNull().cast("int")).alias("_any_a"), F.max(F.col("_has_b").isNotNull().cast("int")).alias("_any_b"),
        F.sum((~both).cast("bigint")).alias("n_unmatched"),
        F.sum((both & (F.col("_a").isNull() != F.col("_b").isNull())).cast("bigint")).alias("n_undefined_moved"),
        F.max(F.when(both, F.abs(F.col("_a") - F.col("_b")))).alias("max_abs_diff"),
    )
    j = attach(attach(cells, shape(left, "a"), by), shape(right, "b"), by)
    status = (
        F.when(F.col("_any_a") == 0, "NO_ORIGINAL_TO_COMPARE")
        .when((F.col("_rows_a") != F.col("_rows_b")) | (F.col("_cols_a") != F.col("_cols_b")) | (F.col("_any_b") == 0),
              "SHAPE_MISMATCH")
        .when(F.col("n_unmatched") > 0, "LABEL_MISMATCH").when(F.col("n_undefined_moved") > 0, "NAN_POSITION_MISMATCH")
        .when(F.coalesce("max_abs_diff", F.lit(0.0)) < F.lit(tol), "OK").otherwise("VALUE_DIFF")
    )
    return j.select(*by, status.alias("status"), "n_unmatched", "n_undefined_moved", "max_abs_diff")


def triage(docs: DataFrame, text: str, pattern: str, out: str = "needs_look") -> DataFrame:
    """Keyword flag on free text."""
    return docs.withColumn(out, F.col(text).rlike(pattern))


def inverted_index(entries: DataFrame, entry: str, text: str, ids=accessions) -> DataFrame:
    """id -> entries that mention it (sorted), and how many."""
    pairs = entries.select(entry, F.explode(F.array_distinct(ids(F.col(text)))).alias("id"))
    return pairs


def referring(pairs: DataFrame, entry: str) -> DataFrame:
    """Number of entries per id; the lists stay as pairs, because a popular id may be named anywhere."""
    return pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n_entries"), F.min(entry).alias("first_entry"))
