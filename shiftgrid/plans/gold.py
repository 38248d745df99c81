"""Directional reference table from curated sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgrid.operators.aggregates import resolve_conflicts
from shiftgrid.operators.joins import match_symbol
from shiftgrid.operators.ordered import attach


def tier_records(raw: DataFrame, index: DataFrame, tier: str, source: str, symbol: str, sign: Column, evidence: Column,
                 ref: Column) -> DataFrame:
    """Rows of one source that name an indexed factor with a direction: tier, source, tf, sign, evidence, ref."""
    m = match_symbol(raw.withColumns({"_sign": sign.cast("int"), "_ev": evidence, "_ref": ref}), index, symbol, "tf", "position")
    return m.where(F.col("matched").isNotNull() & F.col("_sign").isNotNull()).select(
        F.lit(tier).alias("tier"), F.lit(source).alias("source"), F.col("matched").alias("tf"),
        F.col("_sign").alias("expected_ko_sign"), F.coalesce("_ev", F.lit("")).alias("evidence"),
        F.coalesce("_ref", F.lit("")).alias("ref"),
    )


def build_gold(records: list[DataFrame], membership: str = "D") -> tuple[DataFrame, DataFrame]:
    """All tiers with conflicting factors removed (the membership tier has no direction to conflict), and the conflicts."""
    rows = reduce(lambda a, b: a.unionByName(b), records)
    kept, conflicts = resolve_conflicts(rows, ["tier", "source", "tf"], "expected_ko_sign", ["evidence", "ref"])
    return kept, conflicts.where(F.col("tier") != membership).withColumn(
        "reason", F.lit("conflicting directions within tier")
    )


def provenance(raw_counts: DataFrame, records: list[DataFrame], gold: DataFrame, conflicts: DataFrame, min_tfs: int = 10):
    """Per tier: raw rows, rows in the index, conflicts, factors by sign, underpowered flag."""
    rows = reduce(lambda a, b: a.unionByName(b), records)
    n_rows = rows.groupBy("tier").agg(F.count(F.lit(1)).alias("n_rows_in_index"))
    n_conf = conflicts.groupBy("tier").agg(F.count(F.lit(1)).alias("n_conflicts"))
    n_tf = gold.groupBy("tier").agg(
        F.count(F.lit(1)).alias("n_tfs"), F.sum((F.col("expected_ko_sign") == 1).cast("bigint")).alias("n_pos"),
        F.sum((F.col("expected_ko_sign") == -1).cast("bigint")).alias("n_neg"),
    )
    j = attach(attach(attach(raw_counts, n_rows, ["tier"]), n_conf, ["tier"]), n_tf, ["tier"])
    return j.na.fill(0).withColumn("underpowered", F.col("n_tfs") < int(min_tfs))


def unsourced(curated: DataFrame, index: DataFrame) -> DataFrame:
    """Curated rows that are left out, with the reason: no reference or evidence, no valid sign, not indexed."""
    m = match_symbol(curated, index, "tf_name", "tf", "position")
    no_ref = (F.trim(F.coalesce("ref", F.lit(""))) == "") | (F.trim(F.coalesce("evidence", F.lit(""))) == "")
    bad_sign = ~F.trim("sign_text").isin("1", "-1", "+1")
    reason = F.when(no_ref, "unsourced").when(bad_sign, "sign not +1/-1").when(F.col("matched").isNull(), "not in the index")
    return m.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("tf_name", "reason")
