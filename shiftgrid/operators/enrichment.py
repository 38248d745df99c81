"""Running enrichment of gene sets along a ranked list, and its size-matched null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrid.functions.scalars import hash_key
from shiftgrid.operators import replicates
from shiftgrid.operators.ordered import SLICE, attach, attach_stats, group_size, numbered, running
from shiftgrid.operators.ranks import top_rows
from shiftgrid.operators.resample import replicate
from shiftgrid.operators.stats import finite
from shiftgrid.session import cut


def ranked_list(df: DataFrame, by: Sequence[str], gene: str, score: str) -> DataFrame:
    """Positions by descending score, the weight of a position, and the list length."""
    known = df.where(finite(score)).select(*by, gene, score)
    placed = numbered(known, by, [f"-{score}", gene], "position")
    return group_size(placed, by, "n_list").select(
        *by, gene, "position", "n_list", F.abs(F.col(score)).alias("weight")
    )


def scores_of_hits(hits: DataFrame, group: Sequence[str]) -> DataFrame:
    """Signed extreme of the running sum for rows (group, position, weight, n_list).

    A hit adds its share of the weight, a miss takes 1 / (n - k). Between hits the sum only falls, so the values right
    after and right before each hit hold both extremes; at equal magnitude the positive one wins.
    """
    walked = running(
        hits, group, ["position"],
        {"_w": ("sum", F.col("weight")), "_i": ("sum", F.lit(1).cast("bigint"))},
    ).drop(SLICE)
    totals = hits.groupBy(*group).agg(
        F.sum("weight").alias("_nr"), F.count(F.lit(1)).alias("size"), F.max("n_list").alias("_n")
    )
    j = attach_stats(walked, totals, group)
    miss = F.try_divide((F.col("position") - F.col("_i")).cast("double"), (F.col("_n") - F.col("size")).cast("double"))
    up = F.try_divide(F.col("_w"), F.col("_nr")) - miss
    down = F.try_divide(F.col("_w") - F.col("weight"), F.col("_nr")) - miss
    ext = j.groupBy(*group).agg(
        F.max("size").alias("size"), F.max("_n").alias("n_list"), F.max("_nr").alias("_nr"),
        F.greatest(F.max(up), F.lit(0.0)).alias("_hi"), F.least(F.min(down), F.lit(0.0)).alias("_lo"),
    )
    es = F.when((F.col("_nr") <= 0) | (F.col("size") >= F.col("n_list")), F.lit(0.0)).when(
        F.abs("_hi") >= F.abs("_lo"), F.col("_hi")
    ).otherwise(F.col("_lo"))
    return ext.select(*group, "size", "n_list", es.alias("es"))


def enrichment(df: DataFrame, by: Sequence[str], gene: str, score: str, sets: DataFrame, min_hits: int = 5) -> DataFrame:
    """Enrichment score per group and set; sets with too few hits or too few misses are skipped."""
    return enrichment_of_list(ranked_list(df, by, gene, score), by, gene, sets, min_hits)


def enrichment_of_list(listed: DataFrame, by: Sequence[str], gene: str, sets: DataFrame, min_hits: int) -> DataFrame:
    hits = listed.join(
        sets.select("set_name", F.col("gene").alias(gene)).distinct(), gene
    )
    scored = scores_of_hits(hits, [*by, "set_name"])
    return scored.where((F.col("size") >= int(min_hits)) & (F.col("size") < F.col("n_list") - int(min_hits)))


def set_null(
    df: DataFrame, by: Sequence[str], gene: str, score: str, sizes: DataFrame, B: int, seed: int
) -> DataFrame:
    """Enrichment of random sets, once per distinct set size: rows (group, size, b, es).

    One random order of the list per replicate serves all sizes: its first k genes are a random set of size k. Only the
    genes up to the largest size leave each task.
    """
    return null_of_list(ranked_list(df, by, gene, score), by, gene, sizes, B, seed)


def null_of_list(listed: DataFrame, by: Sequence[str], gene: str, sizes: DataFrame, B: int, seed: int) -> DataFrame:
    distinct = sizes.select(*by, F.col("size").alias("_size")).distinct()
    own = cut(distinct.groupBy(*by).agg(F.max("_size").alias("_most")))
    largest = own.agg(F.max("_most").alias("m")).first()["m"]
    asked = attach(listed, own, by, "inner")
    expected = asked.groupBy(*by).agg(F.least(F.count(F.lit(1)), F.max("_most")).alias("n")).agg(F.sum("n").alias("n")).first()["n"] or 0
    slack = 1
    taken = cut(first_of_hash(asked, by, gene, int(largest or 0), B, seed, slack))
    # only where many rows share a hash, that is a gene, the first guess may fall short
    while taken.count() < expected * B:
        slack *= 8
        taken = cut(first_of_hash(asked, by, gene, int(largest or 0), B, seed, slack))
    return replicates.walked_sets(taken, by, distinct)


def first_of_hash(listed: DataFrame, by: Sequence[str], gene: str, largest: int, B: int, seed: int, slack: int) -> DataFrame:
    """The first ``_most`` genes of a random order of each group, for each replicate: their place ``_at``, position and weight.

    Hashes are uniform: those above a bound that leaves a few more than are asked for are dropped where they are made. The result
    is exact if it is complete, which the caller counts.
    """
    share = (F.col("_most") + 8 * F.sqrt("_most") + 64) * F.lit(float(slack)) / F.col("n_list")
    bound = F.when(share < 1, F.lower(F.lpad(F.hex((share * F.lit(float(1 << 60))).cast("bigint")), 15, "0"))).otherwise("~")
    made = replicate(listed.withColumn("_bound", bound), B, [*by, gene])
    text = F.concat_ws("|", *[c.cast("string") for c in (F.lit(seed), *[F.col(c) for c in by], F.col("b"), F.col(gene))])
    near = made.where(F.substring(F.md5(text), 1, 15) < F.col("_bound"))
    hashed = near.withColumn("_h", hash_key(F.lit(seed), *[F.col(c) for c in by], F.col("b"), F.col(gene)))
    placed = top_rows(hashed, [*by, "b"], ["_h", gene], largest, "_at")
    return placed.where(F.col("_at") <= F.col("_most")).select(*by, "b", "_at", "position", "weight", "n_list")


def normalised_enrichment(
    df: DataFrame, by: Sequence[str], gene: str, score: str, sets: DataFrame, B: int, seed: int, min_hits: int = 5
) -> DataFrame:
    """ES divided by the mean magnitude of the null scores of its sign and size."""
    listed = cut(ranked_list(df, by, gene, score))
    es = cut(enrichment_of_list(listed, by, gene, sets, min_hits))
    null = null_of_list(listed, by, gene, es, B, seed)
    per_size = null.groupBy(*by, F.col("set_size").alias("size")).agg(
        F.avg(F.when(F.col("null_es") >= 0, F.abs("null_es"))).alias("_pos"),
        F.avg(F.when(F.col("null_es") < 0, F.abs("null_es"))).alias("_neg"),
    )
    scale = F.when(F.col("es") >= 0, F.col("_pos")).otherwise(F.col("_neg"))
    return attach(es, per_size, [*by, "size"]).select(
        *by, "set_name", "size", "es", F.when(scale > 0, F.try_divide(F.col("es"), scale)).alias("nes")
    )
