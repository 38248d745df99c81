"""Normalisation, regulon activity, variable features, components, clusters and the score-density valley."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftgrid.operators.filters import GuardError
from shiftgrid.operators.ordered import attach, attach_stats, grid, numbered
from shiftgrid.operators.ranks import top_rows
from shiftgrid.operators.stats import finite, projected
from shiftgrid.session import cut


def ln_cp10k(counts: DataFrame, sample: Sequence[str], value: str = "count", out: str = "value") -> DataFrame:
    """``ln(1 + x / total * 1e4)`` per sample, negatives as zero; samples without signal drop out."""
    clean = counts.withColumn("_x", F.greatest(F.col(value).cast("double"), F.lit(0.0)))
    totals = clean.groupBy(*sample).agg(F.sum("_x").alias("_total")).where(F.col("_total") > 0)
    return attach(clean, totals, sample, "inner").select(
        *counts.columns, F.log1p(F.col("_x") / F.col("_total") * F.lit(1e4)).alias(out)
    )


def quantile_normalise(
    expr: DataFrame, by: Sequence[str], sample: str, gene: str, value: str, out: str = "normalised"
) -> DataFrame:
    """The k-th smallest value of each sample becomes the mean of the k-th smallest values of all samples."""
    placed = numbered(expr, [*by, sample], [value, gene], "_k")
    means = placed.groupBy(*by, "_k").agg(F.avg(value).alias(out))
    return attach(placed, means, [*by, "_k"]).drop("_k")


@dataclass
class Network:
    """A weight table restricted to the expressed genes, with the sums every activity needs."""

    scope: list[str]
    rows: DataFrame  # scope, _g, _row
    totals: DataFrame  # scope, _G, _mean_row, _sum_row
    edges: DataFrame  # scope, tf, _g, weight, _deg (edges of the gene)
    cols: DataFrame  # scope, tf, _col


EPS = 1e-6
# Factors of a gene, and factors of a scope, that one array holds.
PACKED, FACTORS = 1024, 8192


def network(edges: DataFrame, genes: DataFrame, scope: Sequence[str], min_genes: int) -> Network:
    """``genes``: scope, _g. Fewer than ``min_genes`` shared genes in a scope is an error."""
    scope = list(scope)
    edges = cut(edges.select(*scope, "tf", "target", "weight"))
    rows = edges.groupBy(*scope, F.col("target").alias("_g")).agg(F.sum("weight").alias("_row"), F.count(F.lit(1)).alias("_deg"))
    rows = cut(rows.join(genes.select(*scope, "_g").distinct(), [*scope, "_g"], "left_semi"))
    totals = rows.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("_G"), F.avg("_row").alias("_mean_row"), F.sum("_row").alias("_sum_row")
    )
    short = totals.where(F.col("_G") < int(min_genes)).limit(5).collect()
    if short:
        raise GuardError(f"fewer than {min_genes} shared genes: {[tuple(r) for r in short]}")
    kept = edges.select(*scope, "tf", F.col("target").alias("_g"), "weight").join(
        rows.select(*scope, "_g", "_deg"), [*scope, "_g"]
    )
    cols = kept.groupBy(*scope, "tf").agg(F.sum("weight").alias("_col"))
    mean_col = cols.groupBy(*scope).agg(F.avg("_col").alias("_mean_col"))
    cols = attach(cols, mean_col, scope).select(
        *scope, "tf", (F.col("_col") + F.col("_mean_col") * F.lit(EPS)).alias("_col")
    )
    cols = cut(cols)
    return Network(scope, rows, totals, kept, cols)


def linear_parts(x: DataFrame, net: Network, sample: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """What the activity takes from an expression table, all of it linear in the values.

    Per sample: ``_tot`` = sum x, ``_rx`` = sum row * x. Per sample and factor: terms ``_num`` = weight * x, not yet summed.
    Only non-zero entries take part, so sparse tables stay sparse.
    """
    key = [*net.scope, *sample]
    shared = x.where(F.col("_x") != 0).join(net.rows, [*net.scope, "_g"])
    per_sample = shared.groupBy(*key).agg(F.sum("_x").alias("_tot"), F.sum(F.col("_row") * F.col("_x")).alias("_rx"))
    terms = shared.select(*key, "_g", "_x").join(net.edges, [*net.scope, "_g"]).select(
        *key, "tf", (F.col("weight") * F.col("_x")).alias("_num")
    )
    return per_sample, terms


def summed_terms(terms: DataFrame, samples: DataFrame, net: Network, sample: Sequence[str]) -> DataFrame:
    """``_num`` for every (sample, factor), zero where they never meet.

    The pairs enter the sum as zeros: one aggregation gives the dense result, and no large table is joined.
    """
    key = [*net.scope, *sample]
    # a few thousand samples may sit in one partition and fan out to millions of pairs: spread them first
    even = samples.repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key) if key else samples
    pairs = even.join(net.cols.select(*net.scope, "tf"), net.scope) if net.scope else grid(even, net.cols.select("tf"))
    zeros = pairs.select(*key, "tf", F.lit(0.0).alias("_num"))
    return terms.unionByName(zeros).groupBy(*key, "tf").agg(F.sum("_num").alias("_num"))


def row_share():
    return F.try_divide(
        F.col("_rx") + F.col("_mean_row") * F.lit(EPS) * F.col("_tot"),
        F.col("_tot") * (F.col("_sum_row") + F.col("_G") * F.col("_mean_row") * F.lit(EPS)),
    )


def activity_expr():
    """``(num - E) / E`` from _tot, _rx, _num, _col and the network totals."""
    expected = F.col("_col") * row_share()
    return F.try_divide(F.try_divide("_num", "_tot") - expected, expected)


def sparse_sums(x: DataFrame, net: Network, key: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """``_num`` = sum of weight * x of the pairs (key, factor) that share a gene of non-zero x.

    The factors and weights of a gene travel as arrays, once for each entry of the gene, to the task of the entry's key. They are taken
    apart there and added up without another shuffle. ``carried`` columns are the same in all rows of a key.
    """
    part = F.pmod(F.xxhash64("tf"), F.ceil(F.col("_deg") / F.lit(PACKED)))
    packed = net.edges.where(F.col("weight").isNotNull()).groupBy(*net.scope, "_g", part.alias("_part")).agg(
        F.collect_list(F.struct("tf", "weight")).alias("_e")
    ).select(*net.scope, "_g", F.col("_e.tf").alias("_tfs"), F.col("_e.weight").alias("_ws"))
    met = x.where(F.col("_x") != 0).select(*key, *carried, "_g", "_x").join(packed, [*net.scope, "_g"])
    there = met.select(*key, *carried, "_x", "_tfs", "_ws").repartition(*key) if key else met
    each = there.select(*key, *carried, "_x", F.explode(F.arrays_zip("_tfs", "_ws")).alias("_e"))
    return each.groupBy(*key, F.col("_e._tfs").alias("tf")).agg(
        F.sum(F.col("_e._ws") * F.col("_x")).alias("_num"), *[F.max(c).alias(c) for c in carried]
    )


def regulon_activity(
    expr: DataFrame, edges: DataFrame, scope: Sequence[str], sample: str, gene: str, value: str, min_genes: int = 1000
) -> DataFrame:
    """Relative excess of each factor's weighted expression over what row and column sums predict.

    With r = x / sum(x): ``num = sum_g T[g,f] r[g]``, ``E = col[f] * sum_g(row[g] r[g]) / sum(row)``,
    activity = ``(num - E) / E``; rows and columns are sums of T over the shared genes plus a millionth of their mean.
    A factor that meets no expressed gene of a sample still has num = 0, so every (sample, factor) pair is returned. Samples x factors
    is the result itself, but pairs that never meet are no rows of a shuffle: they are what is left of arrays of factors.
    """
    scope = list(scope)
    key = [*scope, sample]
    x = cut(expr.select(*key, F.col(gene).alias("_g"), F.coalesce(F.col(value), F.lit(0.0)).alias("_x")))
    net = network(edges, x, scope, min_genes)
    shared = x.where(F.col("_x") != 0).join(net.rows, [*scope, "_g"])
    per_sample = cut(shared.groupBy(*key).agg(F.sum("_x").alias("_tot"), F.sum(F.col("_row") * F.col("_x")).alias("_rx")))
    # a pair with num = 0 has the same activity for every factor whose column is neither zero nor undefined; others stand by themselves
    kind = F.when(finite("_col") & (F.col("_col") != 0), F.lit(1.0)).otherwise(F.col("_col"))
    wide = net.cols.groupBy(*scope).agg(F.ceil(F.count(F.lit(1)) / F.lit(FACTORS)).alias("_wide"))
    placed = cut(attach(net.cols, wide, scope).select(
        *scope, "tf", "_col", kind.alias("_kind"), F.pmod(F.xxhash64("tf"), F.col("_wide")).cast("int").alias("_block")))
    block = [*scope, "_kind", "_block"]
    blocks = cut(placed.groupBy(*block).agg(F.collect_list(F.struct("tf")).alias("_all")).withColumn("_all", F.col("_all.tf")))
    met = attach(sparse_sums(x, net, key), placed, [*scope, "tf"])
    lists = met.groupBy(*key, "_kind", "_block").agg(F.collect_list(F.struct("tf", "_num", "_col")).alias("_m"))
    lists = cut(lists.select(
        *key, "_kind", "_block", *[F.col(f"_m.{c}").alias(f"_l{c}") for c in ("tf", "_num", "_col")]))
    sums = attach(per_sample, net.totals, scope)
    each = attach(lists, sums, key).withColumn("_m", F.explode(F.arrays_zip("_ltf", "_l_num", "_l_col")))
    found = each.withColumns({"_num": F.col("_m._l_num"), "_col": F.col("_m._l_col")}).select(
        *key, F.col("_m._ltf").alias("tf"), activity_expr().alias("activity"))
    pairs = sums.join(blocks.select(*block), scope) if scope else grid(sums, blocks.select(*block))
    left = attach(pairs.withColumns({"_num": F.lit(0.0), "_col": F.col("_kind")}).select(*key, "_kind", "_block", activity_expr().alias("activity")),
                  lists.select(*key, "_kind", "_block", "_ltf"), [*key, "_kind", "_block"])
    known = F.coalesce("_ltf", F.array().cast(lists.schema["_ltf"].dataType))
    rest = attach(left, blocks, block).select(*key, F.explode(F.array_except("_all", known)).alias("tf"), "activity")
    return found.unionByName(rest)


@dataclass
class ScreenShift:
    """Shifts of activity of a screen in parts, see ``screen_shift``."""

    scope: list[str]
    variant: str
    net: Network
    moved: DataFrame  # scope, variant, _g, _x: non-zero shifts of known genes
    variants: DataFrame  # scope, variant, _dtot, _drx
    cols: DataFrame  # scope, tf, _col, totals, _tot, _rx and _num of the baseline, _a0

    def rows(self) -> DataFrame:
        """Every (variant, factor) as a row."""
        scope, key = self.scope, [*self.scope, self.variant]
        terms = self.moved.select(*key, "_g", "_x").join(self.net.edges, [*scope, "_g"]).select(*key, "tf", (F.col("weight") * F.col("_x")).alias("_num"))
        nums = summed_terms(terms, self.variants.select(*key), self.net, [self.variant]).withColumnRenamed("_num", "_dnum")
        j = attach(attach(nums, self.cols, [*scope, "tf"]), self.variants, key)
        summed = j.withColumns({
            "_tot": F.col("_tot") + F.col("_dtot"), "_rx": F.col("_rx") + F.col("_drx"), "_num": F.col("_num") + F.col("_dnum"),
        })
        return summed.select(*key, "tf", (activity_expr() - F.col("_a0")).alias("shift"))

    def project(self, vector: DataFrame, exclude: dict[str, Column] | None = None) -> DataFrame:
        """``stats.project`` on ``vector`` (scope, tf, vector) of all variants, from the pairs that share a gene.

        With u = num / col of the baseline and q = 1 / (tot * row share), the shift of a pair that shares none is u * (q - q of the
        baseline): sums over all factors less those over the factors a variant meets give the sums over these pairs.
        """
        scope, key = self.scope, [*self.scope, self.variant]
        q = F.try_divide(F.lit(1.0), F.col("_tot") * row_share())
        base = attach(self.cols, vector.select(*scope, "tf", "vector"), [*scope, "tf"]).withColumns(
            {"_u": F.try_divide("_num", "_col"), "_q0": q})
        fine = base.withColumn("_fine", finite("_a0", "_u", "_q0"))
        cases = {"": finite("vector"), **{s: finite("vector") & ~c for s, c in (exclude or {}).items()}}
        factors = cut(fine.select(
            *scope, "tf", "vector", "_col", "_u", "_q0", "_fine", *[(F.col("_fine") & c).alias(f"_ok{s}") for s, c in cases.items()]))
        u2, ua, aa = F.col("_u") * F.col("_u"), F.col("_u") * F.col("vector"), F.col("vector") * F.col("vector")

        def of(tag: str) -> list[Column]:
            out = [F.sum(F.when(F.col("_fine"), u2)).alias(f"{tag}u2"), F.count(F.when(F.col("_fine"), 1)).alias(f"{tag}n")]
            for s in cases:
                ok = F.col(f"_ok{s}")
                out += [F.sum(F.when(ok, u2)).alias(f"{tag}u2{s}_"), F.sum(F.when(ok, ua)).alias(f"{tag}ua{s}_"), F.count(F.when(ok, 1)).alias(f"{tag}n{s}_")]
            return out

        whole = cut(factors.groupBy(*scope).agg(*of("_w_"), *[F.sum(F.when(F.col(f"_ok{s}"), aa)).alias(f"_w_aa{s}_") for s in cases], F.max("_q0").alias("_q0")))
        base_sums = self.cols.groupBy(*scope).agg(*[F.max(c).alias(c) for c in ("_tot", "_rx", "_G", "_mean_row", "_sum_row")])
        j = attach(self.variants, base_sums, scope).withColumns({"_tot": F.col("_tot") + F.col("_dtot"), "_rx": F.col("_rx") + F.col("_drx")})
        j = j.select(*key, q.alias("_q"))
        # variants of a scope without factors have no pairs
        variants = cut(j.join(whole.select(*scope, "_q0"), scope) if scope else attach(j, whole.select("_q0"), [], "inner")).select(
            *key, "_q", (F.col("_q") - F.col("_q0")).alias("_d"))
        met = sparse_sums(attach(self.moved, variants, key), self.net, key, ["_q", "_d"])
        pairs = attach(met.withColumnRenamed("_num", "_dnum"), factors, [*scope, "tf"]).withColumn(
            "_s", F.col("_u") * F.col("_d") + F.try_divide(F.coalesce("_dnum", F.lit(0.0)), F.col("_col")) * F.col("_q"))
        good = F.col("_fine") & finite("_s")
        aggs = [*of("_m_"), F.sum(F.when(good, F.col("_s") * F.col("_s"))).alias("_ss"), F.count(F.when(F.col("_fine") & ~finite("_s"), 1)).alias("_bad")]
        for s in cases:
            ok, bad = F.col(f"_ok{s}") & finite("_s"), F.col(f"_ok{s}") & ~finite("_s")
            aggs += [F.sum(F.when(ok, F.col("_s") * F.col("_s"))).alias(f"_ss{s}_"), F.sum(F.when(ok, F.col("_s") * F.col("vector"))).alias(f"_sa{s}_"),
                     F.sum(F.when(bad, aa)).alias(f"_badaa{s}_"), F.count(F.when(bad, 1)).alias(f"_bad{s}_")]
        sums = attach(attach(variants, pairs.groupBy(*key).agg(*aggs), key), whole.drop("_q0"), scope)

        def zero(c: str) -> Column:
            return F.coalesce(F.col(c), F.lit(0))

        def rest(what: str, end: str = "") -> Column:
            left = zero(f"_w_{what}{end}") - zero(f"_m_{what}{end}")
            return F.when(zero(f"_w_n{end}") > zero(f"_m_n{end}"), F.greatest(left, F.lit(0.0)) if what == "u2" else left).otherwise(F.lit(0.0))

        known, d = finite("_q"), F.col("_d")
        count = F.when(known, zero("_w_n") - zero("_bad")).otherwise(0)
        out = [F.when(count > 0, F.sqrt(zero("_ss") + d * d * rest("u2"))).alias("shift_l2")]
        for s in cases:
            n = F.when(known, zero(f"_w_n{s}_") - zero(f"_bad{s}_")).otherwise(0)
            out += [F.when(n > 0, zero(f"_sa{s}_") + d * rest("ua", f"{s}_")).alias(f"_sa{s}"), F.when(n > 0, zero(f"_w_aa{s}_") - zero(f"_badaa{s}_")).alias(f"_aa{s}"),
                    F.when(n > 0, zero(f"_ss{s}_") + d * d * rest("u2", f"{s}_")).alias(f"_ss{s}"), n.alias(f"n_common{s}")]
        return projected(sums.select(*key, *out), key, list(cases))


def screen_shift(
    baseline: DataFrame, shifts: DataFrame, edges: DataFrame, scope: Sequence[str], variant: str, gene: str, value: str,
    shift: str, min_genes: int = 1000,
) -> ScreenShift:
    """Activity of (baseline + shift) minus activity of the baseline, for every variant and factor, in parts.

    All sums behind the activity are linear, so those of a variant are the baseline's plus those of its non-zero shifts:
    no variant's expression is ever written out over all genes.
    """
    scope = list(scope)
    b = cut(baseline.select(*scope, F.col(gene).alias("_g"), F.coalesce(F.col(value), F.lit(0.0)).alias("_x")))
    shifts = cut(shifts.select(*scope, variant, gene, shift))
    s = shifts.select(*scope, variant, F.col(gene).alias("_g"), F.coalesce(F.col(shift), F.lit(0.0)).alias("_x"))
    s = s.join(b.select(*scope, "_g"), [*scope, "_g"], "left_semi")
    net = network(edges, b, scope, min_genes)
    base, base_terms = linear_parts(b, net, [])
    moved, _ = linear_parts(s, net, [variant])
    # one row per factor with everything of the baseline, one row per variant with its sums of shifts
    cols = attach(attach(attach(net.cols, summed_terms(base_terms, base.select(*scope), net, []), [*scope, "tf"]), base, scope),
                  net.totals, scope)
    cols = cut(cols.withColumn("_a0", activity_expr()))
    variants = cut(attach(shifts.select(*scope, variant).distinct(), moved, [*scope, variant]).select(
        *scope, variant, F.coalesce("_tot", F.lit(0.0)).alias("_dtot"), F.coalesce("_rx", F.lit(0.0)).alias("_drx")
    ))
    return ScreenShift(scope, variant, net, s.where(F.col("_x") != 0), variants, cols)


def activity_of_shifts(
    baseline: DataFrame, shifts: DataFrame, edges: DataFrame, scope: Sequence[str], variant: str, gene: str, value: str,
    shift: str, min_genes: int = 1000,
) -> DataFrame:
    """``screen_shift`` as rows: one for every variant and factor."""
    return screen_shift(baseline, shifts, edges, scope, variant, gene, value, shift, min_genes).rows()


def top_variable(
    expr: DataFrame, cells: DataFrame, n_top: int, batch: str, gene: str, value: str, cell: Sequence[str], bins: int = 20
) -> DataFrame:
    """Highly variable features by binned dispersion per batch, then over batches.

    Public definition: dispersion = variance / mean of the non-log values, log-transformed and standardised within equal-
    width bins of log mean; a feature ranks by the number of batches where it is among the top ``n_top``, then by its
    mean standardised dispersion. Sums over non-zero entries give both moments, so no zeros are written out.
    """
    n = cells.groupBy(batch).agg(F.countDistinct(*cell).alias("_n"))
    x = F.expm1(F.col(value))
    sums = expr.groupBy(batch, gene).agg(F.sum(x).alias("_s"), F.sum(x * x).alias("_ss"))
    m = attach_stats(sums, n, [batch])
    mean = F.col("_s") / F.col("_n")
    var = F.try_divide(F.col("_ss") - F.col("_n") * mean * mean, F.col("_n") - F.lit(1.0))
    # an excess over the mean that rounding alone explains is no dispersion
    disp = F.when(var > F.lit(1e-12) * mean * mean, F.log(F.try_divide(var, mean)))
    t = m.select(batch, gene, F.log1p(mean).alias("_m"), disp.alias("_d"))
    span = t.groupBy(batch).agg(F.min("_m").alias("_lo"), F.max("_m").alias("_hi"))
    t = attach_stats(t, span, [batch])
    width = F.nullif((F.col("_hi") - F.col("_lo")) / F.lit(float(bins)), F.lit(0.0))
    # right-closed equal-width bins, the first one closed on both sides
    slot = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((F.col("_m") - F.col("_lo")) / width)))
    t = t.withColumn("_bin", F.coalesce(slot, F.lit(1)))
    stats = t.groupBy(batch, "_bin").agg(F.avg("_d").alias("_mu"), F.stddev_samp("_d").alias("_sd"))
    t = attach_stats(t, stats, [batch, "_bin"])
    # a bin with one feature has no spread: its feature gets 1
    norm = F.when(F.col("_sd").isNull(), F.when(F.col("_d").isNotNull(), F.lit(1.0))).otherwise(
        F.try_divide(F.col("_d") - F.col("_mu"), F.col("_sd"))
    )
    t = t.select(batch, gene, norm.alias("_norm"))
    top = top_rows(t.where(F.col("_norm").isNotNull()), [batch], ["-_norm", gene], n_top).select(
        batch, gene, F.lit(1).alias("_in")
    )
    joined = attach(t, top, [batch, gene])
    per_gene = joined.groupBy(gene).agg(
        F.sum(F.coalesce("_in", F.lit(0))).alias("n_batches"), F.avg("_norm").alias("dispersion_norm")
    )
    known = per_gene.where(F.col("dispersion_norm").isNotNull())
    return top_rows(known.withColumn("_all", F.lit(1)), ["_all"], ["-n_batches", "-dispersion_norm", gene], n_top, "rank").drop("_all")


def scaled_features(df: DataFrame, features: str, clip: float = 10.0, out: str = "_scaled") -> DataFrame:
    """Array column to a vector of unit-variance, centred, clipped features."""
    vec = df.withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))
    model = StandardScaler(inputCol="_v", outputCol="_sv", withMean=True, withStd=True).fit(vec)
    bounded = F.transform(
        vector_to_array("_sv"), lambda x: F.greatest(F.lit(-clip), F.least(F.lit(clip), x))
    )
    return model.transform(vec).withColumn(out, array_to_vector(bounded)).drop("_v", "_sv")


def pca(df: DataFrame, features: str, k: int = 30, clip: float = 10.0, out: str = "pcs"):
    """Scores of the first k principal components, the explained variance ratios, and the loadings (features x k).

    The Gram matrix is summed on the executors; its side is the number of selected features (at most ``top_variable``'s
    n), never the number of cells. The sign of a component is fixed: its largest loading is positive (the first among equals).
    """
    scaled = scaled_features(df, features, clip)
    model = PCA(k=int(k), inputCol="_scaled", outputCol="_pc").fit(scaled)
    loadings = model.pc.toArray()
    largest = np.abs(np.round(loadings, 12)).argmax(axis=0)
    signs = np.where(loadings[largest, np.arange(loadings.shape[1])] < 0, -1.0, 1.0)
    fixed = F.zip_with(vector_to_array("_pc"), F.array(*[F.lit(float(x)) for x in signs]), lambda x, sign: x * sign)
    ratios = [float(v) for v in model.explainedVariance]
    return model.transform(scaled).withColumn(out, fixed).drop("_scaled", "_pc"), ratios, loadings * signs


def _squared_distance(x: Column, centre: Column) -> Column:
    return F.aggregate(F.zip_with(x, centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, d: total + d)


def _nearest(x: Column, centres: Sequence[Sequence[float]]) -> Column:
    """(distance, number) of the nearest centre; the smaller number among equals."""
    listed = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])
    return F.array_min(F.transform(listed, lambda c, i: F.struct(_squared_distance(x, c).alias("distance"), i.alias("number"))))


def cluster(df: DataFrame, key: str, features: str, batch: str, k: int, rounds: int = 20, out: str = "cluster") -> DataFrame:
    """Clusters of an embedding after each batch is moved to a common centre (a contract cell -> cluster).

    Centres start farthest first: the row with the smallest key, then again and again the row farthest from its nearest centre (the
    smallest key among equals). ``rounds`` Lloyd rounds follow, and a last assignment. So cluster numbers are defined by the data.
    A centre without rows stays. Only k centres pass the driver; rows are summed by cluster before they are shuffled.
    """
    vec = df.withColumn("_v", F.col(features).cast("array<double>"))
    centre = vec.groupBy(batch).agg(vector_to_array(Summarizer.mean(array_to_vector("_v"))).alias("_mu"))
    moved = attach_stats(vec, centre, [batch]).withColumn("_x", F.zip_with("_v", "_mu", lambda a, b: a - b)).drop("_v", "_mu")
    # every round reads the same values: means differ in their last bits when they are summed again
    rows = cut(moved)
    centres = [r["_x"] for r in rows.select(key, "_x").orderBy(key).limit(1).collect()]
    while 0 < len(centres) < int(k):
        far = rows.select(key, "_x", _nearest(F.col("_x"), centres)["distance"].alias("_d")).orderBy(F.desc("_d"), key).limit(1).first()
        if far["_d"] == 0.0:  # fewer different rows than clusters
            break
        centres.append(far["_x"])
    if not centres:
        return rows.drop("_x").withColumn(out, F.lit(None).cast("int"))
    for _ in range(int(rounds)):
        placed = rows.select(_nearest(F.col("_x"), centres)["number"].alias("_c"), "_x")
        for r in placed.groupBy("_c").agg(vector_to_array(Summarizer.mean(array_to_vector("_x"))).alias("_m")).collect():
            centres[r["_c"]] = r["_m"]
    return rows.withColumn(out, _nearest(F.col("_x"), centres)["number"]).drop("_x")


def density_valley(
    scores: DataFrame, by: Sequence[str], score: str, lo: float = 0.08, hi: float = 0.5, points: int = 400
) -> DataFrame:
    """First interior minimum of a Gaussian kernel density between two bounds, NULL when there is none.

    Bandwidth: sample deviation times n^(-1/5). Equal scores are counted first and every score adds to the fixed grid, so
    each task sends at most ``points`` sums per group to the shuffle.
    """
    stats = scores.groupBy(*by).agg(
        F.count(score).cast("double").alias("_n"), F.stddev_samp(score).alias("_sd"), F.max(score).alias("_max")
    )
    ties = scores.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count(F.lit(1)).alias("_k"))
    j = attach_stats(ties, stats, by, "inner").where((F.col("_max") >= F.lit(lo)) & (F.col("_sd") > 0))
    grid = j.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_i"))
    x = F.lit(lo) + (F.least(F.lit(hi), F.col("_max")) - F.lit(lo)) * F.col("_i") / F.lit(float(points - 1))
    h = F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2))
    u = (F.col("_x") - F.col(score)) / h
    density = grid.withColumn("_x", x).groupBy(*by, "_i", "_x").agg(
        F.sum(F.col("_k") * F.exp(F.lit(-0.5) * u * u) / (F.col("_n") * h * F.lit(math.sqrt(2 * math.pi)))).alias("_y")
    )
    w = Window.partitionBy(*by).orderBy("_i")
    dips = density.withColumns({"_l": F.lag("_y").over(w), "_r": F.lead("_y").over(w)}).where(
        (F.col("_y") < F.col("_l")) & (F.col("_y") < F.col("_r"))
    )
    first = dips.groupBy(*by).agg(F.min("_x").alias("threshold"))
    return attach(stats.select(*by), first, by)
