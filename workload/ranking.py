"""Ranks, top-k, correlations, classification curves, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftgrid.functions.scalars import wilson
from shiftgrid.operators import aggregates, joins, ranks, stats
from shiftgrid.plans import validation
from workload import standins as S
from workload.registry import query

# average-tie rank of x over w, in SQL
AVG = "(rank() OVER ({p} ORDER BY {x}) + (count(*) OVER ({q} {x}) - 1) / 2.0)"


def avg_rank_sql(x: str, by: str) -> str:
    p = f"PARTITION BY {by}" if by else ""
    q = f"PARTITION BY {by}," if by else "PARTITION BY"
    return AVG.format(p=p, q=q, x=x)


@query("jn1_align", """
    SELECT a.scope AS scope_a, b.scope AS scope_b, count(*) AS n, avg(a.value - b.value) AS mean_difference
    FROM vecs a JOIN vecs b ON a.item = b.item WHERE a.scope <> b.scope GROUP BY 1, 2""",
       "mean_difference", "vecs")
def _(t):
    v = S.vecs(t)
    a = v.select("item", F.col("scope").alias("scope_a"), F.col("value").alias("x"))
    b = v.select("item", F.col("scope").alias("scope_b"), F.col("value").alias("y"))
    return joins.align(a, b, ["item"]).where("scope_a <> scope_b").groupBy("scope_a", "scope_b").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("x") - F.col("y")).alias("mean_difference")
    )


@query("wn1_average_rank", f"SELECT scope, item, {avg_rank_sql('value', 'scope')} AS rank FROM vecs", "rank", "vecs")
def _(t):
    return ranks.average_rank(S.vecs(t), "value", ["scope"]).select("scope", "item", "rank")


@query("wn2_rank_in_scope", """
    SELECT c_mktsegment AS scope, c_custkey, CASE WHEN c_acctbal > 0 THEN
             rank() OVER (PARTITION BY c_mktsegment, c_acctbal > 0 ORDER BY c_acctbal DESC) END AS rank_in_scope
    FROM customer""")
def _(t):
    c = t.customer.select(F.col("c_mktsegment").alias("scope"), "c_custkey", "c_acctbal")
    return ranks.rank_in_scope(c, "c_acctbal", ["scope"], F.col("c_acctbal") > 0).select("scope", "c_custkey", "rank_in_scope")


@query("wn3_rank_percentile", """
    WITH r AS (SELECT n_regionkey AS scope, n_nationkey, s_suppkey,
                      CASE WHEN s_acctbal > 0 THEN rank() OVER (PARTITION BY n_regionkey, s_acctbal > 0 ORDER BY s_acctbal DESC) END AS rk
               FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT scope, s_suppkey, CASE WHEN rk IS NULL THEN NULL WHEN count(rk) OVER (PARTITION BY scope) > 1
           THEN 1.0 - (rk - 1.0) / (count(rk) OVER (PARTITION BY scope) - 1.0) ELSE 1.0 END::DOUBLE AS rank_pct FROM r""",
       "rank_pct")
def _(t):
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("scope"), "s_suppkey", "s_acctbal")
    r = ranks.rank_in_scope(s, "s_acctbal", ["scope"], F.col("s_acctbal") > 0, "rk")
    return ranks.rank_percentile(r, "rk", ["scope"]).select("scope", "s_suppkey", "rank_pct")


@query("wn4_percent_of_rank", f"""
    SELECT scope, item, {avg_rank_sql('value', 'scope')} / count(*) OVER (PARTITION BY scope) - 0.5 AS pct FROM vecs""",
       "pct", "vecs")
def _(t):
    return ranks.percent_of_rank(S.vecs(t), "value", ["scope"], centre=0.5).select("scope", "item", "pct")


@query("wn5_deciles", """
    WITH p AS (SELECT o_orderpriority AS scope, o_orderkey,
                      row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS r,
                      count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
    SELECT scope, o_orderkey, CAST(CASE WHEN n = 1 THEN 0 ELSE greatest(0, ((r - 1) * 10 + n - 2) // (n - 1) - 1) END AS BIGINT) AS decile
    FROM p""")
def _(t):
    o = t.orders.select(F.col("o_orderpriority").alias("scope"), "o_orderkey", "o_totalprice")
    return ranks.deciles(o, "o_totalprice", ["scope"], "o_orderkey").select("scope", "o_orderkey", "decile")


@query("wn7_recall_curve", """
    WITH p AS (SELECT lang, quality, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS k,
                      count(*) OVER (PARTITION BY lang) AS n_ranked, sum(quality) OVER (PARTITION BY lang) AS n_pos FROM labelled)
    SELECT lang, k, CAST(sum(quality) OVER (PARTITION BY lang ORDER BY k) AS DOUBLE) / n_pos AS recall,
           CAST(n_pos AS BIGINT) AS n_pos, n_ranked
    FROM p WHERE n_pos > 0 QUALIFY k <= 200""", "recall", "labelled")
def _(t):
    return stats.recall_curve(S.labelled(t), "quality", "score", ["lang"], "doc_id", 200)


@query("tk1_top_abs_label", """
    WITH a AS (SELECT scope, gene, abs(predicted_shift) AS v, count(*) OVER (PARTITION BY scope) AS n FROM shifts),
         r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY v DESC) AS i FROM a),
         k AS (SELECT scope, min(v) AS threshold FROM r WHERE i <= least(200, n // 2) GROUP BY scope)
    SELECT a.scope, gene, CAST(v >= threshold AS INTEGER) AS is_top FROM a JOIN k ON a.scope = k.scope""", "", "shifts")
def _(t):
    return ranks.top_abs_label(S.shifts(t), "predicted_shift", ["scope"], 200).select("scope", "gene", "is_top")


@query("tk2_top_abs", """
    SELECT scope, gene, real_shift FROM shifts
    QUALIFY row_number() OVER (PARTITION BY scope ORDER BY abs(real_shift) DESC, gene) <= 100""", "real_shift", "shifts")
def _(t):
    return ranks.top_abs(S.shifts(t), "real_shift", ["scope"], "gene", 100).select("scope", "gene", "real_shift")


@query("tk5_top_per_group", """
    SELECT c_mktsegment, c_custkey, c_acctbal,
           row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place
    FROM customer QUALIFY place <= 15""", "c_acctbal")
def _(t):
    c = t.customer.select("c_mktsegment", "c_custkey", "c_acctbal")
    return ranks.top_rows(c, ["c_mktsegment"], ["-c_acctbal", "c_custkey"], 15, "place")


@query("pct_exact_percentiles", """
    SELECT l_returnflag AS scope, quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.5) AS q50,
           quantile_cont(l_extendedprice, 0.99) AS q99 FROM lineitem GROUP BY 1""", "q25 q50 q99")
def _(t):
    li = t.lineitem.select(F.col("l_returnflag").alias("scope"), "l_extendedprice")
    return ranks.percentiles(li, "l_extendedprice", ["scope"], {"q25": .25, "q50": .5, "q99": .99})


RANKED = f"""
    WITH r AS (SELECT scope, {avg_rank_sql('real_shift', 'scope')} AS a, {avg_rank_sql('predicted_shift', 'scope')} AS b FROM shifts)
    SELECT scope, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS rho, count(*) AS n FROM r GROUP BY scope"""


@query("st2_spearman", RANKED, "rho", "shifts")
def _(t):
    return stats.spearman(S.shifts(t), "real_shift", "predicted_shift", ["scope"])


@query("rp6_correlation_p_value", f"""
    WITH k AS (SELECT scope, {avg_rank_sql('real_shift', 'scope')} AS a, {avg_rank_sql('predicted_shift', 'scope')} AS b FROM shifts
               WHERE real_shift IS NOT NULL AND predicted_shift IS NOT NULL),
         c AS (SELECT scope, corr(a, b) AS rho, count(*) AS n, count(*) - 2 AS df FROM k GROUP BY scope),
         -- the central probability of t with whole degrees of freedom is a finite sum in the cosine of atan(t / sqrt(df))
         e AS (SELECT scope, sum(CASE WHEN df % 2 = 0 THEN exp(lgamma(j + 0.5) - lgamma(j + 1) - lgamma(0.5)) * pow(1 - rho * rho, j)
                                     WHEN j <= (df - 3) // 2 THEN exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * pow(1 - rho * rho, j + 0.5) END) AS s
               FROM (SELECT *, unnest(range(0, greatest(1, df // 2))) AS j FROM c) GROUP BY scope)
    SELECT c.scope, rho, n, 1 - CASE WHEN df % 2 = 0 THEN abs(rho) * s ELSE 2 / pi() * (asin(abs(rho)) + abs(rho) * coalesce(s, 0)) END AS p_value
    FROM c JOIN e ON c.scope = e.scope""", "rho p_value", "shifts")
def _(t):
    from shiftgrid.functions.pvalue import with_p_value

    return with_p_value(stats.spearman(S.shifts(t), "real_shift", "predicted_shift", ["scope"]), "rho", "n")


@query("st3_pearson", "SELECT scope, corr(real_shift, predicted_shift) AS pearson, count(*) AS n FROM shifts GROUP BY scope",
       "pearson", "shifts")
def _(t):
    return stats.pearson(S.shifts(t), "real_shift", "predicted_shift", ["scope"])


@query("st4_zscore", """
    SELECT scope, gene, CASE WHEN stddev_pop(real_shift) OVER w > 0
             THEN (real_shift - avg(real_shift) OVER w) / stddev_pop(real_shift) OVER w ELSE 0 END AS z
    FROM shifts WINDOW w AS (PARTITION BY scope)""", "z", "shifts")
def _(t):
    return stats.zscore(S.shifts(t), "real_shift", ["scope"]).select("scope", "gene", "z")


@query("st5_zscore_reference", """
    WITH s AS (SELECT gene, avg(value) AS mu, stddev_samp(value) AS sd FROM expr WHERE scope = 'N' GROUP BY gene)
    SELECT e.scope, e.gene, e.sample, CASE WHEN sd > 1e-6 THEN (value - mu) / (sd + 1e-6) ELSE 0 END AS z, coalesce(NOT sd > 1e-6, true) AS is_flat
    FROM expr e LEFT JOIN s ON e.gene = s.gene""", "z", "expr")
def _(t):
    e = S.expr(t)
    return stats.zscore_ref(e, e.where("scope = 'N'"), "value", ["gene"]).select("scope", "gene", "sample", "z", "is_flat")


@query("st6_relative_rmse", """
    WITH z AS (SELECT scope, (real_shift - avg(real_shift) OVER w) / stddev_pop(real_shift) OVER w AS zr,
                      (predicted_shift - avg(predicted_shift) OVER w) / stddev_pop(predicted_shift) OVER w AS zp
               FROM shifts WINDOW w AS (PARTITION BY scope))
    SELECT scope, sqrt(avg((zp - zr) * (zp - zr))) AS rel_rmse FROM z GROUP BY scope""", "rel_rmse", "shifts")
def _(t):
    z = stats.zscore_many(S.shifts(t), {"zr": "real_shift", "zp": "predicted_shift"}, ["scope"])
    return z.groupBy("scope").agg(stats.rel_rmse_expr(F.col("zp"), F.col("zr")).alias("rel_rmse"))


@query("st7_sign_concordance", """
    WITH k AS (SELECT * FROM shifts QUALIFY row_number() OVER (PARTITION BY scope ORDER BY abs(real_shift) DESC, gene) <= 100)
    SELECT scope, avg(CAST(sign(predicted_shift) = sign(real_shift) AS DOUBLE)) FILTER (WHERE predicted_shift <> 0) AS concordance
    FROM k GROUP BY scope""", "concordance", "shifts")
def _(t):
    return stats.sign_concordance(S.shifts(t), "predicted_shift", "real_shift", ["scope"], "gene", 100)


@query("st8_pearson_centroid", """
    SELECT scope, corr(predicted_shift - level / 100, real_shift - level / 100) AS pcc_centroid FROM shifts GROUP BY scope""",
       "pcc_centroid", "shifts")
def _(t):
    s = S.shifts(t).withColumn("c", F.col("level") / 100)
    return stats.pearson_centroid(s, "predicted_shift", "real_shift", "c", ["scope"], "pcc_centroid")


@query("st9_leave_one_out_mean", """
    WITH v AS (SELECT o_orderpriority AS contrast, substr(o_orderpriority, 1, 1) IN ('1', '2') AS grp, l_partkey AS gene,
                      avg(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
         s AS (SELECT a.contrast, b.contrast AS other, a.gene, b.value FROM v a JOIN v b ON a.gene = b.gene AND a.grp <> b.grp),
         m AS (SELECT contrast, other, avg(value) AS mu, stddev_pop(value) AS sd FROM s GROUP BY 1, 2 HAVING count(*) > 100)
    SELECT s.contrast, s.gene, avg(CASE WHEN sd > 0 THEN (value - mu) / sd ELSE 0 END) AS loco
    FROM s JOIN m ON s.contrast = m.contrast AND s.other = m.other GROUP BY 1, 2""", "loco")
def _(t):
    v = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        F.col("o_orderpriority").alias("contrast"), F.substring("o_orderpriority", 1, 1).isin("1", "2").alias("grp"),
        F.col("l_partkey").alias("gene")).agg(F.avg("l_quantity").alias("value"))
    return stats.loco_mean(v, "value", "contrast", "grp", "gene")


CURVE = f"""
    WITH r AS (SELECT lang, quality AS y, score, {avg_rank_sql('score', 'lang')} AS rk FROM labelled),
         c AS (SELECT lang, count(*) AS n, sum(y) AS p, sum(rk) FILTER (WHERE y = 1) AS s FROM r GROUP BY lang),
         g AS (SELECT lang, score, sum(y) AS tp, count(*) AS m FROM r GROUP BY lang, score),
         w AS (SELECT lang, tp, sum(tp) OVER (PARTITION BY lang ORDER BY score DESC) AS ctp,
                      sum(m) OVER (PARTITION BY lang ORDER BY score DESC) AS cn FROM g),
         a AS (SELECT lang, sum(tp * (CAST(ctp AS DOUBLE) / cn)) AS area FROM w GROUP BY lang)
    SELECT c.lang, n, CAST(p AS BIGINT) AS n_pos,
           CASE WHEN p > 0 AND p < n THEN (s - p * (p + 1) / 2.0) / (p * (n - p)) END::DOUBLE AS auroc,
           CASE WHEN p > 0 AND p < n THEN area / p END::DOUBLE AS aupr
    FROM c JOIN a ON c.lang = a.lang"""


@query("st11_st12_auroc_aupr", CURVE, "auroc aupr", "labelled")
def _(t):
    return stats.roc_pr(S.labelled(t), "quality", "score", ["lang"])


POSITIONAL = """
    WITH p AS (SELECT lang, quality AS y, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS r FROM labelled),
         h AS (SELECT *, sum(y) OVER (PARTITION BY lang ORDER BY r) AS hit,
                      row_number() OVER (PARTITION BY lang ORDER BY y DESC, r) AS ideal FROM p)
    SELECT lang, count(*) AS n_ranked, CAST(sum(y) AS BIGINT) AS n_pos,
           avg(CAST(hit AS DOUBLE) / r) FILTER (WHERE y = 1) AS ap,
           sum(CASE WHEN r <= 10 THEN y / log2(r + 1) ELSE 0 END) / nullif(sum(CASE WHEN ideal <= 10 THEN y / log2(ideal + 1) ELSE 0 END), 0) AS ndcg_at_10,
           sum(CASE WHEN r <= 50 THEN y / log2(r + 1) ELSE 0 END) / nullif(sum(CASE WHEN ideal <= 50 THEN y / log2(ideal + 1) ELSE 0 END), 0) AS ndcg_at_50,
           CAST(sum(CASE WHEN r <= 10 THEN y ELSE 0 END) AS DOUBLE) / nullif(sum(y), 0) AS recall_at_10,
           CAST(sum(CASE WHEN r <= 50 THEN y ELSE 0 END) AS DOUBLE) / nullif(sum(y), 0) AS recall_at_50
    FROM h GROUP BY lang"""


@query("st13_average_precision", "SELECT lang, n_ranked, n_pos, ap FROM (" + POSITIONAL + ")", "ap", "labelled")
def _(t):
    return stats.average_precision(S.labelled(t), "quality", "score", ["lang"], "doc_id").select(
        "lang", "n_ranked", "n_pos", "ap")


@query("st14_ndcg_recall", POSITIONAL, "ap ndcg_at_10 ndcg_at_50 recall_at_10 recall_at_50", "labelled")
def _(t):
    return stats.positional_metrics(S.labelled(t), "quality", "score", ["lang"], "doc_id", [10, 50])


@query("st15_projection", """
    SELECT scope, sum(s * a) / sqrt(sum(a * a)) AS projection, sum(s * a) / sqrt(sum(a * a)) / sqrt(sum(s * s)) AS cosine,
           sqrt(sum(s * s)) AS shift_norm, count(*) AS n_common
    FROM (SELECT scope, predicted_shift AS s, real_shift AS a FROM shifts) GROUP BY scope""",
       "projection cosine shift_norm", "shifts")
def _(t):
    return stats.project(S.shifts(t), "predicted_shift", "real_shift", ["scope"]).drop("shift_l2")


@query("st16_norm_share", """
    SELECT l_returnflag AS scope, sum(CASE WHEN l_discount >= 0.05 THEN l_quantity * l_quantity ELSE 0 END) / sum(l_quantity * l_quantity) AS share
    FROM lineitem GROUP BY 1""", "share")
def _(t):
    li = t.lineitem.withColumn("scope", F.col("l_returnflag"))
    return stats.norm_share(li, "l_quantity", F.col("l_discount") >= 0.05, ["scope"])


@query("ag9_centrality", f"""
    WITH c AS (SELECT scope, tf, sum(weight) AS colsum FROM edges GROUP BY 1, 2)
    SELECT scope, tf, colsum, {avg_rank_sql('colsum', 'scope')} / count(*) OVER (PARTITION BY scope) AS centrality FROM c""",
       "colsum centrality", "edges")
def _(t):
    return aggregates.centrality(S.edges(t), ["scope"])


WILSON = """
    SELECT {by} n_signed, n_correct, CAST(n_correct AS DOUBLE) / n_signed AS sign_accuracy,
           ((n_correct / n_signed + 1.96 * 1.96 / (2 * n_signed)) - 1.96 * sqrt((n_correct / n_signed) * (1 - n_correct / n_signed) / n_signed
             + 1.96 * 1.96 / (4 * n_signed * n_signed))) / (1 + 1.96 * 1.96 / n_signed) AS ci_lo,
           ((n_correct / n_signed + 1.96 * 1.96 / (2 * n_signed)) + 1.96 * sqrt((n_correct / n_signed) * (1 - n_correct / n_signed) / n_signed
             + 1.96 * 1.96 / (4 * n_signed * n_signed))) / (1 + 1.96 * 1.96 / n_signed) AS ci_hi{extra}
    FROM ({src})"""


@query("ag14_sign_accuracy", """
    WITH c AS (SELECT lang AS scope, count(*) AS n_signed, sum(CAST(sign(score - 2000) = e AS INTEGER)) AS n_correct,
                      greatest(avg(CAST(e = 1 AS DOUBLE)), avg(CAST(e = -1 AS DOUBLE))) AS m
               FROM (SELECT lang, score, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS e FROM labelled) GROUP BY 1),
         d AS (SELECT scope, n_signed, CAST(n_correct AS BIGINT) AS n_correct, CAST(n_correct AS DOUBLE) / n_signed AS ph,
                      CAST(n_signed AS DOUBLE) AS n, m FROM c)
    SELECT scope, n_signed, n_correct, ph AS sign_accuracy,
           (ph + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(ph * (1 - ph) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n) AS ci_lo,
           (ph + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(ph * (1 - ph) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n) AS ci_hi,
           m AS majority_class_rate
    FROM d""", "sign_accuracy ci_lo ci_hi majority_class_rate", "labelled")
def _(t):
    d = S.labelled(t).select(F.col("lang").alias("scope"), (F.col("score") - 2000).alias("s"),
                             F.when(F.col("quality") == 1, 1).otherwise(-1).alias("e"))
    return stats.sign_accuracy(d, "s", "e", ["scope"])


@query("sc12_numbers", """
    WITH k AS (SELECT source, CAST(sum(quality) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n, avg(score) AS s FROM labelled GROUP BY source)
    SELECT source, ((k / n) + 3.8416 / (2 * n) - 1.96 * sqrt((k / n) * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n) AS lo,
           ((k / n) + 3.8416 / (2 * n) + 1.96 * sqrt((k / n) * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n) AS hi,
           ln(1 + s) AS log_score, CAST(sign(k - n / 2) AS DOUBLE) AS side, greatest(0.0, least(1.0, (k - n / 3) / 10)) AS clipped
    FROM k""", "lo hi log_score side clipped", "labelled")
def _(t):
    from shiftgrid.functions.scalars import clip01

    d = S.labelled(t).groupBy("source").agg(F.sum("quality").cast("double").alias("k"),
                                            F.count(F.lit(1)).cast("double").alias("n"), F.avg("score").alias("s"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return d.select("source", lo.alias("lo"), hi.alias("hi"), F.log1p("s").alias("log_score"),
                    F.signum(F.col("k") - F.col("n") / 2).alias("side"), clip01((F.col("k") - F.col("n") / 3) / 10).alias("clipped"))


@query("st23_consistency", f"""
    WITH p AS (SELECT a.scope, a.item AS item, a.value AS x, b.value AS y FROM vecs a JOIN vecs b ON a.item = b.item
               WHERE a.scope <> 'N' AND b.scope = 'N'),
         r AS (SELECT *, {avg_rank_sql('x', 'scope')} AS rx, {avg_rank_sql('y', 'scope')} AS ry FROM p)
    SELECT scope, corr(rx, ry) AS rho, count(*) AS n, avg(CAST(sign(x) = sign(y) AS DOUBLE)) AS sign_agrees, avg(x / y) AS mean_ratio,
           sqrt(sum(x * x)) AS norm_a, sqrt(sum(y * y)) AS norm_b FROM r GROUP BY scope""",
       "rho sign_agrees mean_ratio norm_a norm_b", "vecs")
def _(t):
    v = S.vecs(t)
    return stats.consistency(v.where("scope <> 'N'"), v.where("scope = 'N'"), ["item"], "value", ["scope"])


PAIRS = f"""
    WITH p AS (SELECT a.scope AS scope_a, b.scope AS scope_b, a.value AS x, b.value AS y
               FROM vecs a JOIN vecs b ON a.item = b.item AND a.scope < b.scope),
         r AS (SELECT scope_a, scope_b, {avg_rank_sql('x', 'scope_a, scope_b')} AS rx, {avg_rank_sql('y', 'scope_a, scope_b')} AS ry FROM p)
    SELECT scope_a, scope_b, corr(rx, ry) AS rho, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) >= 10"""


@query("jn12_pairwise_spearman", PAIRS, "rho", "vecs")
def _(t):
    return stats.pairwise_spearman(S.vecs(t), "scope", "item", "value")


@query("jn12_scope_structure", f"""
    WITH q AS ({PAIRS}), b AS (SELECT scope_a AS scope, scope_b AS o, rho FROM q UNION ALL SELECT scope_b, scope_a, rho FROM q)
    SELECT v.scope, vector_scale, structure_rho, reference_rho FROM
      (SELECT scope, quantile_cont(abs(value), 0.5) AS vector_scale FROM vecs GROUP BY scope) v
      LEFT JOIN (SELECT scope, quantile_cont(rho, 0.5) FILTER (WHERE o <> 'N') AS structure_rho,
                        max(rho) FILTER (WHERE o = 'N') AS reference_rho FROM b GROUP BY scope) m ON v.scope = m.scope""",
       "vector_scale structure_rho reference_rho", "vecs")
def _(t):
    return stats.scope_structure(S.vecs(t), "scope", "item", "value", "N").select(
        "scope", "vector_scale", "structure_rho", "reference_rho")


@query("rp6_vector_support", f"""
    WITH p AS (SELECT o.scope, r.value AS ref, o.value AS own FROM vecs o JOIN vecs r ON o.item = r.item
               WHERE r.scope = 'N' AND o.scope <> 'N'),
         k AS (SELECT *, {avg_rank_sql('ref', 'scope')} AS ra, {avg_rank_sql('own', 'scope')} AS rb,
                      rank() OVER (PARTITION BY scope ORDER BY abs(ref) DESC) <= least(200, count(*) OVER (PARTITION BY scope) // 2) AS y,
                      abs(own) AS s FROM p),
         l AS (SELECT *, {avg_rank_sql('s', 'scope')} AS rs FROM k),
         c AS (SELECT scope, corr(ra, rb) AS rho, count(*) AS n, sum(CAST(y AS INTEGER)) AS np, sum(rs) FILTER (WHERE y) AS sr FROM l GROUP BY scope),
         g AS (SELECT scope, s, sum(CAST(y AS INTEGER)) AS tp, count(*) AS m FROM l GROUP BY 1, 2),
         w AS (SELECT scope, tp, sum(tp) OVER (PARTITION BY scope ORDER BY s DESC) AS ctp, sum(m) OVER (PARTITION BY scope ORDER BY s DESC) AS cn FROM g),
         a AS (SELECT scope, sum(tp * (CAST(ctp AS DOUBLE) / cn)) AS area FROM w GROUP BY scope)
    SELECT c.scope, rho, n, ((sr - np * (np + 1) / 2.0) / (np * (n - np)))::DOUBLE AS auroc, (area / np)::DOUBLE AS aupr
    FROM c JOIN a ON c.scope = a.scope""", "rho auroc aupr", "vecs")
def _(t):
    v = S.vecs(t)
    return validation.vector_support(v.where("scope = 'N'"), v.where("scope <> 'N'"), "scope", "item", "value").select(
        "scope", "rho", "n", "auroc", "aupr")
