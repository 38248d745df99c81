"""Bootstrap, permutation and matched nulls, with the same keyed draws in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftgrid.operators import enrichment, ordered, ranks, resample, stats
from shiftgrid.plans import metrics, validation
from workload import standins as S
from workload.ranking import avg_rank_sql
from workload.registry import query

B = 200


def key_sql(*parts: object) -> str:
    return "CAST('0x' || substr(md5(concat_ws('|', " + ", ".join(str(p) for p in parts) + ")), 1, 15) AS BIGINT)"


def reps(n: int = B) -> str:
    return f"range(1, {n + 1}) t(b)"


def boot_sql(seed: int, n: int = B, src: str = "shifts", by: str = "scope", key: str = "gene", keep: str = "*") -> str:
    """CTEs pos and boot: the drawn rows of every replicate."""
    on = " AND ".join(f"d.{c.strip()} = p.{c.strip()}" for c in by.split(","))
    return f"""pos AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {key}) AS pos, count(*) OVER (PARTITION BY {by}) AS n FROM {src}),
    boot AS (SELECT d.b, p.* FROM (SELECT {by}, b, {key_sql(seed, by, 'b', 'pos')} % n + 1 AS idx FROM pos, {reps(n)}) d
             JOIN pos p ON {on} AND d.idx = p.pos)"""


@query("rs1_bootstrap_mean", f"""
    WITH {boot_sql(11)}, m AS (SELECT scope, b, avg(real_shift) AS mean FROM boot GROUP BY 1, 2)
    SELECT scope, quantile_cont(mean, 0.025) AS mean_ci_lo, quantile_cont(mean, 0.975) AS mean_ci_hi FROM m GROUP BY scope""",
       "mean_ci_lo mean_ci_hi", "shifts")
def _(t):
    return resample.intervals(resample.bootstrap_mean(S.shifts(t), ["scope"], "gene", "real_shift", B, 11), ["scope"], ["mean"])


def excess_sql(seed: int, n: int) -> str:
    r = {c: avg_rank_sql(c, "scope") for c in ("real_shift", "predicted_shift", "level")}
    rb = {c: avg_rank_sql(c, "scope, b") for c in ("real_shift", "predicted_shift", "level")}
    return f"""{boot_sql(seed, n)},
      rk AS (SELECT scope, predicted_shift, {r['real_shift']} AS a, {r['predicted_shift']} AS p, {r['level']} AS l FROM shifts),
      pt AS (SELECT scope, count(*) AS n_genes, stddev_samp(predicted_shift) AS pred_shift_sd, corr(a, p) AS rho, abs(corr(a, l)) AS level_null FROM rk GROUP BY scope),
      rb AS (SELECT scope, b, {rb['real_shift']} AS a, {rb['predicted_shift']} AS p, {rb['level']} AS l FROM boot),
      eb AS (SELECT scope, b, corr(a, p) AS rho, corr(a, p) - abs(corr(a, l)) AS excess FROM rb GROUP BY 1, 2),
      ci AS (SELECT scope, quantile_cont(rho, 0.025) AS rho_ci_lo, quantile_cont(rho, 0.975) AS rho_ci_hi,
                    quantile_cont(excess, 0.025) AS excess_ci_lo, quantile_cont(excess, 0.975) AS excess_ci_hi FROM eb GROUP BY scope),
      ex AS (SELECT pt.scope, n_genes, pred_shift_sd, rho, level_null, rho - level_null AS excess, rho_ci_lo, rho_ci_hi, excess_ci_lo, excess_ci_hi
             FROM pt JOIN ci ON pt.scope = ci.scope)"""


EXCESS = "pred_shift_sd rho level_null excess rho_ci_lo rho_ci_hi excess_ci_lo excess_ci_hi"


@query("rp3_excess", f"WITH {excess_sql(0, B)} SELECT * FROM ex", EXCESS, "shifts")
def _(t):
    return validation.excess(S.shifts(t), ["scope"], "gene", B, 0)


@query("rp4_verdict", f"""
    WITH {excess_sql(0, 200)} SELECT *, CASE WHEN NOT (n_genes >= 100 AND pred_shift_sd >= 1e-6) THEN 'NOT_EVALUABLE'
      WHEN excess_ci_lo > 0.05 THEN 'PASS' WHEN excess_ci_hi < 0.05 THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS verdict, 'bootstrap_excess' AS verdict_basis FROM ex""",
       EXCESS, "shifts")
def _(t):
    return validation.judged(validation.excess(S.shifts(t), ["scope"], "gene", 200, 0))


@query("rp4_negative_control", f"""
    WITH {excess_sql(3, B)} SELECT *, CASE WHEN NOT (n_genes >= 100 AND pred_shift_sd >= 1e-6) THEN 'NOT_EVALUABLE'
      WHEN rho_ci_hi < 0.05 THEN 'PASS' WHEN rho_ci_lo > 0.05 THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS verdict, 'bootstrap_raw_rho' AS verdict_basis FROM ex""",
       EXCESS, "shifts")
def _(t):
    return validation.judged(validation.excess(S.shifts(t), ["scope"], "gene", B, 3), invert=F.lit(True))


@query("rp5_gate", f"""
    WITH {excess_sql(0, B)}, v AS (SELECT scope, CASE WHEN excess_ci_lo > 0.05 THEN 'PASS' WHEN excess_ci_hi < 0.05 THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS verdict FROM ex)
    SELECT scope, verdict, CASE WHEN scope = 'O' THEN 'SCOPE_FAILS_SANITY' ELSE verdict END AS pass_fail FROM v""", "", "shifts")
def _(t):
    v = validation.judged(validation.excess(S.shifts(t), ["scope"], "gene", B, 0))
    return validation.gate(v.withColumn("sanity_pass", F.when(F.col("scope") == "F", True))).select("scope", "verdict", "pass_fail")


@query("rs2_permutation_null", f"""
    WITH z AS (SELECT scope, gene, (real_shift - avg(real_shift) OVER w) / stddev_pop(real_shift) OVER w AS zr,
                      (predicted_shift - avg(predicted_shift) OVER w) / stddev_pop(predicted_shift) OVER w AS zp, row_number() OVER (PARTITION BY scope ORDER BY gene) AS pos
               FROM shifts WINDOW w AS (PARTITION BY scope)),
         s AS (SELECT scope, b, zp, row_number() OVER (PARTITION BY scope, b ORDER BY {key_sql(5, 'scope', 'b', 'gene')}, gene) AS pos FROM z, {reps()}),
         e AS (SELECT s.scope, b, corr(s.zp, z.zr) AS pcc, sqrt(avg((s.zp - z.zr) * (s.zp - z.zr))) AS rmse FROM s JOIN z ON s.scope = z.scope AND s.pos = z.pos GROUP BY 1, 2)
    SELECT scope, avg(pcc) AS perm_pcc_mean, quantile_cont(pcc, 0.95) AS perm_pcc_p95, avg(rmse) AS perm_rmse_mean, quantile_cont(rmse, 0.05) AS perm_rmse_p05 FROM e GROUP BY scope""",
       "perm_pcc_mean perm_pcc_p95 perm_rmse_mean perm_rmse_p05", "shifts")
def _(t):
    z = stats.zscore_many(S.shifts(t), {"zr": "real_shift", "zp": "predicted_shift"}, ["scope"])
    return resample.permutation_null(z, ["scope"], "gene", "zr", "zp", B, 5)


@query("rs3_stratified_permutation", f"""
    WITH d AS (SELECT 'all' AS grp, lang, doc_id, quality AS y, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM labelled),
         h AS (SELECT b, grp, lang, place, row_number() OVER (PARTITION BY b, lang ORDER BY {key_sql(9, 'grp', 'b', 'doc_id')}, doc_id) AS i FROM d, {reps()}),
         l AS (SELECT lang, y, row_number() OVER (PARTITION BY lang ORDER BY y DESC, doc_id) AS i FROM d),
         p AS (SELECT b, place, y FROM h JOIN l USING (lang, i) WHERE y = 1),
         n AS (SELECT b, avg(hit * 1.0 / place) AS ap FROM (SELECT b, place, row_number() OVER (PARTITION BY b ORDER BY place) AS hit FROM p) GROUP BY b),
         o AS (SELECT avg(hit * 1.0 / place) AS ap FROM (SELECT place, row_number() OVER (ORDER BY place) AS hit FROM d WHERE y = 1))
    SELECT 'all' AS grp, o.ap AS observed, avg(n.ap) AS null_mean, o.ap / avg(n.ap) AS enrichment,
           (count(*) FILTER (WHERE n.ap >= o.ap - 1e-12) + 1.0) / (count(*) + 1.0) AS p_value FROM n, o GROUP BY o.ap""",
       "observed null_mean enrichment p_value", "labelled")
def _(t):
    d = S.labelled(t).select(F.lit("all").alias("grp"), "lang", "doc_id", F.col("quality").alias("y"), F.col("score").alias("rank_score"))
    observed = stats.average_precision(d, "y", "rank_score", ["grp"], "doc_id")
    listed = ordered.group_size(ordered.numbered(d, ["grp"], ["-rank_score", "doc_id"], "_position"), ["grp"], "n_ranked")
    null = metrics.null_ranking(listed, ["grp"], "lang", "doc_id", [], B, 9)
    return resample.null_summary(observed, null, ["grp"], "ap")


@query("rs4_matched_sets", f"""
    WITH d AS (SELECT *, least(9, greatest(0, ((r - 1) * 10 + n - 2) // greatest(1, n - 1) - 1)) AS decile FROM (
           SELECT scope, gene, real_shift, p_brand = 'Brand#13' AS panel, row_number() OVER (PARTITION BY scope ORDER BY level, gene) AS r, count(*) OVER (PARTITION BY scope) AS n
           FROM shifts JOIN part ON gene = p_partkey)),
         p AS (SELECT *, row_number() OVER (PARTITION BY scope, decile ORDER BY gene) AS pos, count(*) OVER (PARTITION BY scope, decile) AS m FROM d),
         w AS (SELECT scope, decile, b, {key_sql(4, 'scope', 'b', 'gene')} % m + 1 AS pos FROM p, {reps()} WHERE panel),
         x AS (SELECT w.scope, b, avg(real_shift) AS mean FROM w JOIN p USING (scope, decile, pos) GROUP BY 1, 2)
    SELECT scope, count(*) AS n, quantile_cont(mean, 0.95) AS threshold FROM x GROUP BY scope""", "threshold", "shifts")
def _(t):
    d = ranks.deciles(S.shifts(t).join(t.part.select(F.col("p_partkey").alias("gene"), "p_brand"), "gene"), "level", ["scope"], "gene")
    m = resample.matched_sets(d, ["scope"], "decile", "gene", "real_shift", F.col("p_brand") == "Brand#13", B, 4)
    return m.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.percentile("mean", F.lit(0.95)).alias("threshold"))


def walk_sql(src: str, key: str) -> str:
    """ES per key from rows (key, position, weight, n_list)."""
    return f"""SELECT {key}, count(*) AS size, max(n_list) AS n_list,
        CASE WHEN max(nr) <= 0 THEN 0.0 WHEN greatest(max(cw / nr - (position - i) / (n_list - k)), 0) >= abs(least(min((cw - weight) / nr - (position - i) / (n_list - k)), 0))
             THEN greatest(max(cw / nr - (position - i) / (n_list - k)), 0) ELSE least(min((cw - weight) / nr - (position - i) / (n_list - k)), 0) END AS es
      FROM (SELECT *, sum(weight) OVER (PARTITION BY {key} ORDER BY position) AS cw, sum(weight) OVER (PARTITION BY {key}) AS nr,
                   CAST(row_number() OVER (PARTITION BY {key} ORDER BY position) AS DOUBLE) AS i, CAST(count(*) OVER (PARTITION BY {key}) AS DOUBLE) AS k FROM {src})
      GROUP BY {key}"""


LISTED = """li AS (SELECT scope, gene, row_number() OVER (PARTITION BY scope ORDER BY {c} DESC, gene) AS position, abs({c}) AS weight, count(*) OVER (PARTITION BY scope) AS n_list FROM {src})"""
SETS = "gs AS (SELECT p_brand AS set_name, p_partkey AS gene FROM part)"


def sets(t):
    return t.part.select(F.col("p_brand").alias("set_name"), F.col("p_partkey").alias("gene"))


@query("wn8_enrichment", f"""
    WITH {LISTED.format(c='real_shift', src='shifts')}, {SETS}, h AS (SELECT li.*, set_name FROM li JOIN gs USING (gene))
    SELECT scope, set_name, size, n_list, es FROM ({walk_sql('h', 'scope, set_name')}) WHERE size >= 5 AND size < n_list - 5""", "es", "shifts")
def _(t):
    return enrichment.enrichment(S.shifts(t), ["scope"], "gene", "real_shift", sets(t))


def nes_sql(tag: str, col: str, seed: int, src: str = "shifts", n: int = B) -> str:
    return f"""{LISTED.format(c=col, src=src).replace('li AS', f'li{tag} AS')},
      es{tag} AS (SELECT scope, set_name, size, es FROM ({walk_sql(f"(SELECT li{tag}.*, set_name FROM li{tag} JOIN gs USING (gene))", 'scope, set_name')}) WHERE size >= 5 AND size < n_list - 5),
      rnd{tag} AS (SELECT scope, b, position, weight, n_list, row_number() OVER (PARTITION BY scope, b ORDER BY {key_sql(seed, 'scope', 'b', 'gene')}, gene) AS spot FROM li{tag}, {reps(n)}),
      hit{tag} AS (SELECT r.scope, s.size AS set_size, b, position, weight, n_list FROM rnd{tag} r JOIN (SELECT DISTINCT scope, size FROM es{tag}) s ON r.scope = s.scope AND spot <= s.size),
      nul{tag} AS (SELECT scope, set_size, b, es FROM ({walk_sql(f'hit{tag}', 'scope, set_size, b')})),
      den{tag} AS (SELECT scope, set_size AS size, avg(abs(es)) FILTER (WHERE es >= 0) AS pos, avg(abs(es)) FILTER (WHERE es < 0) AS neg FROM nul{tag} GROUP BY 1, 2),
      nes{tag} AS (SELECT e.scope, set_name, e.size, e.es, CASE WHEN e.es >= 0 THEN e.es / nullif(pos, 0) ELSE e.es / nullif(neg, 0) END AS nes FROM es{tag} e JOIN den{tag} d ON e.scope = d.scope AND e.size = d.size)"""


@query("rs5_normalised_enrichment", f"WITH {SETS}, {nes_sql('', 'real_shift', 21)} SELECT * FROM nes", "es nes", "shifts")
def _(t):
    return enrichment.normalised_enrichment(S.shifts(t), ["scope"], "gene", "real_shift", sets(t), B, 21)


ZS = """zs AS (SELECT scope, gene, (real_shift - avg(real_shift) OVER w) / stddev_pop(real_shift) OVER w AS zr,
               (predicted_shift - avg(predicted_shift) OVER w) / stddev_pop(predicted_shift) OVER w AS zp FROM shifts WINDOW w AS (PARTITION BY scope))"""


@query("rp13_pathway_agreement", f"""
    WITH {SETS}, {ZS}, {nes_sql('a', 'zr', 2, 'zs')}, {nes_sql('b', 'zp', 3, 'zs')},
      j AS (SELECT a.scope, a.nes AS x, b.nes AS y FROM nesa a JOIN nesb b ON a.scope = b.scope AND a.set_name = b.set_name WHERE a.nes IS NOT NULL AND b.nes IS NOT NULL),
      r AS (SELECT *, {avg_rank_sql('x', 'scope')} AS rx, {avg_rank_sql('y', 'scope')} AS ry FROM j)
    SELECT scope, CASE WHEN count(*) > 3 THEN corr(rx, ry) END AS nes_spearman, count(*) AS n_sets, CAST(count(*) FILTER (WHERE abs(x) >= 1.5) AS BIGINT) AS n_strong_real,
           avg(CAST(sign(x) = sign(y) AS DOUBLE)) FILTER (WHERE abs(x) >= 1.5) AS nes_sign_agree_strong FROM r GROUP BY scope""",
       "nes_spearman nes_sign_agree_strong", "shifts")
def _(t):
    return metrics.pathway_agreement(S.shifts(t), ["scope"], "gene", sets(t), B, 2)


SCREEN_SQL = f"""
    st AS (SELECT s_suppkey AS tf, CASE WHEN s_suppkey % 5 = 0 THEN 'oe' ELSE 'ko' END AS mode, s_suppkey % 7 <> 0 AS usable FROM supplier),
    p AS (SELECT m.scope, e.tf, -e.weight AS s, m.real AS r FROM (SELECT l_returnflag AS scope, l_partkey AS gene, avg(l_quantity) AS real FROM lineitem GROUP BY 1, 2) m
          JOIN edges e ON m.scope = e.scope AND m.gene = e.target JOIN st ON st.tf = e.tf WHERE st.mode = 'ko' AND st.usable AND st.tf NOT IN (3, 4)),
    k AS (SELECT scope, tf, {avg_rank_sql('s', 'scope, tf')} AS a, {avg_rank_sql('r', 'scope, tf')} AS b FROM p),
    c AS (SELECT scope, tf, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS rho FROM k GROUP BY 1, 2),
    o AS (SELECT * FROM (VALUES ('A', 0.3), ('N', 0.02), ('R', -0.9)) v(scope, rho)),
    nl AS (SELECT c.scope, count(c.rho) AS null_n, quantile_cont(c.rho, 0.5) AS null_median, quantile_cont(c.rho, 0.95) AS null_p95, avg(CAST(c.rho < o.rho AS DOUBLE)) AS null_pctile
           FROM c JOIN o ON c.scope = o.scope WHERE c.rho IS NOT NULL GROUP BY 1)"""


def screen_rows(t):
    """Stand-in of a screen: suppliers are factors, each with one variant; some are of another mode or not usable."""
    m = t.lineitem.groupBy(F.col("l_returnflag").alias("scope"), F.col("l_partkey").alias("gene")).agg(F.avg("l_quantity").alias("real"))
    screen = S.edges(t).select("scope", F.col("target").alias("gene"), F.col("tf").alias("variant"), F.col("weight").alias("shift"))
    tf = F.col("s_suppkey")
    status = t.supplier.select(tf.alias("variant"), tf.alias("tf"), F.when(tf % 5 == 0, "oe").otherwise("ko").alias("mode"), (tf % 7 != 0).alias("usable"))
    observed = m.select("scope").distinct().withColumn("rho", F.when(F.col("scope") == "A", 0.3).when(F.col("scope") == "N", 0.02).otherwise(-0.9))
    return m, screen, status, observed


def held_null(t):
    m, screen, status, observed = screen_rows(t)
    return observed, resample.screen_null(m, screen, status, ["scope"], "gene", "real", "shift", observed, "ko", [3, 4], -1.0)


@query("rs6_screen_null", f"WITH {SCREEN_SQL} SELECT * FROM nl", "null_median null_p95 null_pctile", "edges")
def _(t):
    return held_null(t)[1]


@query("rp4_empirical_null", f"""
    WITH {SCREEN_SQL} SELECT o.scope, CAST(o.rho AS DOUBLE) AS rho, null_n, null_pctile, CASE WHEN null_pctile < 0.95 THEN 'PASS' ELSE 'FAIL' END AS verdict, 'empirical_null' AS verdict_basis
    FROM o JOIN nl ON o.scope = nl.scope""", "rho null_pctile", "edges")
def _(t):
    observed, null = held_null(t)
    rows = observed.join(null, "scope").withColumns({
        "n_genes": F.lit(1_000), "pred_shift_sd": F.lit(1.0), **{c: F.col("rho") for c in ("rho_ci_lo", "rho_ci_hi", "excess_ci_lo", "excess_ci_hi")}})
    return validation.judged(rows, invert=F.lit(True)).select("scope", "rho", "null_n", "null_pctile", "verdict", "verdict_basis")


@query("rs7_shuffle_null", f"""
    WITH p AS (SELECT scope, gene, predicted_shift AS s, real_shift AS a, row_number() OVER (PARTITION BY scope ORDER BY gene) AS pos FROM shifts),
         m AS (SELECT scope, b, a, row_number() OVER (PARTITION BY scope, b ORDER BY {key_sql(8, 'scope', 'b', 'gene')}, gene) AS pos FROM p, {reps()}),
         r AS (SELECT m.scope, b, sum(p.s * m.a) / sqrt(sum(m.a * m.a)) AS projection FROM m JOIN p ON m.scope = p.scope AND m.pos = p.pos GROUP BY 1, 2)
    SELECT scope, count(*) AS n, quantile_cont(projection, 0.95) AS p95, quantile_cont(projection, 0.05) AS p05 FROM r GROUP BY scope""", "p95 p05", "shifts")
def _(t):
    r = resample.shuffle_null(S.shifts(t), ["scope"], "gene", "predicted_shift", "real_shift", B, 8)
    return r.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.percentile("projection", F.lit(0.95)).alias("p95"),
                                  F.percentile("projection", F.lit(0.05)).alias("p05"))


@query("rs8_bootstrap_panels", f"""
    WITH src AS (SELECT scope, p_brand AS panel, gene, real_shift FROM shifts JOIN part ON gene = p_partkey WHERE p_brand IN ('Brand#11', 'Brand#13')),
         {boot_sql(6, src='src', by='scope, panel')}, m AS (SELECT scope, panel, b, avg(real_shift) AS mean FROM boot GROUP BY 1, 2, 3),
         d AS (SELECT scope, b, max(mean) FILTER (WHERE panel = 'Brand#11') - max(mean) FILTER (WHERE panel = 'Brand#13') AS difference FROM m GROUP BY 1, 2)
    SELECT scope, quantile_cont(difference, 0.025) AS difference_ci_lo, quantile_cont(difference, 0.975) AS difference_ci_hi FROM d GROUP BY scope""",
       "difference_ci_lo difference_ci_hi", "shifts")
def _(t):
    s = S.shifts(t).join(t.part.select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("panel")), "gene")
    d = resample.bootstrap_panels(s, ["scope"], "panel", "Brand#11", "Brand#13", "gene", "real_shift", B, 6)
    return resample.intervals(d, ["scope"], ["difference"])


BASE = f"""{ZS.replace('zs AS (SELECT scope, gene,', 'zq AS (SELECT scope, gene, real_shift, predicted_shift, (level - avg(level) OVER w) / stddev_pop(level) OVER w AS zl0,')},
    sd AS (SELECT scope, CASE WHEN corr(zl0, zr) >= 0 THEN 1 ELSE -1 END AS side FROM zq GROUP BY 1),
    zz AS (SELECT zq.*, side * zl0 AS zl, row_number() OVER (PARTITION BY zq.scope ORDER BY abs(real_shift) DESC, gene) AS top FROM zq JOIN sd ON zq.scope = sd.scope)"""


@query("st10_baselines", f"""
    WITH {BASE} SELECT scope, count(*) AS n_genes, corr(zp, zr) AS pcc, sqrt(avg((zp - zr) * (zp - zr))) AS rel_rmse, sqrt(avg(zr * zr)) AS nochange_rel_rmse,
      abs(corr(zl, zr)) AS level_pcc, sqrt(avg((zl - zr) * (zl - zr))) AS level_rel_rmse,
      avg(CAST(sign(predicted_shift) = sign(real_shift) AS DOUBLE)) FILTER (WHERE predicted_shift <> 0 AND top <= 100) AS deg_conc_100,
      avg(CAST(sign(zl) = sign(real_shift) AS DOUBLE)) FILTER (WHERE zl <> 0 AND top <= 100) AS level_deg_conc_100,
      avg(CAST(sign(predicted_shift) = sign(real_shift) AS DOUBLE)) FILTER (WHERE predicted_shift <> 0 AND top <= 300) AS deg_conc_300,
      avg(CAST(sign(zl) = sign(real_shift) AS DOUBLE)) FILTER (WHERE zl <> 0 AND top <= 300) AS level_deg_conc_300
    FROM zz GROUP BY scope""",
       "pcc rel_rmse nochange_rel_rmse level_pcc level_rel_rmse deg_conc_100 level_deg_conc_100 deg_conc_300 level_deg_conc_300", "shifts")
def _(t):
    return metrics.baselines(S.shifts(t), ["scope"], "gene")


# a contrast here is a scope, and every scope is a dataset of its own
LOCO = """so AS (SELECT a.scope, b.scope AS other, a.gene, b.real_shift AS value FROM shifts a JOIN shifts b ON a.gene = b.gene AND a.scope <> b.scope),
    mo AS (SELECT scope, other, avg(value) AS mu, stddev_pop(value) AS sd FROM so GROUP BY 1, 2 HAVING count(*) > 100),
    lo AS (SELECT so.scope, so.gene, avg(CASE WHEN sd > 0 THEN (value - mu) / sd ELSE 0 END) AS loco FROM so JOIN mo ON so.scope = mo.scope AND so.other = mo.other GROUP BY 1, 2),
    sh AS (SELECT s.scope, s.gene, real_shift, predicted_shift, level, loco FROM shifts s JOIN lo ON s.scope = lo.scope AND s.gene = lo.gene)"""
CONTRAST_KS = (100, 300)


def conc_sql(pred: str, real: str, k: int, top: str = "top") -> str:
    return f"avg(CAST(sign({pred}) = sign({real}) AS DOUBLE)) FILTER (WHERE {pred} <> 0 AND {top} <= {k})"


def ci_sql(columns: dict[str, str]) -> str:
    return ", ".join(f"quantile_cont({x}, {q}) AS {n}_ci_{s}" for n, x in columns.items() for q, s in ((0.025, "lo"), (0.975, "hi")))


CONTRAST_CI = {"pcc": "pr", "rel_rmse": "rm", "best_baseline_pcc": "bp", "best_baseline_rel_rmse": "br", "d_pcc": "pr - bp", "d_rel_rmse": "rm - br", "pcc_centroid": "ce",
               **{f"deg_conc_{k}": f"conc_{k}" for k in CONTRAST_KS}}
CONTRAST_POINT = ["pcc", "rel_rmse", "nochange_rel_rmse", "level_pcc", "level_rel_rmse", "loco_pcc", "loco_rel_rmse", "pcc_centroid",
                  *[f"{m}deg_conc_{k}" for m in ("", "level_", "loco_") for k in CONTRAST_KS], "perm_pcc_mean", "perm_pcc_p95", "perm_rmse_mean", "perm_rmse_p05",
                  *[f"perm_deg_conc_{k}_p95" for k in CONTRAST_KS]]
CONTRAST_DOUBLES = [*CONTRAST_POINT, *[f"{c}_ci_{s}" for c in CONTRAST_CI for s in ("lo", "hi")]]
CONTRAST_SQL = f"""
    WITH {LOCO}, {boot_sql(0, B, 'sh')},
      z0 AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY abs(real_shift) DESC, gene) AS top, (real_shift - avg(real_shift) OVER w) / stddev_pop(real_shift) OVER w AS zr,
                    (predicted_shift - avg(predicted_shift) OVER w) / stddev_pop(predicted_shift) OVER w AS zp, (level - avg(level) OVER w) / stddev_pop(level) OVER w AS l0,
                    (loco - avg(loco) OVER w) / stddev_pop(loco) OVER w AS zc FROM sh WINDOW w AS (PARTITION BY scope)),
      sd AS (SELECT scope, CASE WHEN corr(l0, zr) >= 0 THEN 1 ELSE -1 END AS side FROM z0 GROUP BY 1),
      z AS (SELECT z0.*, side * l0 AS zl FROM z0 JOIN sd ON z0.scope = sd.scope),
      pt AS (SELECT scope, count(*) AS n_genes, corr(zp, zr) AS pcc, sqrt(avg((zp - zr) ** 2)) AS rel_rmse, sqrt(avg(zr * zr)) AS nochange_rel_rmse, abs(corr(zl, zr)) AS level_pcc,
                    sqrt(avg((zl - zr) ** 2)) AS level_rel_rmse, corr(zc, zr) AS loco_pcc, sqrt(avg((zc - zr) ** 2)) AS loco_rel_rmse, corr(zp - zc, zr - zc) AS pcc_centroid,
                    {", ".join(f"{conc_sql(p, 'real_shift', k)} AS {m}deg_conc_{k}" for m, p in (("", "predicted_shift"), ("level_", "zl"), ("loco_", "zc")) for k in CONTRAST_KS)} FROM z GROUP BY 1),
      zn AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY gene) AS at_pos FROM z),
      sf AS (SELECT scope, b, zp AS moved, row_number() OVER (PARTITION BY scope, b ORDER BY {key_sql(0, 'scope', 'b', 'gene')}, gene) AS at_pos FROM z, {reps()}),
      pn AS (SELECT sf.scope, b, corr(moved, zr) AS c, sqrt(avg((moved - zr) ** 2)) AS r, {", ".join(f"{conc_sql('moved', 'real_shift', k)} AS c{k}" for k in CONTRAST_KS)}
             FROM sf JOIN zn ON sf.scope = zn.scope AND sf.at_pos = zn.at_pos GROUP BY 1, 2),
      pm AS (SELECT scope, avg(c) AS perm_pcc_mean, quantile_cont(c, 0.95) AS perm_pcc_p95, avg(r) AS perm_rmse_mean, quantile_cont(r, 0.05) AS perm_rmse_p05,
                    {", ".join(f"quantile_cont(c{k}, 0.95) AS perm_deg_conc_{k}_p95" for k in CONTRAST_KS)} FROM pn GROUP BY 1),
      b0 AS (SELECT *, row_number() OVER (PARTITION BY scope, b ORDER BY abs(real_shift) DESC, gene) AS top FROM boot),
      b1 AS (SELECT scope, b, corr(predicted_shift, real_shift) AS pr, abs(corr(level, real_shift)) AS lr, corr(loco, real_shift) AS cr, corr(predicted_shift, loco) AS pc,
                    {", ".join(f"{conc_sql('predicted_shift', 'real_shift', k)} AS conc_{k}" for k in CONTRAST_KS)} FROM b0 GROUP BY 1, 2),
      b2 AS (SELECT *, sqrt(2 - 2 * pr) AS rm, greatest(lr, cr) AS bp, least(sqrt(2 - 2 * lr), 1, sqrt(2 - 2 * cr)) AS br, (pr - pc - cr + 1) / sqrt((2 - 2 * pc) * (2 - 2 * cr)) AS ce FROM b1),
      ci AS (SELECT scope, {ci_sql(CONTRAST_CI)} FROM b2 GROUP BY 1)
    SELECT pt.*, pm.* EXCLUDE (scope), ci.* EXCLUDE (scope) FROM pt JOIN pm ON pt.scope = pm.scope JOIN ci ON pt.scope = ci.scope"""


@query("rp12_contrast_metrics", CONTRAST_SQL, " ".join(CONTRAST_DOUBLES), "shifts")
def _(t):
    s = S.shifts(t)
    others = stats.loco_mean(s.withColumn("dataset", F.col("scope")), "real_shift", "scope", "dataset", "gene")
    m = metrics.contrast_metrics(s.join(others, ["scope", "gene"]), ["scope"], "gene", B=B, n_perm=B, min_genes=100, loco=True)
    return m.select("scope", "n_genes", *CONTRAST_DOUBLES)


@query("st24_interaction", f"""
    WITH w AS (SELECT l_partkey AS gene, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS s1, avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS s2,
                      avg(l_quantity) FILTER (WHERE l_returnflag = 'N') AS d, avg(l_discount) FILTER (WHERE l_returnflag = 'A') AS t1,
                      avg(l_discount) FILTER (WHERE l_returnflag = 'R') AS t2, avg(l_discount) FILTER (WHERE l_returnflag = 'N') AS td FROM lineitem GROUP BY 1),
         src AS (SELECT 'x' AS grp, gene, d - (s1 + s2) AS residual, td - (t1 + t2) AS pred, s1 + s2 AS additive FROM w WHERE s1 IS NOT NULL AND s2 IS NOT NULL AND d IS NOT NULL),
         {boot_sql(1, src='src', by='grp')}, e AS (SELECT grp, b, corr(pred, residual) AS c FROM boot GROUP BY 1, 2),
         ci AS (SELECT grp, quantile_cont(c, 0.025) AS lo, quantile_cont(c, 0.975) AS hi FROM e GROUP BY 1)
    SELECT src.grp, count(*) AS n_genes, stddev_pop(residual) AS real_eps_sd, stddev_pop(pred) AS pred_eps_sd, corr(pred, residual) AS pcc_eps,
           stddev_pop(residual) / stddev_pop(additive) AS eps_to_sum_sd_ratio, max(lo) AS pcc_eps_ci_lo, max(hi) AS pcc_eps_ci_hi FROM src JOIN ci ON src.grp = ci.grp GROUP BY 1""",
       "real_eps_sd pred_eps_sd pcc_eps eps_to_sum_sd_ratio pcc_eps_ci_lo pcc_eps_ci_hi")
def _(t):
    arms = t.lineitem.groupBy(F.col("l_partkey").alias("gene"), F.col("l_returnflag").alias("arm")).agg(
        F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    real = stats.interaction(arms, "q", "gene", "arm", "A", "R", "N")
    pred = stats.interaction(arms, "d", "gene", "arm", "A", "R", "N", "pred").drop("additive")
    both = real.join(pred, "gene").withColumn("grp", F.lit("x"))
    return metrics.interaction_metrics(both, ["grp"], "gene", "residual", "pred", B, 1)
