"""Scores, screens, what-if inputs and responses, ranking against tiers, panel indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftgrid.operators import aggregates
from shiftgrid.plans import indices, metrics, scoring, whatif
from shiftgrid.session import cut
from workload import standins as S
from workload.cells import ACTIVITY
from workload.ranking import avg_rank_sql
from workload.registry import query
from workload.resampling import B, boot_sql, key_sql, reps

# ---- shared SQL: factors = suppliers, scopes = return flags -----------------------------------------------------------
SCALARS_SQL = """sc AS (SELECT * FROM (VALUES ('A', 0.8, true, 'PASS'), ('N', 0.6, true, 'FAIL'), ('R', 0.3, false, 'PASS')) v(scope, sanity_rho, sanity_pass, gate_verdict))"""
VECTOR_SQL = """vec AS (SELECT l_returnflag AS scope, l_suppkey AS tf, avg(l_discount) - 0.05 AS vector FROM lineitem GROUP BY 1, 2)"""
SHIFT_SQL = """sh AS (SELECT l_returnflag AS scope, CAST(o_orderpriority AS VARCHAR) AS ko_id, l_suppkey AS tf, avg(l_tax) - 0.04 AS shift
                      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"""
CENTRAL_SQL = f"""cs AS (SELECT scope, tf, sum(weight) AS colsum FROM edges GROUP BY 1, 2),
    ce AS (SELECT *, {avg_rank_sql('colsum', 'scope')} / count(*) OVER (PARTITION BY scope) AS centrality FROM cs)"""
MEMBERS_SQL = """mem AS (SELECT DISTINCT scope, ko_id, CAST(substr(ko_id, 1, 1) AS BIGINT) AS tf FROM sh
                        UNION SELECT DISTINCT scope, ko_id, -1 AS tf FROM sh WHERE ko_id LIKE '5%')"""


def scalars(t):
    rows = "('A', 0.8D, true, 'PASS'), ('N', 0.6D, true, 'FAIL'), ('R', 0.3D, false, 'PASS')"
    one = t.spark.sql(f"SELECT * FROM VALUES {rows} AS v(scope, sanity_rho, sanity_pass, gate_verdict)")
    conf = F.when(F.col("sanity_pass"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("sanity_rho")))).otherwise(F.lit(0.0))
    # only scopes that occur in the data
    return t.lineitem.select(F.col("l_returnflag").alias("scope")).distinct().join(one.withColumn("confidence", conf), "scope")


def vector(t):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("scope"), F.col("l_suppkey").alias("tf")).agg(
        (F.avg("l_discount") - 0.05).alias("vector"))


def ko_shift(t):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        F.col("l_returnflag").alias("scope"), F.col("o_orderpriority").alias("ko_id"), F.col("l_suppkey").alias("tf")).agg(
        (F.avg("l_tax") - 0.04).alias("shift"))


def members(t):
    k = ko_shift(t).select("scope", "ko_id").distinct()
    own = k.withColumn("tf", F.substring("ko_id", 1, 1).cast("bigint"))
    return own.unionByName(k.where("ko_id LIKE '5%'").withColumn("tf", F.lit(-1).cast("bigint")))


def scores(t):
    return scoring.perturbation_score(ko_shift(t), vector(t), S.edges(t), members(t), scalars(t), exclude=[3, 4])


SCORE_SQL = f"""{SCALARS_SQL}, {VECTOR_SQL}, {SHIFT_SQL}, {MEMBERS_SQL}, {CENTRAL_SQL},
    pr AS (SELECT sh.scope, ko_id, sum(shift * vector) / sqrt(sum(vector * vector)) AS projection, sqrt(sum(shift * shift)) AS sn, count(*) AS n_common,
                  sum(shift * vector) FILTER (WHERE sh.tf NOT IN (3, 4)) / sqrt(sum(vector * vector) FILTER (WHERE sh.tf NOT IN (3, 4))) AS projection_excl
           FROM sh JOIN vec ON sh.scope = vec.scope AND sh.tf = vec.tf GROUP BY 1, 2),
    l2 AS (SELECT scope, ko_id, sqrt(sum(shift * shift)) AS shift_l2 FROM sh GROUP BY 1, 2),
    cn AS (SELECT mem.scope, ko_id, string_agg(CAST(mem.tf AS VARCHAR), ',' ORDER BY mem.tf) AS tfs, avg(coalesce(centrality, 0)) AS centrality, sum(coalesce(colsum, 0)) AS centrality_raw, min(CAST(coalesce(colsum, 0) > 0 AS INTEGER)) AS in_net
           FROM mem LEFT JOIN ce ON mem.scope = ce.scope AND mem.tf = ce.tf GROUP BY 1, 2),
    st AS (SELECT l2.scope, l2.ko_id, tfs, CASE WHEN projection IS NULL THEN 'too_few_tfs' WHEN in_net = 0 THEN 'ko_tf_no_network' WHEN shift_l2 < 1e-5 THEN 'no_op' WHEN NOT sanity_pass THEN 'scope_fails_sanity' ELSE 'ok' END AS status,
                  projection, projection_excl, projection / sn AS cosine, shift_l2, n_common, centrality, centrality_raw, CASE WHEN sanity_pass THEN CAST(sanity_rho AS DOUBLE) ELSE 0 END AS confidence, sanity_pass, gate_verdict
           FROM l2 JOIN pr USING (scope, ko_id) JOIN cn USING (scope, ko_id) JOIN sc USING (scope)),
    score AS (SELECT *, CASE status WHEN 'ok' THEN projection * centrality * confidence WHEN 'scope_fails_sanity' THEN 0 END AS score,
                     CASE status WHEN 'ok' THEN projection_excl * centrality * confidence WHEN 'scope_fails_sanity' THEN 0 END AS score_excl FROM st)"""


@query("rp7_perturbation_score", f"""
    WITH {SCORE_SQL} SELECT scope, ko_id, tfs, status, score, score_excl, projection, cosine, shift_l2, n_common, centrality, centrality_raw, confidence, gate_verdict FROM score""",
       "score score_excl projection cosine shift_l2 centrality centrality_raw confidence", "edges")
def _(t):
    return scores(t).drop("sanity_rho", "sanity_pass", "validated_scope").withColumn("tfs", F.col("tfs"))


@query("rp7_population_vector", f"""
    WITH {SCORE_SQL}, pv AS (SELECT l_suppkey AS tf, avg(l_discount) - 0.05 AS vector FROM lineitem GROUP BY 1),
      pp AS (SELECT scope, ko_id, CASE WHEN count(*) >= 2 THEN sum(shift * vector) / sqrt(sum(vector * vector)) END AS projection_population FROM sh JOIN pv ON sh.tf = pv.tf GROUP BY 1, 2)
    SELECT score.scope, score.ko_id, status, score, projection, projection_population FROM score LEFT JOIN pp ON score.scope = pp.scope AND score.ko_id = pp.ko_id""",
       "score projection projection_population", "edges")
def _(t):
    whole = t.lineitem.groupBy(F.col("l_suppkey").alias("tf")).agg((F.avg("l_discount") - 0.05).alias("vector"))
    rows = scoring.perturbation_score(ko_shift(t), vector(t), S.edges(t), members(t), scalars(t), exclude=[3, 4], population=whole)
    return rows.select("scope", "ko_id", "status", "score", "projection", "projection_population")


@query("rp8_noop_reason", f"""
    WITH {SHIFT_SQL}, {MEMBERS_SQL}, b AS (SELECT scope, sample AS tf, avg(value) - 60 AS m FROM expr GROUP BY 1, 2)
    SELECT mem.scope, ko_id, avg(m) AS ko_tf_mean_expr, CASE WHEN max(m) IS NULL THEN 'tf_absent_from_expression_matrix' WHEN NOT max(m) > 1e-6 THEN 'tf_not_expressed_in_scope'
      ELSE 'tf_expressed_but_activity_shift_below_threshold' END AS noop_reason FROM mem LEFT JOIN b ON mem.scope = b.scope AND mem.tf = b.tf GROUP BY 1, 2""", "ko_tf_mean_expr", "expr")
def _(t):
    base = S.expr(t).select("scope", F.col("sample").alias("gene"), (F.col("value") - 60).alias("value"))
    s = ko_shift(t).select("scope", "ko_id").distinct().withColumn("status", F.lit("no_op"))
    return scoring.noop_reason(s, members(t), base).select("scope", "ko_id", "ko_tf_mean_expr", "noop_reason")


@query("tk3_top_contributors", f"""
    WITH {VECTOR_SQL}, {SHIFT_SQL}, c AS (SELECT sh.scope, ko_id, sh.tf, shift * vector / sqrt(sum(vector * vector) OVER (PARTITION BY sh.scope, ko_id)) AS x FROM sh JOIN vec ON sh.scope = vec.scope AND sh.tf = vec.tf),
      r AS (SELECT *, row_number() OVER (PARTITION BY scope, ko_id ORDER BY abs(x) DESC, tf) AS place FROM c QUALIFY place <= 3)
    SELECT scope, ko_id, string_agg(CAST(tf AS VARCHAR), ';' ORDER BY place) AS top, CAST(count(*) FILTER (WHERE tf IN (1, 2, 3)) AS BIGINT) AS n_listed_in_top FROM r GROUP BY 1, 2""")
def _(t):
    pairs = ko_shift(t).join(vector(t), ["scope", "tf"])
    sums = S.edges(t).groupBy("scope", "tf").agg(F.sum("weight").alias("colsum"))
    top = scoring.top_contributors(pairs, sums, ["scope", "ko_id"], [1, 2, 3])
    names = F.transform(F.split("top_contributors", ";"), lambda s: F.substring_index(s, "(", 1))
    return top.select("scope", "ko_id", F.array_join(names, ";").alias("top"), "n_listed_in_top")


REPORT_SQL = f"""{SCORE_SQL}, ctl AS (SELECT * FROM (VALUES ('A', 'PASS', 0.25), ('N', 'FAIL', -0.125)) v(scope, control_verdict, control_difference)),
    rk AS (SELECT *, CASE WHEN status = 'ok' THEN rank() OVER (PARTITION BY scope, status = 'ok' ORDER BY score DESC) END AS rank_in_scope,
                  CASE WHEN status = 'ok' THEN rank() OVER (PARTITION BY scope, status = 'ok' ORDER BY score_excl DESC) END AS rank_in_scope_excl FROM score),
    report AS (SELECT rk.*, (CASE WHEN rank_in_scope IS NULL THEN NULL WHEN count(rank_in_scope) OVER w > 1 THEN 1.0 - (rank_in_scope - 1.0) / (count(rank_in_scope) OVER w - 1.0) ELSE 1.0 END)::DOUBLE AS rank_pct,
                  control_verdict, CAST(control_difference AS DOUBLE) AS control_difference, status = 'ok' AND gate_verdict = 'PASS' AS headline FROM rk LEFT JOIN ctl ON rk.scope = ctl.scope WINDOW w AS (PARTITION BY rk.scope))"""


def control(t):
    return t.spark.sql("SELECT * FROM VALUES ('A', 'PASS', 0.25D), ('N', 'FAIL', -0.125D) AS v(scope, control_verdict, control_difference)")


@query("rp10_score_report", f"""
    WITH {REPORT_SQL} SELECT scope, ko_id, status, score, rank_in_scope, rank_in_scope_excl, rank_pct, control_verdict, control_difference, headline FROM report""",
       "score rank_pct control_difference", "edges")
def _(t):
    return scoring.score_report(scores(t), control(t), "A").select(
        "scope", "ko_id", "status", "score", "rank_in_scope", "rank_in_scope_excl", "rank_pct", "control_verdict", "control_difference", "headline")


@query("tk4_report_order", f"""
    WITH {REPORT_SQL} SELECT scope, ko_id, row_number() OVER (ORDER BY CASE WHEN scope = 'N' THEN 0 ELSE 1 END, scope, rank_in_scope NULLS LAST, ko_id) AS line FROM report""", "", "edges")
def _(t):
    report = scoring.score_report(scores(t), control(t), "N").select("scope", "ko_id", "rank_in_scope")
    # the report has one row per perturbation and scope; numbering it shows its order
    one = report.withColumns({"_one": F.lit(1), "_ref": (F.col("scope") != "N").cast("int"), "_null": F.col("rank_in_scope").isNull()})
    from shiftgrid.operators.ordered import numbered

    return numbered(one, ["_one"], ["_ref", "scope", "_null", "rank_in_scope", "ko_id"], "line").select("scope", "ko_id", "line")


@query("ag13_consensus", f"""
    WITH {REPORT_SQL} SELECT ko_id, CAST(count(*) FILTER (WHERE headline) AS BIGINT) AS n_headline_scopes, string_agg(scope, ',' ORDER BY scope) FILTER (WHERE headline) AS headline_scopes,
      quantile_cont(rank_in_scope::DOUBLE, 0.5) FILTER (WHERE headline) AS median_rank, quantile_cont(score, 0.5) FILTER (WHERE headline) AS median_score,
      CASE WHEN count(*) FILTER (WHERE headline AND score > 0) > count(*) FILTER (WHERE headline AND score < 0) THEN 1 WHEN count(*) FILTER (WHERE headline AND score < 0) > count(*) FILTER (WHERE headline AND score > 0) THEN -1 ELSE 0 END AS majority_sign,
      CAST(count(*) FILTER (WHERE status = 'ok') AS BIGINT) AS n_ok_scopes, max(score) FILTER (WHERE scope = 'N') AS reference_score, max(rank_in_scope) FILTER (WHERE scope = 'N') AS reference_rank,
      max(gate_verdict) FILTER (WHERE scope = 'N') AS reference_gate_verdict, quantile_cont(rank_pct, 0.5) FILTER (WHERE headline) AS median_rank_pct,
      CAST(count(*) FILTER (WHERE headline AND control_verdict = 'PASS') AS BIGINT) AS n_control_pass
    FROM report GROUP BY 1 HAVING count(*) FILTER (WHERE headline) > 0""", "median_rank median_score reference_score median_rank_pct", "edges")
def _(t):
    report = scoring.score_report(scores(t), control(t), "N")
    return aggregates.consensus(report, "ko_id", "N").select(
        "ko_id", "n_headline_scopes", "headline_scopes", "median_rank", "median_score", "majority_sign", "n_ok_scopes", "reference_score",
        "reference_rank", "reference_gate_verdict", "median_rank_pct", "n_control_pass")


# ---- screen -----------------------------------------------------------------------------------------------------------
def screen(t):
    e = S.edges(t).select("scope", F.col("tf").cast("string").alias("tf"), F.col("target").alias("gene"), "weight")
    modes = F.explode(F.array(F.struct(F.lit("ko").alias("m"), F.lit(-0.5).alias("k")), F.struct(F.lit("oe").alias("m"), F.lit(0.25).alias("k"))))
    return e.select("scope", "tf", "gene", "weight", modes.alias("v")).select(
        "scope", F.concat_ws("__", F.col("v.m"), "tf").alias("variant"), "gene", (F.col("weight") * F.col("v.k")).alias("shift"))


def text_edges(t):
    return S.edges(t).withColumn("tf", F.col("tf").cast("string"))


def screened(t):
    base = S.edges(t).groupBy("scope", F.col("target").alias("gene")).agg(F.sum("weight").alias("value"))
    act = scoring.screen_activity_shift(screen(t), base, text_edges(t), min_genes=100, parts=True)
    return scoring.screen_score(act, vector(t).withColumn("tf", F.col("tf").cast("string")), text_edges(t), scalars(t), ["3", "4"])


SCREEN_SQL = ("x0 AS (SELECT scope, target AS gene, sum(weight) AS value FROM edges GROUP BY 1, 2)," + """
    sv AS (SELECT scope, m || '__' || tf AS variant, target AS gene, weight * k AS shift FROM edges, (VALUES ('ko', -0.5), ('oe', 0.25)) v(m, k)),
    vl AS (SELECT DISTINCT scope, variant FROM sv),
    x AS (SELECT vl.scope, vl.variant AS sample, x0.gene, x0.value + coalesce(sv.shift, 0) AS value FROM vl JOIN x0 ON vl.scope = x0.scope
            LEFT JOIN sv ON sv.scope = vl.scope AND sv.variant = vl.variant AND sv.gene = x0.gene
          UNION ALL SELECT scope, '__baseline', gene, value FROM x0),""" + ACTIVITY + f""",
    shf AS (SELECT a.scope, a.sample AS variant, a.tf, a.activity - z.activity AS shift FROM act a JOIN act z ON a.scope = z.scope AND a.tf = z.tf AND z.sample = '__baseline' WHERE a.sample <> '__baseline'),
    {VECTOR_SQL}, {SCALARS_SQL}, {CENTRAL_SQL},
    pj AS (SELECT shf.scope, variant, sum(shift * vector) / sqrt(sum(vector * vector)) AS projection, sqrt(sum(shift * shift)) AS shift_l2 FROM shf JOIN vec ON shf.scope = vec.scope AND shf.tf = vec.tf GROUP BY 1, 2),
    ss AS (SELECT pj.scope, split_part(variant, '__', 1) AS mode, split_part(variant, '__', 2) AS tf, variant, projection, shift_l2, centrality,
                  CASE WHEN shift_l2 < 1e-5 THEN 'no_op' WHEN NOT sanity_pass THEN 'scope_fails_sanity' ELSE 'ok' END AS status, CASE WHEN sanity_pass THEN CAST(sanity_rho AS DOUBLE) ELSE 0 END AS confidence, gate_verdict
           FROM pj JOIN ce ON pj.scope = ce.scope AND CAST(ce.tf AS VARCHAR) = split_part(variant, '__', 2) JOIN sc ON sc.scope = pj.scope),
    screen AS (SELECT *, CASE status WHEN 'ok' THEN projection * centrality * confidence WHEN 'scope_fails_sanity' THEN 0 END AS score FROM ss)""")


@query("rp9_screen_score", f"""
    WITH {SCREEN_SQL} SELECT scope, mode, tf, variant, status, score, projection, shift_l2, centrality FROM screen""",
       "score projection shift_l2 centrality", "edges")
def _(t):
    return screened(t).select("scope", "mode", "tf", "variant", "status", "score", "projection", "shift_l2", "centrality")


# screen: discounts and prices by factor; single perturbations: taxes and quantities of the factors with money left
CONSISTENT_SQL = """bs AS (SELECT l_returnflag AS scope, l_suppkey AS f, l_partkey AS tf, max(l_discount) - 0.05 AS b FROM lineitem GROUP BY 1, 2, 3),
    sg AS (SELECT l_returnflag AS scope, 'KO' || l_suppkey AS ko_id, l_partkey AS tf, min(l_tax) - 0.04 AS a FROM lineitem WHERE l_linestatus = 'F' OR l_quantity > 10 GROUP BY 1, 2, 3),
    cs AS (SELECT l_returnflag AS scope, l_suppkey AS f, avg(l_extendedprice) - 35000 AS score, CASE WHEN l_suppkey % 17 = 3 THEN 'no_op' ELSE 'ok' END AS status FROM lineitem GROUP BY 1, 2),
    cg AS (SELECT l_returnflag AS scope, 'KO' || l_suppkey AS ko_id, CASE WHEN l_suppkey % 13 = 2 THEN NULL WHEN l_suppkey % 13 = 5 THEN 0 ELSE avg(l_quantity) - 25 END AS score, 'ok' AS status
           FROM lineitem WHERE l_suppkey % 11 <> 4 GROUP BY 1, 2, l_suppkey),
    km AS (SELECT s_suppkey AS f, 'KO' || s_suppkey AS ko_id FROM supplier WHERE s_acctbal > 0),
    pr AS (SELECT bs.scope, bs.f, km.ko_id, b, a FROM bs JOIN km ON bs.f = km.f JOIN sg ON sg.scope = bs.scope AND sg.ko_id = km.ko_id AND sg.tf = bs.tf)"""


@query("rp9_consistency", f"""
    WITH {CONSISTENT_SQL}, rk AS (SELECT *, {avg_rank_sql('a', 'scope, f')} AS ra, {avg_rank_sql('b', 'scope, f')} AS rb FROM pr),
      r AS (SELECT scope, f, CASE WHEN count(*) > 10 AND stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END AS rho, sqrt(sum(b * b)) AS lb, sqrt(sum(a * a)) AS la FROM rk GROUP BY 1, 2),
      k AS (SELECT DISTINCT bs.scope, bs.f, km.ko_id FROM bs JOIN km ON bs.f = km.f WHERE (bs.scope, km.ko_id) IN (SELECT (scope, ko_id) FROM sg))
    SELECT k.scope, CAST(k.f AS VARCHAR) AS tf, k.ko_id, rho AS shift_rho, coalesce(lb, 0) AS shift_l2_screen, coalesce(la, 0) AS shift_l2_single, cs.score AS score_screen, cg.score AS score_single,
      sign(cs.score) = sign(cg.score) AS sign_agrees, CASE WHEN cg.score <> 0 THEN cs.score / cg.score END AS score_ratio, coalesce(cs.status, '') AS status_screen, coalesce(cg.status, '') AS status_single
    FROM k LEFT JOIN r ON k.scope = r.scope AND k.f = r.f LEFT JOIN cs ON cs.scope = k.scope AND cs.f = k.f LEFT JOIN cg ON cg.scope = k.scope AND cg.ko_id = k.ko_id""",
       "shift_rho shift_l2_screen shift_l2_single score_screen score_single score_ratio")
def _(t):
    li = t.lineitem.withColumnRenamed("l_returnflag", "scope")
    variant, ko_id = F.concat(F.lit("ko__"), "l_suppkey").alias("variant"), F.concat(F.lit("KO"), "l_suppkey").alias("ko_id")
    tf, rest = F.col("l_partkey").alias("tf"), F.col("l_suppkey") % 13
    screen_shift = li.groupBy("scope", variant, tf).agg((F.max("l_discount") - 0.05).alias("shift"))
    single_shift = li.where("l_linestatus = 'F' OR l_quantity > 10").groupBy("scope", ko_id, tf).agg((F.min("l_tax") - 0.04).alias("shift"))
    of_screen = li.groupBy("scope", "l_suppkey").agg((F.avg("l_extendedprice") - 35000).alias("score")).select(
        "scope", variant, "score", F.when(F.col("l_suppkey") % 17 == 3, "no_op").otherwise("ok").alias("status"))
    single = li.where("l_suppkey % 11 <> 4").groupBy("scope", "l_suppkey").agg((F.avg("l_quantity") - 25).alias("_s")).select(
        "scope", ko_id, F.when(rest == 5, 0.0).when(rest != 2, F.col("_s")).alias("score"), F.lit("ok").alias("status"))
    known = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("tf"), F.concat(F.lit("KO"), "s_suppkey").alias("ko_id"))
    return scoring.screen_consistency(of_screen, screen_shift, single, single_shift, known)


@query("rp21_variants", "SELECT m || '__' || s_suppkey AS variant, m AS mode, CAST(s_suppkey AS VARCHAR) AS tf FROM supplier, (VALUES ('ko'), ('oe')) v(m)")
def _(t):
    v = whatif.make_variants(t.supplier.select(F.col("s_suppkey").alias("tf")))
    return v.select("variant", "mode", F.col("tfs")[0].alias("tf"))


# the cap is spelled out, because a value that ties with it counts as unchanged: both sides must interpolate in the same order
INPUTS_SQL = """nq AS (SELECT gene, avg(value) AS mu, stddev_samp(value) AS sd, list_sort(list(value)) AS l, 0.99::DOUBLE * (count(*) - 1) AS pos FROM expr WHERE scope = 'N' GROUP BY 1),
    nn AS (SELECT *, l[floor(pos)::BIGINT + 1] + (l[ceil(pos)::BIGINT + 1] - l[floor(pos)::BIGINT + 1]) * (pos - floor(pos)) AS cap FROM nq),
    inp AS (SELECT scope, m || '__' || e.gene AS variant, m AS mode, e.gene, e.sample, value AS old, CASE m WHEN 'ko' THEN 0.0 ELSE greatest(value, cap) END AS new, coalesce(NOT sd > 1e-6, true) AS is_flat, mu, sd
            FROM expr e JOIN part p ON gene = p_partkey LEFT JOIN nn ON e.gene = nn.gene, (VALUES ('ko'), ('oe')) v(m)),
    inz AS (SELECT *, CASE WHEN is_flat THEN 0 ELSE (new - old) / (sd + 1e-6) END AS z_shift FROM inp)"""


def changed_inputs(t):
    e = cut(S.expr(t).withColumn("gene", F.col("gene").cast("string")))  # read as data and as reference
    v = whatif.make_variants(t.part.select(F.col("p_partkey").alias("tf")))
    own, reference = e.select("scope", "gene", "sample", "value"), e.where("scope = 'N'").select("gene", "sample", "value")
    return whatif.whatif_inputs(own, reference, v, "gene", "sample", "value", by=["scope"])


@query("rp19_whatif_inputs", f"WITH {INPUTS_SQL} SELECT scope, variant, mode, sample, old, new, z_shift, is_flat FROM inz", "old new z_shift", "expr")
def _(t):
    return changed_inputs(t).select("scope", "variant", "mode", "sample", "old", "new", "z_shift", "is_flat")


RESPONSE_SQL = f"""{INPUTS_SQL}, wt AS (SELECT l_partkey AS gene, l_suppkey AS target, sum(l_discount) AS weight FROM lineitem GROUP BY 1, 2),
    ns AS (SELECT scope, count(DISTINCT sample) AS n FROM expr GROUP BY 1),
    resp AS (SELECT inz.scope, variant, target AS gene, sum(z_shift * weight) / max(n) AS shift FROM inz JOIN wt ON inz.gene = wt.gene JOIN ns ON inz.scope = ns.scope WHERE inz.gene <> target GROUP BY 1, 2, 3)"""


def weights(t):
    li = t.lineitem.select(F.col("l_partkey").cast("string").alias("gene"), F.col("l_suppkey").cast("string").alias("target"), "l_discount")
    return S.dealt(li, ["gene", "target"]).groupBy("gene", "target").agg(F.sum("l_discount").alias("weight"))


def responses(t, inputs):
    n = t.lineitem.groupBy(F.col("l_returnflag").alias("scope")).agg(F.countDistinct("l_suppkey").alias("n_samples"))
    return whatif.whatif_response(inputs, weights(t), n, "gene", "sample", by=["scope"])


@query("rp20_whatif_response", f"WITH {RESPONSE_SQL} SELECT scope, variant, CAST(gene AS VARCHAR) AS gene, shift FROM resp", "shift", "expr")
def _(t):
    return responses(t, changed_inputs(t))


@query("rp19_whatif_status", f"""
    WITH {RESPONSE_SQL}, c AS (SELECT scope, variant, max(mode) AS mode, CAST(sum(CAST(new <> old AS INTEGER)) AS BIGINT) AS n_samples_changed, min(CAST(is_flat AS INTEGER)) AS flat FROM inz GROUP BY 1, 2),
         r AS (SELECT scope, variant, sqrt(sum(shift * shift)) AS l2, max(abs(shift)) AS mx FROM resp GROUP BY 1, 2)
    SELECT c.scope, c.variant, mode, n_samples_changed, CASE WHEN n_samples_changed = 0 OR flat = 1 THEN 0 ELSE coalesce(l2, 0) END AS shift_l2, CASE WHEN n_samples_changed = 0 OR flat = 1 THEN 0 ELSE coalesce(mx, 0) END AS shift_max_abs,
           n_samples_changed = 0 OR flat = 1 OR coalesce(mx, 0) < 1e-6 AS noop FROM c LEFT JOIN r ON c.scope = r.scope AND c.variant = r.variant""", "shift_l2 shift_max_abs", "expr")
def _(t):
    inputs = whatif.input_sums(changed_inputs(t), "gene", by=["scope"])  # read for the changes and for the response
    return whatif.whatif_status(inputs, responses(t, inputs), by=["scope"])


@query("rp20_baseline_response", """
    WITH n AS (SELECT gene, avg(value) AS mu, stddev_samp(value) AS sd FROM expr WHERE scope = 'N' GROUP BY 1),
      k AS (SELECT scope, count(DISTINCT sample) AS n FROM expr GROUP BY 1),
      z AS (SELECT e.scope, e.gene, sum(CASE WHEN sd > 1e-6 THEN (value - mu) / (sd + 1e-6) ELSE 0 END) AS zs FROM expr e LEFT JOIN n ON e.gene = n.gene GROUP BY 1, 2),
      w AS (SELECT l_partkey AS gene, l_suppkey AS target, sum(l_discount) AS weight FROM lineitem GROUP BY 1, 2)
    SELECT z.scope, CAST(target AS VARCHAR) AS gene, sum(zs * weight) / max(k.n) AS baseline FROM z JOIN w ON z.gene = w.gene JOIN k ON z.scope = k.scope WHERE z.gene <> target GROUP BY 1, 2""", "baseline", "expr")
def _(t):
    e = S.expr(t).withColumn("gene", F.col("gene").cast("string"))
    return whatif.baseline_response(e, e.where("scope = 'N'"), weights(t), "gene", "sample", "value", by=["scope"])


@query("rp22_gene_match", """
    SELECT gene, CASE WHEN gene IN (SELECT p_brand FROM part) THEN 'ELIGIBLE' WHEN lower(gene) IN (SELECT lower(p_brand) FROM part) THEN 'CASING_MISMATCH_CHECK_MANUALLY' ELSE 'NOT_FOUND_NOT_ELIGIBLE' END AS verdict
    FROM (SELECT DISTINCT CASE WHEN p_size < 10 THEN upper(p_brand) WHEN p_size < 20 THEN p_type ELSE p_brand END AS gene FROM part)""")
def _(t):
    g = t.part.select(F.when(F.col("p_size") < 10, F.upper("p_brand")).when(F.col("p_size") < 20, F.col("p_type")).otherwise(F.col("p_brand")).alias("gene")).distinct()
    return whatif.gene_match(g, t.part, "gene", "p_brand").select("gene", "verdict")


@query("rp22_eligibility", """
    WITH n AS (SELECT scope, count(DISTINCT sample) AS n FROM expr GROUP BY 1), g AS (SELECT s_suppkey AS gene FROM supplier),
      e AS (SELECT scope, gene, sum(value) AS s, count(*) FILTER (WHERE value > 0) AS k FROM expr GROUP BY 1, 2),
      w AS (SELECT scope, tf, sum(abs(weight)) AS w FROM edges GROUP BY 1, 2), c AS (SELECT gene, quantile_cont(value, 0.99) AS cap FROM expr WHERE scope = 'N' GROUP BY 1)
    SELECT g.gene, n.scope, coalesce(w, 0) > 0 AS in_network, s / n AS mean_expr, CAST(k AS DOUBLE) / n AS frac_samples_expressed, coalesce(w, 0) > 0 AND coalesce(s / n > 20, false) AS expressed_in_scope,
           NOT coalesce(w, 0) > 0 OR NOT coalesce(k > 0, false) AS ko_noop_expected, cap AS oe_cap, coalesce(w, 0) > 0 AND coalesce(cap > 0, false) AS oe_possible
    FROM g CROSS JOIN n LEFT JOIN e ON e.scope = n.scope AND e.gene = g.gene LEFT JOIN w ON w.scope = n.scope AND w.tf = g.gene LEFT JOIN c ON c.gene = g.gene""",
       "mean_expr frac_samples_expressed oe_cap", "expr edges")
def _(t):
    e = S.expr(t)
    n = e.groupBy("scope").agg(F.countDistinct("sample").alias("n_samples"))
    return whatif.eligibility(t.supplier.select(F.col("s_suppkey").alias("gene")), e, S.edges(t), e.where("scope = 'N'"), "gene", "sample", "value", n, 20.0)


# ---- ranking against tiers --------------------------------------------------------------------------------------------
GOLD_SQL = """gold AS (SELECT tier, s_suppkey AS tf, CASE WHEN tier = 'D' THEN 0 WHEN s_acctbal > 4000 THEN 1 ELSE -1 END AS expected_ko_sign FROM supplier, (VALUES ('B', 0), ('C', 5), ('D', 10)) v(tier, lo)
                       WHERE s_nationkey BETWEEN lo AND lo + 12)"""
ALL_SQL = """scr AS (SELECT l_returnflag AS scope, l_suppkey AS tf, CASE l_linestatus WHEN 'O' THEN 'ko' ELSE 'oe' END AS mode, avg(l_extendedprice) - 35000 AS score, sum(l_quantity) AS centrality,
      CASE WHEN l_suppkey % 17 = 3 THEN 'scope_fails_sanity' ELSE 'ok' END AS status, CASE l_returnflag WHEN 'R' THEN 'FAIL' ELSE 'PASS' END AS gate FROM lineitem GROUP BY 1, 2, 3),
    pss AS (SELECT *, {rank} / count(*) OVER (PARTITION BY scope) AS pct FROM scr WHERE mode = 'ko' AND status = 'ok' AND gate = 'PASS'),
    con AS (SELECT tf, quantile_cont(pct, 0.5) - 0.5 AS score, quantile_cont(centrality, 0.5) AS centrality, count(*) AS n_scopes, 'consensus_headline' AS scope FROM pss GROUP BY tf),
    sco AS (SELECT scope, tf, score, centrality FROM scr WHERE mode = 'ko' AND status = 'ok'
            UNION ALL SELECT scope, tf, score, centrality FROM con WHERE (SELECT count(DISTINCT scope) FROM pss) >= 2)""".replace("{rank}", avg_rank_sql("score", "scope"))
CASES_SQL = f"""{GOLD_SQL}, {ALL_SQL}, tl AS (SELECT DISTINCT tier FROM gold),
    lb AS (SELECT sco.*, tl.tier, expected_ko_sign FROM sco CROSS JOIN tl LEFT JOIN gold ON gold.tier = tl.tier AND gold.tf = sco.tf),
    c0 AS (SELECT scope, tier, tf, score, centrality, expected_ko_sign, 'membership' AS direction, abs(score) AS rank_score, CAST(expected_ko_sign IS NOT NULL AS INTEGER) AS y FROM lb WHERE tier = 'D'
           UNION ALL SELECT scope, tier, tf, score, centrality, expected_ko_sign, 'raises', score, CASE WHEN expected_ko_sign = 1 THEN 1 ELSE 0 END FROM lb WHERE tier <> 'D'
           UNION ALL SELECT scope, tier, tf, score, centrality, expected_ko_sign, 'lowers', -score, CASE WHEN expected_ko_sign = -1 THEN 1 ELSE 0 END FROM lb WHERE tier <> 'D'),
    cases AS (SELECT *, 'all' AS subset FROM c0 UNION ALL SELECT *, 'leave_source_out' FROM c0 WHERE (tier = 'B' AND tf NOT IN (SELECT tf FROM gold WHERE tier = 'C')) OR (tier = 'C' AND tf NOT IN (SELECT tf FROM gold WHERE tier = 'B')))"""


def gold_cases(t):
    tiers = F.explode(F.array(*[F.struct(F.lit(n).alias("t"), F.lit(lo).alias("lo")) for n, lo in (("B", 0), ("C", 5), ("D", 10))]))
    g = t.supplier.select("s_suppkey", "s_acctbal", "s_nationkey", tiers.alias("v")).where(F.col("s_nationkey").between(F.col("v.lo"), F.col("v.lo") + 12)).select(
        F.col("v.t").alias("tier"), F.col("s_suppkey").alias("tf"),
        F.when(F.col("v.t") == "D", 0).when(F.col("s_acctbal") > 4000, 1).otherwise(-1).alias("expected_ko_sign"))
    return metrics.tier_cases(metrics.screen_scores(screen_rows(t)), g, min_ranked=5)


def screen_rows(t):
    """Stand-in of a scored screen: two modes, failed rows, one scope that does not pass."""
    return t.lineitem.groupBy(
        F.col("l_returnflag").alias("scope"), F.col("l_suppkey").alias("tf"), F.when(F.col("l_linestatus") == "O", "ko").otherwise("oe").alias("mode")).agg(
        (F.avg("l_extendedprice") - 35000).alias("score"), F.sum("l_quantity").alias("centrality")).withColumns({
            "status": F.when(F.col("tf") % 17 == 3, "scope_fails_sanity").otherwise("ok"),
            "gate_verdict": F.when(F.col("scope") == "R", "FAIL").otherwise("PASS")})


CASE = "scope, tier, direction, subset"
RANK_B = 200


RANK_KS = (10, 20, 50)


def each_k(text: str) -> str:
    """``text`` once for every k of the ranking report."""
    return ", ".join(text.replace("{k}", str(k)) for k in RANK_KS)


def whole_mean(total: str, of: str) -> str:
    """total / of rounded to six digits in whole numbers, half up, so that no order of summation can decide a tie."""
    return f"CAST((2000000 * CAST({total} AS HUGEINT) + {of}) // (2 * {of}) AS DOUBLE) / 1000000.0"


def whole_mean_column(total, of):
    return F.floor((F.lit(2_000_000) * total.cast("decimal(38,0)") + of) / (F.lit(2) * of)).cast("double") / F.lit(1e6)


NULL_FIRST = max(200, RANK_B // 5)
RECALL_COLUMNS = [f"recall_at_{k}{c}" for k in RANK_KS for c in ("", "_p", "_ci_lo", "_ci_hi")] + [f"ndcg_at_{k}{c}" for k in RANK_KS for c in ("", "_ci_lo", "_ci_hi")]


@query("rp14_rank_against_gold", f"""
    WITH {CASES_SQL},
      p AS (SELECT *, row_number() OVER (PARTITION BY {CASE} ORDER BY rank_score DESC, tf) AS place, row_number() OVER (PARTITION BY {CASE} ORDER BY centrality, tf) AS cr, count(*) OVER (PARTITION BY {CASE}) AS n FROM cases),
      d0 AS (SELECT *, CASE WHEN n = 1 THEN 0 ELSE greatest(0, ((cr - 1) * 10 + n - 2) // (n - 1) - 1) END AS decile, sum(y) OVER (PARTITION BY {CASE}) AS np FROM p),
      t AS (SELECT {CASE}, count(*) AS n_ranked, CAST(sum(y) AS BIGINT) AS n_pos FROM d0 GROUP BY {CASE}),
      d AS (SELECT * FROM d0 WHERE np > 0 AND np < n),
      o AS (SELECT {CASE}, CAST(sum(y) AS BIGINT) AS np, avg(hit * 1.0 / place) FILTER (WHERE y = 1) AS ap, sum(y) * 1.0 / count(*) AS prevalence,
                   {each_k("count(*) FILTER (WHERE y = 1 AND place <= {k}) AS obs_{k}")},
                   {each_k("coalesce(sum(1 / log2(place + 1)) FILTER (WHERE y = 1 AND place <= {k}), 0) / sum(1 / log2(hit + 1)) FILTER (WHERE y = 1 AND hit <= {k}) AS ndcg_at_{k}")}
            FROM (SELECT *, sum(y) OVER (PARTITION BY {CASE} ORDER BY place) AS hit FROM d) GROUP BY {CASE}),
      {boot_sql(7, RANK_B, 'd', CASE, 'tf')},
      bp AS (SELECT {CASE}, b, y, row_number() OVER (PARTITION BY {CASE}, b ORDER BY rank_score DESC, tf) AS loc FROM boot),
      bh AS (SELECT *, sum(y) OVER (PARTITION BY {CASE}, b ORDER BY loc) AS hit FROM bp),
      bs AS (SELECT {CASE}, b, avg(hit * 1.0 / loc) AS ap, {each_k("avg(CAST(loc <= {k} AS DOUBLE)) AS rc_{k}")},
                    {each_k("coalesce(sum(1 / log2(loc + 1)) FILTER (WHERE loc <= {k}), 0) / sum(1 / log2(hit + 1)) FILTER (WHERE hit <= {k}) AS nd_{k}")} FROM bh WHERE y = 1 GROUP BY {CASE}, b),
      ci AS (SELECT {CASE}, quantile_cont(ap, 0.025) AS ap_ci_lo, quantile_cont(ap, 0.975) AS ap_ci_hi,
                    {each_k("quantile_cont(nd_{k}, 0.025) AS ndcg_at_{k}_ci_lo, quantile_cont(nd_{k}, 0.975) AS ndcg_at_{k}_ci_hi")},
                    {each_k("quantile_cont(rc_{k}, 0.025) AS recall_at_{k}_ci_lo, quantile_cont(rc_{k}, 0.975) AS recall_at_{k}_ci_hi")} FROM bs GROUP BY {CASE} HAVING count(*) > 20),
      h AS (SELECT {CASE}, decile, b, place, row_number() OVER (PARTITION BY {CASE}, decile, b ORDER BY {key_sql(0, 'scope', 'tier', 'direction', 'subset', 'b', 'tf')}, tf) AS i FROM d, {reps(RANK_B)}),
      l AS (SELECT {CASE}, decile, y, row_number() OVER (PARTITION BY {CASE}, decile ORDER BY y DESC, tf) AS i FROM d),
      q AS (SELECT {CASE}, b, place FROM h JOIN l USING (scope, tier, direction, subset, decile, i) WHERE y = 1),
      k AS (SELECT {CASE}, b, avg(hit * 1.0 / place) AS ap, {each_k("count(*) FILTER (WHERE place <= {k}) AS h_{k}")}
            FROM (SELECT *, row_number() OVER (PARTITION BY {CASE}, b ORDER BY place) AS hit FROM q) GROUP BY {CASE}, b),
      s AS (SELECT k.scope, k.tier, k.direction, k.subset, avg(k.ap) AS null_mean, max(o.ap) / avg(k.ap) AS enrichment, (count(*) FILTER (WHERE k.ap >= o.ap - 1e-12) + 1.0) / (count(*) + 1.0) AS p_value,
                   {each_k("CAST(sum(h_{k}) FILTER (WHERE b <= " + str(NULL_FIRST) + ") AS BIGINT) AS null_hits_{k}")},
                   {each_k("(count(*) FILTER (WHERE b <= " + str(NULL_FIRST) + " AND h_{k} >= obs_{k}) + 1.0) / (count(*) FILTER (WHERE b <= " + str(NULL_FIRST) + ") + 1.0) AS recall_at_{k}_p")}
            FROM k JOIN o USING (scope, tier, direction, subset) GROUP BY 1, 2, 3, 4)
    SELECT t.*, ap, prevalence, null_mean, enrichment, p_value, ap_ci_lo, ap_ci_hi, n_pos < 10 AS underpowered, {each_k("ndcg_at_{k}, CAST(obs_{k} AS DOUBLE) / n_pos AS recall_at_{k}")},
           {each_k("null_hits_{k}, recall_at_{k}_p, ndcg_at_{k}_ci_lo, ndcg_at_{k}_ci_hi, recall_at_{k}_ci_lo, recall_at_{k}_ci_hi")},
           {", ".join(whole_mean(f"null_hits_{k}", f"({NULL_FIRST} * n_pos)") + f" AS recall_at_{k}_null_mean" for k in RANK_KS)}
    FROM t LEFT JOIN o USING (scope, tier, direction, subset) LEFT JOIN s USING (scope, tier, direction, subset) LEFT JOIN ci USING (scope, tier, direction, subset)""",
       " ".join(["ap prevalence null_mean enrichment p_value ap_ci_lo ap_ci_hi", *RECALL_COLUMNS, *[f"recall_at_{k}_null_mean" for k in RANK_KS]]))
def _(t):
    out = metrics.rank_against_gold(gold_cases(t), RANK_KS, RANK_B, 0, B_boot=RANK_B)
    return out.withColumns({f"recall_at_{k}_null_mean": whole_mean_column(F.col(f"null_hits_{k}"), F.lit(NULL_FIRST) * F.col("n_pos")) for k in RANK_KS})


@query("rp14_signs_against_gold", f"""
    WITH {CASES_SQL} SELECT scope, tier, subset, count(*) AS n_signed, CAST(sum(CAST(sign(score) = expected_ko_sign AS INTEGER)) AS BIGINT) AS n_correct, avg(CAST(sign(score) = expected_ko_sign AS DOUBLE)) AS sign_accuracy
    FROM cases WHERE direction = 'raises' AND expected_ko_sign <> 0 GROUP BY 1, 2, 3""", "sign_accuracy")
def _(t):
    return metrics.signs_against_gold(gold_cases(t)).select("scope", "tier", "subset", "n_signed", "n_correct", "sign_accuracy")


@query("so5_leave_source_out", f"""WITH {CASES_SQL} SELECT {CASE}, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos FROM cases GROUP BY {CASE}""")
def _(t):
    return gold_cases(t).groupBy("scope", "tier", "direction", "subset").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("n_pos"))


@query("rp14_consensus_scope", f"""
    WITH {ALL_SQL} SELECT * FROM con""", "score centrality")
def _(t):
    return metrics.consensus_scope(screen_rows(t).where("mode = 'ko'"))


@query("rp15_recall_report", f"""
    WITH {CASES_SQL},
      p AS (SELECT *, row_number() OVER (PARTITION BY {CASE} ORDER BY rank_score DESC, tf) AS place, row_number() OVER (PARTITION BY {CASE} ORDER BY centrality, tf) AS cr, count(*) OVER (PARTITION BY {CASE}) AS n, sum(y) OVER (PARTITION BY {CASE}) AS np FROM cases WHERE subset = 'all'),
      d AS (SELECT *, CASE WHEN n = 1 THEN 0 ELSE greatest(0, ((cr - 1) * 10 + n - 2) // (n - 1) - 1) END AS decile FROM p WHERE np > 0 AND np < n),
      o AS (SELECT scope, tier, direction, place AS k, CAST(sum(y) OVER (PARTITION BY scope, tier, direction ORDER BY place) AS DOUBLE) / np AS recall, CAST(np AS BIGINT) AS n_pos, n AS n_ranked FROM d QUALIFY k <= 200),
      h AS (SELECT scope, tier, direction, np, decile, b, place, row_number() OVER (PARTITION BY scope, tier, direction, decile, b ORDER BY {key_sql(4, 'scope', 'tier', 'direction', 'b', 'tf')}, tf) AS i FROM d, {reps(RANK_B)}),
      l AS (SELECT scope, tier, direction, decile, y, row_number() OVER (PARTITION BY scope, tier, direction, decile ORDER BY y DESC, tf) AS i FROM d),
      c AS (SELECT scope, tier, direction, b, place AS k, sum(l.y) OVER (PARTITION BY scope, tier, direction, b ORDER BY place) AS hits, np, CAST(hits AS DOUBLE) / np AS r FROM h JOIN l USING (scope, tier, direction, decile, i)),
      m AS (SELECT scope, tier, direction, k, CAST(sum(hits) AS BIGINT) AS null_hits, CAST(round(20 * quantile_cont(CAST(hits AS DOUBLE), 0.05)) AS BIGINT) AS h05, CAST(round(20 * quantile_cont(CAST(hits AS DOUBLE), 0.95)) AS BIGINT) AS h95 FROM c GROUP BY 1, 2, 3, 4),
      {boot_sql(4, RANK_B, 'd', 'scope, tier, direction', 'tf')},
      bp AS (SELECT scope, tier, direction, b, y, row_number() OVER (PARTITION BY scope, tier, direction, b ORDER BY rank_score DESC, tf) AS k, sum(y) OVER (PARTITION BY scope, tier, direction, b) AS bn FROM boot),
      bc AS (SELECT scope, tier, direction, b, k, CAST(sum(y) OVER (PARTITION BY scope, tier, direction, b ORDER BY k) AS DOUBLE) / bn AS r FROM bp WHERE bn > 0),
      bi AS (SELECT scope, tier, direction, k, quantile_cont(r, 0.025) AS ci_lo, quantile_cont(r, 0.975) AS ci_hi FROM bc GROUP BY 1, 2, 3, 4)
    SELECT o.*, null_hits, {whole_mean("null_hits", f"({RANK_B} * n_pos)")} AS null_mean, {whole_mean("h05", "(20 * n_pos)")} AS null_p05, {whole_mean("h95", "(20 * n_pos)")} AS null_p95, ci_lo, ci_hi FROM o LEFT JOIN m USING (scope, tier, direction, k) LEFT JOIN bi USING (scope, tier, direction, k)""", "recall null_mean null_p05 null_p95 ci_lo ci_hi")
def _(t):
    out = metrics.recall_report(gold_cases(t), 200, RANK_B, 4, RANK_B)
    # percentiles of 200 counts lie on twentieths
    sides = {f"null_{c}": whole_mean_column(F.round(F.col(f"null_hits_{c}") * 20).cast("bigint"), F.lit(20) * F.col("n_pos")) for c in ("p05", "p95")}
    mean = whole_mean_column(F.col("null_hits"), F.lit(RANK_B) * F.col("n_pos"))
    return out.withColumns({"null_mean": mean, **sides}).drop("null_hits_p05", "null_hits_p95")


# ---- panel indices ----------------------------------------------------------------------------------------------------
def panels(t):
    names = F.when(F.col("p_brand").isin("Brand#11", "Brand#12"), "first").when(F.col("p_brand").isin("Brand#13", "Brand#14"), "second") \
        .when(F.col("p_brand").isin("Brand#15", "Brand#21", "Brand#22"), "damage")
    return t.part.select(names.alias("panel"), F.col("p_partkey").cast("string").alias("gene")).where(F.col("panel").isNotNull())


IDX_B = 200
IDX = f"""
    WITH pn AS (SELECT CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'first' WHEN p_brand IN ('Brand#13', 'Brand#14') THEN 'second' WHEN p_brand IN ('Brand#15', 'Brand#21', 'Brand#22') THEN 'damage' END AS panel, CAST(p_partkey AS VARCHAR) AS gene FROM part),
      fl AS (SELECT scope, quantile_cont(level, 0.25) AS f FROM shifts GROUP BY 1),
      ts AS (SELECT s.scope, CAST(gene AS VARCHAR) AS gene, real_shift, level FROM shifts s JOIN fl ON s.scope = fl.scope WHERE level >= f),
      z0 AS (SELECT *, (real_shift - avg(real_shift) OVER w) / stddev_pop(real_shift) OVER w AS z, row_number() OVER (PARTITION BY scope ORDER BY level, gene) AS r, count(*) OVER w AS n FROM ts WINDOW w AS (PARTITION BY scope)),
      z AS (SELECT scope, gene, z, real_shift AS raw, greatest(0, ((r - 1) * 10 + n - 2) // (n - 1) - 1) AS decile, n FROM z0),
      mb AS (SELECT z.scope, panel, z.gene, z, raw, decile FROM z JOIN pn ON z.gene = pn.gene WHERE panel IS NOT NULL),
      src AS (SELECT * FROM mb),
      {boot_sql(0, IDX_B, 'src', 'scope, panel')},
      bm AS (SELECT scope, panel, b, avg(z) AS m FROM boot GROUP BY 1, 2, 3),
      bi AS (SELECT scope, b, max(m) FILTER (WHERE panel = 'first') - max(m) FILTER (WHERE panel = 'second') AS d FROM bm GROUP BY 1, 2),
      ci AS (SELECT scope, quantile_cont(d, 0.025) AS i_ci_lo, quantile_cont(d, 0.975) AS i_ci_hi FROM bi GROUP BY 1),
      posd AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY gene) AS pos, count(*) OVER (PARTITION BY scope) AS n FROM mb WHERE panel = 'damage'),
      bd AS (SELECT d.scope, d.b, avg(p.z) AS m FROM (SELECT scope, b, {key_sql(0, 'scope', 'b', 'pos')} % n + 1 AS idx FROM posd, {reps(IDX_B)}) d JOIN posd p ON d.scope = p.scope AND idx = p.pos GROUP BY 1, 2),
      cd AS (SELECT scope, quantile_cont(m, 0.025) AS d_ci_lo, quantile_cont(m, 0.975) AS d_ci_hi FROM bd GROUP BY 1),
      po AS (SELECT *, row_number() OVER (PARTITION BY scope, decile ORDER BY gene) AS pos, count(*) OVER (PARTITION BY scope, decile) AS m FROM z),
      wa AS (SELECT mb.scope, panel, po.decile, b, CAST('0x' || substr(md5(concat_ws('|', CASE panel WHEN 'first' THEN 1 WHEN 'second' THEN 2 ELSE 3 END, mb.scope, b, mb.gene)), 1, 15) AS BIGINT) % m + 1 AS pos FROM mb JOIN po ON mb.scope = po.scope AND mb.gene = po.gene, {reps(IDX_B)}),
      nm AS (SELECT wa.scope, panel, b, avg(po.z) AS m FROM wa JOIN po ON wa.scope = po.scope AND wa.decile = po.decile AND wa.pos = po.pos GROUP BY 1, 2, 3),
      ni AS (SELECT scope, quantile_cont(abs(a - c), 0.95) AS i_null_p95_abs FROM (SELECT scope, b, max(m) FILTER (WHERE panel = 'first') AS a, max(m) FILTER (WHERE panel = 'second') AS c FROM nm GROUP BY 1, 2) GROUP BY 1),
      nd AS (SELECT scope, quantile_cont(m, 0.95) AS d_null_p95 FROM nm WHERE panel = 'damage' GROUP BY 1),
      mn AS (SELECT scope, count(*) FILTER (WHERE panel = 'first') AS n_first, count(*) FILTER (WHERE panel = 'second') AS n_second, count(*) FILTER (WHERE panel = 'damage') AS n_damage,
                    avg(z) FILTER (WHERE panel = 'first') - avg(z) FILTER (WHERE panel = 'second') AS i_signed, avg(z) FILTER (WHERE panel = 'damage') AS d,
                    avg(z) FILTER (WHERE panel = 'first') AS mean_first, avg(z) FILTER (WHERE panel = 'second') AS mean_second, avg(raw) FILTER (WHERE panel = 'first') AS raw_first,
                    avg(raw) FILTER (WHERE panel = 'second') AS raw_second, avg(raw) FILTER (WHERE panel = 'damage') AS raw_damage FROM mb GROUP BY 1),
      sz AS (SELECT scope, count(*) AS n_genes_tested FROM z GROUP BY 1)
    SELECT sz.scope, n_genes_tested, n_first, n_second, n_damage, 'ok' AS status, i_signed, abs(i_signed) AS i_abs, CASE WHEN i_signed > 0 THEN 'toward first' ELSE 'toward second' END AS direction,
           mean_first, mean_second, raw_first, raw_second, raw_damage, i_ci_lo, i_ci_hi, i_null_p95_abs, (i_ci_lo > 0 OR i_ci_hi < 0) AND abs(i_signed) > i_null_p95_abs AS i_call,
           d, d_ci_lo, d_ci_hi, d_null_p95, d_ci_lo > 0 AND d > d_null_p95 AS d_call,
           CASE WHEN d_ci_lo > 0 AND d > d_null_p95 THEN 'non-specific damage' WHEN (i_ci_lo > 0 OR i_ci_hi < 0) AND abs(i_signed) > i_null_p95_abs THEN 'identity reprogramming' ELSE 'no clear effect' END AS ird_class
    FROM sz JOIN mn USING (scope) JOIN ci USING (scope) JOIN cd USING (scope) JOIN ni USING (scope) JOIN nd USING (scope)"""


def index_rows(t, column="real_shift", seed=0):
    s = S.shifts(t).withColumn("gene", F.col("gene").cast("string"))
    return indices.panel_indices(s, panels(t), ["scope"], "gene", column, "level", "first", "second", "damage", IDX_B, seed, min_tested=50)


@query("rp16_panel_indices", IDX, "i_signed i_abs mean_first mean_second raw_first raw_second raw_damage i_ci_lo i_ci_hi i_null_p95_abs d d_ci_lo d_ci_hi d_null_p95", "shifts")
def _(t):
    rows = index_rows(t).withColumns({"r_assessed": F.lit(False), "r_call": F.lit(False)})
    return indices.classify(rows).drop("r_assessed", "r_call")


@query("rp16_rejuvenation", f"""
    WITH src AS (SELECT scope, gene, predicted_shift AS s, real_shift AS a FROM shifts), {boot_sql(2, src='src')},
      p AS (SELECT scope, -sum(s * a) / sqrt(sum(a * a)) AS r, count(*) AS n_items FROM src GROUP BY 1),
      bb AS (SELECT scope, b, -sum(s * a) / sqrt(sum(a * a)) AS r FROM boot GROUP BY 1, 2), ci AS (SELECT scope, quantile_cont(r, 0.025) AS r_ci_lo, quantile_cont(r, 0.975) AS r_ci_hi FROM bb GROUP BY 1),
      m AS (SELECT scope, b, a, row_number() OVER (PARTITION BY scope, b ORDER BY {key_sql(3, 'scope', 'b', 'gene')}, gene) AS pos FROM pos, {reps()}),
      n0 AS (SELECT m.scope, m.b, -sum(pos.s * m.a) / sqrt(sum(m.a * m.a)) AS r FROM m JOIN pos ON m.scope = pos.scope AND m.pos = pos.pos GROUP BY 1, 2),
      nn AS (SELECT scope, quantile_cont(r, 0.95) AS r_null_p95, quantile_cont(r, 0.05) AS r_null_p05 FROM n0 GROUP BY 1)
    SELECT p.scope, p.r, r_ci_lo, r_ci_hi, r_null_p95, r_null_p05, n_items, true AS r_assessed, r_ci_lo > 0 AND p.r > r_null_p95 AS r_call FROM p JOIN ci USING (scope) JOIN nn USING (scope)""",
       "r r_ci_lo r_ci_hi r_null_p95 r_null_p05", "shifts")
def _(t):
    return indices.rejuvenation(S.shifts(t), ["scope"], "gene", "predicted_shift", "real_shift", B, 2)


@query("rp17_index_validation", """
    WITH r AS (SELECT o_orderpriority AS contrast, l_returnflag AS scope, avg(l_quantity) - 25.5 AS real, avg(l_quantity) - 26 AS real_lo, avg(l_quantity) - 25.2 AS real_hi, avg(l_discount) - 0.05 AS pred
               FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
      d AS (SELECT *, 'all_contrasts' AS subset FROM r UNION ALL SELECT *, CASE WHEN scope = 'N' THEN 'population_scope' ELSE 'cell_type_scopes' END FROM r),
      k AS (SELECT *, rank() OVER (PARTITION BY subset ORDER BY real) AS a, rank() OVER (PARTITION BY subset ORDER BY pred) AS b, real_lo > 0 OR real_hi < 0 AS clear FROM d),
      t AS (SELECT subset, count(*) AS n_contrasts, count(*) FILTER (WHERE clear) AS n_real_clear, count(*) FILTER (WHERE clear AND sign(real) = sign(pred)) AS n_sign_agree, CASE WHEN count(*) >= 5 THEN corr(a, b) END AS rho FROM k GROUP BY 1)
    SELECT subset, 'I' AS axis, n_contrasts, n_real_clear, n_sign_agree, CAST(n_sign_agree AS DOUBLE) / nullif(n_real_clear, 0) AS sign_agreement, rho FROM t""", "sign_agreement rho")
def _(t):
    q = F.avg("l_quantity")
    r = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderpriority").alias("contrast"), F.col("l_returnflag").alias("scope")).agg(
        (q - 25.5).alias("real"), (q - 26).alias("real_lo"), (q - 25.2).alias("real_hi"), (F.avg("l_discount") - 0.05).alias("pred"))
    return indices.index_validation(r.withColumn("axis", F.lit("I")), "N").select("subset", "axis", "n_contrasts", "n_real_clear", "n_sign_agree", "sign_agreement", "rho")
