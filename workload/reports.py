"""Text rules, reports, set operations, audits, gold table."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftgrid.functions import scalars as X
from shiftgrid.operators import aggregates, joins
from shiftgrid.plans import audit, gold, validation
from workload import standins as S
from workload.ranking import avg_rank_sql
from workload.registry import query


# --------------------------------------------------------------------------------------------------------------- text
@query("sc2_name_prefix", r"""
    SELECT s, count(*) AS n, CASE kind WHEN 0 THEN lower(p_type) WHEN 1 THEN lower(p_type) || '_mut' WHEN 2 THEN lower(p_type) || '_wt' ELSE lower(p_type) END AS prefix
    FROM (SELECT p_type, p_size % 4 AS kind, CASE p_size % 4 WHEN 0 THEN p_type || '_rep' || p_size WHEN 1 THEN p_type || '_MUT' || p_size || '-B12' WHEN 2 THEN p_type || ' WT_' || p_size || '_a_counts' ELSE p_type || '-' || p_size END AS s FROM part)
    GROUP BY 1, 3""")
def _(t):
    k, z, y = F.col("p_size") % 4, F.col("p_size").cast("string"), F.col("p_type")
    s = F.when(k == 0, F.concat(y, F.lit("_rep"), z)).when(k == 1, F.concat(y, F.lit("_MUT"), z, F.lit("-B12"))) \
        .when(k == 2, F.concat(y, F.lit(" WT_"), z, F.lit("_a_counts"))).otherwise(F.concat(y, F.lit("-"), z))
    p = t.part.select(s.alias("s"))
    return p.groupBy("s", X.name_prefix(F.col("s")).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def named(t):
    k = F.col("o_orderkey") % 5
    name = F.when(k == 0, F.concat(F.lit("WT_"), F.col("o_orderkey").cast("string"))).when(k == 1, F.concat(F.lit("Cre-KO1_"), F.col("o_custkey").cast("string"), F.lit("mo"))) \
        .when(k == 2, F.concat(F.lit("DAPT_treated_p"), (F.col("o_custkey") % 90).cast("string"))).when(k == 3, F.lit("ACGTACGTACGT-1")).otherwise(F.lit("Vehicle_untreated"))
    return t.orders.select(F.col("o_orderpriority").alias("entry"), "o_orderkey", name.alias("name"))


NAMED = """nm AS (SELECT o_orderpriority AS entry, o_orderkey, o_orderkey % 5 AS k, CASE o_orderkey % 5 WHEN 0 THEN 'WT_' || o_orderkey WHEN 1 THEN 'Cre-KO1_' || o_custkey || 'mo'
             WHEN 2 THEN 'DAPT_treated_p' || (o_custkey % 90) WHEN 3 THEN 'ACGTACGTACGT-1' ELSE 'Vehicle_untreated' END AS name FROM orders)"""


@query("sc3_token_families", f"""
    WITH {NAMED} SELECT o_orderkey, CASE k WHEN 0 THEN 'wildtype' WHEN 1 THEN 'knockout' ELSE '' END AS genotype,
      CASE k WHEN 2 THEN 'dapt,treated' WHEN 4 THEN 'treated,untreated,vehicle' ELSE '' END AS treatment,
      CASE k WHEN 1 THEN regexp_extract(name, '[0-9]+mo') WHEN 2 THEN regexp_extract(name, 'p[0-9]+$') ELSE '' END AS age FROM nm""")
def _(t):
    n = F.col("name")
    return named(t).select("o_orderkey", F.array_join(X.buckets_of(n, X.GENOTYPE_PATTERNS), ",").alias("genotype"),
                           F.array_join(X.buckets_of(n, X.TREATMENT_PATTERNS), ",").alias("treatment"), F.array_join(X.ages_of(n), ",").alias("age"))


@query("sc4_barcodes", f"WITH {NAMED} SELECT entry, avg(CAST(k = 3 AS DOUBLE)) AS share, avg(CAST(k = 3 AS DOUBLE)) >= 0.8 AS looks_like_barcodes FROM nm GROUP BY 1", "share")
def _(t):
    bc = F.avg(X.is_barcode(F.col("name")).cast("double"))
    return named(t).groupBy("entry").agg(bc.alias("share"), (bc >= 0.8).alias("looks_like_barcodes"))


@query("sc5_accessions", """
    SELECT doc_id, string_agg(m, ',') AS ids, dataset FROM (SELECT doc_id, unnest(regexp_extract_all(txt, 'GSE[0-9]+')) AS m, 'GSE' || doc_id AS dataset FROM
      (SELECT doc_id, 'GSE' || doc_id || '_P8 and GSE' || (n_chars + 1000) || ' in ' || source AS txt FROM documents)) GROUP BY 1, 3""")
def _(t):
    d = t.documents.select("doc_id", F.concat(F.lit("GSE"), F.col("doc_id").cast("string"), F.lit("_P8 and GSE"), (F.col("n_chars") + 1000).cast("string"), F.lit(" in "), "source").alias("txt"))
    return d.select("doc_id", F.array_join(X.accessions(F.col("txt")), ",").alias("ids"), X.dataset_of(F.col("txt")).alias("dataset"))


@query("sc6_match_symbol", """
    WITH i AS (SELECT upper(p_type) AS up, arg_min(t, p) AS matched FROM (SELECT CASE WHEN p_size < 25 THEN p_type ELSE lower(p_type) END AS t, p_type, p_partkey AS p FROM part) GROUP BY 1)
    SELECT s.p_partkey, matched FROM (SELECT p_partkey, CASE WHEN p_size > 45 THEN 'none' ELSE lower(p_type) END AS s FROM part) s LEFT JOIN i ON upper(s.s) = i.up""")
def _(t):
    index = t.part.select(F.when(F.col("p_size") < 25, F.col("p_type")).otherwise(F.lower("p_type")).alias("tf"), F.col("p_partkey").alias("position"))
    s = t.part.select("p_partkey", F.when(F.col("p_size") > 45, "none").otherwise(F.lower("p_type")).alias("s"))
    return joins.match_symbol(s, index, "s", "tf", "position").select("p_partkey", "matched")


EFFECT = "CASE p_size % 4 WHEN 0 THEN 'Pro-Longevity' WHEN 1 THEN ' anti-longevity ' WHEN 2 THEN 'Inhibits' ELSE 'Induces' END"


@query("sc7_effect_sign", f"SELECT {EFFECT} AS effect, count(*) AS n, CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 END AS longevity, CASE p_size % 4 WHEN 2 THEN 1 WHEN 3 THEN -1 END AS senescence FROM part GROUP BY 1, 3, 4")
def _(t):
    e = F.col("effect")
    return t.part.select(F.expr(EFFECT).alias("effect")).groupBy("effect", X.longevity_sign(e).alias("longevity"), X.senescence_sign(e).alias("senescence")).agg(F.count(F.lit(1)).alias("n"))


@query("sc8_parse_list", "SELECT p_partkey, p_name AS first_re, 2 AS n_res FROM part WHERE p_name NOT LIKE '%''%'")
def _(t):
    c = F.concat(F.lit("['"), "p_name", F.lit("', '"), "p_brand", F.lit("']"))
    p = t.part.where(~F.contains("p_name", F.lit("'"))).select("p_partkey", X.parse_list(c).alias("res"))
    return p.select("p_partkey", F.col("res")[0].alias("first_re"), F.size("res").alias("n_res"))


@query("sc9_variant_parts", """
    SELECT event_id, event_type AS mode, 'tf__' || user_id AS tf, CASE WHEN user_id % 3 = 0 THEN 'Gfi1' WHEN user_id % 3 = 1 THEN 'Atoh1' END AS named_tf FROM events""")
def _(t):
    v = F.concat_ws("__", "event_type", F.lit("tf"), F.col("user_id").cast("string"))
    text = F.concat(F.lit("prior_"), F.when(F.col("user_id") % 3 == 0, "GFI1_run").when(F.col("user_id") % 3 == 1, "gfi1 after Atoh1").otherwise("other"))
    return t.events.select("event_id", X.variant_mode(v).alias("mode"), X.variant_tf(v).alias("tf"), X.tf_from_text(text).alias("named_tf"))


@query("sc10_json_specs", """SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1""")
def _(t):
    spec = X.json_spec("props", "k bigint")
    return t.events.select("event_type", spec["k"].alias("k")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


@query("sc10_variant_specs", """
    SELECT event_type, event_id % 4 AS kind, count(*) AS n, CASE event_id % 4 WHEN 0 THEN 'mode is neither ko nor oe' WHEN 1 THEN 'tfs is empty' WHEN 2 THEN 'id is missing or reserved' END AS problem FROM events GROUP BY 1, 2, 4""")
def _(t):
    kind = F.col("event_id") % 4
    variant = F.struct(
        F.when(kind == 2, "__baseline_mean__").otherwise(F.concat(F.lit("v"), "event_id")).alias("id"),
        F.when(kind == 1, F.array().cast("array<string>")).otherwise(F.array(F.col("user_id").cast("string"))).alias("tfs"),
        F.when(kind == 0, "knock").otherwise("ko").alias("mode"))
    texts = t.events.select("event_type", kind.alias("kind"), F.to_json(F.array(variant)).alias("text"))
    specs = texts.select("event_type", "kind", X.json_list("text", X.VARIANT_SPEC).alias("spec"))
    return specs.groupBy("event_type", "kind", X.variant_problem(F.col("spec")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query("sc11_perturb_class", """
    SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'OE' WHEN 1 THEN 'KD' ELSE 'mixed' END AS cls, CASE WHEN p_size % 3 < 2 THEN '1,2' ELSE '1,2,3' END AS dims FROM part""")
def _(t):
    k = F.col("p_size") % 3
    d = F.when(k == 0, F.array(F.lit("oe"), F.lit("CRISPRa"))).when(k == 1, F.array(F.lit("KO"))).otherwise(F.array(F.lit("KO"), F.lit("activation")))
    dims = F.array(F.lit("1"), F.lit("2"), F.lit("3"))
    return t.part.select("p_partkey", X.perturb_class(d).alias("cls"), X.arm_dimensions(dims, k < 2).alias("dims"))


# ------------------------------------------------------------------------------------------------------------- reports
@query("rp1_real_shift", """
    WITH c AS (SELECT o_orderpriority || '_' || o_orderkey AS cell_id, p_brand AS gene, l_quantity AS count, o_orderstatus AS cluster, o_orderpriority AS plate FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
      s AS (SELECT cell_id, gene, CASE WHEN plate LIKE '1%' THEN 'target' ELSE 'reference' END AS side, sum(count) AS count FROM c WHERE cluster IN ('F', 'O') AND (plate LIKE '1%' OR plate LIKE '2%') GROUP BY 1, 2, 3),
      l AS (SELECT side, cell_id, gene, ln(1 + count / sum(count) OVER (PARTITION BY cell_id) * 10000) AS v FROM s), n AS (SELECT side, count(DISTINCT cell_id) AS n FROM s GROUP BY 1),
      m AS (SELECT l.side, gene, sum(v) / max(n) AS m FROM l JOIN n ON l.side = n.side GROUP BY 1, 2)
    SELECT g.gene, coalesce(t.m, 0) AS target_mean, coalesce(r.m, 0) AS reference_mean, coalesce(t.m, 0) - coalesce(r.m, 0) AS real_shift FROM (SELECT DISTINCT gene FROM c) g
      LEFT JOIN (SELECT * FROM m WHERE side = 'target') t ON g.gene = t.gene LEFT JOIN (SELECT * FROM m WHERE side = 'reference') r ON g.gene = r.gene""",
       "target_mean reference_mean real_shift")
def _(t):
    cell = F.concat_ws("_", "o_orderpriority", F.col("o_orderkey").cast("string"))
    o = t.orders.select("o_orderkey", cell.alias("cell_id"), F.col("o_orderstatus").alias("cluster"))
    used = t.lineitem.select("l_orderkey").distinct().join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    c = t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        "cell_id", F.col("p_brand").alias("gene"), F.col("l_quantity").alias("count"))
    target = validation.pick_cells(used, "1-URGENT", ["F", "O"], "target")
    reference = validation.pick_cells(used, "2-HIGH", ["F", "O"], "reference")
    return validation.real_shift(c, target, reference)


@query("rp2_predicted_shift", """
    WITH b AS (SELECT l_partkey AS gene, avg(l_quantity) AS b FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
      p AS (SELECT l_linestatus AS component, l_partkey AS gene, avg(l_quantity) AS p FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2)
    SELECT gene, sum(CASE component WHEN 'F' THEN 1 ELSE -1 END * (p - b)) AS predicted_shift, max(b) AS level FROM p JOIN b USING (gene) GROUP BY gene HAVING count(*) = 2""", "predicted_shift level")
def _(t):
    one = F.lit("x").alias("scope")
    p = t.lineitem.where("l_returnflag = 'A'").select(one, F.col("l_linestatus").alias("component"), F.col("l_partkey").alias("gene"), F.col("l_orderkey").alias("sample"), F.col("l_quantity").alias("value"))
    b = t.lineitem.where("l_returnflag = 'N'").select(one, F.col("l_partkey").alias("gene"), F.col("l_orderkey").alias("sample"), F.col("l_quantity").alias("value"))
    comps = t.lineitem.select(one, F.col("l_linestatus").alias("component")).distinct().withColumn("sign", F.when(F.col("component") == "F", 1).otherwise(-1))
    return validation.predicted_shift(p, b, comps, ["scope"], "component", "gene", "sample", "value").drop("scope")


@query("jn11_diff_reports", """
    WITH b AS (SELECT p_partkey, p_size, CASE WHEN p_size < 20 THEN 'PASS' ELSE 'FAIL' END AS v, p_retailprice AS x FROM part WHERE p_size < 45),
         a AS (SELECT p_partkey, p_size, CASE WHEN p_size < 25 THEN 'PASS' ELSE 'FAIL' END AS v, p_retailprice + p_size / 1000.0 AS x FROM part WHERE p_size > 5)
    SELECT p_partkey, b.v AS verdict_before, a.v AS verdict_after, CASE WHEN b.v IS NULL THEN 'after_only' WHEN a.v IS NULL THEN 'before_only' ELSE 'both' END AS side,
           CASE WHEN b.v IS NOT NULL AND a.v IS NOT NULL THEN b.v <> a.v END AS verdict_changed, a.x - b.x AS delta, CASE WHEN b.v IS NOT NULL AND a.v IS NOT NULL THEN abs(a.x - b.x) > 0.0205 END AS moved
    FROM b FULL OUTER JOIN a USING (p_partkey)""", "delta")
def _(t):
    size = F.col("p_size")
    b = t.part.where("p_size < 45").select("p_partkey", F.when(size < 20, "PASS").otherwise("FAIL").alias("v"), F.col("p_retailprice").alias("x"))
    a = t.part.where("p_size > 5").select("p_partkey", F.when(size < 25, "PASS").otherwise("FAIL").alias("v"), (F.col("p_retailprice") + size / 1000.0).alias("x"))
    return joins.diff_reports(b, a, ["p_partkey"], "v", "x", 0.0205).select("p_partkey", "verdict_before", "verdict_after", "side", "verdict_changed", "delta", "moved")


@query("jn13_attach_meta", """
    SELECT l_suppkey AS id, n, n_name AS dataset, CASE WHEN n > 60 THEN 'PASS' ELSE 'FAIL' END AS verdict, CASE WHEN n > 60 THEN 'PASS' ELSE 'FAIL' END AS pass_fail
    FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT -r_regionkey - 1, NULL, r_name, 'descriptive_only', 'descriptive_only' FROM region""")
def _(t):
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("n")).withColumn("verdict", F.when(F.col("n") > 60, "PASS").otherwise("FAIL"))
    meta = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("dataset"))
    extra = t.region.select((-F.col("r_regionkey") - 1).cast("bigint").alias("id"), F.col("r_name").alias("dataset"))
    return joins.attach_meta(rows, meta, "id", extra).select("id", "n", "dataset", "verdict", "pass_fail")


UNITS = """un AS (SELECT c_custkey, c_mktsegment AS cls, CASE WHEN c_acctbal < 0 THEN 'not_a_tf' WHEN c_acctbal > 9000 THEN 'tf_not_in_network' ELSE 'scored' END AS status,
              c_nationkey || ';' || (c_nationkey + 10) AS ids, '1,' || (1 + c_nationkey % 4) AS dims FROM customer)"""


def units(t):
    b, n = F.col("c_acctbal"), F.col("c_nationkey")
    return t.customer.select(
        "c_custkey", F.col("c_mktsegment").alias("cls"), F.when(b < 0, "not_a_tf").when(b > 9000, "tf_not_in_network").otherwise("scored").alias("status"),
        F.concat_ws(";", n.cast("string"), (n + 10).cast("string")).alias("ids"), F.concat(F.lit("1,"), (1 + n % 4).cast("string")).alias("dims"))


def unit_report(t):
    return t.nation.select(F.col("n_nationkey").cast("string").alias("panel_id"), F.when(F.col("n_regionkey") < 2, "PASS").otherwise("FAIL").alias("verdict"), (F.col("n_regionkey") / 8.0).alias("excess"))


COVER = f"""{UNITS}, rp AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_regionkey < 2 THEN 'PASS' ELSE 'FAIL' END AS v, n_regionkey / 8.0 AS x FROM nation),
    ix AS (SELECT c_custkey, unnest(string_split(ids, ';')) AS id, generate_subscripts(string_split(ids, ';'), 1) AS p FROM un),
    fo AS (SELECT c_custkey, string_agg(v, '/' ORDER BY p) FILTER (WHERE v IS NOT NULL) AS vs, string_agg(v, ';' ORDER BY p) FILTER (WHERE v IS NOT NULL) AS vl, string_agg(printf('%.3f', x), ';' ORDER BY p) FILTER (WHERE v IS NOT NULL) AS xs,
                  string_agg(ix.id, ';' ORDER BY p) FILTER (WHERE v IS NULL) AS ms FROM ix LEFT JOIN rp ON ix.id = rp.id GROUP BY 1),
    cov AS (SELECT un.*, CASE WHEN status = 'scored' THEN 'scored: ' || vs WHEN status = 'not_a_tf' THEN 'N/A: not a transcription factor' ELSE 'N/A: TF not in trained network (descriptive only)' END AS final_status,
                   coalesce(vl, '') AS verdicts, coalesce(xs, '') AS values, coalesce(ms, '') AS missing FROM un JOIN fo USING (c_custkey))"""


@query("jn14_coverage", f'WITH {COVER} SELECT c_custkey, final_status, verdicts, "values", missing FROM cov')
def _(t):
    return joins.coverage(units(t), unit_report(t), "c_custkey", "ids", "status", "panel_id", "verdict", "excess").select("c_custkey", "final_status", "verdicts", "values", "missing")


@query("ag12_coverage_summary", f"""
    WITH {COVER}, e AS (SELECT *, unnest(string_split(dims, ',')) AS dimension FROM cov), k AS (SELECT *, split_part(vf, '/', 1) AS v FROM (SELECT *, substr(final_status, 9) AS vf FROM e WHERE status = 'scored')),
      ta AS (SELECT dimension, cls, string_agg(v || '=' || n, ';' ORDER BY n DESC, v) AS tally FROM (SELECT dimension, cls, v, count(*) AS n FROM k GROUP BY 1, 2, 3) GROUP BY 1, 2),
      gr AS (SELECT d.dimension, c.cls FROM (VALUES ('1'), ('2'), ('3'), ('5')) d(dimension), (VALUES ('BUILDING'), ('MACHINERY')) c(cls))
    SELECT gr.dimension, gr.cls AS class, count(e.c_custkey) AS n_units, CAST(count(*) FILTER (WHERE status = 'scored') AS BIGINT) AS n_scored, CAST(count(*) FILTER (WHERE status = 'tf_not_in_network') AS BIGINT) AS n_tf_not_in_network,
           CAST(count(*) FILTER (WHERE status = 'not_a_tf') AS BIGINT) AS n_not_a_tf, 0::BIGINT AS n_other_na, coalesce(max(tally), '') AS verdicts_of_scored
    FROM gr LEFT JOIN e ON e.dimension = gr.dimension AND e.cls = gr.cls LEFT JOIN ta ON ta.dimension = gr.dimension AND ta.cls = gr.cls GROUP BY 1, 2""")
def _(t):
    cov = joins.coverage(units(t), unit_report(t), "c_custkey", "ids", "status", "panel_id", "verdict", "excess")
    v = F.substring_index(F.trim(F.substring_index("final_status", ":", -1)), "/", 1)
    return aggregates.coverage_summary(cov, "dims", "cls", "status", v, ["1", "2", "3", "5"], ["BUILDING", "MACHINERY"])


@query("jn15_attach_scope", """
    SELECT o_orderpriority, count(*) AS n, max(s) AS first_status FROM orders JOIN (SELECT o_orderpriority AS p, arg_min(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) ON o_orderpriority = p GROUP BY 1""")
def _(t):
    o = t.orders.select("o_orderpriority", "o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("s"))
    first = joins.first_per_scope(o, ["o_orderpriority"], "s", ["o_orderkey"], "first_status")
    return joins.attach_scope(o, first, ["o_orderpriority"]).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("first_status").alias("first_status"))


@query("ag10_resolve_conflicts", """
    SELECT source, 'kept' AS state, min(quality) AS sign, string_agg(DISTINCT lang, ';' ORDER BY lang) AS langs FROM (SELECT source || '_' || toxic || '_' || (doc_id % 7) AS source, quality, lang FROM labelled) GROUP BY 1 HAVING count(DISTINCT quality) = 1
    UNION ALL SELECT source, 'conflict', NULL, NULL FROM (SELECT source || '_' || toxic || '_' || (doc_id % 7) AS source, quality FROM labelled) GROUP BY 1 HAVING count(DISTINCT quality) > 1""", "", "labelled")
def _(t):
    d = S.labelled(t).select(F.concat_ws("_", "source", F.col("toxic").cast("string"), (F.col("doc_id") % 7).cast("string")).alias("source"), F.col("quality").alias("sign"), F.col("lang").alias("langs"))
    kept, conflicts = aggregates.resolve_conflicts(d, ["source"], "sign", ["langs"])
    return kept.withColumn("state", F.lit("kept")).unionByName(conflicts.withColumn("state", F.lit("conflict")), allowMissingColumns=True)


def funnel_rows(t):
    labels = t.customer.select(F.col("c_mktsegment").alias("cell_type"), "c_nationkey").distinct()
    nets = t.customer.where("c_acctbal > 9500").select(F.col("c_mktsegment").alias("cell_type"))
    bench = t.customer.where("c_acctbal > 9900").select(F.col("c_mktsegment").alias("cell_type"))
    return aggregates.funnel(labels, "cell_type", {"with_network": nets, "benchmarked": bench, "perturbed": None})


FUNNEL = """fu AS (SELECT cell_type, count(*) AS n_clusters, max(CAST(cell_type IN (SELECT c_mktsegment FROM customer WHERE c_acctbal > 9500) AS INTEGER)) = 1 AS with_network, max(CAST(cell_type IN (SELECT c_mktsegment FROM customer WHERE c_acctbal > 9900) AS INTEGER)) = 1 AS benchmarked
             FROM (SELECT DISTINCT c_mktsegment AS cell_type, c_nationkey FROM customer) GROUP BY 1)"""


@query("ag11_funnel", f"WITH {FUNNEL} SELECT *, CAST(NULL AS BOOLEAN) AS perturbed, CASE WHEN benchmarked THEN 'benchmarked' WHEN with_network THEN 'with_network' ELSE 'labelled' END AS last_stage FROM fu")
def _(t):
    return funnel_rows(t)


@query("ag11_funnel_summary", f"""
    WITH {FUNNEL} SELECT 'clusters_annotated' AS stage, CAST(sum(n_clusters) AS BIGINT) AS n FROM fu UNION ALL SELECT 'labelled', count(*) FROM fu UNION ALL SELECT 'with_network', count(*) FILTER (WHERE with_network) FROM fu
    UNION ALL SELECT 'benchmarked', count(*) FILTER (WHERE benchmarked) FROM fu UNION ALL SELECT 'perturbed', NULL FROM fu GROUP BY 1""")
def _(t):
    return aggregates.funnel_summary(funnel_rows(t), ["with_network", "benchmarked", "perturbed"])


@query("ag15_check_difference", """
    WITH f AS (SELECT o_orderpriority AS scope, o_orderstatus AS c, arg_min(o_totalprice, o_orderkey) AS v FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2)
    SELECT scope, max(v) FILTER (WHERE c = 'F') - max(v) FILTER (WHERE c = 'O') AS difference FROM f GROUP BY 1""", "difference")
def _(t):
    return aggregates.check_difference(t.orders.withColumnRenamed("o_orderpriority", "scope"), "scope", "o_orderstatus", "o_totalprice", ["o_orderkey"], "F", "O")


@query("ag16_sanity", f"""
    WITH e AS (SELECT l_linestatus AS scope, l_suppkey AS gene, l_partkey AS sample, sum(l_quantity) AS p, sum(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2, 3),
      r AS (SELECT scope, gene, {avg_rank_sql('p', 'scope, gene')} AS a, {avg_rank_sql('m', 'scope, gene')} AS b FROM e), c AS (SELECT scope, gene, corr(a, b) AS rho FROM r GROUP BY 1, 2)
    SELECT c.scope, quantile_cont(rho, 0.5) AS sanity_rho, avg(CAST(rho > 0.3 AS DOUBLE)) AS sanity_frac, count(*) AS n_genes, max(n) AS sanity_n_samples, quantile_cont(rho, 0.5) >= 0.5 AND avg(CAST(rho > 0.3 AS DOUBLE)) >= 0.7 AS sanity_pass
    FROM c JOIN (SELECT scope, count(DISTINCT sample) AS n FROM e GROUP BY 1) s ON c.scope = s.scope WHERE rho IS NOT NULL GROUP BY 1""", "sanity_rho sanity_frac")
def _(t):
    e = t.lineitem.groupBy(F.col("l_linestatus").alias("scope"), F.col("l_suppkey").alias("gene"), F.col("l_partkey").alias("sample")).agg(F.sum("l_quantity").alias("p"), F.sum("l_extendedprice").alias("m"))
    return aggregates.sanity(e.withColumnRenamed("p", "value"), e.withColumnRenamed("m", "value"), ["scope"], "gene", "sample", "value")


@query("ag17_sample_report", """
    WITH a AS (SELECT o_orderpriority AS s, o_orderkey AS c, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS p FROM orders),
      b AS (SELECT s, c, CASE WHEN s LIKE '3%' AND p = 1 THEN 2 WHEN s LIKE '3%' AND p = 2 THEN 1 ELSE p END AS p FROM a WHERE NOT (s LIKE '2%' AND p = 1)),
      m AS (SELECT coalesce(a.s, b.s) AS s, count(a.c) AS ra, count(b.c) AS rb, count(*) FILTER (WHERE a.c IS NULL OR b.c IS NULL) AS single, count(*) FILTER (WHERE a.p <> b.p) AS moved FROM a FULL OUTER JOIN b ON a.s = b.s AND a.c = b.c GROUP BY 1),
      f AS (SELECT o_orderpriority AS s, count(DISTINCT l_suppkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT m.s AS sample_id, CASE WHEN single > 0 THEN 'MISMATCH' WHEN moved > 0 THEN 'SAME_SET_DIFF_ORDER' ELSE 'OK' END AS barcodes_match, ra AS n_obs_rna, rb AS n_obs_atac, f.n AS n_features, f.n = 10 AS n_features_ok,
           round(100.0 * rb / ra, 2)::DOUBLE AS pct_retained, CASE WHEN m.s LIKE '1%' THEN 0.2 ELSE 0.05 END::DOUBLE AS doublet_rate, m.s LIKE '1%' AS doublet_flag FROM m JOIN f ON m.s = f.s""", "pct_retained doublet_rate")
def _(t):
    from shiftgrid.operators.ordered import numbered

    o = t.orders.select(F.col("o_orderpriority").alias("sample_id"), F.col("o_orderkey").alias("cell_id"))
    rna = numbered(o, ["sample_id"], ["cell_id"], "position")
    p, three = F.col("position"), F.startswith("sample_id", F.lit("3"))
    atac = rna.where(~(F.startswith("sample_id", F.lit("2")) & (p == 1))).withColumn("position", F.when(three & (p == 1), 2).when(three & (p == 2), 1).otherwise(p))
    feats = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("sample_id"), F.col("l_suppkey").alias("feature_id"))
    dbl = o.select("sample_id").distinct().withColumn("doublet_rate", F.when(F.startswith("sample_id", F.lit("1")), 0.2).otherwise(0.05))
    return aggregates.sample_report(rna, atac, o, feats, dbl, 10)


@query("so2_stack", "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS verdict FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, NULL FROM supplier", "balance")
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    out = joins.stack([a, b], ["id", "balance", "segment", "verdict"])
    return out.withColumn("verdict", F.col("verdict").cast("string"))


@query("so4_id_diff", """
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'b_only' WHEN b.k IS NULL THEN 'a_only' ELSE 'both' END AS side FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A') a FULL OUTER JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') b ON a.k = b.k""")
def _(t):
    k = t.lineitem.select(F.col("l_orderkey").alias("k"), "l_returnflag")
    return joins.id_diff(k.where("l_returnflag = 'A'"), k.where("l_returnflag = 'R'"), "k")


@query("so6_panel", """
    SELECT DISTINCT p_partkey AS gene FROM part WHERE p_brand IN ('Brand#11', 'Brand#13') AND p_size >= 10 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)""")
def _(t):
    sets = t.part.select(F.col("p_brand").alias("set_name"), F.col("p_partkey").alias("gene"))
    small = t.part.where("p_size < 10").select(F.col("p_partkey").alias("gene"))
    heavy = t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("gene"))
    return joins.panel(sets, ["Brand#11", "Brand#13"], [small, heavy])


@query("rp18_build_gold", """
    WITH i AS (SELECT arg_min(p_name, p_partkey) AS tf, upper(p_name) AS up FROM part GROUP BY 2),
      b AS (SELECT 'B' AS tier, i.tf, CASE WHEN c_acctbal > 0 THEN 1 ELSE -1 END AS sign, 'models:' || c_mktsegment AS ev FROM customer JOIN (SELECT p_partkey, p_name FROM part) p ON c_custkey = p_partkey JOIN i ON upper(p.p_name) = i.up),
      d AS (SELECT 'D' AS tier, i.tf, 0 AS sign, 'member' AS ev FROM supplier JOIN part ON s_suppkey = p_partkey JOIN i ON upper(p_name) = i.up), r AS (SELECT * FROM b UNION ALL SELECT * FROM d)
    SELECT tier, tf, min(sign) AS expected_ko_sign, string_agg(DISTINCT ev, ';' ORDER BY ev) AS evidence FROM r GROUP BY 1, 2 HAVING min(sign) = max(sign)""")
def _(t):
    index = t.part.select(F.col("p_name").alias("tf"), F.col("p_partkey").alias("position"))
    names = t.part.select("p_partkey", F.lower("p_name").alias("symbol"))
    b = t.customer.join(names, F.col("c_custkey") == F.col("p_partkey"))
    effect = F.when(F.col("c_acctbal") > 0, "Pro-Longevity").otherwise("Anti-Longevity")
    recs_b = gold.tier_records(b, index, "B", "models", "symbol", X.longevity_sign(effect), F.concat(F.lit("models:"), "c_mktsegment"), F.lit("r"))
    d = t.supplier.join(names, F.col("s_suppkey") == F.col("p_partkey"))
    recs_d = gold.tier_records(d, index, "D", "member", "symbol", F.lit(0), F.lit("member"), F.lit("r"))
    kept, _ = gold.build_gold([recs_b, recs_d])
    return kept.select("tier", "tf", "expected_ko_sign", "evidence")


# -------------------------------------------------------------------------------------------------------------- audits
@query("tq1_audit_mixing", f"""
    WITH {NAMED} SELECT entry, count(*) AS n_samples, false AS looks_like_barcodes, 'knockout,wildtype' AS genotype, 'dapt,treated,untreated,vehicle' AS treatment, 'FLAGGED_LIKELY_MIXED' AS status FROM nm GROUP BY 1""")
def _(t):
    cols = audit.column_cardinality(t.orders.withColumnRenamed("o_orderpriority", "entry"), "entry", ["o_orderstatus", "o_custkey"])
    return audit.audit_mixing(named(t), "entry", "name", cols).select("entry", "n_samples", "looks_like_barcodes", "genotype", "treatment", "status")


@query("tq1_prefix_clusters", f"""
    WITH {NAMED} SELECT entry, CASE k WHEN 0 THEN 'wt' WHEN 1 THEN 'cre_ko1_' || regexp_extract(name, '[0-9]+mo') WHEN 2 THEN CASE WHEN length(regexp_extract(name, '[0-9]+$')) <= 3 THEN 'dapt_treated' END WHEN 3 THEN 'acgtacgtacgt' ELSE 'vehicle_untreated' END AS prefix, count(*) AS n FROM nm GROUP BY 1, 2""")
def _(t):
    return audit.prefix_clusters(named(t), "entry", "name")


@query("tq1_column_cardinality", """
    SELECT entry, "column", n_distinct FROM (SELECT o_orderpriority AS entry, 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS n_distinct FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, 'o_custkey', count(DISTINCT o_custkey) FROM orders GROUP BY 1)""")
def _(t):
    return audit.column_cardinality(t.orders.withColumnRenamed("o_orderpriority", "entry"), "entry", ["o_orderstatus", "o_custkey"])


@query("tq2_compare_tables", """
    SELECT scope, CASE scope WHEN 'A' THEN 'OK' WHEN 'N' THEN 'VALUE_DIFF' ELSE 'NAN_POSITION_MISMATCH' END AS status, 0::BIGINT AS n_unmatched,
           CASE scope WHEN 'R' THEN count(*) FILTER (WHERE value > 40) ELSE 0 END::BIGINT AS n_undefined_moved, CASE WHEN scope = 'N' THEN 0.5 ELSE 0 END::DOUBLE AS max_abs_diff FROM expr GROUP BY 1""", "max_abs_diff", "expr")
def _(t):
    a = S.expr(t)
    v, s = F.col("value"), F.col("scope")
    b = a.withColumn("value", F.when(s == "N", v + 0.5).when((s == "R") & (v > 40), F.lit(float("nan"))).otherwise(v))
    return audit.compare_tables(a, b, ["scope"], "gene", "sample", "value")


@query("tq3_triage", """SELECT doc_id, regexp_matches(text, '(?i)\\b(control|treated|old|young|month)\\b') AS needs_look FROM documents""".replace("\\\\", "\\"))
def _(t):
    return audit.triage(t.documents, "text", r"(?i)\b(control|treated|old|young|month)\b").select("doc_id", "needs_look")


@query("tq3_referring", """
    WITH p AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(url, '(example\\.[a-z]+)', 1)) AS id FROM pages) SELECT id, count(*) AS n_entries, min(page_id) AS first_entry FROM p GROUP BY 1""".replace("\\\\", "\\"))
def _(t):
    pairs = audit.inverted_index(t.pages, "page_id", "url", lambda c: F.regexp_extract_all(c, F.lit(r"(example\.[a-z]+)"), F.lit(1)))
    return audit.referring(pairs, "page_id")
