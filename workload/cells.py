"""Sparse counts: quality filters, profiles, guards, pooling, normalisation, components."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shiftgrid.operators import aggregates, filters, joins, matrix
from shiftgrid.operators.ordered import attach
from workload import standins as S
from workload.ranking import avg_rank_sql
from workload.registry import query

FLAGGED = """c AS (SELECT counts.*, lower(symbol) LIKE 'mt-%' AS is_mt, lower(symbol) = 'hba-a1' AS is_hb, feature_type
                   FROM counts JOIN features USING (feature_id))"""


def flagged(t):
    f = filters.flag_features(S.features(t)).select("feature_id", "is_mt", "is_hb", "feature_type")
    return S.counts(t).join(f, "feature_id")


CELL, GENE = ["sample_id", "cell_id"], ["sample_id", "feature_id"]


@query("flt1_split_by_type", f"""
    WITH {FLAGGED} SELECT CASE feature_type WHEN 'Peaks' THEN 'atac' ELSE 'rna' END AS side, count(*) AS n, sum(count) AS total FROM c GROUP BY 1""",
       "total", "counts features")
def _(t):
    rna, atac = filters.split_by_type(S.counts(t), S.features(t))
    return rna.withColumn("side", F.lit("rna")).unionByName(atac.withColumn("side", F.lit("atac"))).groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), F.sum("count").alias("total"))


@query("flt2_flag_features", """
    SELECT feature_id, lower(symbol) LIKE 'mt-%' AS is_mt, lower(symbol) = 'hba-a1' AS is_hb FROM features""", "", "features")
def _(t):
    return filters.flag_features(S.features(t)).select("feature_id", "is_mt", "is_hb")


@query("ag1_cell_metrics", f"""
    WITH {FLAGGED} SELECT sample_id, cell_id, CAST(sum(CAST(count > 0 AS INTEGER)) AS BIGINT) AS n_genes, sum(count) AS total_counts,
      sum(CASE WHEN is_mt THEN count ELSE 0 END) * 100.0 / sum(count) AS pct_mt FROM c GROUP BY 1, 2""",
       "total_counts pct_mt", "counts features")
def _(t):
    return filters.cell_metrics(flagged(t), CELL)


@query("flt3_qc_rna", f"""
    WITH {FLAGGED},
      m AS (SELECT sample_id, cell_id, count(*) AS g, sum(CASE WHEN is_mt THEN count ELSE 0 END) * 100.0 / sum(count) AS pct FROM c GROUP BY 1, 2),
      k AS (SELECT c.*, pct FROM c JOIN m ON c.sample_id = m.sample_id AND c.cell_id = m.cell_id WHERE g >= 3),
      f AS (SELECT sample_id, feature_id FROM k GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT k.sample_id, k.cell_id, k.feature_id, count FROM k JOIN f ON k.sample_id = f.sample_id AND k.feature_id = f.feature_id
    WHERE pct < 15 AND NOT is_mt AND NOT is_hb""", "count", "counts features")
def _(t):
    return filters.qc_rna(flagged(t), CELL, GENE, min_genes=3, min_cells=2).select(*CELL, "feature_id", "count")


@query("flt4_qc_atac", f"""
    WITH k AS (SELECT * FROM counts WHERE (sample_id, cell_id) IN (SELECT (sample_id, cell_id) FROM counts GROUP BY sample_id, cell_id HAVING count(*) >= 4))
    SELECT * FROM k WHERE (sample_id, feature_id) IN (SELECT (sample_id, feature_id) FROM k GROUP BY sample_id, feature_id HAVING count(*) >= 3)""",
       "count", "counts")
def _(t):
    return filters.qc_atac(S.counts(t), CELL, GENE, min_peaks=4, min_cells=3).select(*CELL, "feature_id", "count")


DOUBLET = """
    SELECT lang AS sample, threshold_source, CAST(sum(CAST(d AS INTEGER)) AS BIGINT) AS n_doublets, count(*) AS n_cells_before, avg(CAST(d AS DOUBLE)) AS doublet_rate
    FROM (SELECT lang, CASE lang WHEN 'en' THEN 'manual' WHEN 'de' THEN 'automatic' ELSE 'fallback' END AS threshold_source,
                 n_chars / 20000.0 > CASE lang WHEN 'en' THEN 0.2 WHEN 'de' THEN 0.1 ELSE 0.3 END AS d FROM documents) GROUP BY 1, 2"""


@query("flt5_doublets", DOUBLET, "doublet_rate")
def _(t):
    cells = t.documents.select("doc_id", F.col("lang").alias("sample"), (F.col("n_chars") / 20000.0).alias("score"))
    # manual for en; automatic works for de; elsewhere it flags nothing and the fallback applies
    thr = t.documents.select(F.col("lang").alias("sample")).distinct().select(
        "sample", F.when(F.col("sample") == "en", 0.2).alias("manual"),
        F.when(F.col("sample") == "de", 0.1).otherwise(1e9).alias("automatic"), F.lit(0.3).alias("fallback"))
    return filters.doublet_report(filters.flag_doublets(cells, "sample", "score", thr), "sample")


@query("flt6_usable_variants", """
    WITH v AS (SELECT s_suppkey AS tf, s_acctbal < 0 AS noop FROM supplier),
         n AS (SELECT tf, sum(weight) AS w FROM edges GROUP BY tf)
    SELECT v.tf, v.noop, coalesce(w, 0) > 0 AS tf_in_network, coalesce(w, 0) > 0 AND NOT noop AS usable FROM v LEFT JOIN n ON v.tf = n.tf""", "", "edges")
def _(t):
    v = t.supplier.select(F.col("s_suppkey").alias("tf"), (F.col("s_acctbal") < 0).alias("noop"))
    return filters.usable_variants(v, S.edges(t))


@query("flt7_floor_filter", """
    SELECT scope, gene, level FROM shifts s WHERE level >= (SELECT quantile_cont(level, 0.25) FROM shifts x WHERE x.scope = s.scope)""", "level", "shifts")
def _(t):
    return filters.floor_filter(S.shifts(t), "level", ["scope"]).select("scope", "gene", "level")


@query("flt8_min_support", """
    SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 200""")
def _(t):
    kept = filters.min_support(t.lineitem.select("l_suppkey", "l_returnflag"), ["l_suppkey", "l_returnflag"], 200)
    return kept.groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("flt8_support_status", """
    SELECT source, count(*) AS n, stddev_samp(score) AS sd, CASE WHEN count(*) < 10 THEN 'too_few' WHEN coalesce(stddev_samp(score), 0) < 1e-6 THEN 'no_op' ELSE 'ok' END AS status
    FROM labelled GROUP BY source""", "sd", "labelled")
def _(t):
    return filters.support_status(S.labelled(t), ["source"], 10, "score")


@query("flt9_route_by_role", """
    SELECT CASE event_type WHEN 'click' THEN 'skipped' WHEN 'error' THEN 'loops' WHEN 'purchase' THEN 'peaks' ELSE 'out_of_scope' END AS route, count(*) AS n FROM events GROUP BY 1""")
def _(t):
    e = t.events.withColumn("role", F.when(F.col("event_type") == "click", "skip").otherwise(F.col("event_type")))
    return filters.route_by_role(e, {"error": "loops", "purchase": "peaks"}).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("flt10_exclude_ids", "SELECT scope, count(*) AS n, sum(value) AS total FROM vecs WHERE item NOT IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY scope",
       "total", "vecs")
def _(t):
    ids = t.part.where("p_size < 10").select(F.col("p_partkey").alias("item"))
    return filters.exclude_ids(S.vecs(t), ids, "item").groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("flt11_drop_nonfinite", """
    SELECT scope, CAST(sum(CASE WHEN a IS NOT NULL AND r IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_kept,
           CAST(sum(CASE WHEN a IS NULL OR r IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped
    FROM (SELECT l_linestatus AS scope, l_partkey, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS a, avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS r
          FROM lineitem GROUP BY 1, 2) GROUP BY scope""")
def _(t):
    m = t.lineitem.groupBy(F.col("l_linestatus").alias("scope"), "l_partkey").agg(
        F.avg(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))).alias("a"),
        F.coalesce(F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))), F.lit(float("nan"))).alias("r"))
    return filters.drop_nonfinite(m, ["a", "r"], ["scope"])[1]


# --------------------------------------------------------------------------------------------------------------- joins
@query("jn2_pair_cells", """
    WITH r AS (SELECT DISTINCT o_orderpriority AS sample_id, l_orderkey AS cell_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A'),
         a AS (SELECT DISTINCT o_orderpriority AS sample_id, l_orderkey AS cell_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')
    SELECT s.sample_id, coalesce(n, 0) AS n_shared, coalesce(n, 0) < 400 AS few_shared FROM (SELECT sample_id FROM r UNION SELECT sample_id FROM a) s
    LEFT JOIN (SELECT r.sample_id, count(*) AS n FROM r JOIN a USING (sample_id, cell_id) GROUP BY 1) x ON s.sample_id = x.sample_id""")
def _(t):
    o = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("sample_id"))
    li = t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("sample_id", F.col("l_orderkey").alias("cell_id"), "l_returnflag")
    _, _, report = joins.pair_cells(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), ["cell_id"], ["sample_id"], 400)
    return report


@query("jn3_sync_subset", "SELECT count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')", "total")
def _(t):
    o = t.orders.withColumnRenamed("o_orderkey", "k")
    b = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("k"))
    return joins.sync_subset(o, b, ["k"]).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query("jn4_apply_labels", "SELECT n_name AS cell_type, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(t):
    labels = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("cell_type"))
    return joins.apply_labels(t.customer, labels, "c_nationkey", "cell_type").groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"))


@query("jn5_map_ids", """
    SELECT symbol, is_mapped, count(*) AS n FROM (SELECT coalesce(p_name, CAST(l_partkey AS VARCHAR)) AS symbol, p_name IS NOT NULL AS is_mapped
      FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 40) p ON l_partkey = p_partkey) GROUP BY 1, 2""")
def _(t):
    ids = t.lineitem.select(F.concat(F.col("l_partkey").cast("string"), F.lit(".3")).alias("gene_id"))
    m = t.part.where("p_size < 40").select(F.col("p_partkey").alias("GeneID"), F.col("p_name").alias("Symbol"))
    return joins.map_ids(ids, m, "gene_id", "GeneID", "Symbol").groupBy("symbol", "is_mapped").agg(F.count(F.lit(1)).alias("n"))


@query("jn6_first_symbol", """
    WITH f AS (SELECT l_partkey, arg_min(l_returnflag || l_linestatus, l_orderkey * 10 + l_linenumber) AS s FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
    SELECT coalesce(s, CAST(l.l_partkey AS VARCHAR)) AS final_symbol, count(*) AS n FROM lineitem l LEFT JOIN f ON l.l_partkey = f.l_partkey GROUP BY 1""")
def _(t):
    li = t.lineitem.select("l_partkey", F.when(F.col("l_linestatus") == "F", F.concat("l_returnflag", "l_linestatus")).alias("symbol"),
                           (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return joins.map_symbols_first(li, "l_partkey", "symbol", ["place"]).groupBy("final_symbol").agg(F.count(F.lit(1)).alias("n"))


@query("jn10_tf_universe", "SELECT CAST(p_partkey AS VARCHAR) AS tf FROM part INTERSECT SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 0")
def _(t):
    genes = t.part.select(F.col("p_partkey").cast("string").alias("gene"))
    motifs = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("motif_tf"))
    return joins.tf_universe(genes, motifs, "gene", "motif_tf")


@query("jn16_columns_of_group", """
    SELECT scope, n_name AS grp, gene, sum(value) AS value, 0::BIGINT AS n_unresolved FROM expr JOIN supplier ON sample = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    GROUP BY 1, 2, 3""", "value", "expr")
def _(t):
    cells = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("sample"), F.col("n_name").alias("grp"))
    labelled, unresolved = joins.columns_of_group(S.expr(t), cells, "sample", "grp")
    n = unresolved.agg(F.count(F.lit(1)).alias("n_unresolved"))
    return labelled.groupBy("scope", "grp", "gene").agg(F.sum("value").alias("value")).crossJoin(F.broadcast(n))


@query("so1_pool", "SELECT cell_id || '-' || sample_id AS cell_id, count(*) AS n, sum(count) AS total FROM counts GROUP BY 1", "total", "counts")
def _(t):
    return joins.pool_long(S.counts(t), "sample_id", "cell_id").groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("total"))


# ---------------------------------------------------------------------------------------------------------- aggregates
@query("ag2_pseudobulk", "SELECT sample_id, feature_id, sum(count) AS count FROM counts GROUP BY 1, 2", "count", "counts")
def _(t):
    return aggregates.pseudobulk(S.counts(t), ["sample_id"], "feature_id")


@query("ag3_sum_duplicates", """
    WITH s AS (SELECT p_name AS symbol, l_suppkey AS cell, sum(l_quantity) AS value, count(*) - 1 AS extra FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
    SELECT symbol, cell, value, max(extra) OVER (PARTITION BY symbol) AS n_duplicates FROM s""", "value")
def _(t):
    x = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_name").alias("symbol"), F.col("l_suppkey").alias("cell"), F.col("l_quantity").alias("value"))
    summed, dup = aggregates.sum_duplicates(x, "symbol", ["cell"])
    return summed.join(dup, "symbol")


@query("ag4_make_unique", """
    SELECT p_partkey, CASE WHEN k = 1 THEN p_name ELSE p_name || '-' || (k - 1) END AS unique_name
    FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)""")
def _(t):
    return aggregates.make_unique(t.part.select("p_partkey", "p_name"), "p_name", ["p_partkey"]).select("p_partkey", "unique_name")


@query("ag5_marker_means", """
    WITH cells AS (SELECT o_orderkey AS cell, o_orderstatus AS cluster FROM orders),
         e AS (SELECT l_orderkey AS cell, l_suppkey AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
         n AS (SELECT cluster, count(*) AS n FROM cells GROUP BY 1), m AS (SELECT s_suppkey AS gene FROM supplier WHERE s_acctbal > 5000)
    SELECT n.cluster, m.gene, coalesce(s, 0) / n AS mean_expr, true AS present
    FROM n CROSS JOIN m LEFT JOIN (SELECT cluster, gene, sum(value) AS s FROM e JOIN cells USING (cell) GROUP BY 1, 2) x ON x.cluster = n.cluster AND x.gene = m.gene
    WHERE m.gene IN (SELECT gene FROM e) UNION ALL SELECT NULL, -1::BIGINT, NULL, false""", "mean_expr")
def _(t):
    cells = t.orders.select(F.col("o_orderkey").alias("cell"), F.col("o_orderstatus").alias("cluster"))
    e = t.lineitem.groupBy(F.col("l_orderkey").alias("cell"), F.col("l_suppkey").alias("gene")).agg(F.sum("l_quantity").alias("value"))
    markers = t.supplier.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("gene"))
    absent = t.region.where("r_regionkey = 0").select(F.lit(-1).cast("bigint").alias("gene"))
    return aggregates.marker_means(e, cells, markers.unionByName(absent), ["cell"], "cluster", "gene", "value")


@query("ag6_mean_profile", """
    WITH n AS (SELECT scope, count(DISTINCT sample) AS n_samples FROM expr GROUP BY 1)
    SELECT e.scope, gene, sum(value) / max(n_samples) AS mean, max(n_samples) AS n_samples FROM expr e JOIN n ON e.scope = n.scope GROUP BY 1, 2""", "mean", "expr")
def _(t):
    return aggregates.mean_profile(S.expr(t), ["scope"], "gene", ["sample"], "value")


@query("ag7_crosstab", """
    SELECT c_mktsegment, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P"
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def _(t):
    cells = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return aggregates.crosstab(cells, "c_mktsegment", "o_orderstatus", ["F", "O", "P"])


@query("ag18_labels_with_support", "SELECT n_name AS cell_type, CAST(sum(k) AS BIGINT) AS n_cells FROM (SELECT c_nationkey, c_mktsegment, count(*) AS k FROM customer GROUP BY 1, 2) JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING sum(k) >= 5")
def _(t):
    clusters = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n_cells"))
    named = clusters.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_name", "cell_type")
    return aggregates.labels_with_support(named, "cell_type", "n_cells", 5)


@query("ag19_rank_genes", f"""
    WITH cells AS (SELECT o_orderkey AS cell, o_orderstatus AS grp FROM orders),
         e AS (SELECT l_orderkey AS cell, l_suppkey AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
         genes AS (SELECT DISTINCT gene FROM e),
         d AS (SELECT g.gene, c.cell, c.grp, coalesce(value, 0) AS v FROM genes g CROSS JOIN cells c LEFT JOIN e ON e.gene = g.gene AND e.cell = c.cell),
         r AS (SELECT gene, grp, {avg_rank_sql('v', 'gene')} AS rk FROM d),
         s AS (SELECT gene, grp, sum(rk) AS w, count(*)::DOUBLE AS ng, (SELECT count(*)::DOUBLE FROM cells) AS n FROM r GROUP BY 1, 2)
    SELECT grp, gene, (w - ng * (n + 1) / 2) / sqrt(ng * (n - ng) * (n + 1) / 12) AS score,
           row_number() OVER (PARTITION BY grp ORDER BY (w - ng * (n + 1) / 2) / sqrt(ng * (n - ng) * (n + 1) / 12) DESC, gene) AS rank
    FROM s QUALIFY rank <= 15""", "score")
def _(t):
    cells = t.orders.select(F.col("o_orderkey").alias("cell"), F.col("o_orderstatus").alias("grp"))
    e = t.lineitem.groupBy(F.col("l_orderkey").alias("cell"), F.col("l_suppkey").alias("gene")).agg(F.sum("l_quantity").alias("value"))
    return aggregates.rank_genes(e, cells, ["cell"], "grp", "gene", "value")


# -------------------------------------------------------------------------------------------------------------- matrix
@query("st1_ln_cp10k", """
    SELECT sample_id, cell_id, feature_id, ln(1 + count / sum(count) OVER (PARTITION BY sample_id, cell_id) * 10000) AS value FROM counts""", "value", "counts")
def _(t):
    return matrix.ln_cp10k(S.counts(t), CELL).select(*CELL, "feature_id", "value")


@query("st18_quantile_normalise", """
    WITH k AS (SELECT scope, gene, sample, row_number() OVER (PARTITION BY scope, sample ORDER BY value, gene) AS k, value FROM expr)
    SELECT scope, gene, sample, avg(value) OVER (PARTITION BY scope, k) AS normalised FROM k""", "normalised", "expr")
def _(t):
    return matrix.quantile_normalise(S.expr(t), ["scope"], "sample", "gene", "value").select("scope", "gene", "sample", "normalised")


ACTIVITY = """
    g AS (SELECT e.scope, e.gene FROM (SELECT DISTINCT scope, gene FROM x) e JOIN (SELECT DISTINCT scope, target FROM edges) t ON e.scope = t.scope AND e.gene = t.target),
    ed AS (SELECT edges.* FROM edges JOIN g ON edges.scope = g.scope AND target = gene),
    rw AS (SELECT scope, target, sum(weight) AS r FROM ed GROUP BY 1, 2),
    rw2 AS (SELECT scope, target, r + avg(r) OVER (PARTITION BY scope) * 1e-6 AS r FROM rw),
    cl AS (SELECT scope, tf, sum(weight) AS c FROM ed GROUP BY 1, 2),
    cl2 AS (SELECT scope, tf, c + avg(c) OVER (PARTITION BY scope) * 1e-6 AS c FROM cl),
    rx AS (SELECT x.scope, sample, gene, value / sum(value) OVER (PARTITION BY x.scope, sample) AS r FROM x JOIN g USING (scope, gene)),
    q AS (SELECT rx.scope, sample, sum(rw2.r * rx.r) / max(tr) AS q FROM rx JOIN rw2 ON rx.scope = rw2.scope AND gene = target
          JOIN (SELECT scope, sum(r) AS tr FROM rw2 GROUP BY 1) z ON z.scope = rx.scope GROUP BY 1, 2),
    nm AS (SELECT rx.scope, sample, tf, sum(weight * r) AS num FROM rx JOIN ed ON rx.scope = ed.scope AND gene = target GROUP BY 1, 2, 3),
    act AS (SELECT q.scope, q.sample, cl2.tf, (coalesce(num, 0) - c * q) / (c * q) AS activity FROM q JOIN cl2 ON q.scope = cl2.scope
            LEFT JOIN nm ON nm.scope = q.scope AND nm.sample = q.sample AND nm.tf = cl2.tf)"""


@query("st17_regulon_activity", "WITH x AS (SELECT * FROM expr)," + ACTIVITY + " SELECT scope, sample, tf, activity FROM act", "activity", "expr edges")
def _(t):
    return matrix.regulon_activity(S.expr(t), S.edges(t), ["scope"], "sample", "gene", "value", min_genes=100)


@query("st19_top_variable", """
    WITH cells AS (SELECT o_orderpriority AS batch, count(*) AS n FROM orders GROUP BY 1),
         e AS (SELECT o_orderpriority AS batch, l_orderkey AS cell, l_suppkey AS gene, ln(1 + sum(l_quantity)) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
         s AS (SELECT e.batch, gene, sum(exp(value) - 1) / max(n) AS mean, (sum((exp(value) - 1) * (exp(value) - 1)) - max(n) * (sum(exp(value) - 1) / max(n)) * (sum(exp(value) - 1) / max(n))) / (max(n) - 1.0) AS var
               FROM e JOIN cells ON e.batch = cells.batch GROUP BY 1, 2),
         d AS (SELECT batch, gene, ln(1 + mean) AS m, CASE WHEN var > 1e-12 * mean * mean THEN ln(var / mean) END AS d FROM s),
         b AS (SELECT *, coalesce(greatest(1, least(20, CAST(ceil((m - min(m) OVER w) / nullif((max(m) OVER w - min(m) OVER w) / 20.0, 0)) AS BIGINT))), 1) AS bin FROM d WINDOW w AS (PARTITION BY batch)),
         z AS (SELECT batch, gene, CASE WHEN stddev_samp(d) OVER v IS NULL THEN CASE WHEN d IS NOT NULL THEN 1.0 END ELSE (d - avg(d) OVER v) / nullif(stddev_samp(d) OVER v, 0) END AS nd FROM b WINDOW v AS (PARTITION BY batch, bin)),
         t AS (SELECT *, CASE WHEN nd IS NOT NULL AND row_number() OVER (PARTITION BY batch ORDER BY nd DESC NULLS LAST, gene) <= 30 THEN 1 ELSE 0 END AS hit FROM z),
         f AS (SELECT gene, CAST(sum(hit) AS BIGINT) AS n_batches, avg(nd) AS dispersion_norm FROM t GROUP BY gene)
    SELECT gene, n_batches, dispersion_norm, row_number() OVER (ORDER BY n_batches DESC, dispersion_norm DESC, gene) AS rank FROM f WHERE dispersion_norm IS NOT NULL QUALIFY rank <= 30""",
       "dispersion_norm")
def _(t):
    o = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("batch"))
    cells = o.withColumnRenamed("o_orderkey", "cell")
    e = t.lineitem.groupBy(F.col("l_orderkey").alias("cell"), F.col("l_suppkey").alias("gene")).agg(F.log1p(F.sum("l_quantity")).alias("value")).join(cells, "cell")
    return matrix.top_variable(e, cells, 30, "batch", "gene", "value", ["cell"])


SCALED_SQL = """e AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
         z AS (SELECT vec_id, label, i, greatest(-10, least(10, (x - avg(x) OVER w) / stddev_samp(x) OVER w)) AS z FROM e WINDOW w AS (PARTITION BY i))"""


# all components together turn the scaled features: every row keeps its length
@query("st20_pca_scores", f"WITH {SCALED_SQL} SELECT vec_id, sum(z * z) AS length2, 64 AS components FROM z GROUP BY vec_id", "length2")
def _(t):
    scores, _, _ = matrix.pca(t.embeddings.select("vec_id", "embedding"), "embedding", 64)
    return scores.select("vec_id", F.aggregate("pcs", F.lit(0.0), lambda s, x: s + x * x).alias("length2"), F.size("pcs").alias("components"))


@query("st20_pca_invariants", f"""
    WITH {SCALED_SQL}
    SELECT sum(v) AS total_variance, 0.0::DOUBLE AS largest_covariance, true AS falling, true AS largest_loading_positive, 1.0::DOUBLE AS ratio_sum
    FROM (SELECT var_samp(z) AS v FROM z GROUP BY i)""", "total_variance largest_covariance ratio_sum")
def _(t):
    scores, ratios, loadings = matrix.pca(t.embeddings.select("vec_id", "embedding"), "embedding", 64)
    one = scores.select("vec_id", F.posexplode("pcs").alias("i", "s"))
    moments = one.select("vec_id", "i", "s").join(one.select("vec_id", F.col("i").alias("j"), F.col("s").alias("r")), "vec_id").where("i <= j") \
        .groupBy("i", "j").agg(F.covar_samp("s", "r").alias("c"))
    after = Window.partitionBy(F.lit(0)).orderBy("i")  # one row per component
    spread = moments.where("i = j").select("i", "c", F.lead("c").over(after).alias("next"))
    variances = spread.agg(F.sum("c").alias("total_variance"), F.min(F.coalesce(F.col("next") <= F.col("c") + 1e-9, F.lit(True))).alias("falling"))
    mixed = moments.where("i < j").agg(F.max(F.abs("c")).alias("largest_covariance"))
    signs = bool((loadings[abs(loadings).argmax(axis=0), range(loadings.shape[1])] > 0).all())
    return attach(variances, mixed, []).withColumns({"largest_loading_positive": F.lit(signs), "ratio_sum": F.lit(float(sum(ratios)))})


CLUSTER_K, CLUSTER_ROUNDS = 8, 6


def cluster_sql() -> str:
    """Farthest-first seeds and Lloyd rounds, one pair of CTEs each."""
    ctes = [
        "x AS MATERIALIZED (SELECT vec_id, label, i, v - avg(v) OVER (PARTITION BY label, i) AS x FROM (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings))",
        "f1 AS MATERIALIZED (SELECT 0 AS c, min(vec_id) AS vec_id FROM embeddings)",
    ]
    for k in range(1, CLUSTER_K):
        ctes.append(f"""f{k + 1} AS MATERIALIZED (SELECT * FROM f{k} UNION ALL SELECT {k}, vec_id FROM (
            SELECT vec_id, min(d) AS d FROM (SELECT a.vec_id, f.c, sum((a.x - s.x) * (a.x - s.x)) AS d FROM x a CROSS JOIN f{k} f JOIN x s ON s.vec_id = f.vec_id AND s.i = a.i GROUP BY 1, 2)
            GROUP BY 1 ORDER BY d DESC, vec_id LIMIT 1))""")
    ctes.append(f"c0 AS MATERIALIZED (SELECT c, i, x AS m FROM f{CLUSTER_K} JOIN x USING (vec_id))")
    for r in range(CLUSTER_ROUNDS + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, min({{'d': d, 'c': c}}).c AS c FROM (SELECT vec_id, c, sum((x - m) * (x - m)) AS d FROM x JOIN c{r} USING (i) GROUP BY 1, 2) GROUP BY 1)")
        ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT c, i, coalesce(n.m, o.m) AS m FROM c{r} o LEFT JOIN (SELECT c, i, avg(x) AS m FROM x JOIN a{r} USING (vec_id) GROUP BY 1, 2) n USING (c, i))")
    return "WITH " + ",\n".join(ctes) + f" SELECT vec_id, label, CAST(c AS INTEGER) AS cluster FROM a{CLUSTER_ROUNDS} JOIN embeddings USING (vec_id)"


@query("st21_clusters", cluster_sql())
def _(t):
    return matrix.cluster(t.embeddings, "vec_id", "embedding", "label", CLUSTER_K, CLUSTER_ROUNDS).select("vec_id", "label", "cluster")


@query("st22_density_valley", """
    WITH s AS (SELECT lang, least(1.0, n_chars / 8000.0) AS v FROM documents),
         p AS (SELECT lang, count(*)::DOUBLE AS n, stddev_samp(v) AS sd, max(v) AS mx FROM s GROUP BY lang),
         g AS (SELECT lang, n, sd * pow(n, -0.2) AS h, i, 0.08 + (least(0.5, mx) - 0.08) * i / 399.0 AS x FROM p, range(400) r(i) WHERE mx >= 0.08),
         y AS (SELECT g.lang, i, x, sum(exp(-0.5 * ((x - v) / h) * ((x - v) / h)) / (n * h * sqrt(2 * pi()))) AS y FROM g JOIN s ON g.lang = s.lang GROUP BY 1, 2, 3),
         e AS (SELECT *, lag(y) OVER w AS a, lead(y) OVER w AS b FROM y WINDOW w AS (PARTITION BY lang ORDER BY i))
    SELECT p.lang, min(x) AS threshold FROM p LEFT JOIN (SELECT * FROM e WHERE y < a AND y < b) e ON p.lang = e.lang GROUP BY 1""", "threshold")
def _(t):
    s = t.documents.select("lang", F.least(F.lit(1.0), F.col("n_chars") / 8000.0).alias("v"))
    return matrix.density_valley(s, ["lang"], "v")
