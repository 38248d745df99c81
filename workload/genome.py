"""Interval operators on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftgrid.functions import scalars
from shiftgrid.operators import intervals
from shiftgrid.plans import metrics
from workload import standins as S
from workload.ranking import avg_rank_sql
from workload.registry import query

MERGED = """
    SELECT {by} min(start) AS start, max("end") AS "end", CAST(count(*) AS BIGINT) AS members FROM (
      SELECT *, sum(opens) OVER (PARTITION BY {part} ORDER BY start, "end", event_id) AS island FROM (
        SELECT *, CASE WHEN start > coalesce(max("end") OVER (PARTITION BY {part} ORDER BY start, "end", event_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000000) + {gap} THEN 1 ELSE 0 END AS opens FROM {src}))
    GROUP BY {by} island"""


@query("sc1_regions", """
    SELECT event_id, region, CASE WHEN event_type <> 'click' THEN chrom END AS chrom, CASE WHEN event_type <> 'click' THEN start END AS start,
           CASE WHEN event_type <> 'click' THEN "end" END AS "end"
    FROM (SELECT *, CASE WHEN event_type <> 'click' THEN chrom || ':' || start || '-' || "end" ELSE 'peak' || event_id END AS region FROM ivals)""",
       "", "ivals")
def _(t):
    iv = S.ivals(t)
    region = F.when(F.col("event_type") != "click", scalars.format_region(F.col("chrom"), F.col("start"), F.col("end"))) \
        .otherwise(F.concat(F.lit("peak"), F.col("event_id").cast("string")))
    r = iv.select("event_id", region.alias("region"))
    c = F.col("region")
    return r.select("event_id", "region", scalars.region_chrom(c).alias("chrom"), scalars.region_start(c).alias("start"),
                    scalars.region_end(c).alias("end"))


@query("wn6_merge_intervals", MERGED.format(by="chrom,", part="chrom", gap=0, src="ivals"), "", "ivals")
def _(t):
    return intervals.merge_intervals(S.ivals(t), ["chrom"])


@query("wn6_merge_with_gap", MERGED.format(by="chrom, event_type,", part="chrom, event_type", gap=50, src="ivals"), "", "ivals")
def _(t):
    return intervals.merge_intervals(S.ivals(t), ["chrom", "event_type"], gap=50)


@query("ag8_width_stats", """
    SELECT chrom, min("end" - start)::DOUBLE AS width_min, max("end" - start)::DOUBLE AS width_max, avg("end" - start) AS width_mean,
           quantile_cont(CAST("end" - start AS DOUBLE), 0.5) AS width_median,
           list_sort(list("end" - start))[count(*) // 2] AS median_shell
    FROM ivals GROUP BY chrom""", "width_min width_max width_mean width_median", "ivals")
def _(t):
    iv = S.ivals(t)
    return intervals.width_stats(iv, ["chrom"]).join(intervals.lower_median(iv, ["chrom"]), "chrom")


@query("jn7_overlaps_any", """
    SELECT event_id, CAST(EXISTS (SELECT 1 FROM ivals b WHERE b.event_type = 'error' AND a.chrom = b.chrom AND a.start < b."end" AND a."end" > b.start) AS INTEGER) AS hit
    FROM ivals a""", "", "ivals")
def _(t):
    iv = S.ivals(t)
    return intervals.overlaps_any(iv, iv.where("event_type = 'error'")).select("event_id", "hit")


COUNTED = """
    SELECT a.event_type AS cell, b.event_id AS peak, CAST(count(*) AS BIGINT) AS n
    FROM {frags} a JOIN ivals b ON b.event_type = 'error' AND a.chrom = b.chrom AND a.start < b."end" AND a."end" > b.start
    WHERE a.event_type <> 'error' GROUP BY 1, 2"""


@query("jn8_count_fragments", COUNTED.format(frags="ivals"), "", "ivals")
def _(t):
    iv = S.ivals(t)
    frags = iv.where("event_type <> 'error'").withColumnRenamed("event_type", "cell")
    return intervals.count_overlaps(frags, iv.where("event_type = 'error'").withColumnRenamed("event_id", "peak"), "cell", "peak")


@query("jn8_count_insertions", COUNTED.format(frags="""(SELECT event_type, chrom, start, start + 1 AS "end" FROM ivals
       UNION ALL SELECT event_type, chrom, "end" - 1, "end" FROM ivals)"""), "", "ivals")
def _(t):
    iv = S.ivals(t)
    frags = iv.where("event_type <> 'error'").withColumnRenamed("event_type", "cell")
    return intervals.count_overlaps(frags, iv.where("event_type = 'error'").withColumnRenamed("event_id", "peak"), "cell", "peak",
                                    "insertion", salt=4)


@query("jn9_near_join", """
    SELECT e.chrom, e.event_id AS element, s.event_id AS gene, abs((e.start + e."end") // 2 - s.start) AS distance
    FROM ivals e JOIN ivals s ON e.chrom = s.chrom AND s.event_type = 'error' AND abs((e.start + e."end") // 2 - s.start) <= 2000""",
       "", "ivals")
def _(t):
    iv = S.ivals(t)
    sites = iv.where("event_type = 'error'").select("chrom", F.col("event_id").alias("gene"), F.col("start").alias("tss"))
    return intervals.near_join(iv.withColumnRenamed("event_id", "element"), sites, 2000, "element", "gene")


@query("so3_union_intervals", """
    SELECT chrom, count(*) AS n, CAST(sum("end" - start) AS BIGINT) AS width FROM ivals GROUP BY chrom""", "", "ivals")
def _(t):
    iv = S.ivals(t)
    kinds = F.col("event_type").isin("error", "click")
    u = intervals.union_intervals(iv.where("event_type = 'error'"), iv.where("event_type = 'click'"), iv.where(~kinds))
    return u.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("width"))


@query("rp11_benchmark_edges", f"""
    WITH e AS (SELECT DISTINCT * FROM ivals), s AS (SELECT unnest(['error', 'purchase']) AS ground_truth),
         l AS (SELECT s.ground_truth, e.event_type AS scope, e.value, CAST(EXISTS (SELECT 1 FROM ivals b WHERE b.event_type = s.ground_truth
                 AND e.chrom = b.chrom AND e.start < b."end" AND e."end" > b.start) AS INTEGER) AS y FROM e, s),
         r AS (SELECT *, {avg_rank_sql('value', 'ground_truth, scope')} AS rk FROM l),
         c AS (SELECT ground_truth, scope, count(*) AS n, sum(y) AS p, sum(rk) FILTER (WHERE y = 1) AS sr FROM r GROUP BY 1, 2),
         g AS (SELECT ground_truth, scope, value, sum(y) AS tp, count(*) AS m FROM r GROUP BY 1, 2, 3),
         w AS (SELECT ground_truth, scope, tp, sum(tp) OVER z AS ctp, sum(m) OVER z AS cn FROM g
               WINDOW z AS (PARTITION BY ground_truth, scope ORDER BY value DESC)),
         a AS (SELECT ground_truth, scope, sum(tp * (CAST(ctp AS DOUBLE) / cn)) AS area FROM w GROUP BY 1, 2)
    SELECT c.scope, 'cis' AS edge_type, c.ground_truth, n AS n_edges, CAST(p AS BIGINT) AS n_hits,
           ((sr - p * (p + 1) / 2.0) / (p * (n - p)))::DOUBLE AS auroc, (area / p)::DOUBLE AS aupr
    FROM c JOIN a ON c.scope = a.scope AND c.ground_truth = a.ground_truth WHERE p > 0 AND p < n""", "auroc aupr", "ivals")
def _(t):
    iv = S.ivals(t)
    edges = iv.select(F.col("event_type").alias("scope"), F.lit("cis").alias("edge_type"),
                      scalars.format_region(F.col("chrom"), F.col("start"), F.col("end")).alias("re"), "value")
    truth = iv.where(F.col("event_type").isin("error", "purchase")).withColumnRenamed("event_type", "truth_set")
    return metrics.benchmark_edges(edges, truth, "scope", "re", "value", "truth_set", ["error", "purchase"])


FACTOR_SETS = (("error", "f1"), ("purchase", "f9"), ("loops", None))


@query("rp11_factor_edges", f"""
    WITH truth AS (SELECT DISTINCT CASE WHEN event_type IN ('view', 'signup') THEN 'loops' ELSE event_type END AS s, chrom, start, "end" FROM ivals WHERE event_type <> 'click'),
         routes AS (SELECT * FROM (VALUES ('error', 'f1'), ('purchase', 'f9'), ('loops', NULL)) v(s, own)),
         e AS (SELECT event_type AS scope, 'f' || (event_id % 4) AS factor, chrom, start, "end", value FROM ivals),
         known AS (SELECT DISTINCT scope, factor FROM e),
         cases AS (SELECT k.scope, k.factor, r.s, r.own IS NOT NULL AND NOT EXISTS (SELECT 1 FROM known o WHERE o.scope = k.scope AND o.factor = r.own) AS fallback
                   FROM known k, routes r WHERE r.own IS NULL OR r.own = k.factor OR NOT EXISTS (SELECT 1 FROM known o WHERE o.scope = k.scope AND o.factor = r.own)),
         l AS (SELECT c.scope, c.factor, c.s, fallback, value, CAST(EXISTS (SELECT 1 FROM truth b WHERE b.s = c.s AND e.chrom = b.chrom AND e.start < b."end" AND e."end" > b.start) AS INTEGER) AS y
               FROM cases c JOIN e ON e.scope = c.scope AND e.factor = c.factor),
         r AS (SELECT *, {avg_rank_sql('value', 'scope, factor, s')} AS rk FROM l),
         c AS (SELECT scope, factor, s, bool_or(fallback) AS fallback, count(*) AS n, sum(y) AS p, sum(rk) FILTER (WHERE y = 1) AS sr FROM r GROUP BY 1, 2, 3),
         g AS (SELECT scope, factor, s, value, sum(y) AS tp, count(*) AS m FROM r GROUP BY 1, 2, 3, 4),
         w AS (SELECT scope, factor, s, tp, sum(tp) OVER z AS ctp, sum(m) OVER z AS cn FROM g WINDOW z AS (PARTITION BY scope, factor, s ORDER BY value DESC)),
         a AS (SELECT scope, factor, s, sum(tp * (CAST(ctp AS DOUBLE) / cn)) AS area FROM w GROUP BY 1, 2, 3)
    SELECT c.scope, 'TF_RE_binding[' || c.factor || ']' AS edge_type, c.s AS ground_truth, n AS n_edges, CAST(p AS BIGINT) AS n_hits,
           ((sr - p * (p + 1) / 2.0) / (p * (n - p)))::DOUBLE AS auroc, (area / p)::DOUBLE AS aupr, c.fallback,
           (SELECT count(*) FROM (SELECT DISTINCT scope, s FROM cases WHERE fallback)) AS n_fallbacks
    FROM c JOIN a ON c.scope = a.scope AND c.factor = a.factor AND c.s = a.s WHERE p > 0 AND p < n""", "auroc aupr", "ivals")
def _(t):
    iv = S.ivals(t)
    edges = iv.select(F.col("event_type").alias("scope"), F.concat(F.lit("f"), (F.col("event_id") % 4).cast("string")).alias("factor"),
                      scalars.format_region(F.col("chrom"), F.col("start"), F.col("end")).alias("re"), "value")
    truth = metrics.pooled(iv.where("event_type <> 'click'").withColumnRenamed("event_type", "truth_set"), "truth_set", ["view", "signup"], "loops")
    routes = t.spark.createDataFrame(FACTOR_SETS, "truth_set string, own string")
    return metrics.benchmark_factor_edges(edges, truth, routes, "scope", "factor", "re", "value", "truth_set", [n for n, _ in FACTOR_SETS])
