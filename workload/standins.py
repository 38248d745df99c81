"""Stand-ins: the driver tables in the shape of the operators' inputs, once in Spark and once in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrid.session import tasks_for

CTES = {
    # gene vectors: measured, predicted, level; scope = line status
    "shifts": """
        SELECT scope, gene, real_shift, predicted_shift, level FROM (
          SELECT l_linestatus AS scope, l_partkey AS gene,
                 avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A')
                   - avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS real_shift,
                 avg(l_quantity) FILTER (WHERE l_returnflag = 'A')
                   - avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS predicted_shift,
                 max(p_retailprice) AS level
          FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
        WHERE real_shift IS NOT NULL AND predicted_shift IS NOT NULL AND level IS NOT NULL""",
    # means per scope (return flag) and item (part)
    "vecs": """
        SELECT l_returnflag AS scope, l_partkey AS item, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2""",
    "counts": """
        SELECT o_orderpriority AS sample_id, l_orderkey AS cell_id, l_partkey AS feature_id, sum(l_quantity) AS count
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""",
    "features": """
        SELECT p_partkey AS feature_id,
               CASE WHEN p_size <= 3 THEN 'mt-' || p_name WHEN p_size = 4 THEN 'HBA-A1' ELSE p_name END AS symbol,
               CASE WHEN p_size > 40 THEN 'Peaks' ELSE 'Gene Expression' END AS feature_type, p_partkey AS position
        FROM part""",
    "edges": """
        SELECT l_returnflag AS scope, l_suppkey AS tf, l_partkey AS target, sum(l_quantity) AS weight
        FROM lineitem GROUP BY 1, 2, 3""",
    "ivals": """
        SELECT event_id, event_type, 'chr' || CAST(user_id % 20 AS VARCHAR) AS chrom, event_id * 10 AS start,
               event_id * 10 + CAST(ceil(value) AS BIGINT) AS "end", value
        FROM events""",
    "labelled": """
        SELECT d.doc_id, lang, source, quality, toxic, CAST(n_chars AS DOUBLE) AS score
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "expr": """
        SELECT l_returnflag AS scope, l_partkey AS gene, l_suppkey AS sample, sum(l_quantity) AS value
        FROM lineitem GROUP BY 1, 2, 3""",
}


def shifts(t) -> DataFrame:
    def mean_of(c: str, flag: str):
        return F.avg(F.when(F.col("l_returnflag") == flag, F.col(c)))

    def delta(c: str):
        return mean_of(c, "A") - mean_of(c, "R")

    means = t.lineitem.groupBy(F.col("l_linestatus").alias("scope"), F.col("l_partkey").alias("gene")).agg(
        delta("l_extendedprice").alias("real_shift"), delta("l_quantity").alias("predicted_shift")
    ).where(F.col("real_shift").isNotNull() & F.col("predicted_shift").isNotNull())
    level = t.part.select(F.col("p_partkey").alias("gene"), F.col("p_retailprice").alias("level"))
    return means.join(level, "gene").where(F.col("level").isNotNull()).select(
        "scope", "gene", "real_shift", "predicted_shift", "level"
    )


def vecs(t) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_returnflag").alias("scope"), F.col("l_partkey").alias("item")).agg(
        F.avg("l_quantity").alias("value")
    )


def counts(t) -> DataFrame:
    # orders x parts are summed before the join, so the join carries one row per pair
    pairs = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("count"))
    return pairs.join(t.orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderpriority").alias("sample_id"), F.col("l_orderkey").alias("cell_id"),
        F.col("l_partkey").alias("feature_id"), "count",
    )


def features(t) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("feature_id"),
        F.when(F.col("p_size") <= 3, F.concat(F.lit("mt-"), "p_name")).when(F.col("p_size") == 4, "HBA-A1")
        .otherwise(F.col("p_name")).alias("symbol"),
        F.when(F.col("p_size") > 40, "Peaks").otherwise("Gene Expression").alias("feature_type"),
        F.col("p_partkey").alias("position"),
    )


def edges(t) -> DataFrame:
    return t.lineitem.groupBy(
        F.col("l_returnflag").alias("scope"), F.col("l_suppkey").alias("tf"), F.col("l_partkey").alias("target")
    ).agg(F.sum("l_quantity").alias("weight"))


def dealt(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` in more partitions than the session's, by the columns it is grouped by, where these would hold too many rows."""
    tasks = tasks_for(df.sparkSession, df.count())
    return df.repartition(tasks, *by) if tasks > tasks_for(df.sparkSession, 0) else df


def expr(t) -> DataFrame:
    return dealt(t.lineitem, ["l_returnflag", "l_partkey", "l_suppkey"]).groupBy(
        F.col("l_returnflag").alias("scope"), F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("sample")
    ).agg(F.sum("l_quantity").alias("value"))


def ivals(t) -> DataFrame:
    start = F.col("event_id") * 10
    return t.events.select(
        "event_id", "event_type", F.concat(F.lit("chr"), F.pmod("user_id", F.lit(20)).cast("string")).alias("chrom"),
        start.alias("start"), (start + F.ceil("value")).alias("end"), "value",
    )


def labelled(t) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id").select(
        "doc_id", "lang", "source", "quality", "toxic", F.col("n_chars").cast("double").alias("score")
    )
