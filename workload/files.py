"""Readers and sinks on a round trip: Spark writes a driver table in the file's format, the reader reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shiftgrid.operators.ordered import numbered
from shiftgrid.session import cut, scratch_folder
from shiftgrid.sources import matrices, sinks, tables, text
from workload import standins as S
from workload.registry import query


def scratch(t) -> str:
    """A new folder under the shared one."""
    return f"{scratch_folder(t.spark)}/files-{uuid.uuid4().hex}"


def put_lines(df, folder: str, name: str, columns, sep: str = "\t", header: bool = False) -> str:
    """Rows as one ordered text file per partition; ``name`` ends the file names, so that patterns can find them."""
    path = f"{folder}/{name}"
    df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in columns]).alias("value")).write.text(path)
    return path


def trio(t):
    """The counts of each priority as a coordinate matrix: entries, cells, features."""
    c = cut(S.counts(t))  # read for the cells and for the entries
    cells = numbered(c.select("sample_id", "cell_id").distinct(), ["sample_id"], ["cell_id"], "j")
    feats = numbered(t.part.select(F.col("p_partkey").alias("feature_id"), F.lit(1).alias("one")), ["one"], ["feature_id"], "i").drop("one")
    return c, cut(cells), cut(feats)


def write_trios(t) -> str:
    """One trio per sample in one folder, named by the sample.

    The file names carry the sample, so each trio is written under a partition folder and addressed by its own path. A file is written in
    parts, whose order is that of the folders ``o`` and then of their numbers; entries have no order.
    """
    folder = scratch(t)
    c, cells, feats = trio(t)
    body = cut(c.join(cells, ["sample_id", "cell_id"]).join(feats, "feature_id").select("sample_id", "i", "j", "count"))  # counted, then written
    n_feats = feats.agg(F.count(F.lit(1)).alias("nf"))
    dims = body.groupBy("sample_id").agg(F.count(F.lit(1)).alias("nnz")).join(cells.groupBy("sample_id").agg(F.count(F.lit(1)).alias("nc")), "sample_id").crossJoin(F.broadcast(n_feats))
    dims = cut(dims)
    head = dims.select("sample_id", F.lit(0).alias("o"), F.lit("%%MatrixMarket matrix coordinate real general").alias("value")).unionByName(
        dims.select("sample_id", F.lit(1).alias("o"), F.concat_ws(" ", "nf", "nc", "nnz").alias("value")))
    lines = head.unionByName(body.select("sample_id", F.lit(2).alias("o"), F.concat_ws(" ", "i", "j", "count").alias("value")))
    labels = cells.select("sample_id", F.col("j").alias("o"), F.col("cell_id").cast("string").alias("value"))
    names = feats.crossJoin(F.broadcast(dims.select("sample_id"))).select(
        "sample_id", F.col("i").alias("o"), F.concat(F.lit("ID"), F.col("feature_id").cast("string"), F.lit("\t"), F.col("feature_id").cast("string"), F.lit("\tGene Expression")).alias("value"))
    lines.select("sample_id", "o", "value").write.partitionBy("sample_id", "o").text(f"{folder}/matrix.mtx")
    for kind, df in (("barcodes.tsv", labels), ("features.tsv", names)):
        df.repartitionByRange("sample_id", "o").sortWithinPartitions("sample_id", "o").select("sample_id", "value").write.partitionBy("sample_id").text(f"{folder}/{kind}")
    return folder


def folder_lines(spark, path: str, column: str, suffix: str):
    """``read_lines`` for the round-trip layout, where a partition folder stands for the name of a file in it.

    Spark hands the names of the folders to each file once; only the number of a part is taken from a name for every line.
    """
    base, *stars = path.rstrip("/").split("/*")
    nested = len(stars) > 1
    lines = spark.read.schema(f"value string, `{column}` string" + (", o int" if nested else "")).option("basePath", base).text(path)
    value = F.coalesce(column, F.lit("__HIVE_DEFAULT_PARTITION__"))
    part = F.split_part("_metadata.file_name", F.lit("-"), F.lit(2)).try_cast("int")
    place = F.struct((F.col("o") if nested else F.lit(None).cast("int")).alias("folder"), part.alias("part"),
                     F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return lines.select(F.concat(value, F.lit(suffix)).alias("file_name"), place.alias("place"), F.col("value").alias("line"))


def trio_lines(spark, path: str):
    folder, name = path.rsplit("/", 1)
    kind = "matrix.mtx" if "matrix" in name else "barcodes.tsv" if "barcodes" in name else "features.tsv"
    return folder_lines(spark, f"{folder}/{kind}/*/" + ("*/" if kind == "matrix.mtx" else ""), "sample_id", f"_{kind}")


@query("src1_read_mtx", """SELECT sample_id || '_' AS prefix, CAST(cell_id AS VARCHAR) AS cell_id, CAST(feature_id AS VARCHAR) AS feature_id, count FROM counts""", "count", "counts")
def _(t):
    counts, _ = matrices.read_mtx(t.spark, write_trios(t), lines=trio_lines)
    return counts


def wide_path(t) -> str:
    """Parts x priorities as a tab-separated file with a text column and a mostly unreadable column."""
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    w = S.counts(t).groupBy("feature_id").pivot("sample_id", names).agg(F.sum("count"))
    w = w.join(t.part.select(F.col("p_partkey").alias("feature_id"), "p_name", "p_size"), "feature_id")
    cols = [F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).cast("string").alias(f"s{n[0]}") for n in names]
    path = f"{scratch(t)}/wide.tsv"
    w.select(F.col("feature_id").cast("string").alias("gene"), *cols, F.col("p_name").alias("description"),
             F.when(F.col("p_size") > 25, "n/a").otherwise(F.col("p_size").cast("string")).alias("mixed")).write.csv(path, sep="\t", header=True)
    return path


LONG = "SELECT CAST(feature_id AS VARCHAR) AS gene, 's' || substr(sample_id, 1, 1) AS sample, sum(count) AS value FROM counts GROUP BY 1, 2"
DENSE = "SELECT gene, sample, coalesce(value, 0) AS value FROM (SELECT DISTINCT CAST(feature_id AS VARCHAR) AS gene FROM counts) g CROSS JOIN (SELECT unnest(['s1','s2','s3','s4','s5']) AS sample) s LEFT JOIN ({q}) v USING (gene, sample)"


@query("src3_src4_wide_matrix", DENSE.format(q=LONG), "value", "counts")
def _(t):
    return matrices.read_wide_matrix(t.spark, wide_path(t), "gene", deny=["description"])


@query("src5_select_by_regex", f"SELECT * FROM ({DENSE.format(q=LONG)}) WHERE sample IN ('s1', 's2')", "value", "counts")
def _(t):
    return matrices.read_wide_matrix(t.spark, wide_path(t), "gene", pattern="s[12]")


@query("src9_merge_condition_files", f"SELECT * FROM ({DENSE.format(q=LONG)}) WHERE gene IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size < 30)", "value", "counts")
def _(t):
    path = wide_path(t)
    df = t.spark.read.csv(path, sep="\t", header=True)
    second = f"{scratch(t)}/second.tsv"
    small = t.part.where("p_size < 30").select(F.col("p_partkey").cast("string").alias("gene"))
    df.join(small, "gene").select("gene", "s4", "s5").write.csv(second, sep="\t", header=True)
    return matrices.merge_condition_files(t.spark, [
        {"path": path, "index": "gene", "pattern": "s[123]"}, {"path": second, "index": "gene", "pattern": "s"}])


def per_sample_path(t) -> str:
    """One file per priority, in parts: caption line, header, isoform rows. The folder of a file names its sample, the one in it its place."""
    li = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = li.select(F.col("o_orderpriority").alias("s"), F.lit(2).alias("o"), F.concat_ws(
        "\t", F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), F.col("l_partkey").cast("string"), F.col("l_quantity").cast("string")).alias("value"))
    prio = t.orders.select(F.col("o_orderpriority").alias("s")).distinct()
    head = prio.select("s", F.lit(0).alias("o"), F.lit("quantified reads").alias("value")).unionByName(
        prio.select("s", F.lit(1).alias("o"), F.concat(F.lit("isoform\tgene_id\tcount_"), F.substring("s", 1, 1)).alias("value")))
    path = f"{scratch(t)}/samples"
    head.unionByName(rows).select("s", "o", "value").write.partitionBy("s", "o").text(path)
    return path


@query("src6_src7_src8_per_sample", """
    SELECT CAST(l_partkey AS VARCHAR) AS gene, count(DISTINCT o_orderpriority) AS n_files, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""", "value")
def _(t):
    path = per_sample_path(t)
    long = matrices.read_per_sample(
        t.spark, f"{path}/*/*/", "isoform", 1, rollup="gene_id", lines=lambda spark, p: folder_lines(spark, p, "s", ".txt"))
    return long.groupBy("gene").agg(F.count_distinct("file_name").alias("n_files"), F.sum("value").alias("value"))


@query("src2_mtx_pseudobulk", "SELECT sample_id AS sample, CAST(feature_id AS VARCHAR) AS feature_id, sum(count) AS count FROM counts GROUP BY 1, 2", "count", "counts")
def _(t):
    return matrices.read_mtx_pseudobulk(t.spark, write_trios(t), lines=trio_lines)


@query("src10_sniffed_text", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name FROM supplier")
def _(t):
    folder = scratch(t)
    a = t.part.select(F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name").alias("value"))
    b = t.supplier.select(F.concat_ws("\t", F.col("s_suppkey").cast("string"), "s_name").alias("value"))
    a.write.option("compression", "gzip").text(f"{folder}/packed")
    b.write.text(f"{folder}/plain")
    lines = text.read_text_sniff(t.spark, [f"{folder}/packed/*.txt*", f"{folder}/plain/*.txt"])
    f = F.split("line", "\t")
    return lines.select(f[0].alias("id"), f[1].alias("name"))


@query("src11_read_intervals", """
    SELECT chrom, count(*) AS n, CAST(sum("end" - start) AS BIGINT) AS width FROM (SELECT chrom, start, "end" FROM ivals WHERE event_type <> 'click'
      UNION ALL SELECT chrom, start + 5, "end" + 5 FROM ivals WHERE event_type = 'error') GROUP BY 1""", "", "ivals")
def _(t):
    iv = S.ivals(t)
    s, e, kind = F.col("start").cast("string"), F.col("end").cast("string"), F.col("event_type")
    second = F.concat_ws("\t", "chrom", (F.col("start") + 5).cast("string"), (F.col("end") + 5).cast("string"))
    line = F.when(kind == "click", F.concat_ws("\t", "chrom", F.lit("x"), e)).when(kind == "error", F.concat_ws("\t", "chrom", s, e, second)) \
        .when(kind == "view", F.concat_ws("\t", "chrom", s, e, F.lit("name"), F.lit("1"), F.lit("+"))).otherwise(F.concat_ws(" ", "chrom", s, e))
    rows = iv.select(line.alias("value")).unionByName(t.region.select(F.concat(F.lit("#"), "r_name").alias("value")))
    path = f"{scratch(t)}/bed"
    rows.write.text(path)
    return tables.read_intervals(t.spark, path).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("width"))


@query("src12_read_gmt", """
    SELECT p_type AS set_name, p_partkey::VARCHAR AS gene FROM part WHERE p_size < 40 AND p_type IN (SELECT p_type FROM part WHERE p_size < 40 GROUP BY 1 HAVING count(*) BETWEEN 15 AND 500)""")
def _(t):
    path = f"{scratch(t)}/sets"
    # a gene-set line holds its members, so a file line is as long as its set
    t.part.groupBy("p_type").agg(F.collect_list(F.col("p_partkey").cast("string")).alias("m")).select(
        F.concat(F.col("p_type"), F.lit("\tabout\t\t"), F.array_join("m", "\t")).alias("value")).write.text(path)
    universe = t.part.where("p_size < 40").select(F.col("p_partkey").cast("string").alias("gene"))
    return tables.read_gmt(t.spark, path, universe=universe)


@query("src13_read_fragments", """
    SELECT chrom, count(*) AS n FROM ivals JOIN (SELECT 'u' || (event_id % 50) AS barcode, event_id AS e FROM events) b ON e = event_id
    WHERE barcode IN (SELECT 'u' || s_suppkey FROM supplier WHERE s_acctbal > 0) AND "end" <= 8000 AND chrom <> 'chr1' GROUP BY 1""", "", "ivals")
def _(t):
    path = f"{scratch(t)}/fragments"
    S.ivals(t).select("chrom", "start", "end", F.concat(F.lit("u"), (F.col("event_id") % 50).cast("string")), F.lit(1)).write.csv(path, sep="\t")
    allowed = t.supplier.where("s_acctbal > 0").select(F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("barcode"))
    sizes = S.ivals(t).select("chrom").distinct().where("chrom <> 'chr1'").withColumn("size", F.lit(8000))
    return tables.read_fragments(t.spark, path, allowed, sizes).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


@query("src14_many_rows", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation WHERE n_regionkey <> 2")
def _(t):
    path = f"{scratch(t)}/rows"
    t.nation.select("n_nationkey", "n_name", F.col("n_regionkey").alias("part")).write.partitionBy("part").json(path)
    out = tables.read_many_rows(t.spark, f"{path}/*/", "lines", exclude="part=2/", schema="n_nationkey bigint, n_name string")
    return out.drop("source_file")


@query("snk1_write_tsv", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS balance FROM customer", "balance")
def _(t):
    path = f"{scratch(t)}/tsv"
    df = t.customer.select("c_mktsegment", "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    sinks.write_tsv(df, path, ["c_custkey", "balance"], compress=True)
    return t.spark.read.schema("c_custkey bigint, balance double").csv(path, sep="\t", header=True, nullValue="NA")


@query("snk2_file_hashes", """
    SELECT c_mktsegment AS segment, substr(md5(string_agg(c_custkey || ',' || c_name || chr(10), '' ORDER BY c_custkey)), 1, 12) AS md5 FROM customer GROUP BY 1""")
def _(t):
    path = f"{scratch(t)}/input"
    # one ordered file per segment
    t.customer.repartition("c_mktsegment").sortWithinPartitions("c_mktsegment", "c_custkey").select(
        "c_mktsegment", F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name").alias("value")).write.partitionBy("c_mktsegment").text(path)
    segment = F.regexp_extract(F.url_decode("path"), "c_mktsegment=([^/]+)/", 1)
    return sinks.file_hashes(t.spark, f"{path}/*/part-*").select(segment.alias("segment"), "md5")


@query("snk2_provenance", """
    SELECT s_suppkey, (SELECT substr(md5(string_agg(concat_ws(',', r_regionkey, r_name) || chr(10), '' ORDER BY r_regionkey NULLS FIRST, r_name NULLS FIRST)), 1, 12) FROM region) AS input_0,
           (SELECT substr(md5(string_agg(concat_ws(',', n_nationkey, n_name) || chr(10), '' ORDER BY n_nationkey NULLS FIRST, n_name NULLS FIRST)), 1, 12) FROM nation) AS input_1,
           substr(md5('{"ratio": 0.5, "seed": 1}'), 1, 10) AS config_hash, true AS has_input_hash, 10::INTEGER AS config_hash_length FROM supplier""")
def _(t):
    folder, hashes = scratch(t), {}
    inputs = {"input_0": t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v")), "input_1": t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))}
    for name, df in inputs.items():
        # one ordered file per input
        df.coalesce(1).sortWithinPartitions("k", "v").select(F.concat_ws(",", F.col("k").cast("string"), "v").alias("value")).write.text(f"{folder}/{name}")
        hashes |= {name: r["md5"] for r in sinks.file_hashes(t.spark, f"{folder}/{name}/part-*").collect()}
    df = sinks.with_provenance(t.supplier.select("s_suppkey"), hashes, {"seed": 1, "ratio": 0.5})
    return df.withColumns({"has_input_hash": F.length("input_0") == 12, "config_hash_length": F.length("config_hash")})


@query("snk3_pivot_report", """
    SELECT l_returnflag AS entry, 'validation' AS role, avg(l_quantity) FILTER (WHERE l_linestatus = 'F') AS "F", avg(l_quantity) FILTER (WHERE l_linestatus = 'O') AS "O" FROM lineitem GROUP BY 1""", "F O")
def _(t):
    a = t.lineitem.groupBy(F.col("l_returnflag").alias("entry"), F.col("l_linestatus").alias("tf")).agg(F.avg("l_quantity").alias("value")).withColumn("role", F.lit("validation"))
    return sinks.pivot_report(a, "entry", "role", "tf", "value", ["F", "O"])
