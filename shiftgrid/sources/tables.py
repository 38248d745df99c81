"""Interval, gene-set, fragment and report readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftgrid.sources.text import read_lines


def read_intervals(spark: SparkSession, path: str | list[str], lines=read_lines) -> DataFrame:
    """BED-like text: (chrom, start, end). With six or more tokens, tokens four to six are a second interval.

    A bad integer drops the row; a bad second interval keeps the first.
    """
    raw = lines(spark, path).where(~F.col("line").rlike(r"^(#|track|browser)"))
    t = F.split(F.trim("line"), r"\s+")

    def part(i: int):
        return F.struct(
            F.get(t, F.lit(i)).alias("chrom"), F.get(t, F.lit(i + 1)).try_cast("bigint").alias("start"),
            F.get(t, F.lit(i + 2)).try_cast("bigint").alias("end"),
        )

    pairs = raw.where(F.size(t) >= 3).select(
        part(0).alias("a"), F.when(F.size(t) >= 6, part(3)).alias("b")
    ).where(F.col("a.start").isNotNull() & F.col("a.end").isNotNull())
    return pairs.select(F.explode(F.array("a", "b")).alias("x")).where(
        F.col("x.start").isNotNull() & F.col("x.end").isNotNull()
    ).select("x.chrom", "x.start", "x.end")


def read_gmt(
    spark: SparkSession, path: str | list[str], min_size: int = 15, max_size: int = 500, universe: DataFrame | None = None,
    lines=read_lines,
) -> DataFrame:
    """Gene sets as (set_name, gene); the universe restricts the members before the size filter."""
    f = F.split("line", "\t")
    # the name is taken before the members are unpacked: beside an explode it would split the whole line again for each of them
    parts = lines(spark, path).select(f.alias("f")).where(F.size("f") >= 3).select(
        F.element_at("f", 1).alias("set_name"), F.slice("f", F.lit(3), F.size("f") - 2).alias("members"))
    members = parts.select("set_name", F.explode("members").alias("gene")).where(F.col("gene") != "")
    if universe is not None:
        members = members.join(universe.select("gene").distinct(), "gene", "left_semi").select("set_name", "gene")
    return size_filter(members, min_size, max_size)


def size_filter(sets: DataFrame, min_size: int, max_size: int) -> DataFrame:
    sized = sets.groupBy("set_name").agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("_n").between(int(min_size), int(max_size))
    )
    return sets.join(sized.select("set_name"), "set_name", "left_semi")


def read_fragments(
    spark: SparkSession, path: str | list[str], whitelist: DataFrame, chrom_sizes: DataFrame | None = None
) -> DataFrame:
    """Fragments of whitelisted barcodes, inside the chromosome bounds when those are given."""
    schema = "chrom string, start bigint, end bigint, barcode string, n int"
    frags = spark.read.csv(path, sep="\t", comment="#", schema=schema)
    kept = frags.join(whitelist.select("barcode").distinct(), "barcode", "left_semi").select(*frags.columns)
    if chrom_sizes is not None:
        kept = kept.join(chrom_sizes.select("chrom", F.col("size").alias("_size")), "chrom").where(
            (F.col("start") >= 0) & (F.col("end") <= F.col("_size"))
        ).select(*frags.columns)
    return kept


def read_many_rows(
    spark: SparkSession, path: str | list[str], kind: str = "tsv", exclude: str | None = None, schema: str | None = None
) -> DataFrame:
    """One-row summaries (JSON documents, JSON lines or TSV) as one table; ``exclude`` is a pattern on the file path."""
    if kind in ("json", "lines"):
        reader = spark.read.option("multiLine", kind == "json")
        df = (reader.schema(schema) if schema else reader).json(path)
    else:
        reader = spark.read.option("sep", "\t").option("header", True)
        df = (reader.schema(schema) if schema else reader).csv(path)
    out = df.select("*", F.col("_metadata.file_path").alias("source_file"))
    return out.where(~F.col("source_file").rlike(exclude)) if exclude else out
