"""Readers that turn matrix files into long tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftgrid.operators.filters import GuardError, require_empty
from shiftgrid.operators.ordered import attach_stats, grid, numbered
from shiftgrid.session import cut
from shiftgrid.sources.text import find_header, read_lines

# File name endings of a coordinate-matrix trio (fixed values).
MATRIX_SUFFIX = r"matrix\.mtx(\.gz)?$"
BARCODES_SUFFIX = r"barcodes\.tsv(\.gz)?$"
FEATURES_SUFFIX = r"(features|genes)\.tsv(\.gz)?$"


def _labels(lines: DataFrame, suffix: str, second: bool) -> DataFrame:
    """Trio prefix, 1-based line number and label; the symbol is the second field where there is one."""
    fields = F.split(F.col("line"), "\t")
    label = F.coalesce(F.try_element_at(fields, F.lit(2)), F.element_at(fields, 1)) if second else F.element_at(fields, 1)
    kept = lines.where(F.trim("line") != "").select(
        F.regexp_replace("file_name", suffix, "").alias("prefix"), "place", label.alias("label"),
        F.try_element_at(fields, F.lit(3)).alias("feature_type"),
    )
    return numbered(kept, ["prefix"], ["place"], "index").drop("place")


def read_mtx(spark: SparkSession, folder: str, pattern: str = "*", lines=read_lines) -> tuple[DataFrame, DataFrame]:
    """All coordinate-matrix trios of a folder: counts (prefix, cell_id, feature_id, count), features.

    A trio shares one file-name prefix. Which axis holds the features follows from the label counts; when neither way
    fits, the trio is refused.
    """
    raw = lines(spark, f"{folder}/{pattern}matrix.mtx*")
    # numbered once, read for the sizes and for the names
    cells = cut(_labels(lines(spark, f"{folder}/{pattern}barcodes.tsv*"), BARCODES_SUFFIX, second=False))
    feats = cut(_labels(lines(spark, f"{folder}/{pattern}{{features,genes}}.tsv*"), FEATURES_SUFFIX, second=True))
    data = raw.where(~F.startswith("line", F.lit("%")) & (F.trim("line") != "")).withColumn(
        "prefix", F.regexp_replace("file_name", MATRIX_SUFFIX, "")
    )
    fields = F.split(F.trim("line"), r"\s+")
    # one pass over the lines, of which one a trio is split
    head = cut(data.groupBy("prefix").agg(
        F.min("place").alias("head_place"), F.min_by("line", "place").alias("line"), (F.count(F.lit(1)) - 1).alias("_lines")
    ).select("prefix", "head_place", fields.alias("_dims"), "_lines"))
    sizes = head.join(cells.groupBy("prefix").agg(F.count(F.lit(1)).alias("_nc")), "prefix", "left").join(
        feats.groupBy("prefix").agg(F.count(F.lit(1)).alias("_nf")), "prefix", "left"
    )
    r, c = F.element_at("_dims", 1).cast("bigint"), F.element_at("_dims", 2).cast("bigint")
    shape = sizes.select(
        "prefix", "head_place",
        F.when((r == F.col("_nf")) & (c == F.col("_nc")), "features_by_cells")
        .when((r == F.col("_nc")) & (c == F.col("_nf")), "cells_by_features").alias("_way"),
    )
    require_empty(shape.where(F.col("_way").isNull()).select("prefix"), "matrix shape fits neither orientation")
    # the third figure of the header counts the entries; every entry must lie inside the matrix
    wrong = head.where(~F.col("_lines").eqNullSafe(F.try_element_at("_dims", F.lit(3)).cast("bigint")))
    require_empty(wrong.select("prefix"), "number of entries differs from the header")
    entries = attach_stats(data, shape, ["prefix"], "inner").where(F.col("place") != F.col("head_place"))
    first, second = F.element_at(fields, 1).cast("bigint"), F.element_at(fields, 2).cast("bigint")
    straight = F.col("_way") == "features_by_cells"
    # read for the check and for the counts
    triples = cut(entries.select(
        "prefix", F.when(straight, first).otherwise(second).alias("_f"),
        F.when(straight, second).otherwise(first).alias("_c"), F.element_at(fields, 3).cast("double").alias("count"),
    ))
    outside = attach_stats(triples, sizes.select("prefix", "_nc", "_nf"), ["prefix"], "inner").where(
        ~F.coalesce(F.col("_f").between(1, F.col("_nf")) & F.col("_c").between(1, F.col("_nc")), F.lit(False)))
    require_empty(outside.select("prefix"), "an entry has no label")
    counts = triples.join(
        cells.select("prefix", F.col("index").alias("_c"), F.col("label").alias("cell_id")), ["prefix", "_c"]
    ).join(feats.select("prefix", F.col("index").alias("_f"), F.col("label").alias("feature_id")), ["prefix", "_f"])
    features = feats.select("prefix", F.col("label").alias("feature_id"), "feature_type", F.col("index").alias("position"))
    return counts.select("prefix", "cell_id", "feature_id", "count"), features


def read_mtx_pseudobulk(
    spark: SparkSession, folder: str, pattern: str = "*", exclude: str | None = None, name: str | None = None,
    lines=read_lines,
) -> DataFrame:
    """Each trio collapsed to one summed column named by its prefix; all trios must share one ordered feature list."""
    counts, features = read_mtx(spark, folder, pattern, lines)
    if exclude:
        keep = ~F.concat(F.col("prefix"), F.lit("matrix.mtx")).rlike(exclude)
        counts, features = counts.where(keep), features.where(keep)
    # an order-sensitive fingerprint per trio, added up where the lines are
    prints = features.groupBy("prefix").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("position", "feature_id")).alias("h")
    )
    if prints.select("n", "h").distinct().limit(2).count() > 1:
        raise GuardError("trios differ in their features or in the order of them")
    found = F.regexp_extract("prefix", name, 1) if name else F.lit("")
    sample = F.when(found != "", found).otherwise(F.regexp_replace("prefix", r"[_\-.]+$", ""))
    return counts.groupBy(sample.alias("sample"), "feature_id").agg(F.sum("count").alias("count"))


@dataclass
class Wide:
    """A delimited file as rows of text cells: however many columns it has, a plan node holds one array."""

    names: list[str]
    rows: DataFrame  # cells: array<string>, in the order of the names

    def at(self, name: str) -> int:
        if name not in self.names:
            raise GuardError(f"no column {name!r} in {self.names[:20]}")
        return self.names.index(name)


def _fields(line: str, sep: str) -> str:
    """SQL text that splits a line at ``sep``; quoted fields may hold it, and a doubled quote is one quote."""
    plain = "\\t" if sep == "\t" else re.escape(sep).replace("\\", "\\\\")
    quoted = f"regexp_extract_all(concat({line}, '{plain}'), '(\"(?:[^\"]|\"\")*\"|[^{plain}]*){plain}', 1)"
    opened = f"transform({quoted}, x -> CASE WHEN x LIKE '\"%\"' THEN replace(substring(x, 2, length(x) - 2), '\"\"', '\"') ELSE x END)"
    return f"CASE WHEN instr({line}, '\"') > 0 THEN {opened} ELSE split({line}, '{plain}', -1) END"


def read_table(spark: SparkSession, path: str | list[str], sep: str | None = None) -> Wide:
    """A delimited file with a header; the separator follows from the extension. One line is one row.

    The header is the first line; parts of a folder repeat it, and lines equal to it are no data. A row may be shorter than the
    header (its last cells are NULL); more cells than names are refused where they are read.
    """
    first = path if isinstance(path, str) else path[0]
    sep = sep or ("," if re.search(r"\.csv(\.gz)?$", first) else "\t")
    lines = spark.read.text(path).where(F.col("value") != "")
    head = lines.first()
    if head is None:
        return Wide([], spark.createDataFrame([], "cells array<string>"))
    names = spark.createDataFrame([(head["value"],)], "value string").selectExpr(f"{_fields('value', sep)} AS cells").first()["cells"]
    rows = lines.where(F.col("value") != F.lit(head["value"])).selectExpr(f"{_fields('value', sep)} AS cells")
    fits = F.when(F.size("cells") <= len(names), F.col("cells"))
    return Wide(list(names), rows.select(F.coalesce(fits, F.raise_error(F.lit(f"a row has more than {len(names)} cells"))).alias("cells")))


def to_long(wide: Wide, index: str, columns: Sequence[str], gene: str = "gene", sample: str = "sample") -> DataFrame:
    """(gene, sample, value) of the named columns; unreadable and missing cells become 0."""
    kept = set(columns)
    # the names travel as one literal; a column that is not kept has an empty one
    marks = F.split(F.lit("\x1f".join(n if n in kept else "" for n in wide.names)), "\x1f", -1)
    width = F.lit(len(wide.names))
    whole = F.transform(F.sequence(F.lit(1), width), lambda i: F.try_element_at("cells", i))
    cells = wide.rows.select(F.get("cells", F.lit(wide.at(index))).alias(gene), F.posexplode(whole).alias("_at", "_cell"))
    named = cells.select(gene, F.get(marks, F.col("_at")).alias(sample), F.coalesce(F.col("_cell").try_cast("double"), F.lit(0.0)).alias("value"))
    return named.where(F.col(sample) != "")


def numeric_columns(wide: Wide, index: str, deny: Sequence[str] = (), min_cols: int = 2, max_bad: float = 0.05) -> list[str]:
    """The columns where at most 5 % of the cells fail to parse: bad cells are counted by position, in one pass over the file."""
    width = F.lit(len(wide.names))
    flags = F.transform(F.sequence(F.lit(1), width), lambda i: F.try_element_at("cells", i).try_cast("double").isNull().cast("double"))
    bad = wide.rows.select(F.posexplode(flags).alias("_at", "_bad")).groupBy("_at").agg(F.avg("_bad").alias("bad"))
    fine = {r["_at"] for r in bad.where(F.col("bad") <= max_bad).collect()}  # at most one row per column
    kept = [c for i, c in enumerate(wide.names) if i in fine and c != index and c not in set(deny)]
    if len(kept) < min_cols:
        raise GuardError(f"only {len(kept)} numeric column(s): kept {kept}")
    return kept


def matching_columns(wide: Wide, index: str, pattern: str) -> list[str]:
    """The columns whose name matches from its start."""
    kept = [c for c in wide.names if c != index and re.match(pattern, c)]
    if not kept:
        raise GuardError(f"{pattern!r} matches no column of {wide.names[:20]}")
    return kept


def read_wide_matrix(
    spark: SparkSession, path: str, index: str, pattern: str | None = None, deny: Sequence[str] = (), sep: str | None = None
) -> DataFrame:
    """A genes-by-samples file as (gene, sample, value)."""
    wide = read_table(spark, path, sep)
    wide.at(index)
    return to_long(wide, index, matching_columns(wide, index, pattern) if pattern else numeric_columns(wide, index, deny))


def read_per_sample(
    spark: SparkSession, path: str, id_col: str, value: str | int, name: str | None = None, exclude: str | None = None,
    rollup: str | None = None, symbol: str | None = None, lines=read_lines,
) -> DataFrame:
    """One file per sample: (gene, sample, value); ``value`` is a column name or a position after the id column.

    Headers are searched per file, so caption lines and columns named after the sample are fine. ``rollup`` names another
    id column whose rows are summed per file.
    """
    raw = lines(spark, path)
    if exclude:
        raw = raw.where(~F.col("file_name").rlike(exclude))
    heads = find_header(raw, id_col)
    key = rollup or id_col

    def at(col: Column, label: str) -> Column:
        return F.array_position(col, label).cast("int")

    header = F.col("header")
    if isinstance(value, str):
        position = at(header, value)
    else:
        rest = F.filter(F.transform(header, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("p"))), lambda s: s["h"] != id_col)
        position = F.element_at(rest, int(value) + 1)["p"]
    where = heads.select(
        "file_name", "header_place", at(header, key).alias("_k"), position.alias("_v"),
        *([at(header, symbol).alias("_s")] if symbol else []),
    )
    found = F.regexp_extract("file_name", name, 1) if name else F.lit("")
    sample = F.when(found != "", found).otherwise(F.regexp_replace("file_name", r"\.gz$", ""))
    fields = F.split("line", "\t")
    rows = attach_stats(raw, where, ["file_name"], "inner").where(
        (F.col("place") > F.col("header_place")) & (F.trim("line") != "")
    )
    table = rows.select(
        "file_name", "place", F.get(fields, F.col("_k") - 1).alias("gene"), sample.alias("sample"),
        F.coalesce(F.get(fields, F.col("_v") - 1).try_cast("double"), F.lit(0.0)).alias("value"),
        *([F.get(fields, F.col("_s") - 1).alias("symbol")] if symbol else []),
    )
    if not rollup:
        return table
    extra = [F.min_by("symbol", "place").alias("symbol")] if symbol else []
    return rollup_sum(table, ["file_name", "sample", "gene"], "value", extra)


def rollup_sum(df: DataFrame, key: Sequence[str], value: str, extra: Sequence[Column] = ()) -> DataFrame:
    return df.groupBy(*key).agg(F.sum(value).alias(value), *extra)


def densify(long: DataFrame, gene: str = "gene", sample: str = "sample", value: str = "value") -> DataFrame:
    """Zero rows for missing (gene, sample) pairs; only for a sink that wants the full matrix."""
    cells = grid(long.select(gene).distinct(), long.select(sample).distinct())
    return cells.join(long, [gene, sample], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def merge_condition_files(spark: SparkSession, specs: Sequence[dict]) -> DataFrame:
    """Files that each bring their own sample columns, kept on the genes all files share.

    A spec holds ``path``, ``index`` and optionally ``pattern``, ``deny``, ``sep``.
    """
    parts = [read_wide_matrix(spark, **s).withColumn("_file", F.lit(i)) for i, s in enumerate(specs)]
    both = reduce(lambda a, b: a.unionByName(b), parts)
    shared = both.groupBy("gene").agg(F.countDistinct("_file").alias("_n")).where(F.col("_n") == len(specs)).select("gene")
    return both.join(shared, "gene", "left_semi").drop("_file")
