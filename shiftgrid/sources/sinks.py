"""Text sinks, provenance columns and the wide report."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftgrid.sources.opened import opener


def write_tsv(df: DataFrame, path: str, cols: Sequence[str], compress: bool = False) -> None:
    """Tab-separated files with a header, columns in order, undefined values written as NA."""
    df.select(*cols).write.mode("overwrite").csv(
        path, sep="\t", header=True, nullValue="NA", compression="gzip" if compress else "none"
    )


def file_hashes(spark: SparkSession, path: str | list[str], length: int = 12) -> DataFrame:
    """Digest of every file, read as a stream in the task that owns it: a file is never a row, and takes one block of memory.

    An empty file is not listed.
    """
    files = spark.read.format("binaryFile").load(path).select("path")  # the listing; no content is read
    opened = opener()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch.column(0).to_pylist():
                system, inside = opened(name)
                digest = hashlib.md5()
                with system.open_input_stream(inside) as stream:
                    while block := stream.read(1 << 20):
                        digest.update(block)
                found.append(digest.hexdigest()[:length])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["path", "md5"])

    return files.mapInArrow(digests, "path string, md5 string")


def config_hash(config: dict, length: int = 10) -> str:
    return hashlib.md5(json.dumps(config, sort_keys=True).encode()).hexdigest()[:length]


def with_provenance(df: DataFrame, hashes: dict[str, str], config: dict) -> DataFrame:
    """One literal column per input hash, and the hash of the configuration."""
    return df.withColumns({**{k: F.lit(v) for k, v in hashes.items()}, "config_hash": F.lit(config_hash(config))})


def pivot_report(activity: DataFrame, entry: str, role: str, tf: str, value: str, tfs: Sequence[str] | None = None):
    """Datasets x factors with the role; given factor names save the job that would look them up."""
    grouped = activity.groupBy(entry, role)
    return (grouped.pivot(tf, list(tfs)) if tfs else grouped.pivot(tf)).agg(F.first(value))
