"""Lines of text files with their place, header search, and files whose name lies about their compression."""

from __future__ import annotations

import gzip
import io
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shiftgrid.operators.filters import require_empty
from shiftgrid.sources.opened import opener


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (file_name, place, line); ``place`` orders the lines of a file.

    A split knows its start in the file, and lines keep their order inside a split.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_name").alias("file_name"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
        ).alias("place"),
        F.col("value").alias("line"),
    )


def sniffed_source() -> type[DataSource]:
    """The data source class; made here, so that it travels to the workers with its code."""

    opened = opener()

    class Part(InputPartition):
        def __init__(self, path: str, start: int, end: int | None):
            self.path, self.start, self.end = path, start, end  # no end: the whole file as a stream

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.files = json.loads(options["files"])
            self.block, self.encoding = int(options["block"]), options["encoding"]

        def partitions(self) -> list[InputPartition]:
            parts: list[InputPartition] = []
            for path, size in self.files:
                system, inside = opened(path)
                with system.open_input_stream(inside, compression=None) as stream:
                    packed = stream.read(2) == b"\x1f\x8b"
                if packed or self.encoding != "utf-8":
                    parts.append(Part(path, 0, None))
                else:
                    parts += [Part(path, a, min(a + self.block, size)) for a in range(0, size, self.block)]
            return parts

        def lines(self, part: Part) -> Iterator[str]:
            system, inside = opened(part.path)
            if part.end is None:
                with system.open_input_stream(inside, compression=None) as raw:
                    stream = io.BufferedReader(raw, 1 << 20)
                    if stream.peek(2)[:2] == b"\x1f\x8b":
                        stream = gzip.GzipFile(fileobj=stream)
                    for line in io.TextIOWrapper(stream, encoding=self.encoding):
                        yield line.rstrip("\r\n")
                return
            with system.open_input_file(inside) as raw:
                # a line belongs to the part in which it starts
                at = part.start
                if at:
                    raw.seek(at - 1)
                stream = io.BufferedReader(raw, 1 << 20)
                if at:
                    at += len(stream.readline()) - 1
                while at < part.end:
                    line = stream.readline()
                    at += len(line)
                    yield line.decode(errors="replace").rstrip("\r\n")

        def read(self, part: Part) -> Iterator[tuple]:
            base = part.path.rsplit("/", 1)[-1]
            for i, line in enumerate(self.lines(part)):
                yield base, part.start, i, line

    class SniffedText(DataSource):
        @classmethod
        def name(cls) -> str:
            return "sniffed_text"

        def schema(self) -> str:
            return "file_name string, block long, row long, line string"

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    return SniffedText


def read_text_sniff(spark: SparkSession, path: str | list[str], encoding: str = "utf-8", block: int = 128 << 20) -> DataFrame:
    """The same rows for files that are gzip or plain by content, not by name; UTF-16 on request.

    Spark picks a codec by extension and fails on a plain file named ``.gz``. Two bytes of each file tell them apart: plain UTF-8
    files are read by byte range, ``block`` bytes a task; a gzip stream cannot be split and is read as a stream. No file is ever
    held whole.
    """
    spark.dataSource.register(sniffed_source())
    files = [[r["path"], r["length"]] for r in spark.read.format("binaryFile").load(path).select("path", "length").collect()]  # the listing
    rows = spark.read.format("sniffed_text").options(files=json.dumps(files), block=str(int(block)), encoding=encoding).load()
    return rows.select("file_name", F.struct("block", "row").alias("place"), "line")


def find_header(lines: DataFrame, id_col: str, lookahead: int = 5) -> DataFrame:
    """Per file: place and tokens of the first line among the first few that holds ``id_col`` as a tab token."""
    from shiftgrid.operators.ranks import top_rows

    head = top_rows(lines, ["file_name"], ["place"], lookahead)
    tokens = F.split(F.col("line"), "\t")
    found = head.where(F.array_contains(tokens, id_col)).groupBy("file_name").agg(
        F.min("place").alias("header_place"), F.min_by(tokens, "place").alias("header")
    )
    require_empty(
        lines.select("file_name").distinct().join(found, "file_name", "left_anti"),
        f"no header row with {id_col!r} within the first {lookahead} lines",
    )
    return found
