"""Registry of the check queries: each reads the driver tables, and most carry the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


class Tables:
    """Driver tables of one folder as DataFrames (``t.lineitem``), read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return tidy(self.run(Tables(spark, folder)))

    @cached_property
    def oracle(self) -> str | None:
        return self.sql


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, doubles: str = "", ctes: str = "", order: str = ""):
    """Register a query. ``ctes`` names shared stand-in tables, ``doubles`` the columns the SQL side rounds."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = Query(name, fn, None if sql is None else rounded(sql, doubles, ctes))
        return fn

    return register


def rounded(sql: str, doubles: str, ctes: str) -> str:
    from workload.standins import CTES

    parts: list[str] = []
    for c in ctes.split():
        parts.append(f"{c} AS ({CTES[c].strip()})")
    body = f"SELECT * FROM ({sql.strip()}) AS q" if not doubles else (
        "SELECT * REPLACE ("
        + ", ".join(f"round({c}, {DIGITS}) + 0.0 AS {c}" for c in doubles.split())
        + f") FROM ({sql.strip()}) AS q"
    )
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six digits without a negative zero: sums differ in the last bits between engines."""
    return df.select(*[
        (F.round(F.col(f.name), DIGITS) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name)
        for f in df.schema.fields
    ])
