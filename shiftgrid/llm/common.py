"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# What Python's bytes.split() and bytes.strip() take as white space: \x20 and \x09-\x0D, nothing else.
SPACE = b" \t\n\r\x0b\x0c"


def need(df: DataFrame, *columns: str) -> None:
    """Raise when a column the operator reads is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} not found in {df.columns}")


def map_rows(df: DataFrame, keep: list[str], text: str, make: Callable[[], Callable[[list], Iterable[tuple]]],
             out: T.StructType) -> DataFrame:
    """One output row per input row: the columns ``keep`` and what the function returns for the text.

    ``make`` is called once per task and returns a function from a list of texts (UTF-8 bytes, null as None) to one tuple of
    ``out`` per text. Columns of ``df`` that are neither kept nor the text never reach Python.
    """
    need(df, text, *keep)
    source = df.select(*[F.col(c) for c in keep], F.col(text).cast("binary").alias("_text"))
    schema = T.StructType([source.schema[c] for c in keep] + list(out.fields))
    made = to_arrow_schema(out)
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = list(function(batch.column(n_keep).to_pylist()))
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(list(columns[i]), type=f.type) for i, f in enumerate(made)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n_keep)] + arrays, names=schema.names)

    return source.mapInArrow(run, schema)


def row_key(id_col: str, text: str) -> Column:
    """Number of a row within its id: rows that repeat an id with another text stay different documents."""
    return F.xxhash64(F.col(id_col), F.col(text)).alias("_row")


def same(left: DataFrame, right: DataFrame, *columns: str) -> Column:
    """Equality of ``columns`` on both sides; null equals null."""
    condition = left[columns[0]].eqNullSafe(right[columns[0]])
    for c in columns[1:]:
        condition = condition & left[c].eqNullSafe(right[c])
    return condition


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``n_keys`` columns (whole numbers without null), across batch borders.

    The input is sorted by these columns within the partition. Only one run is held at a time.
    """
    rest: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        borders = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            key = tuple(int(k[a]) for k in keys)
            if rest and key != last:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(a, b - a))
            last = key
    if rest:
        yield pa.Table.from_batches(rest)


def flat_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def held_out(id_col: str, folds: int = 5) -> Column:
    """True for the rows kept away from learning: crc32 of the id as text leaves no rest. A null id is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))
