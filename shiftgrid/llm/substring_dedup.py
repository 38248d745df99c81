"""Substring deduplication of word windows by super-k-mer partitioning.

Runs of consecutive windows that share a minimiser travel as one packed string to the bucket of that minimiser. There the windows
of all distinct strings are sorted and each distinct window gets the smallest document that holds it, compared word by word. A
word goes when a window over it also starts in a document with a smaller id; windows are judged on the input.

Null, empty and short texts lose nothing. Rows that share an id are not smaller than each other, so copies under one id stay;
a null id counts as larger than any other. Repeated rows get the same result each. Columns besides the id and the text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftgrid.llm.common import flat_runs, groups, map_rows, row_key, same
from shiftgrid.llm.minimisers import Unit, flat_windows, gram_hashes, hot_ranges, in_chunks, lost_spans, mixed, repeated_pieces

REMEMBERED = 400_000


class Words(Unit):
    """Words between white space (\\x20, \\x09-\\x0D), unchanged."""

    def __init__(self, window: int, k: int):
        super().__init__(window, k)
        self.seen: dict[bytes, int] = {}

    def split(self, text: bytes) -> list[bytes]:
        return text.split()

    def values(self, parts: list[bytes]) -> np.ndarray:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        seen = self.seen
        for w in parts:
            if w not in seen:
                seen[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, parts), np.uint64, len(parts))

    def piece(self, parts: list[bytes], a: int, b: int) -> bytes:
        return b" ".join(parts[a:b])

    def sizes(self, parts: list[bytes], start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)))
        return total[end] - total[start]


def equal_windows(ids: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows that start at ``at`` so that equal ones stand together, and where a new window begins in it."""
    h = gram_hashes(mixed(ids.astype(np.uint64) + np.uint64(1)), window)[at]
    order = np.argsort(h, kind="stable")
    alike = h[order][1:] == h[order][:-1]
    same_words = alike.copy()
    where = np.flatnonzero(alike)
    for j in range(window):
        where = where[ids[at[order[where]] + j] == ids[at[order[where + 1]] + j]]
    same_words[:] = False
    same_words[where] = True
    if not np.array_equal(same_words, alike):  # two windows share a hash: sort the words themselves
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(ids, window)[at])
        order = np.lexsort(rows.T[::-1])
        same_words = (rows[order][1:] == rows[order][:-1]).all(axis=1)
    return order, np.concatenate(([True], ~same_words))


def smallest(pieces: list[bytes], owner: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """(piece, first window, end, smallest owner) for runs of windows of each piece; owners are numbers."""
    number: dict[bytes, int] = {}
    split = [p.split(b" ") for p in pieces]
    sizes = np.array([len(s) for s in split], np.int64)
    ids = np.fromiter((number.setdefault(w, len(number)) for s in split for w in s), np.int64, int(sizes.sum()))
    at, piece, within = flat_windows(sizes, window)
    order, new = equal_windows(ids, at, window)
    start = np.flatnonzero(new)
    least = np.minimum.reduceat(owner[piece[order]], start)
    best = np.empty(at.size, owner.dtype)
    best[order] = np.repeat(least, np.diff(np.append(start, at.size)))
    change = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]) | (best[1:] != best[:-1]))))
    last = np.append(change[1:], at.size) - 1
    return list(zip(piece[change].tolist(), within[change].tolist(), (within[last] + 1).tolist(), best[change].tolist(), strict=True))


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 50, k: int = 8,
                  unpack_from: int = 20_000, unpack_bytes: int = 6 << 20, chunk_bytes: int = 6 << 20) -> DataFrame:
    """(id, _row, text, starts, ends) for documents that lose words: spans of words, end exclusive, not merged."""
    none = F.count(F.when(F.col("id").isNull(), 1)) > 0
    repeated = (F.min("id") < F.max("id")) | (none & F.min("id").isNotNull())
    rows = repeated_pieces(
        docs, lambda: Words(window, k), id_col, text, F.coalesce(repeated, F.lit(False)), unpack_from, unpack_bytes)
    found = rows.where(F.col("mark").isNotNull())
    id_type = rows.schema["id"].dataType.simpleString()

    def sort(batches):
        for t in in_chunks(groups(batches, 1), "piece", chunk_bytes):
            known = [i for i in t.column("id").to_pylist() if i is not None]
            if not known:
                continue
            owners, owner = np.unique(np.array(known), return_inverse=True)
            rank = np.full(t.num_rows, owners.size)  # a null id is larger than any
            rank[t.column("id").is_valid().to_numpy()] = owner
            # copies of a string are sorted once, for the smallest document that holds it
            of: dict[bytes, int] = {}
            piece = np.fromiter((of.setdefault(d, len(of)) for d in t.column("digest").to_pylist()), np.int64, t.num_rows)
            first = np.unique(piece, return_index=True)[1]
            least = np.full(len(of), owners.size)
            np.minimum.at(least, piece, rank)
            out = np.array(smallest(t.column("piece").take(pa.array(first)).to_pylist(), least, window), np.int64)
            # every string meets the ranges of its text
            begin = np.searchsorted(out[:, 0], np.arange(len(of) + 1))
            n = (begin[1:] - begin[:-1])[piece]
            row = np.repeat(np.arange(t.num_rows), n)
            at = begin[piece][row] + np.arange(row.size) - np.repeat(np.cumsum(n) - n, n)
            lost = out[at, 3] < rank[row]
            row, at = row[lost], at[lost]
            take, start = pa.array(row), t.column("start").to_numpy()
            yield pa.RecordBatch.from_arrays([
                t.column("id").combine_chunks().take(take), t.column("_row").combine_chunks().take(take),
                pa.array(start[row] + out[at, 1]), pa.array(start[row] + out[at, 2] + (window - 1))], names=["id", "_row", "a", "b"])

    packed = found.where(~F.col("hot")).select("mark", "digest", "id", "_row", "start", "piece").repartition(
        "mark").sortWithinPartitions("mark").mapInArrow(sort, f"id {id_type}, _row long, a long, b long")
    hot = hot_ranges(rows, lambda: Words(window, k), F.min("id"), F.min("value"))
    smaller = (F.col("best") < F.col("id")) | (F.col("id").isNull() & F.col("best").isNotNull())
    unpacked = hot.where(smaller).select(
        "id", "_row", (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("end") + (window - 1)).alias("b"))
    return lost_spans(rows, packed.unionByName(unpacked))


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()),
    T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType()))])


def kept(text: bytes | None, starts: list[int], ends: list[int]) -> tuple:
    """Counts, digest of the kept words joined by one space, and the merged removed spans."""
    words = (text or b"").split()
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, starts, 1)
    np.add.at(gone, ends, -1)
    gone = np.cumsum(gone)[:-1] > 0
    a, b = flat_runs(gone)
    left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if a.size else words
    return (len(words), int(gone.sum()), hashlib.sha256(b" ".join(left)).hexdigest(), a.tolist(), b.tolist())


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: the id, n_words, n_removed, kept_sha256, and starts and ends of the removed spans of words."""
    lost = removed_spans(docs, id_col, text, **options)
    fields = [f.name for f in RESULT]

    def cut_out():
        def function(packed):
            for p in packed:
                yield kept(p, [], [])
        return function

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            got = [kept(t, s, e) for t, s, e in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
            arrays = [pa.array(list(c), k) for c, k in zip(
                zip(*got, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["id", "_row", *fields])

    schema = T.StructType([lost.schema["id"], lost.schema["_row"], *RESULT.fields])
    changed = lost.mapInArrow(run, schema).dropDuplicates(["id", "_row"])
    whole = map_rows(docs.select(F.col(id_col).alias("id"), row_key(id_col, text), F.col(text).alias("_t")), ["id", "_row"], "_t", cut_out, RESULT)
    return whole.join(changed, same(whole, changed, "id", "_row"), "left").select(
        whole["id"].alias(id_col), *[F.coalesce(changed[f], whole[f]).alias(f) for f in fields])
