"""Super-k-mers: consecutive windows that share their smallest hashed k-gram, and the plan that finds repeated ones.

Every window of a sequence belongs to one run of windows with the same minimiser, and equal windows have equal minimisers, so
only runs whose minimiser occurs elsewhere can hold a repeated window. ``repeated_pieces`` finds them in two passes: the first
counts the runs of each minimiser and their bytes over all documents, the second packs each run that is left as one string for
its bucket. A minimiser with more than ``unpack_from`` runs, or more than ``unpack_bytes`` bytes of them, is not gathered, so this
bounds every bucket. Its equal strings are combined by their digest first (``hot_ranges``), and the windows of the distinct strings
are grouped by their own digest, however many there are; both combine before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgrid.llm.common import need, row_key, same
from shiftgrid.session import cut

BASE = 0x9E3779B97F4A7C15
# Sequences are cut into overlapping segments of so many elements, so that memory does not grow with a text.
SEGMENT = 1 << 19


POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse; a task computes them once for each size."""
    if n in POWERS:
        return POWERS[n]
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for b in (BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    POWERS[n] = out[0], out[1]
    return POWERS[n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values (uint64): differences of a running sum, scaled back to the start of the gram."""
    n = values.size
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers(max(SEGMENT * 2, 1 << (n - 1).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((values + np.uint64(1)) * up[:n], out=total[1:])
    return mixed((total[k:] - total[:-k]) * down[:n - k + 1])


def minima(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive numbers."""
    out, have = h, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


# A task sends a string of a very common minimiser once, as long as it remembers no more digests than this.
REMEMBERED = 200_000


def runs(values: np.ndarray, window: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per segment: minimiser, first window and end (exclusive) of each run, and whether the minimiser occurs twice in it."""
    n = values.size - window + 1
    for a in range(0, n, SEGMENT):
        h = gram_hashes(values[a:min(a + SEGMENT, n) + window - 1], k)
        low = minima(h, window - k + 1)
        start = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        s = np.sort(h)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        own = low[start]
        place = np.minimum(np.searchsorted(twice, own), max(twice.size - 1, 0))
        again = twice[place] == own if twice.size else np.zeros(own.size, bool)
        yield own.view(np.int64), start + a, np.append(start[1:], low.size) + a, again


class Unit:
    """How a text becomes a sequence: ``values`` gives 64-bit numbers for hashing, ``piece`` the bytes of elements a to b."""

    def __init__(self, window: int, k: int):
        self.window, self.k = window, k

    def split(self, text: bytes):
        raise NotImplementedError

    def values(self, parts) -> np.ndarray:
        raise NotImplementedError

    def piece(self, parts, a: int, b: int) -> bytes:
        raise NotImplementedError

    def sizes(self, parts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Bytes of the elements from each start to its end (exclusive)."""
        raise NotImplementedError


def repeated_pieces(docs: DataFrame, unit: Callable[[], Unit], id_col: str, text: str, repeated: Column, unpack_from: int,
                    unpack_bytes: int) -> DataFrame:
    """Rows (id, _row, mark, digest, start, hot, piece, text), written to the shared folder.

    A row with a mark is a run of windows from element ``start`` on, ``piece`` its bytes (of a very common, ``hot`` minimiser, null
    where the task has sent the same string before); a row without one carries the text of a document that has such runs.
    ``repeated`` is an aggregate over the columns id, n (the runs of a minimiser in a document, at least 2 where it occurs twice in
    one) that tells which minimisers are kept.
    """
    need(docs, id_col, text)
    source = docs.select(F.col(id_col).alias("id"), row_key(id_col, text), F.col(text).cast("binary").alias("_text")).where(
        F.col("_text").isNotNull())
    id_type = source.schema["id"].dataType.simpleString()

    def count(batches):
        u = unit()
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            take, marks, ns, sizes = [], [], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                if len(t) < u.window:
                    continue
                parts = u.split(t)
                if len(parts) < u.window:
                    continue
                found = list(runs(u.values(parts), u.window, u.k))
                mark = np.concatenate([f[0] for f in found])
                start, end, again = (np.concatenate([f[j] for f in found]) for j in (1, 2, 3))
                distinct, where, n = np.unique(mark, return_inverse=True, return_counts=True)
                size = np.bincount(where, u.sizes(parts, start, end + (u.window - 1)), distinct.size)
                take.append(np.full(distinct.size, i))
                marks.append(distinct)
                ns.append(np.maximum(n, 1 + (np.bincount(where, again, distinct.size) > 0)))
                sizes.append(size.astype(np.int64))
            if take:
                at = pa.array(np.concatenate(take))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), keys.take(at), pa.array(np.concatenate(marks)), pa.array(np.concatenate(ns).astype(np.int32)),
                     pa.array(np.concatenate(sizes))], names=["id", "_row", "mark", "n", "size"])

    pairs = cut(source.mapInArrow(count, f"id {id_type}, _row long, mark long, n int, size long"))
    common = pairs.groupBy("mark").agg(
        repeated.alias("_kept"), ((F.sum("n") > unpack_from) | (F.sum("size") > unpack_bytes)).alias("_hot")).where("_kept").select(
        "mark", "_hot")
    hits = pairs.join(common, "mark").groupBy("id", "_row").agg(
        F.collect_set("mark").alias("_marks"), F.collect_set(F.when(F.col("_hot"), F.col("mark"))).alias("_hot"))
    joined = source.join(hits, same(source, hits, "id", "_row")).select(source["id"], source["_row"], "_text", "_marks", "_hot")

    def pack(batches):
        u = unit()
        names = ["id", "_row", "mark", "digest", "start", "hot", "piece", "text"]
        sent: set[bytes] = set()
        for batch in batches:
            for begin in range(0, batch.num_rows, 128):
                part = batch.slice(begin, 128)
                take, rows = [], []
                for i, (t, marks, hot) in enumerate(zip(*(part.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                    take.append(i)
                    rows.append((None, None, None, None, None, t))
                    parts = u.split(t)
                    marks, hot = np.sort(np.array(marks, np.int64)), set(hot)
                    for mark, start, end, _ in runs(u.values(parts), u.window, u.k):
                        at = np.minimum(np.searchsorted(marks, mark), marks.size - 1)
                        kept = marks[at] == mark
                        for m, a, b in zip(mark[kept].tolist(), start[kept].tolist(), end[kept].tolist(), strict=True):
                            piece = u.piece(parts, a, b - 1 + u.window)
                            digest = hashlib.blake2b(piece, digest_size=16).digest()
                            if m in hot:
                                if digest in sent:
                                    piece = None
                                else:
                                    if len(sent) >= REMEMBERED:
                                        sent.clear()
                                    sent.add(digest)
                            take.append(i)
                            rows.append((m, digest, a, m in hot, piece, None))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
                at = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at)] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=names)

    return cut(joined.mapInArrow(
        pack, f"id {id_type}, _row long, mark long, digest binary, start long, hot boolean, piece binary, text binary"))


def hot_ranges(rows: DataFrame, unit: Callable[[], Unit], of_string: Column, of_window: Column) -> DataFrame:
    """(id, _row, start, first, end, best): the runs of very common minimisers with the ranges of their windows.

    ``of_string`` aggregates the ids of the runs that are the same string, ``of_window`` these values (column ``value``) over all
    distinct strings that hold a window, once for each place; ``best`` is the outcome, alike for the windows ``first`` to
    ``end`` (exclusive) of the run that starts at ``start``.
    """
    hot = rows.where("hot")
    places = hot.select("digest", "id", "_row", "start")
    values = places.groupBy("digest").agg(of_string.alias("value"))
    kind = values.schema["value"].dataType.simpleString()
    strings = hot.where(F.col("piece").isNotNull()).select("digest", "piece").dropDuplicates(["digest"]).join(values, "digest")

    def unpack(batches):
        u = unit()
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                take, windows, places = [], [], []
                for i, piece in enumerate(part.column(1).to_pylist()):
                    parts = u.split(piece)
                    n = len(parts) - u.window + 1
                    take.append(np.full(n, i))
                    places.append(np.arange(n))
                    windows += [hashlib.blake2b(u.piece(parts, x, x + u.window), digest_size=16).digest() for x in range(n)]
                at = pa.array(np.concatenate(take))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(windows, pa.binary()), part.column(0).take(at), pa.array(np.concatenate(places)), part.column(2).take(at)],
                    names=["window", "digest", "x", "value"])

    windows = strings.select("digest", "piece", "value").mapInArrow(unpack, f"window binary, digest binary, x long, value {kind}")
    best = windows.groupBy("window").agg(of_window.alias("best"))
    # a string has as many windows as a segment has elements at most
    one = windows.select("window", "digest", "x").join(best, "window").groupBy("digest").agg(
        F.array_sort(F.collect_list(F.struct("x", "best"))).alias("_all"))
    # neighbours with one outcome are one range
    edge = F.filter("_all", lambda w, i: (i == 0) | ~w["best"].eqNullSafe(F.element_at("_all", F.greatest(i, F.lit(1)))["best"]))
    ranges = one.select("digest", F.size("_all").cast("long").alias("_n"), edge.alias("_edge")).select("digest", "_n", F.posexplode("_edge"), "_edge").select(
        "digest", F.col("col.x").alias("first"), F.col("col.best").alias("best"),
        F.coalesce(F.try_element_at("_edge", F.col("pos") + 2)["x"], F.col("_n")).alias("end"))
    return places.join(ranges, "digest")


def lost_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, _row, text, starts, ends): the texts of ``repeated_pieces`` with the spans (id, _row, a, b) they lose, not merged.

    A repeated row comes once for each time it is repeated.
    """
    texts = rows.where(F.col("mark").isNull()).select("id", "_row", "text")
    listed = spans.groupBy("id", "_row").agg(F.collect_set(F.struct("a", "b")).alias("_spans"))
    return texts.join(listed, same(texts, listed, "id", "_row")).select(
        texts["id"], texts["_row"], "text", F.col("_spans.a").alias("starts"), F.col("_spans.b").alias("ends"))


def in_chunks(tables: Iterator[pa.Table], column: str, limit: int) -> Iterator[pa.Table]:
    """Whole groups put together until ``column`` holds about ``limit`` bytes."""
    held, size = [], 0
    for t in tables:
        held.append(t)
        size += t.column(column).nbytes
        if size >= limit:
            yield pa.concat_tables(held)
            held, size = [], 0
    if held:
        yield pa.concat_tables(held)


def flat_windows(n_elements: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces laid end to end: start of each window, the piece it is in, and its number within the piece."""
    begin = np.cumsum(n_elements) - n_elements
    n = n_elements - window + 1
    piece = np.repeat(np.arange(n.size), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return begin[piece] + within, piece, within
