"""Suffix-array deduplication of byte strings by two-stage sorting.

Runs of consecutive 200-byte windows that share a minimiser are packed as one string (see ``minimisers``), so that all
occurrences of a string that repeats meet in one bucket. The strings of some buckets together make a text. Only its suffixes that
are smaller than their successors are sorted directly; the others are induced by scanning the buckets of the first bytes from
small to large, since a suffix that is larger than its successor starts with a larger byte. Prefixes that neighbours in the
order have in common, computed last, tell which windows occur more than once.

A byte goes when a window over it also starts anywhere else, the same document included; windows are judged on the input and
never cross documents. Null, empty and short texts lose nothing. Repeated rows are documents of their own, so their long texts
go from each. Columns besides the id and the text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftgrid.llm.common import flat_runs, groups, map_rows, row_key, same
from shiftgrid.llm.minimisers import Unit, flat_windows, gram_hashes, hot_ranges, in_chunks, lost_spans, repeated_pieces

WORD = 8  # bytes compared at a time


class Bytes(Unit):
    def split(self, text: bytes) -> bytes:
        return text

    def values(self, parts: bytes) -> np.ndarray:
        return np.frombuffer(parts, np.uint8).astype(np.uint64)

    def piece(self, parts: bytes, a: int, b: int) -> bytes:
        return parts[a:b]

    def sizes(self, parts: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return end - start


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number that sorts like them; zeros stand behind the end."""
    padded = np.concatenate((text, np.zeros(WORD, np.uint8))).astype(np.uint64)
    out = np.zeros(text.size, np.uint64)
    for j in range(WORD):
        out = (out << np.uint64(8)) | padded[j:j + text.size]
    return out


def sort_directly(words: np.ndarray, suffixes: np.ndarray, depth: int, whole: np.ndarray | None) -> np.ndarray:
    """``suffixes`` by their first ``depth`` bytes, refined eight bytes at a time among those that agree so far.

    A group whose members share ``whole``, a hash of the prefix to ``depth``, is equal and not refined further.
    """
    order = suffixes[np.argsort(words[suffixes], kind="stable")]
    key = words[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    for at in range(WORD, depth, WORD):
        group = np.cumsum(new) - 1
        open_group = np.bincount(group) > 1
        if whole is not None:
            h = whole[order]
            differs = np.zeros(open_group.size, bool)
            differs[group[1:][(h[1:] != h[:-1]) & (group[1:] == group[:-1])]] = True
            open_group &= differs
        place = np.flatnonzero(open_group[group])
        if not place.size:
            break
        part, g = order[place], group[place]
        # a position beyond the text has no word; suffixes are only compared as far as they reach
        far = np.minimum(part + at, words.size - 1)
        key = np.where(part + at < words.size, words[far], 0)
        by = np.lexsort((key, g))
        order[place], key, g = part[by], key[by], g[by]
        apart = np.concatenate(([True], (g[1:] != g[:-1]) | (key[1:] != key[:-1])))
        new[place] |= apart
    return order


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int, whole: np.ndarray | None = None) -> np.ndarray:
    """The suffixes marked ``wanted``, in the order of their first ``depth`` bytes at least; ties in any order.

    Two-stage sorting. A suffix that is larger than its successor needs that successor in order first, so what is wanted is
    extended along falling bytes up to the first suffix that is sorted directly.
    """
    n = text.size
    after = np.append(text[1:], 0)
    falls = text > after  # larger than its successor; an equal byte counts as sorted directly, which is always right
    falls[-1] = True  # the last suffix is larger than the empty one
    need = wanted.copy()
    # a falling stretch ends within 255 bytes
    for _ in range(256):
        grown = np.flatnonzero(need[:-1] & falls[:-1]) + 1
        grown = grown[~need[grown]]
        if not grown.size:
            break
        need[grown] = True
    words = words_at(text)
    direct = sort_directly(words, np.flatnonzero(need & ~falls), depth, whole)
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]  # of each first byte, in the order of the successors
    if need[-1]:
        waiting[int(text[-1])].append(np.array([n - 1]))
    induces = np.zeros(n, bool)
    induces[1:] = need[1:] & need[:-1] & falls[:-1]
    out = []
    for c in range(256):
        bucket = np.concatenate((*waiting[c], direct[bounds[c]:bounds[c + 1]]))
        waiting[c] = []
        if not bucket.size:
            continue
        out.append(bucket)
        before = bucket[induces[bucket]] - 1
        if before.size:
            byte = text[before]
            by = np.argsort(byte, kind="stable")
            before, byte = before[by], byte[by]
            cuts = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
            for a, b in zip(cuts.tolist(), np.append(cuts[1:], byte.size).tolist(), strict=True):
                waiting[int(byte[a])].append(before[a:b])
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def common_prefix(text_words: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Whether the suffixes at ``a`` and ``b`` agree in their first ``depth`` bytes (a multiple of eight, or its last word overlaps)."""
    agree = np.zeros(a.size, bool)
    where = np.arange(a.size)
    for at in [*range(0, depth - WORD + 1, WORD), *([depth - WORD] if depth % WORD else [])]:
        where = where[text_words[a[where] + at] == text_words[b[where] + at]]
    agree[where] = True
    return agree


def repeated_windows(pieces: list[bytes], counts: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(piece, first window, end) of the windows that occur more than once over all pieces, or stand in a piece that does."""
    # pieces lie end to end; a window never reaches over its piece, so no separator is needed
    text = np.frombuffer(b"".join(pieces), np.uint8)
    at, piece, within = flat_windows(np.fromiter(map(len, pieces), np.int64, len(pieces)), window)
    wanted = np.zeros(text.size, bool)
    wanted[at] = True
    repeated = np.zeros(text.size, bool)
    repeated[at[counts[piece] > 1]] = True
    whole = np.zeros(text.size, np.uint64)
    hashes = gram_hashes(text.astype(np.uint64), window)
    whole[:hashes.size] = hashes
    words = words_at(text)
    for known in (whole, None):
        order = suffix_order(text, wanted, window, known)
        alike = common_prefix(words, order[1:], order[:-1], window)
        # equal hashes of unequal windows would leave a group unsorted; then sort again without them
        if known is None or np.array_equal(alike, known[order[1:]] == known[order[:-1]]):
            break
    repeated[order[1:][alike]] = True
    repeated[order[:-1][alike]] = True
    hit = repeated[at]
    edge = np.concatenate(([True], (piece[1:] != piece[:-1]) | (hit[1:] != hit[:-1])))
    start = np.flatnonzero(edge)
    last = np.append(start[1:], at.size) - 1
    return [(p, a, b + 1) for p, a, b, h in zip(
        piece[start].tolist(), within[start].tolist(), within[last].tolist(), hit[start].tolist(), strict=True) if h]


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 200, k: int = 48,
                  unpack_from: int = 20_000, unpack_bytes: int = 4 << 20, chunk_bytes: int = 4 << 20) -> DataFrame:
    """(id, _row, text, starts, ends) for documents that lose bytes: spans of bytes, end exclusive, not merged.

    ``k`` bytes are long enough to be rarely shared by chance, so few documents are read again in vain.
    """
    if window < WORD:
        raise ValueError(f"windows have {WORD} bytes at least")
    rows = repeated_pieces(docs, lambda: Bytes(window, k), id_col, text, F.sum("n") > 1, unpack_from, unpack_bytes)
    found = rows.where(F.col("mark").isNotNull())
    id_type = rows.schema["id"].dataType.simpleString()

    def sort(batches):
        for t in in_chunks(groups(batches, 1), "piece", chunk_bytes):
            # copies of a string are sorted once and repeat as a whole
            of: dict[bytes, int] = {}
            piece = np.fromiter((of.setdefault(d, len(of)) for d in t.column("digest").to_pylist()), np.int64, t.num_rows)
            first, counts = np.unique(piece, return_index=True, return_counts=True)[1:]
            found_ = repeated_windows(t.column("piece").take(pa.array(first)).to_pylist(), counts, window)
            out = np.array(found_, np.int64).reshape(-1, 3)
            begin = np.searchsorted(out[:, 0], np.arange(len(of) + 1))
            n = (begin[1:] - begin[:-1])[piece]
            row = np.repeat(np.arange(t.num_rows), n)
            at = begin[piece][row] + np.arange(row.size) - np.repeat(np.cumsum(n) - n, n)
            take, start = pa.array(row), t.column("start").to_numpy()
            yield pa.RecordBatch.from_arrays([
                t.column("id").combine_chunks().take(take), t.column("_row").combine_chunks().take(take),
                pa.array(start[row] + out[at, 1]), pa.array(start[row] + out[at, 2] + (window - 1))], names=["id", "_row", "a", "b"])

    packed = found.where(~F.col("hot")).select("mark", "digest", "id", "_row", "start", "piece").repartition(
        "mark").sortWithinPartitions("mark").mapInArrow(sort, f"id {id_type}, _row long, a long, b long")
    hot = hot_ranges(rows, lambda: Bytes(window, k), F.count("*"), F.sum("value"))
    unpacked = hot.where("best > 1").select(
        "id", "_row", (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("end") + (window - 1)).alias("b"))
    return lost_spans(rows, packed.unionByName(unpacked))


RESULT = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
    T.StructField("kept_sha256", T.StringType()), T.StructField("starts", T.ArrayType(T.LongType())),
    T.StructField("ends", T.ArrayType(T.LongType()))])


def kept(text: bytes | None, starts: list[int], ends: list[int]) -> tuple:
    """Counts, digest of the remaining bytes, and the merged removed spans."""
    text = text or b""
    gone = np.zeros(len(text) + 1, np.int32)
    np.add.at(gone, starts, 1)
    np.add.at(gone, ends, -1)
    gone = np.cumsum(gone)[:-1] > 0
    a, b = flat_runs(gone)
    left = np.frombuffer(text, np.uint8)[~gone].tobytes() if a.size else text
    return (len(text), int(gone.sum()), int(a.size), hashlib.sha256(left).hexdigest(), a.tolist(), b.tolist())


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: the id, n_bytes, n_removed, n_spans, kept_sha256, starts and ends of the removed spans."""
    lost = removed_spans(docs, id_col, text, **options)
    fields = [f.name for f in RESULT]

    def untouched():
        def function(texts):
            for t in texts:
                yield (len(t or b""), 0, 0, hashlib.sha256(t or b"").hexdigest(), [], [])
        return function

    def run(batches):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        for batch in batches:
            if not batch.num_rows:
                continue
            got = [kept(t, s, e) for t, s, e in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
            arrays = [pa.array(list(c), k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["id", "_row", *fields])

    changed = lost.mapInArrow(run, T.StructType([lost.schema["id"], lost.schema["_row"], *RESULT.fields])).dropDuplicates(["id", "_row"])
    whole = map_rows(docs.select(F.col(id_col).alias("id"), row_key(id_col, text), F.col(text).alias("_t")), ["id", "_row"], "_t", untouched, RESULT)
    return whole.join(changed, same(whole, changed, "id", "_row"), "left").select(
        whole["id"].alias(id_col), *[F.coalesce(changed[f], whole[f]).alias(f) for f in fields])
