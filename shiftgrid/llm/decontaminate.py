"""Benchmark decontamination with an FM-index per shard of the training texts.

A shard is what a task holds of the documents at a time. Its words become numbers of a small alphabet, the words of the test
phrases; every other word ends a run, and runs shorter than the shortest phrase cannot hold one. Over what remains stands an
FM-index: the Burrows-Wheeler transform in a wavelet tree for ranks, and every eighth suffix position as a sample. All phrases
search backward at once, occurrences are located by walking to a sampled position, and their spans are merged per document.

The phrases are read in blocks of bounded size, so a benchmark of any size is searched with the same memory; nothing of the
documents is shuffled unless there are several blocks. Null and empty texts have no words; items without a word have no phrase;
items that share a phrase are all reported; a null item id is left out of the lists but its phrases count as hits. Repeated rows
are judged alike; columns besides the ids and the texts are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftgrid.llm.common import flat_runs, map_rows, need
from shiftgrid.session import cut

WINDOW = 13
SAMPLED = 8
# A-Z fall to lower case; digits, letters and all bytes beyond ASCII make words, the rest separates them.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class WaveletTree:
    """Ranks of symbols in a sequence, one bit of the symbol per level (a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.levels.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int((bit == 0).sum()))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position ``end``."""
        begin = np.zeros_like(end)
        for k, ones in enumerate(self.levels):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            b, e = ones[begin], ones[end]
            begin = np.where(one, self.zeros[k] + b, begin - b)
            end = np.where(one, self.zeros[k] + e, end - e)
        return end - begin

    def at(self, place: np.ndarray) -> np.ndarray:
        """The symbols at positions."""
        out = np.zeros_like(place)
        for k, ones in enumerate(self.levels):
            bit = ones[place + 1] - ones[place]
            out = (out << 1) | bit
            place = np.where(bit == 1, self.zeros[k] + ones[place], place - ones[place])
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order, by prefix doubling."""
    n = text.size
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[:-k or n] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        k *= 2
        if rank[order[-1]] == n - 1 or k >= n:
            return order


class FMIndex:
    """Backward search over one shard. ``text`` holds symbols from 1 on, runs separated by ``separator``."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        text = np.append(text, 0)  # smaller than all others
        order = suffix_order(text)
        last = text[order - 1]
        self.tree = WaveletTree(last.astype(np.int32), max(1, int(n_symbols).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols + 1)))).astype(np.int64)
        self.size = text.size
        kept = order % SAMPLED == 0
        self.kept = np.concatenate(([0], np.cumsum(kept)))
        self.is_kept, self.places = kept, order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the suffixes that start with each row of ``phrases`` (all of one length)."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.size, np.int64)
        alive = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, j]
            lo[alive] = self.before[c] + self.tree.rank(c, lo[alive])
            hi[alive] = self.before[c] + self.tree.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
            if not alive.size:
                break
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: step to the symbol before until a sampled suffix is met."""
        out = np.full(rows.size, -1, np.int64)
        walk, at, steps = np.arange(rows.size), rows.astype(np.int64), 0
        while walk.size:
            met = self.is_kept[at]
            out[walk[met]] = self.places[self.kept[at[met]]] + steps
            walk, at = walk[~met], at[~met]
            c = self.tree.at(at)
            at = self.before[c] + self.tree.rank(c, at)
            steps += 1
        return out


class Phrases:
    """The windows of one block of benchmark items, as rows of word numbers by length, with the items that hold them."""

    def __init__(self, items: list[tuple[int | str | None, bytes | None]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if ids else 0):
                owners.setdefault(tuple(ids[i:i + size]), set()).add(item)
        by_length: dict[int, list] = {}
        for phrase, held in owners.items():
            by_length.setdefault(len(phrase), []).append((phrase, sorted((str(x) for x in held if x is not None))))
        self.by_length = {k: (np.array([p for p, _ in v], np.int64), [o for _, o in v]) for k, v in by_length.items()}
        self.shortest = min(self.by_length, default=0)

    def hits(self, texts: list[bytes | None]) -> Iterator[tuple[int, list[int], list[int], list[str]]]:
        """Per text: number of words, starts and ends of the merged hit spans, and items found, over one FM-index."""
        number, counts, parts = self.number, [], []
        for t in texts:
            words = words_of(t)
            counts.append(len(words))
            parts.append(np.fromiter(map(number.get, words, (0 for _ in words)), np.int64, len(words)))
            parts.append(np.zeros(1, np.int64))  # a phrase never crosses documents
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        offset = np.concatenate(([0], np.cumsum(np.array(counts, np.int64) + 1)))
        found_items: dict[int, set[str]] = {}
        hit = np.zeros(flat.size + 1, np.int64)
        starts, ends = flat_runs(flat > 0)
        long = ends - starts >= max(1, self.shortest)
        starts, ends = starts[long], ends[long]
        if starts.size and self.by_length:
            sizes = ends - starts + 1  # each run keeps the separator behind it
            place = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
            separator = len(number) + 1
            text = np.where(flat[place] > 0, flat[place], separator)
            index = FMIndex(text, separator)
            for phrases, owners in self.by_length.values():
                lo, hi = index.search(phrases)
                which = np.repeat(np.arange(len(phrases)), hi - lo)
                if not which.size:
                    continue
                rows = np.arange(which.size) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[which]
                at = place[index.locate(rows)]
                np.add.at(hit, at, 1)
                np.add.at(hit, at + phrases.shape[1], -1)
                pairs = np.unique(np.stack((np.searchsorted(offset, at, side="right") - 1, which)), axis=1)
                for doc, phrase in pairs.T.tolist():
                    found_items.setdefault(doc, set()).update(owners[phrase])
        covered = np.cumsum(hit)[:-1] > 0
        a, b = flat_runs(covered)
        doc = np.searchsorted(offset, a, side="right") - 1
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        for i, n in enumerate(counts):
            x, y = bounds[i], bounds[i + 1]
            yield (n, (a[x:y] - offset[i]).tolist(), (b[x:y] - offset[i]).tolist(), sorted(found_items.get(i, ())))


SPANS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())),
    T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType())),
])


def search(docs: DataFrame, phrases: Phrases, keep: list[str], text: str, shard_bytes: int) -> DataFrame:
    def make():
        def function(texts):
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < shard_bytes):
                    size += len(texts[end] or b"")
                    end += 1
                yield from phrases.hits(texts[at:end])
                at = end

        return function

    return map_rows(docs, keep, text, make, SPANS)


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id",
         item_text: str = "text", window: int = WINDOW, block_bytes: int = 16 << 20, shard_bytes: int = 8 << 20) -> DataFrame:
    """``keep``, n_words, starts and ends (words, end exclusive) of the merged hit spans, and the items found (as strings).

    Blocks of about ``block_bytes`` of benchmark text, dealt by a hash of the item, are searched one after the other. With more
    than one block each block's result is written before the next block is read, and the results are merged per row: rows that
    agree in ``keep`` but not in the text stay apart.
    """
    need(benchmark, item, item_text)
    known = benchmark.select(F.col(item).alias("_item"), F.col(item_text).cast("binary").alias("_text")).where(
        F.col("_text").isNotNull())
    total = known.agg(F.sum(F.length("_text"))).first()[0] or 0
    blocks = -(-int(total) // block_bytes) or 1

    def block(k: int) -> Phrases:
        rows = known.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == k).distinct().collect()
        return Phrases([(r["_item"], bytes(r["_text"])) for r in rows], window)

    if blocks == 1:
        return search(docs, block(0), keep, text, shard_bytes)
    need(docs, text, *keep)
    packed = docs.select(F.struct(*keep).alias("_keep"), F.xxhash64(text).alias("_mark"), F.col(text).alias("_text"))
    union = None
    for k in range(blocks):
        found = cut(search(packed, block(k), ["_keep", "_mark"], "_text", shard_bytes))
        union = found if union is None else union.unionByName(found)
    merged = union.groupBy("_keep", "_mark").agg(  # as many rows per document as there are blocks
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        (F.count("*") / blocks).cast("int").alias("_copies"))  # repeated rows stay repeated
    spans = F.aggregate(
        F.array_sort("_spans"), F.expr("cast(array() as array<struct<starts:bigint,ends:bigint>>)"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["ends"] >= s["starts"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.element_at(acc, -1)["starts"].alias("starts"), F.greatest(F.element_at(acc, -1)["ends"], s["ends"]).alias("ends")))),
        ).otherwise(F.concat(acc, F.array(F.struct(s["starts"].alias("starts"), s["ends"].alias("ends"))))))
    return merged.withColumn("_spans", spans).withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(
        "_keep.*", "n_words", F.col("_spans.starts").alias("starts"), F.col("_spans.ends").alias("ends"), "items")


def n_hit() -> Column:
    """Words inside hit spans."""
    return F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda acc, s: acc + s["ends"] - s["starts"])


def contaminated() -> Column:
    """At least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))

