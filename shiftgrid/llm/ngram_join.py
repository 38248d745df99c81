"""Similarity self-join on word shingles by chosen paths.

Every distinct set of shingles (five words) is embedded into ``COORDINATES`` minhash tokens. A run of the join hashes each set
down a random tree: at a node, every token is sampled with probability 1 / (SLACK * threshold * tokens), and the set goes to one
child for each sampled token, so that similar sets meet in children of tokens they share. SLACK is below 1: a pair at the
threshold then shares more than one sampled token per node on average, and its paths survive at any depth. Buckets that are small are compared by brute
force; large ones are split further, with more sampled tokens per node, and buckets still large at ``DEEPEST`` are verified whole.
Runs are repeated until a pair at the threshold is met with the target probability at the depth its buckets are split to: sets
that were in a large bucket get more runs than the others. The probability is averaged over the spread of the tokens that the
sketches of such a pair share.

What the buckets find are candidates by sketch. Connected candidates form loose clusters, and inside them every pair of sets is
verified with its exact Jaccard similarity, in blocks, so that links are counted without a row per pair. Equal sets are one class
from the start; copies are never expanded.

Texts without a word link to nothing and are classes of their own; texts of fewer than five words are one shingle. Null is
empty. Rows that repeat an id with another text are different documents; a null id is an id. Repeated rows are copies of each
other. Columns besides the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftgrid.llm.common import groups, map_rows, need, row_key, same
from shiftgrid.llm.minimisers import gram_hashes, mixed
from shiftgrid.llm.substring_dedup import Words
from shiftgrid.session import cut

SHINGLE = 5
COORDINATES = 64
FIRST_DEPTH = 2
DEEPEST = 8
SLACK = 0.875
SPLIT_SLACK = 0.7  # below FIRST_DEPTH, where pairs that share few tokens by chance would die out
NODE_LIMIT = 2_000  # larger buckets are split further
BLOCK = 96  # members of a loose cluster that are verified against as many others in one task group


def survival(depth: int, offspring: float = 1 / SLACK) -> float:
    """Probability that a pair whose expected number of shared sampled tokens per node is ``offspring`` meets at ``depth``."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-offspring * q)
    return q


def shared_tokens(threshold: float) -> np.ndarray:
    """Probability of each number of equal tokens in the sketches of a pair at ``threshold``."""
    k = np.arange(COORDINATES + 1)
    ways = np.array([math.comb(COORDINATES, i) for i in k.tolist()], np.float64)
    return ways * threshold ** k * (1 - threshold) ** (COORDINATES - k)


def least_equal(recall: float, threshold: float = 0.8) -> int:
    """Equal tokens asked of a candidate: a pair at the threshold has fewer with an eighth of the allowed misses at most."""
    return int(np.searchsorted(np.cumsum(shared_tokens(threshold)), (1 - recall) / 8, side="right"))


def missed(runs: int, depth: int, least: int, threshold: float = 0.8) -> float:
    """Probability that a pair at the threshold is no candidate after ``runs`` runs whose buckets are split to ``depth``."""
    k = np.arange(COORDINATES + 1)
    q = np.ones(k.size)
    for level in range(depth, 0, -1):
        q = 1 - (1 - q * sampling(level, threshold)) ** k
    return float((shared_tokens(threshold) * np.where(k < least, 1.0, (1 - q) ** runs)).sum())


def runs_for(recall: float, depth: int = FIRST_DEPTH, threshold: float = 0.8) -> int:
    """Runs after which a pair at the threshold has met in some bucket at ``depth`` or before with probability ``recall``."""
    least, runs = least_equal(recall, threshold), 1
    while missed(runs, depth, least, threshold) > 1 - recall:
        runs += 1
    return runs


def sampling(level: int, threshold: float) -> float:
    """Probability that a token is sampled on the way to ``level`` of the tree."""
    return min(1.0, 1 / ((SLACK if level <= FIRST_DEPTH else SPLIT_SLACK) * threshold * COORDINATES))


def shingles(words: Words, text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    parts = (text or b"").split()
    if not parts:
        return np.zeros(0, np.uint64)
    return np.unique(gram_hashes(words.values(parts), min(SHINGLE, len(parts))))


def multipliers() -> np.ndarray:
    return mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minhash(hashes: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Smallest of each coordinate's hash over the set (32 bits)."""
    best = np.full(odd.size, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, hashes.size, 4096):
        h = (odd[:, None] * hashes[None, a:a + 4096])
        h ^= h >> np.uint64(31)
        np.minimum(best, (h * np.uint64(0x94D049BB133111EB)).min(axis=1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def children(owner: np.ndarray, path: np.ndarray, sketches: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Next level of the tree: for each (set, node) the children of tokens sampled at ``rate``, as (set, node)."""
    limit = np.uint64(min(int(rate * (1 << 63)) * 2, (1 << 64) - 1))
    places = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    out_owner, out_path = [], []
    for a in range(0, owner.size, 8192):
        o, p = owner[a:a + 8192], path[a:a + 8192]
        row, col = np.nonzero(mixed(p[:, None] ^ places[None, :]) < limit)
        token = places[col] + sketches[o[row], col].astype(np.uint64)
        out_owner.append(o[row])
        out_path.append(mixed(p[row] * np.uint64(0xBF58476D1CE4E5B9) ^ mixed(token)))
    return np.concatenate(out_owner), np.concatenate(out_path)


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node connected to each of 0 .. n-1 by the edges (a, b), inside one task."""
    label = np.arange(n)
    while a.size:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def sketched(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, _row, n (distinct shingles), set (digest of the shingle set) and sketch of every row."""
    source = docs.select(F.col(id_col).alias("id"), row_key(id_col, text), F.col(text).alias("_text"))

    def make():
        words, odd = Words(SHINGLE, 1), multipliers()

        def function(texts):
            for t in texts:
                h = shingles(words, t)
                if not h.size:
                    yield (0, None, None)
                else:
                    yield (h.size, hashlib.blake2b(h.tobytes(), digest_size=16).digest(), minhash(h, odd).astype("<u4").tobytes())

        return function

    return map_rows(source, ["id", "_row"], "_text", make, T.StructType([
        T.StructField("n", T.LongType()), T.StructField("set", T.BinaryType()), T.StructField("sketch", T.BinaryType())]))


def as_matrix(column: pa.ChunkedArray | pa.Array, width: int, kind: str) -> np.ndarray:
    """Fixed-size binaries as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def first_nodes(classes: DataFrame, begin_run: int, runs: int, threshold: float) -> DataFrame:
    """(node, set) for the nodes at FIRST_DEPTH of every run from ``begin_run`` to before ``runs``."""
    numbers = range(begin_run + 1, runs + 1)
    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                sketches = as_matrix(part.column(1), COORDINATES, "<u4")
                owner = np.tile(np.arange(part.num_rows), len(numbers))
                path = np.repeat(mixed(np.array(numbers, np.uint64) * np.uint64(0xA0761D6478BD642F)), part.num_rows)
                for level in range(1, FIRST_DEPTH + 1):
                    owner, path = children(owner, path, sketches, sampling(level, threshold))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(path.view(np.int64)), part.column(0).take(pa.array(owner))], names=["node", "set"])

    return classes.select("set", "sketch").mapInArrow(run, "node long, set binary")


def split_nodes(heavy: DataFrame, classes: DataFrame, level: int, threshold: float) -> DataFrame:
    """Children at ``level`` of the nodes of large buckets."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sketches = as_matrix(batch.column(2), COORDINATES, "<u4")
            path = batch.column(0).to_numpy().view(np.uint64)
            owner, path = children(np.arange(batch.num_rows), path, sketches, sampling(level, threshold))
            yield pa.RecordBatch.from_arrays(
                [pa.array(path.view(np.int64)), batch.column(1).take(pa.array(owner))], names=["node", "set"])

    return heavy.join(classes, "set").select("node", "set", "sketch").mapInArrow(run, "node long, set binary")


def in_buckets(small: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """(a, b): members of a bucket and the smallest member their sketches connect them to, by brute force in each bucket."""
    def compare(tables):
        node = np.concatenate([t.column(0).to_numpy() for t in tables])
        keys = pa.concat_arrays([c for t in tables for c in t.column(1).chunks])
        low = as_matrix(pa.chunked_array([c for t in tables for c in t.column(2).chunks]), COORDINATES, np.uint8)
        start = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        sizes = np.diff(np.append(start, node.size))
        # the i-th row of a bucket pairs with the rows behind it
        behind = np.repeat(start + sizes, sizes) - np.arange(node.size) - 1
        a_all = np.repeat(np.arange(node.size), behind)
        b_all = a_all + 1 + np.arange(a_all.size) - np.repeat(np.cumsum(behind) - behind, behind)
        hits = [np.flatnonzero((low[a_all[i:i + 65536]] == low[b_all[i:i + 65536]]).sum(axis=1) >= least) + i
                for i in range(0, a_all.size, 65536)]
        hit = np.concatenate(hits) if hits else np.zeros(0, np.int64)
        label = connected(node.size, a_all[hit], b_all[hit])
        member = np.flatnonzero(label != np.arange(node.size))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(label[member])), keys.take(pa.array(member))], names=["a", "b"])

    def run(batches):
        held, pairs = [], 0
        for t in groups(batches, 1):
            held.append(t)
            pairs += t.num_rows * t.num_rows
            if pairs > 400_000:
                yield compare(held)
                held, pairs = [], 0
        if held:
            yield compare(held)

    def low_bytes(batches):  # eight bits of each coordinate are enough to compare
        for batch in batches:
            if batch.num_rows:
                low = np.ascontiguousarray(as_matrix(batch.column(1), COORDINATES, "<u4").astype(np.uint8))
                flat = low.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([flat[i:i + COORDINATES] for i in range(0, len(flat), COORDINATES)], pa.binary())],
                    names=["set", "low"])

    brief = classes.select("set", "sketch").mapInArrow(low_bytes, "set binary, low binary")
    rows = small.join(brief, "set").select("node", "set", "low")
    return rows.repartition("node").sortWithinPartitions("node", "set").mapInArrow(run, "a binary, b binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node each node of the edges (a, b) is connected to.

    Labels take the minimum over neighbours and then jump to their own label's label, so a chain shrinks by half each round.
    """
    both = cut(edges.union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("_near"))
        lower = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        target = labels.select(F.col("node").alias("_at"), F.col("label").alias("_next"))
        new = cut(lower.join(target, lower["label"] == target["_at"], "left").select(
            "node", F.least("label", F.coalesce("_next", "label")).alias("label"), "_old"))
        done = new.where(F.col("label") != F.col("_old")).isEmpty()
        labels = new.select("node", "label")
        if done:
            return labels


def loose_clusters(classes: DataFrame, threshold: float, recall: float, node_limit: int) -> DataFrame:
    """(node, label): classes that the candidates of all runs connect.

    A pair is missed only if it does not meet at FIRST_DEPTH in the first runs, or if both sets were in large buckets there and
    it does not meet at DEEPEST in all runs; each of the two may use up half of the allowed misses.
    """
    half = (1 + recall) / 2
    least = least_equal(half, threshold)
    edges = []
    begin, who = 0, classes
    for runs in (runs_for(half, FIRST_DEPTH, threshold), runs_for(half, DEEPEST, threshold)):
        rows, large = first_nodes(who, begin, runs, threshold), None
        for depth in range(FIRST_DEPTH, DEEPEST + 1):
            counts = rows.groupBy("node").count().where("count > 1")
            met = cut(rows.join(counts, "node").select("node", "set", (F.col("count") > node_limit).alias("heavy")))
            edges.append(in_buckets(met.where(~F.col("heavy")).select("node", "set"), classes, least))
            heavy = met.where("heavy").select("node", "set")
            if heavy.isEmpty():
                break
            if depth == FIRST_DEPTH:
                large = heavy.select("set").distinct()
            if depth == DEEPEST:
                # so many shared tokens: mostly near sets; all of a bucket are one loose cluster, verified like the others
                lowest = heavy.groupBy("node").agg(F.min("set").alias("a"))
                edges.append(heavy.join(lowest, "node").where(F.col("a") != F.col("set")).select("a", F.col("set").alias("b")))
            else:
                rows = split_nodes(heavy, classes, depth + 1, threshold)
        if large is None:
            break
        begin, who = runs, cut(classes.join(large, "set", "left_semi"))
    union = edges[0]
    for e in edges[1:]:
        union = union.union(e)
    return components(cut(union.distinct()))


def verify(sets: list[np.ndarray], side: np.ndarray | None, weight: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member within one block pair, and the smallest member it is linked to, directly or not.

    Members of one block (``side`` None) are compared with each other, else those of side 0 with those of side 1.
    """
    n = np.array([s.size for s in sets], np.int64)
    m = n.size
    # J >= p / q  <=>  (p + q) * common >= p * (n1 + n2)
    p, q = threshold.numerator, threshold.denominator
    a, b = np.triu_indices(m, 1)
    if side is not None:
        across = side[a] != side[b]
        a, b = a[across], b[across]
    fits = q * np.minimum(n[a], n[b]) >= p * np.maximum(n[a], n[b])
    a, b = a[fits], b[fits]
    if not a.size:
        return np.zeros(m, np.int64), np.arange(m)
    if a.size <= 64:
        common = np.array([np.intersect1d(sets[i], sets[j], assume_unique=True).size for i, j in zip(a.tolist(), b.tolist(), strict=True)])
    else:
        owner = np.repeat(np.arange(m), n)
        _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1
        number = np.cumsum(shared) - 1
        keep = shared[token]
        owner, token = owner[keep], number[token[keep]]
        order = np.argsort(token, kind="stable")
        owner, token = owner[order], token[order]
        total = np.zeros((m, m), np.float64)
        for t in range(0, int(shared.sum()), 4096):
            x, y = np.searchsorted(token, (t, t + 4096))
            dense = np.zeros((m, 4096), np.float32)
            dense[owner[x:y], token[x:y] - t] = 1
            total += dense @ dense.T
        common = total[a, b].round().astype(np.int64)
    linked = (p + q) * common >= p * (n[a] + n[b])
    a, b = a[linked], b[linked]
    links = np.bincount(a, weight[b], m) + np.bincount(b, weight[a], m)
    return links.astype(np.int64), connected(m, a, b)


def links_in_clusters(docs: DataFrame, classes: DataFrame, clusters: DataFrame, id_col: str, text: str, threshold: Fraction,
                      block: int) -> DataFrame:
    """(set, links, root) of classes with links, one row for each block pair in which they have any."""
    sizes = clusters.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    members = clusters.join(sizes, "label").join(classes.select(F.col("set").alias("node"), "rep", "copies"), "node").select(
        F.col("node").alias("set"), F.xxhash64("label").alias("cluster"), "blocks", "copies",
        F.pmod(F.xxhash64("node", "label"), F.col("blocks")).cast("int").alias("block"), F.col("rep.id").alias("id"), F.col("rep._row").alias("_row"))
    source = docs.select(F.col(id_col).alias("id"), row_key(id_col, text), F.col(text).alias("_text"))
    rows = source.join(members, same(source, members, "id", "_row")).select(
        "cluster", "block", "blocks", "copies", "set", "_text")

    def make():
        words = Words(SHINGLE, 1)
        return lambda texts: ((shingles(words, t).tobytes(),) for t in texts)

    sets = map_rows(rows, ["cluster", "block", "blocks", "copies", "set"], "_text", make,
                    T.StructType([T.StructField("hashes", T.BinaryType())]))
    dealt = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "copies", "set", "hashes")

    def run(batches):
        for t in groups(batches, 3):
            keys, at = np.unique(np.array(t.column("set").to_pylist(), dtype=object), return_index=True)
            if keys.size < 2:
                continue
            t = t.take(pa.array(at))
            hashes = [np.frombuffer(h, np.uint64) for h in t.column("hashes").to_pylist()]
            side = None if t.column("low")[0].equals(t.column("high")[0]) else t.column("side").to_numpy()
            links, root = verify(hashes, side, t.column("copies").to_numpy(), threshold)
            hit = np.flatnonzero(links)
            if hit.size:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[hit].tolist(), pa.binary()), pa.array(links[hit]), pa.array(keys[root[hit]].tolist(), pa.binary())],
                    names=["set", "links", "root"])

    return dealt.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high").mapInArrow(
        run, "set binary, links long, root binary")


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: Fraction = Fraction(4, 5),
         recall: float = 1 - 1e-6, node_limit: int = NODE_LIMIT, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, _row, class_id, n_links, n_copies, n_shingles, first.

    ``class_id`` is the smallest id of the documents connected by links of Jaccard similarity ``threshold`` or more, ``n_links``
    the number of other documents a document is linked to (copies included), ``n_copies`` the number of documents with its
    set, and ``first`` holds for one row key of each class.
    """
    need(docs, id_col, text)
    rows = cut(sketched(docs, id_col, text))
    classes = cut(rows.where("n > 0").groupBy("set").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_row")).alias("rep"), F.count("*").alias("copies"), F.first("sketch").alias("sketch")))
    clusters = loose_clusters(classes, float(threshold), recall, node_limit)
    links = cut(links_in_clusters(docs, classes, clusters, id_col, text, threshold, block))
    label = components(links.where(F.col("set") != F.col("root")).select(F.col("root").alias("a"), F.col("set").alias("b")))
    counted = links.groupBy("set").agg(F.sum("links").alias("links"))
    linked = label.join(classes.select(F.col("set").alias("node"), "rep", "copies"), "node")
    best = linked.groupBy("label").agg(F.min("rep").alias("best"))
    named = linked.join(best, "label").select(F.col("node").alias("set"), "best")
    # classes without a link to another set stand for themselves
    per_class = classes.select("set", "rep", "copies").join(named, "set", "left").join(counted, "set", "left").select(
        "set", "copies", F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("best", "rep").alias("best"))
    alone = F.struct(F.col("id").isNull().alias("none"), "id", "_row")
    out = rows.select("id", "_row", "n", "set").join(per_class, "set", "left").select(
        F.col("id"), "_row", F.col("n").alias("n_shingles"), F.coalesce("copies", F.lit(1)).alias("n_copies"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        F.coalesce("best", alone).alias("_best"))
    return out.select(
        F.col("id").alias(id_col), "_row", F.col("_best.id").alias("class_id"), "n_links", "n_copies", "n_shingles",
        (F.col("_best.id").eqNullSafe(F.col("id")) & (F.col("_best._row") == F.col("_row"))).alias("first"))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class, that of the smallest id; of repeated rows one stays."""
    kept = join(docs, id_col, text, **options).where("first").select(F.col(id_col).alias("_id"), "_row").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(id_col).alias("_id"), row_key(id_col, text))
    left = rows.join(kept, same(rows, kept, "_id", "_row"), "left_semi")
    return left.dropDuplicates(["_id", "_row"]).select("_doc.*")
