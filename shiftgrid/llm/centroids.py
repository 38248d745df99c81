"""Exact k-means over whole-number vectors, sharded by dimension.

Vectors are packed into chunks, and the matrix of a chunk is cut into column blocks: one row per (chunk, block). These rows lie in a
bucketed table, spread by chunk and block, so that every task holds slices of columns rather than whole vectors. A round is:

1. tasks of column blocks compute exact partial squared distances to their slice of the centroids;
2. the partial distances of a chunk are added over its blocks, and the nearest centroid is taken (ties: the smaller number);
3. the labels of a chunk go back to its blocks (the blocks do not move: they are bucketed by the join key), where each block sums its
   own columns by label; the sums are added per block, and each block's slice of the centroids is replaced by the floor of the mean.

Only k x dim numbers per round pass the driver. Chunks bound what a task holds at once; no vector, cluster or label list is gathered.

Vectors that are null, hold a null or a non-finite component, or have another length are left out. Repeated ids and repeated rows are
vectors of their own. A null id starts no centroid unless too few other vectors are there. With fewer vectors than k, there are as
many centroids as vectors; without any, the result is empty. Arithmetic is in 64 bits: a scaled component of more than 2^27 in
magnitude, whose squared distance might not fit, raises an error instead of giving a wrong one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftgrid.llm.common import groups, need
from shiftgrid.session import cut, scratch_folder

CHUNK = 2_048  # vectors of one chunk
WIDTH = 32  # columns of one block
LARGEST = 1 << 27


def usable(vector: str, dim: int):
    """Rows whose vector has ``dim`` components, all of them finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) == dim) & F.coalesce(finite, F.lit(False))


def scaled(vector: str, scale: int):
    """Whole numbers floor(scale * x), each x as a double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def narrow(values: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold them all; the first byte says how many."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    size = next(s for s in (1, 2, 4, 8) if -(1 << 8 * s - 1) <= low and high < 1 << 8 * s - 1)
    return bytes([size]) + np.ascontiguousarray(values, f"<i{size}").tobytes()


def wide(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64).reshape(-1, columns)


@dataclass
class Shards:
    """Column blocks in a bucketed table, and the ids of each chunk."""

    cells: DataFrame  # chunk, block, cell (number of chunk and block), data
    ids: DataFrame  # chunk, ids
    dim: int
    width: int
    buckets: int

    @property
    def blocks(self) -> int:
        return -(-self.dim // self.width)

    def columns(self, block: int) -> slice:
        return slice(block * self.width, min(self.dim, (block + 1) * self.width))


def shard(vectors: DataFrame, id_col: str, dim: int, chunk: int = CHUNK, width: int = WIDTH) -> Shards:
    """``vectors``: id and ``whole`` (array of whole numbers). Packs, cuts into column blocks and writes both tables."""
    spark = vectors.sparkSession
    blocks = -(-dim // width)
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("cell", T.LongType()),
        T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, chunk):
                part = batch.slice(a, chunk)
                matrix = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                if matrix.size and max(-int(matrix.min()), int(matrix.max())) > LARGEST:
                    raise OverflowError(f"a scaled component exceeds {LARGEST}")
                ids = part.column(0).to_pylist()
                rows = {"chunk": [number] * blocks, "block": list(range(blocks)), "cell": [number * blocks + b for b in range(blocks)],
                        "ids": [ids] + [None] * (blocks - 1),
                        "data": [narrow(matrix[:, b * width:(b + 1) * width]) for b in range(blocks)]}
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([
                    ("chunk", pa.int64()), ("block", pa.int32()), ("cell", pa.int64()), ("ids", pa.list_(pa.int64())), ("data", pa.binary())]))
                number += 1

    packed = cut(vectors.select(F.col(id_col).cast("long").alias("id"), "whole").mapInArrow(pack, schema))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = "shards_" + uuid.uuid4().hex
    cells = packed.select("chunk", "block", "cell", "data").repartition(buckets, "cell")
    cells.write.bucketBy(buckets, "cell").option("path", f"{scratch_folder(spark)}/{name}").saveAsTable(name)
    return Shards(spark.table(name), packed.where("block = 0").select("chunk", "ids"), dim, width, buckets)


def distances(shards: Shards, centroids: np.ndarray) -> DataFrame:
    """chunk, block, part: partial squared distances of a column block to its slice of every centroid."""
    slices = [centroids[:, shards.columns(b)] for b in range(shards.blocks)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for block, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = slices[block]
                x = wide(data, own.shape[1])
                out = np.empty((len(x), len(own)), np.int64)
                for c, centre in enumerate(own):
                    d = x - centre
                    out[:, c] = np.einsum("ij,ij->i", d, d)
                parts.append(narrow(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.binary())], names=["chunk", "block", "part"])

    return shards.cells.select("chunk", "block", "data").mapInArrow(partial, "chunk long, block int, part binary")


def assigned(shards: Shards, centroids: np.ndarray) -> DataFrame:
    """chunk, labels, dist: the nearest centroid of every vector of a chunk, and its squared distance."""
    k = len(centroids)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, 1):
            total = sum(wide(p, k) for p in rows.column("part").to_pylist())
            labels = total.argmin(axis=1)
            best = total[np.arange(len(total)), labels]
            yield pa.RecordBatch.from_pydict(
                {"chunk": [rows.column("chunk")[0].as_py()], "labels": [narrow(labels)], "dist": [narrow(best)]},
                schema=pa.schema([("chunk", pa.int64()), ("labels", pa.binary()), ("dist", pa.binary())]))

    ordered = distances(shards, centroids).repartition(shards.buckets, "chunk").sortWithinPartitions("chunk", "block")
    return ordered.mapInArrow(nearest, "chunk long, labels binary, dist binary")


def updated(shards: Shards, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floors of exact means; a centroid without vectors stays."""
    k, n_blocks = len(centroids), shards.blocks
    labels = assigned(shards, centroids).select("chunk", "labels", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    labels = labels.select((F.col("chunk") * n_blocks + F.col("block")).alias("cell"), "labels")
    widths = [shards.columns(b).stop - shards.columns(b).start for b in range(n_blocks)]
    slices = [centroids[:, shards.columns(b)] for b in range(n_blocks)]
    schema = pa.schema([("block", pa.int32()), ("sums", pa.binary()), ("counts", pa.binary())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((k, w), np.int64) for w in widths]
        counts = [np.zeros(k, np.int64) for _ in widths]
        seen: set[int] = set()
        for batch in batches:
            for block, data, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                x, label = wide(data, widths[block]), wide(own, 1)[:, 0]
                hot = np.zeros((k, len(x)), np.int64)
                hot[label, np.arange(len(x))] = 1
                sums[block] += hot @ x
                counts[block] += hot.sum(axis=1)
                seen.add(block)
        found = sorted(seen)
        yield pa.RecordBatch.from_pydict(
            {"block": found, "sums": [narrow(sums[b]) for b in found], "counts": [narrow(counts[b]) for b in found]}, schema=schema)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, 1):
            block = rows.column("block")[0].as_py()
            total = sum(wide(s, widths[block]) for s in rows.column("sums").to_pylist())
            count = sum(wide(c, 1) for c in rows.column("counts").to_pylist())
            means = np.where(count > 0, total // np.maximum(count, 1), slices[block])
            yield pa.RecordBatch.from_pydict({"block": [block], "slice": [narrow(means)]}, schema=pa.schema([("block", pa.int32()), ("slice", pa.binary())]))

    met = shards.cells.select("block", "data", "cell").join(labels, "cell").select("block", "data", "labels")
    sums = met.mapInArrow(add, "block int, sums binary, counts binary")
    # one row per task and block
    each = sums.repartition(min(n_blocks, shards.buckets), "block").sortWithinPartitions("block").mapInArrow(replace, "block int, slice binary")
    out = centroids.copy()
    for block, data in each.collect():
        out[:, shards.columns(block)] = wide(bytes(data), widths[block])
    return out


def first_centroids(vectors: DataFrame, id_col: str, k: int, seed: int) -> np.ndarray:
    """The vectors of the k smallest hashes of ``<seed>:<id>``; equal ids by their vectors, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    rows = vectors.select(key.alias("key"), "whole").orderBy(F.col("key").asc_nulls_last(), "whole").limit(k).collect()
    return np.array([r["whole"] for r in rows], np.int64)


def cluster(
    embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dim: int = 64, k: int = 8, rounds: int = 10, seed: int = 3,
    scale: int = 1_024, chunk: int = CHUNK, width: int = WIDTH,
) -> tuple[DataFrame, DataFrame]:
    """Two tables: (id, cluster, distance), one row per usable vector; and (cluster, centroid, vectors, inertia), one per centroid."""
    need(embeddings, id_col, vector)
    spark = embeddings.sparkSession
    vectors = embeddings.where(usable(vector, dim)).select(F.col(id_col).alias("id"), scaled(vector, scale).alias("whole"))
    centroids = first_centroids(vectors, "id", k, seed)
    members_schema = "id long, cluster int, distance long"
    centre_schema = "cluster int, centroid array<long>"
    if not len(centroids):
        members = spark.createDataFrame([], members_schema)
        centres = spark.createDataFrame([], centre_schema)
    else:
        if max(-int(centroids.min()), int(centroids.max())) > LARGEST:
            raise OverflowError(f"a scaled component exceeds {LARGEST}")
        shards = shard(vectors, "id", dim, chunk, width)
        for _ in range(rounds):
            centroids = updated(shards, centroids)

        def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, labels, dist in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(wide(labels, 1)[:, 0], pa.int32()), pa.array(wide(dist, 1)[:, 0], pa.int64())],
                        names=["id", "cluster", "distance"])

        final = assigned(shards, centroids).join(shards.ids, "chunk").select("ids", "labels", "dist")
        members = cut(final.mapInArrow(opened, members_schema))
        centres = spark.createDataFrame([(i, [int(x) for x in c]) for i, c in enumerate(centroids)], centre_schema)
    sums = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("vectors"), F.sum("distance").alias("inertia"))
    figures = centres.join(sums, "cluster", "left").select("cluster", "centroid", F.coalesce("vectors", F.lit(0)).alias("vectors"), F.coalesce("inertia", F.lit(0)).alias("inertia"))
    return members.withColumnRenamed("id", id_col), figures
