"""Merkle manifest of a dataset: leaves, subtree roots, one root, and for every row the siblings that lead to it.

Levels are concatenated strings. The leaves of a group are numbered in order, and every aligned block of ``arity ** depth`` leaves
keeps each of its levels as one string of hexadecimal digests. A parent is the hash of a fixed-width piece of that string; the
siblings of a node are the pieces that flank it within its run. The roots of the blocks are the leaves of the same procedure, until
every group has one root; then the group roots, in order, are the leaves of the last tree. Everything is built-in SQL functions.

Only digests are ordered and grouped, never texts. The order comes from range slices, so a group that holds all rows spreads over
all tasks, and a block is the most that one task holds at once, whatever the size of the group.

Nulls: a null field is hashed as ``-``, a null group is a group of its own (first), null ids come first. Rows that repeat an id are
ordered by their digest; equal rows are leaves of their own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgrid.llm.common import need
from shiftgrid.operators.ordered import attach, numbered
from shiftgrid.session import cut

ARITY = 8
DEPTH = 4  # levels inside a block: 8 ** 4 leaves, 256 KB of hexadecimal digits
HEX = 64  # characters of a digest


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256)


def field(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; null is ``-``."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def _piece(level: Column, start: Column, end: Column) -> Column:
    """Digests ``start`` (0-based) to ``end`` (exclusive) of a level."""
    return F.substring(level, start * HEX + 1, F.greatest(end - start, F.lit(0)) * HEX)


def _blocks(nodes: DataFrame, by: list[str], arity: int, depth: int) -> DataFrame:
    """One row per block: ``by``, block, n (nodes of its group), items (rows in order), l0 .. l<depth> (its levels; l<depth> holds one
    digest). A level above the root of the group repeats the root."""
    size = arity ** depth
    extra = [c for c in nodes.columns if c not in (*by, "at", "n")]
    packed = nodes.select(*by, F.floor(F.col("at") / size).alias("block"), "n", F.struct("at", *extra).alias("item"))
    blocks = packed.groupBy(*by, "block").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("item")).alias("items"))
    # as bytes, pieces are cut by offset; as characters they would have to be counted from the start
    blocks = blocks.withColumn("l0", F.array_join(F.transform("items", lambda x: x["hash"]), "").cast("binary"))
    left = F.col("n")  # nodes of the whole group at the level below
    for k in range(1, depth + 1):
        below = F.col(f"l{k - 1}")
        count = F.octet_length(below) / HEX
        runs = F.sequence(F.lit(0), F.ceil(count / arity).cast("int") - 1)
        parents = F.array_join(F.transform(runs, lambda r: F.sha2(F.substring(below, r * arity * HEX + 1, F.lit(arity * HEX)), 256)), "")
        blocks = blocks.withColumn(f"l{k}", F.when(left > 1, parents.cast("binary")).otherwise(below))
        left = F.ceil(left / arity)
    return blocks


def _own_path(own: Column, n: Column, arity: int, depth: int) -> Column:
    """Siblings (left, right) of the node at place ``own`` of its block, from its level up to the top of the block."""
    steps, place, left = [], own, n
    for k in range(depth):
        level = F.col(f"l{k}")
        first = F.floor(place / arity).cast("int") * arity
        last = F.least(first + arity, (F.octet_length(level) / HEX).cast("int"))
        flank = F.struct(_piece(level, first, place).alias("left"), _piece(level, place + 1, last).alias("right"))
        steps.append(F.when(left > 1, flank))
        place, left = F.floor(place / arity).cast("int"), F.ceil(left / arity)
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def tree(nodes: DataFrame, by: list[str], largest: int, arity: int = ARITY, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """``nodes``: by, at (0-based place in its group), n (size of its group), hash, and further columns.

    Returns them with path (array of (left, right) sibling strings up to the group's root) and root; and the roots by themselves.
    ``largest`` is the size of the largest group; it says how often the roots of blocks are blocked again.
    """
    size = arity ** depth
    blocks = cut(_blocks(nodes, by, arity, depth))
    top = F.col(f"l{depth}").cast("string")
    if largest > size:
        tops = blocks.select(*by, F.col("block").alias("at"), F.ceil(F.col("n") / size).alias("n"), top.alias("hash"))
        upper, roots = tree(tops, by, -(-largest // size), arity, depth)
        above = upper.select(*by, F.col("at").alias("block"), F.col("path").alias("above"), "root")
        blocks = attach(blocks, above, [*by, "block"])
    else:
        roots = blocks.select(*by, top.alias("root"))
        blocks = blocks.select("*", F.array().cast("array<struct<left:binary,right:binary>>").alias("above"), top.alias("root"))
    keep = [c for c in nodes.columns if c not in (*by, "n")]
    opened = F.transform("items", lambda x, i: F.struct(*[x[c].alias(c) for c in keep], _own_path(i, F.col("n"), arity, depth).alias("path")))
    rows = blocks.select(*by, "n", "above", "root", F.inline(opened))
    return rows.select(*by, "n", *keep, F.concat("path", "above").alias("path"), "root"), roots


def siblings(path: Column) -> Column:
    """All sibling digests of a path, level by level, left to right, as one string of bytes."""
    return F.aggregate(path, F.lit("").cast("binary"), lambda text, s: F.concat(text, s["left"], s["right"]))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node.cast("binary"), s["right"]), 256))


def manifest(
    docs: DataFrame, by: str, order: str, leaf: Column, carry: dict[str, Column] | None = None, arity: int = ARITY, depth: int = DEPTH
) -> DataFrame:
    """One row per row of ``docs``: by, order, leaf, the columns ``carry``, subroot, root and path.

    Leaves of a group ascend by ``order``; group roots ascend by ``by``. ``path`` holds the siblings of each level up to the root.
    ``carry`` are further digests of the row (say, of a changed copy) that are to be held against its path.
    """
    need(docs, by, order)
    carry = carry or {}
    rows = cut(docs.select(
        F.col(by).alias("_by"), F.col(order).alias("_order"), F.unhex(leaf).alias("_leaf"),
        *[F.unhex(c).alias(name) for name, c in carry.items()], F.monotonically_increasing_id().alias("_line")))
    sizes = cut(rows.groupBy("_by").agg(F.count(F.lit(1)).alias("n")))
    groups, largest = sizes.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    # the last key parts equal rows, so that no slice holds all of them
    placed = attach(numbered(rows, ["_by"], ["_order", "_leaf", "_line"], "_at"), sizes, ["_by"])
    text = {"hash": F.lower(F.hex("_leaf"))} | {name: F.lower(F.hex(name)) for name in carry}
    nodes = placed.select("_by", (F.col("_at") - 1).alias("at"), "n", "_order", *[c.alias(name) for name, c in text.items()])
    leaves, roots = tree(nodes, ["_by"], largest, arity, depth)
    tops = numbered(roots.withColumnRenamed("root", "hash"), [], ["_by"], "_at")
    whole, _ = tree(tops.select("_by", (F.col("_at") - 1).alias("at"), F.lit(groups).alias("n"), "hash"), [], groups, arity, depth)
    above = cut(whole.select("_by", F.col("path").alias("above"), "root"))
    joined = attach(leaves.withColumnRenamed("root", "subroot"), above, ["_by"])
    return joined.select(
        F.col("_by").alias(by), F.col("_order").alias(order), F.col("hash").alias("leaf"), *carry, "subroot", "root",
        F.concat("path", "above").alias("path"))
