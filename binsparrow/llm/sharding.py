"""Hierarchical weighted hash tree: region, rack and shard chosen level by level with weighted hash draws.

At each level every child draws -ln(u) / weight, u being a hash of the row's key and the child's name in (0, 1); the
least draw wins, so a child gets rows in proportion to its weight. A changed weight changes one child's draws only:
rows move into or out of the subtree whose weight changed and nowhere else. A shard that comes with a region of its
own takes rows only into itself. Everything is Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]


#: Shards that share regions and racks; each beyond them has a region of its own.
BASE_SHARDS = 8


def even_tree(shards: int, per_rack: int = 2, racks: int = 2) -> Tree:
    """The tree of a shard count, however the count was reached: even_tree(n + 1) is grown_tree(even_tree(n)) from BASE_SHARDS on.

    Fewer than BASE_SHARDS shards have a region each, so that growth moves rows only into the new shard there as well.
    """
    tree: Tree = {}
    for s in range(shards):
        if shards < BASE_SHARDS or s >= BASE_SHARDS:
            tree = grown_tree(tree)
        else:
            region, rack = s // (per_rack * racks), s // per_rack % racks
            tree.setdefault(f"region{region}", {}).setdefault(f"region{region}/rack{rack}", {})[s] = 1.0
    return tree


def grown_tree(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own, so that no other subtree's weight changes."""
    new = 1 + max((s for racks in tree.values() for shards in racks.values() for s in shards), default=-1)
    return tree | {f"region-of-{new}": {f"region-of-{new}/rack0": {new: weight}}}


def _draw(key: Column, name: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 53))) / F.lit(weight)


def _least(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the least draw; the first of equal draws."""
    if len(children) == 1:
        return children[0][2]
    draws = [F.struct(_draw(key, name, w).alias("d"), F.lit(i).alias("i")) for i, (name, w, _) in enumerate(children)]
    winner = F.array_min(F.array(*draws))["i"]
    out = F.when(winner == 0, children[0][2])
    for i, (_, _, value) in enumerate(children[1:], 1):
        out = out.when(winner == i, value)
    return out


def tree_shard(key: Column, tree: Tree) -> Column:
    """The shard of a key: only subtrees with a positive weight are entered."""

    def total(node: dict | float) -> float:
        return sum(map(total, node.values())) if isinstance(node, dict) else node

    def descend(node: dict | float, name: object) -> Column:
        if not isinstance(node, dict):
            return F.lit(name)
        return _least(key, [(str(n), total(c), descend(c, n)) for n, c in node.items() if total(c) > 0])

    return descend(tree, "")


def shard_documents(docs: DataFrame, tree: Tree, grown: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Size is the text's UTF-8 bytes plus 1; a null text has no bytes (crc32 0). A null doc_id is a key like any other.
    Repeated rows each get a slot. Slots count from 0 without gaps inside a shard: rows are numbered inside (shard,
    input partition), and each such run begins where the runs before it end, so that no task sorts a whole shard.
    An empty table gives no rows; other columns are ignored.
    """
    key = F.col("doc_id").cast("long")
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        tree_shard(key, tree).cast("int").alias("shard"),
        tree_shard(key, grown or grown_tree(tree)).cast("int").alias("grown_shard"),
        F.spark_partition_id().alias("run"),
    )
    rows = materialize(rows, "sharding")
    counts = rows.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")) - 1
    slots = rows.withColumn("inside", inside).join(bases, ["shard", "run"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("inside")).cast("long").alias("slot"), "grown_shard")
