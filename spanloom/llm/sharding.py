"""Sharding by a hierarchical weighted hash tree.

Regions hold racks, racks hold shards. A row descends the tree: at each node
every child draws ``-ln(u) / weight`` with ``u`` a uniform hash of the row's key
and the child's path, and the smallest draw wins. A child's draw depends on
nothing but the key, its own path and its own weight, so a changed weight moves
rows only into or out of the subtree whose weight changed, and a new child takes
rows only into itself. ``grow`` therefore adds a shard as a region of its own:
then the law ``key`` holds exactly (doc_id and shard count decide; one more
shard takes rows only into itself).

Numbering inside a shard is gapless and follows (key, checksum, size); it is
made by a range sort whose partitions are counted and offset, never by a window
over a whole shard, and a unique row number breaks ties so that repeated rows
can be split over partitions too.

Edge cases: a null key draws as the empty string; a null text has size 1 and the
checksum of the empty string; repeated rows get one slot each; an empty table
gives an empty result; columns other than the key and the text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

_ROW_BITS = 33  # monotonically_increasing_id: the partition is above, the row below


@dataclass(frozen=True)
class Node:
    """A region, rack or (without children) a shard. An inner node weighs what its children weigh."""

    name: str
    children: tuple["Node", ...] = ()
    own_weight: float = 1.0
    shard: int = -1

    @property
    def weight(self) -> float:
        return sum(child.weight for child in self.children) if self.children else self.own_weight


def uniform_tree(regions: int, racks: int, shards: int) -> Node:
    """A tree of regions x racks x shards, numbered from 0, all of weight 1."""
    number = iter(range(regions * racks * shards))
    return Node("root", tuple(
        Node(f"g{g}", tuple(
            Node(f"r{r}", tuple(Node(f"s{s}", shard=next(number)) for s in range(shards)))
            for r in range(racks)))
        for g in range(regions)))


def shard_count(tree: Node) -> int:
    return sum(map(shard_count, tree.children)) if tree.children else 1


def grow(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, which is a new region."""
    new = Node("s0", own_weight=weight, shard=shard_count(tree))
    region = Node(f"g{len(tree.children)}", (Node("r0", (new,)),))
    return Node(tree.name, (*tree.children, region), tree.own_weight)


def _draw(key: Column, path: str, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f"/{path}")).cast("binary")), 1, 12)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**48)
    return -F.log(uniform) / F.lit(float(weight))


def _descend(key: Column, node: Node, path: str) -> Column:
    if not node.children:
        return F.lit(node.shard)
    live = [(i, child) for i, child in enumerate(node.children) if child.weight > 0]
    if len(live) == 1:
        return _descend(key, live[0][1], f"{path}.{live[0][1].name}")
    won = F.array_min(F.array(*(
        F.struct(_draw(key, f"{path}.{child.name}", child.weight).alias("draw"), F.lit(i).alias("child"))
        for i, child in live)))["child"]
    # the winner is a value of its own, so that each level's draws are made once
    return F.transform(F.array(won), lambda child: F.element_at(
        F.array(*(F.when(child == i, _descend(key, node.children[i], f"{path}.{node.children[i].name}")) for i, _ in live)),
        F.array_position(F.array(*(F.lit(i) for i, _ in live)), child).cast("int")))[0]


def place(key: Column, tree: Node) -> Column:
    """The shard of a key."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return _descend(text, tree, tree.name).cast("int")


def assign_shards(docs: DataFrame, tree: Node, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        place(F.col(id_col), tree).alias("shard"),
        place(F.col(id_col), grow(tree)).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row_number"),
    )
    rows = materialise(rows, "shard-rows")
    order = ["shard", "doc_id", "text_crc32", "size", "row_number"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = materialise(ranged.drop("row_number"), "shard-order")
    ranged = ranged.select("*", F.shiftright("at", _ROW_BITS).alias("part"), F.col("at").bitwiseAND((1 << _ROW_BITS) - 1).alias("pos"))
    held = ranged.groupBy("shard", "part").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("shard", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_pos")).alias("shift"))
    return ranged.join(held, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("pos") + F.col("shift")).alias("slot"), "grown_shard")
