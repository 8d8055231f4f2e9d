"""Sharding by a hierarchical weighted hash tree, in DataFrame functions alone.

The tree has regions, their racks and the racks' shards. A key descends it: on each level every child draws -ln(u) / weight with
u hashed from the key and the child's name, and the least draw wins, so a child wins in proportion to its weight. A changed
weight changes that child's own draws and no other: a heavier child only takes keys in and a lighter one only gives keys
away, and keys elsewhere stay where they are.

A row's place follows from its key and the tree only (the law `key`). Shards beyond the first `base` each open a region of
their own, so one more shard is one more child of the root and takes rows into itself alone.

Defined cases: a null text has no bytes; a null key hashes like any other value; equal keys share a shard; rows that are equal
in every respect get different slots; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from readloom.llm.common import free_name

SHARDS, RACKS_PER_REGION, SHARDS_PER_RACK = 40, 2, 4
#: Slots are counted inside this many buckets of each shard.
BUCKETS = 1024
#: A table of up to so many rows is sent to all executors.
MOST_SENT = 1 << 20


@dataclass(frozen=True)
class Node:
    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int | None = None


def leaf(shard: int, weight: float = 1.0) -> Node:
    return Node(f"shard-{shard}", weight, (), shard)


def parent(name: str, children: list[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), tuple(children))


def topology(shards: int, base: int = SHARDS, racks: int = RACKS_PER_REGION, per_rack: int = SHARDS_PER_RACK) -> Node:
    """Shards 0..base - 1 in regions of `racks` racks of `per_rack` shards; each further shard is a region of its own."""
    rack_list = [parent(f"rack-{i // per_rack}", [leaf(s) for s in range(i, min(i + per_rack, base, shards))]) for i in range(0, min(base, shards), per_rack)]
    regions = [parent(f"region-{i // racks}", rack_list[i : i + racks]) for i in range(0, len(rack_list), racks)]
    regions += [parent(f"region-own-{s}", [parent(f"rack-own-{s}", [leaf(s)])]) for s in range(base, shards)]
    return parent("root", regions)


def draw(key: Column, child: Column) -> Column:
    """An exponential variate with the child's weight as its rate, the same for the same key and name everywhere."""
    bits = F.shiftrightunsigned(F.xxhash64(child["name"], key), 11)
    return -F.log((bits.cast("double") + 0.5) / float(2**53)) / child["weight"]


def _choices(nodes: list[Node], numbers: list[int]) -> Column:
    """The children of a node that can win, each with the number it has on its level."""
    return F.array(*[F.struct(F.lit(n.name).alias("name"), F.lit(float(n.weight)).alias("weight"), F.lit(i).alias("number")) for i, n in zip(numbers, nodes) if n.weight > 0])


def descend(key: Column, tree: Node) -> Column:
    """The shard that the key reaches. On each level the children of the node reached so far draw, and only they."""
    level, at = [tree], F.lit(0)
    while level[0].shard is None:
        below = [c for node in level for c in node.children]
        numbers = iter(range(len(below)))
        choices = F.array(*[_choices(list(node.children), [next(numbers) for _ in node.children]) for node in level])
        drawn = F.transform(F.get(choices, at), lambda c: F.struct(draw(key, c).alias("d"), c["number"].alias("number")))
        level, at = below, F.array_min(drawn)["number"]
    return F.get(F.array(*[F.lit(node.shard) for node in level]), at)


def slots(df: DataFrame, shard: str, order: list[str], shards: int, buckets: int = BUCKETS) -> DataFrame:
    """df with `slot`: gapless from 0 in each of the `shards` shards. Rows are numbered in buckets, which then move up by the counts before."""
    bucket, n, base, local = (free_name(df, c) for c in ("bucket", "n", "base", "local"))
    cut = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = cut.groupBy(shard, bucket).agg(F.count("*").alias(n))
    before = W.Window.partitionBy(shard).orderBy(bucket).rowsBetween(W.Window.unboundedPreceding, -1)
    bases = counts.select(shard, bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))  # `buckets` rows for each shard
    bases = F.broadcast(bases) if shards * buckets <= MOST_SENT else bases
    numbered = cut.withColumn(local, F.row_number().over(W.Window.partitionBy(shard, bucket).orderBy(*order)) - 1).join(bases, [shard, bucket])
    return numbered.select("*", (F.col(base) + F.col(local)).cast("long").alias("slot")).drop(bucket, local, base)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = F.col("doc_id")
    placed = rows.withColumn("shard", descend(key, topology(shards))).withColumn("grown_shard", descend(key, topology(shards + 1, base=shards)))
    out = slots(placed, "shard", ["doc_id", "text_crc32", "size"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
