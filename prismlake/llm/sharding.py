"""Hierarchical weighted hash tree: region, rack and shard are chosen one after the other,
each by the smallest weighted hash draw among a node's children.

A child's draw is ``-ln(u) / weight`` with ``u`` a hash of the key and the
child's name, so a child wins in proportion to its weight and a changed weight
moves keys only between that child and its siblings.  A new shard therefore
joins as a region of its own: no existing subtree's weight changes, and rows
move only into the new shard (law ``key``).

Defined results for odd input: a null key is hashed as the empty string, so all
such rows share a shard; a null text counts as empty.  Repeated rows share a
shard and get different slots.  Extra columns stay; columns named like the
results are replaced.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree; a rack's or region's weight is the sum of its leaves'."""

    shard: int
    region: str
    rack: str
    weight: float = 1.0


def topology(n_shards: int, base: int = 40, regions: int = 4, racks: int = 5) -> tuple[Shard, ...]:
    """``base`` shards dealt over regions and racks; every later shard is a region of its own."""
    per_region, per_rack = -(-base // regions), -(-base // (regions * racks))
    return tuple(
        Shard(i, f"region{i // per_region}", f"rack{i % per_region // per_rack}") if i < base else Shard(i, f"grown{i}", "rack0")
        for i in range(n_shards)
    )


def _draw(key: Column, name: Column, weight: Column) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(key, name), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(unit) / weight


def _children(nodes: list[tuple[str, float, int]]) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"), F.lit(i).alias("i")) for name, weight, i in nodes])


def _choose(key: Column, children: Column) -> Column:
    """Number of the child with the smallest draw; equal draws go to the smaller number."""
    return F.array_min(F.transform(children, lambda c: F.struct(_draw(key, c["name"], c["weight"]).alias("d"), c["i"].alias("i"))))["i"]


def shard_of(key: Column, shards: tuple[Shard, ...]) -> Column:
    """The shard of a string key under a topology: a draw among regions, then among the
    chosen region's racks, then among the chosen rack's shards."""
    live = sorted((s for s in shards if s.weight > 0), key=lambda s: (s.region, s.rack, s.shard))
    regions, racks, leaves = [], [], []
    for region, in_region in groupby(live, key=lambda s: s.region):
        members = list(in_region)
        regions.append((region, sum(s.weight for s in members), len(regions)))
        racks.append([])
        for rack, in_rack in groupby(members, key=lambda s: s.rack):
            own = list(in_rack)
            racks[-1].append((f"{region}/{rack}", sum(s.weight for s in own), len(leaves)))
            leaves.append([(f"{region}/{rack}/{s.shard}", s.weight, s.shard) for s in own])
    rack = _choose(key, F.get(F.array(*[_children(x) for x in racks]), _choose(key, _children(regions))))
    return _choose(key, F.get(F.array(*[_children(x) for x in leaves]), rack))


def number_slots(df: DataFrame, shard: str, key: str, buckets: int = 1024, slot: str = "slot") -> DataFrame:
    """Numbers the rows of every shard from 0 without a gap.

    A shard is cut into ``buckets`` hash buckets; their sizes give each bucket's
    first number, so no task sorts a whole shard.  The table of sizes has at
    most shards x buckets rows, which bounds the broadcast.
    """
    rest = sorted(c for c in df.columns if c not in (shard, key))
    cut = df.withColumn("__b", F.pmod(F.xxhash64(F.col(key), *[F.col(c) for c in rest]), F.lit(buckets)).cast("int"))
    sizes = cut.groupBy(shard, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(shard).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(shard, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy(shard, "__b").orderBy(key, *rest)
    numbered = cut.withColumn("__i", F.row_number().over(inside))
    return numbered.join(F.broadcast(first), [shard, "__b"]).withColumn(slot, (F.col("__first") + F.col("__i") - 1).cast("long")).drop("__b", "__first", "__i")


def assign(df: DataFrame, key: str, shards: tuple[Shard, ...], grown: tuple[Shard, ...] | None = None) -> DataFrame:
    """Adds ``shard`` and, for a grown topology, ``grown_shard``; a map stage without a shuffle."""
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    out = df.withColumn("shard", shard_of(k, shards).cast("int"))
    return out.withColumn("grown_shard", shard_of(k, grown).cast("int") if grown else F.lit(None).cast("int"))


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"))
    placed = assign(rows, "doc_id", topology(40), topology(41)).withColumn("law", F.lit("key"))
    return number_slots(placed, "shard", "doc_id").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
