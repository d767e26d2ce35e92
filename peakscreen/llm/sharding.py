"""Hierarchical weighted hash tree: place rows on region, rack and shard.

A row descends the tree. At each node every child gets a draw ``-ln(u) / weight``
with ``u`` hashed from the row's key, the path and the child's name, and the
smallest draw wins: a child is chosen with probability weight / sum of weights.
A draw depends on no other child, so changing one child's weight moves rows only
into it (growing) or out of it (shrinking); below children whose weight is
unchanged nothing moves.

Defined cases: a null key is placed as one key of its own; equal keys go to the
same shard; an empty table gives an empty table; a child of weight 0 gets nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakscreen.llm.common import staged, unit_draw

#: Rows emitted from one counter row at a time when equal rows get their slots.
SLOT_CHUNK = 10_000


@dataclass(frozen=True)
class Rack:
    name: str
    shards: tuple[tuple[int, float], ...]       # (shard number, weight)

    @property
    def weight(self) -> float:
        return sum(w for _, w in self.shards)


@dataclass(frozen=True)
class Region:
    name: str
    racks: tuple[Rack, ...]

    @property
    def weight(self) -> float:
        return sum(r.weight for r in self.racks)


@dataclass(frozen=True)
class HashTree:
    regions: tuple[Region, ...]

    @staticmethod
    def uniform(regions: int, racks: int, shards: int) -> HashTree:
        """``regions x racks x shards`` equal shards, numbered from 0."""
        return HashTree(tuple(
            Region(f"g{g}", tuple(
                Rack(f"g{g}r{r}", tuple(((g * racks + r) * shards + s, 1.0) for s in range(shards)))
                for r in range(racks)))
            for g in range(regions)))

    @property
    def n_shards(self) -> int:
        return sum(len(rack.shards) for region in self.regions for rack in region.racks)

    def expanded(self, weight: float = 1.0) -> HashTree:
        """One more shard in a region of its own: only the new shard receives rows."""
        n, g = self.n_shards, len(self.regions)
        return HashTree(self.regions + (
            Region(f"g{g}", (Rack(f"g{g}r0", ((n, weight),)),)),))

    def reweighted(self, shard: int, weight: float) -> HashTree:
        """The same tree with one shard's weight changed (and so its rack's and region's)."""
        return HashTree(tuple(
            Region(g.name, tuple(
                Rack(r.name, tuple((s, weight if s == shard else w) for s, w in r.shards))
                for r in g.racks))
            for g in self.regions))


def _children(options: list[tuple[str, float]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"))
                     for n, w in options if w > 0])


def _pick(key: Column, children: Column) -> Column:
    """Name of the child with the smallest draw."""
    draws = F.transform(children, lambda c: F.struct(
        (-F.ln(unit_draw(key, c["name"])) / c["weight"]).alias("draw"), c["name"].alias("name")))
    return F.array_min(draws)["name"]


def _by_parent(parent: Column, options: dict[str, list[tuple[str, float]]]) -> Column:
    pairs = [x for name, kids in options.items() for x in (F.lit(name), _children(kids))]
    return F.element_at(F.create_map(*pairs), parent)


def assign(df: DataFrame, tree: HashTree, key: str, out: str = "shard") -> DataFrame:
    """Append the shard number (int). No shuffle: each row is placed from its key alone."""
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    regions = [(g.name, g.weight) for g in tree.regions if g.weight > 0]
    racks = {g.name: [(r.name, r.weight) for r in g.racks] for g in tree.regions if g.weight > 0}
    shards = {r.name: [(f"s{s}", w) for s, w in r.shards]
              for g in tree.regions for r in g.racks if r.weight > 0}
    # Names are unique in the tree, so a draw by (key, name) is a draw by path.
    region, rack = "_region_of_" + out, "_rack_of_" + out
    placed = (df.withColumn(region, _pick(k, _children(regions)))
              .withColumn(rack, _pick(k, _by_parent(F.col(region), racks)))
              .withColumn(out, F.substring(_pick(k, _by_parent(F.col(rack), shards)), 2, 12).cast("int")))
    return placed.drop(region, rack)


def slots(rows: DataFrame, shard: str = "shard", buckets: int = 1024) -> DataFrame:
    """Number the rows of each shard from 0 without gaps (column ``slot``).

    ``rows`` holds the compact columns only. Equal rows are counted first; a
    shard's rows are split into ``buckets`` hash buckets that are numbered apart,
    and a bucket's first number comes from the bucket sizes (shards x buckets
    rows), so no task holds a whole shard.
    """
    cols = rows.columns
    counted = staged(
        rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bucket", F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")), "slot-rows")
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(
        counted.groupBy(shard, "_bucket").agg(F.sum("_n").alias("_size"))
        .select(shard, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")),
        "slot-offsets")
    inside = (Window.partitionBy(shard, "_bucket").orderBy(*cols)
              .rowsBetween(Window.unboundedPreceding, -1))
    first = (counted.withColumn("_first", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
             .join(offsets, [shard, "_bucket"])
             .withColumn("_first", F.col("_first") + F.col("_offset")))
    last = F.col("_n") - 1
    chunks = first.withColumn("_chunk", F.explode(F.sequence(
        F.lit(0).cast("long"), last, F.lit(SLOT_CHUNK).cast("long"))))
    numbered = chunks.withColumn("_i", F.explode(F.sequence(
        F.col("_chunk"), F.least(last, F.col("_chunk") + (SLOT_CHUNK - 1)))))
    return numbered.select(*cols, (F.col("_first") + F.col("_i")).alias("slot"))


#: The production tree: 2 regions of 4 racks of 5 shards.
PRODUCTION = HashTree.uniform(2, 4, 5)


def shard_table(docs: DataFrame, tree: HashTree = PRODUCTION) -> DataFrame:
    """Place documents by ``doc_id``: size, text checksum, shard, slot and the
    shard after one more shard has been added. A null text has size 16 and checksum 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    placed = assign(assign(rows, tree, "doc_id"), tree.expanded(), "doc_id", "grown_shard")
    return slots(placed).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
