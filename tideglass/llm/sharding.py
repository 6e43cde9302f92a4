"""Sharding by a hierarchical weighted hash tree, in DataFrame expressions only.

Every document descends region, rack and shard levels. At each level each child draws
``-ln(u) / weight`` with u hashed from (child, doc_id), and the smallest draw wins, so a child gets
rows in proportion to its weight and a changed weight moves rows only into or out of the subtrees
whose weights change. A shard added by ``Topology.grow`` is a region of its own: no other node's
weight changes, so the only rows that move are those that the new shard wins.

Defined cases: a null doc_id is hashed as a null (all such rows share a shard); a null text has 0
bytes and the checksum of the empty text; rows that repeat a doc_id share its shard and get slots of
their own; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import materialise
from .columns import fresh

ROW_OVERHEAD = 16


@dataclass(frozen=True)
class Topology:
    """regions[r][k][s]: the weight of shard s of rack k of region r; shards count in that order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    def __post_init__(self) -> None:
        if not self.regions or any(not rack or min(rack) <= 0 for region in self.regions for rack in (region or ((),))):
            raise ValueError("every region needs racks, every rack shards, every shard a weight above 0")

    @staticmethod
    def even(shards: int, racks_per_region: int = 2, shards_per_rack: int = 4) -> Topology:
        """Regions of racks_per_region x shards_per_rack shards of weight 1; the last ones may be smaller."""
        racks = [tuple([1.0] * min(shards_per_rack, shards - i)) for i in range(0, shards, shards_per_rack)]
        return Topology(tuple(tuple(racks[i : i + racks_per_region]) for i in range(0, len(racks), racks_per_region)))

    def grow(self, weight: float = 1.0) -> Topology:
        return Topology((*self.regions, ((weight,),)))

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)


def _draw(key: Column, level: str, node: Column, weight: Column) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(level), node, key), 11)
    return -F.log((bits.cast("double") + 0.5) * F.lit(2.0**-53)) / weight


def _descend(key: Column, level: str, weights: list[list[float]], parent: Column | None) -> Column:
    """The global number of the winning child; weights[p] are those of the children of parent p."""
    width = max(map(len, weights))
    first = [sum(map(len, weights[:p])) for p in range(len(weights))]
    base = F.lit(0) if parent is None else F.element_at(F.array(*map(F.lit, first)), parent + 1)
    table = F.array(*(F.lit(float(row[j]) if j < len(row) else 0.0) for row in weights for j in range(width)))
    draws = []
    for j in range(width):
        w = F.lit(float(weights[0][j])) if parent is None else F.element_at(table, parent * width + (j + 1))
        child = (base + j).cast("int")
        draws.append(F.struct(F.when(w > 0, _draw(key, level, child, w)).otherwise(F.lit(float("inf"))).alias("draw"), child.alias("child")))
    return (F.least(*draws) if width > 1 else draws[0]).getField("child")


def assign(df: DataFrame, key: str, topology: Topology, out: str) -> DataFrame:
    """df with the shard of each row's ``key`` in column ``out``; a name that ``df`` has already is an error, its other columns stay."""
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"df has a column {out}")
    region, rack = fresh(df, "_region", "_rack")
    region_w = [[sum(map(sum, region)) for region in topology.regions]]
    rack_w = [[sum(rack) for rack in region] for region in topology.regions]
    shard_w = [list(rack) for region in topology.regions for rack in region]
    k = F.col(key)
    steps = df.withColumn(region, _descend(k, "region", region_w, None))
    steps = steps.withColumn(rack, _descend(k, "rack", rack_w, F.col(region)))
    return steps.withColumn(out, _descend(k, "shard", shard_w, F.col(rack))).drop(region, rack)


def place(docs: DataFrame, topology: Topology, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard.

    Slots come without a sort of a whole shard: rows are counted per (input task, shard), the counts'
    running sums give each such group its first slot, and rows are numbered inside their group. A
    group holds no more rows than one input task read, whatever keys are hot.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = assign(rows, "doc_id", topology, "shard")
    rows = assign(rows, "doc_id", topology.grow(), "grown_shard")
    rows = materialise(rows.withColumn("_seq", F.monotonically_increasing_id()).withColumn("_task", F.shiftright(F.col("_seq"), 33)), "shards")
    counts = rows.groupBy("shard", "_task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("shard", "_task").orderBy("_seq")
    return (
        rows.withColumn("_rank", F.row_number().over(inside))
        .join(first, ["shard", "_task"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("_first") + F.col("_rank") - 1).cast("long").alias("slot"), "grown_shard")
    )
