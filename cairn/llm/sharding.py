"""Sharding by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Held, bins_for, running, utf8_bytes


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree. Names of regions and racks are labels that the draws hash; racks are named within a region."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(n: int, base: int = 8) -> list[Shard]:
    """Shards 0..n-1: the first `base` fill regions of two racks of two; every shard after them opens a region of its own.

    A region of its own is the one place where growth changes no existing subtree: the draw of the regions gains a child,
    and rows leave others only for it.
    """
    return [Shard(f"r{s // 4}", f"k{s // 2}", s) if s < base else Shard(f"x{s}", "k", s) for s in range(n)]


def _draw(key: Column, level: str, children: list[tuple[str, float]]) -> Column:
    """The child with the smallest exponential draw -ln(u)/weight; a child's draw depends on its own name and weight only."""
    live = [(name, w) for name, w in children if w > 0]
    if len(live) == 1:
        return F.lit(live[0][0])
    scored = []
    for name, w in live:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{level}/{name}")), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        scored.append(F.struct((-F.log(u) / F.lit(float(w))).alias("s"), F.lit(name).alias("c")))
    return F.least(*scored)["c"]


def assign(key: Column, shards: list[Shard]) -> Column:
    """The shard of a key: one draw a level, only among the children of the node drawn before.

    Changing a shard's weight changes the weights of its rack and region, so rows move only into or out of those subtrees.
    """
    if not any(s.weight > 0 for s in shards):
        raise ValueError("no shard has a positive weight")
    k = F.coalesce(key.cast("string"), F.lit(""))
    weight = lambda part: sum(s.weight for s in part)
    regions = sorted({s.region for s in shards if s.weight > 0})
    region = _draw(k, "region", [(r, weight([s for s in shards if s.region == r])) for r in regions])
    out = None
    for r in regions:
        inside = [s for s in shards if s.region == r and s.weight > 0]
        racks = sorted({s.rack for s in inside})
        rack = _draw(k, r, [(x, weight([s for s in inside if s.rack == x])) for x in racks])
        leaf = None
        for x in racks:
            own = [(str(s.shard), s.weight) for s in inside if s.rack == x]
            one = _draw(k, f"{r}/{x}", own)
            leaf = F.when(rack == x, one) if leaf is None else leaf.when(rack == x, one)
        out = F.when(region == r, leaf) if out is None else out.when(region == r, leaf)
    return out.cast("int")


def shard(docs: DataFrame, shards: list[Shard], grown: list[Shard] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law 'key', shard, slot (gapless from 0 in a shard) and grown_shard, one row a document.

    Nulls: a null key is drawn as the empty string; a null text has no bytes (size 1, crc 0). Repeated rows get the same
    shard and slots of their own. Documents with equal texts but different keys are placed independently. An empty table
    gives an empty result; other columns are ignored. The texts themselves are never shuffled.
    """
    spark = docs.sparkSession
    meta = docs.select(
        F.col(key).alias(key),
        (utf8_bytes(F.col(text)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    meta = Held(spark, "shard").put(meta, "meta")
    meta = meta.withColumns({"shard": assign(F.col(key), shards), "grown_shard": assign(F.col(key), grown) if grown else F.lit(None).cast("int")})
    meta = meta.withColumn("_h", F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("slot")))
    out = running(meta, ["shard"], ["_h", key, "size", "text_crc32"], bins_for(meta.count()))
    return out.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("_slot").cast("long").alias("slot"), "grown_shard")
