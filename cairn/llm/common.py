"""Helpers that several operators share: tables held in the shared folder, gapless numbering, connected components."""

from __future__ import annotations

import ctypes

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import held

#: Ids up to this many are broadcast (8 bytes each, so 16 MB at most before hashing); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


class Held(held.Held):
    """Held tables of text operators: texts are long, so Python workers get 1,000 rows at once."""

    def __init__(self, spark: SparkSession, name: str):
        super().__init__(spark, name, 1000)


def trimmed(run):
    """A function over batches that, at its end, gives freed memory back: Python workers live on and would keep it for each kind of task."""

    def wrapped(batches):
        yield from run(batches)
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return wrapped


def by_ids(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """docs left_semi or left_anti the ids, which are broadcast only when counted and few. ids must be held."""
    ids = ids.select(F.col(key).alias("_id"))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[key].eqNullSafe(F.col("_id")) if how == "left_semi" else docs[key] == F.col("_id"), how)


def bins_for(rows: int) -> int:
    """Bits of a bin number so that bins and rows in a bin both grow as the square root of the rows."""
    return max(4, min(30, (max(rows, 1).bit_length() + 1) // 2))


def running(df: DataFrame, group: list[str], order: list[str], bits: int, add: str | None = None) -> DataFrame:
    """Adds _slot (0-based rank in the group) and, with add, _before (sum of add over earlier rows of the group).

    order[0] is a bigint hash, uniform over its whole range. A group is cut into 2**bits hash ranges; their counts are
    summed up first, so no task orders more than one range of a group, however large the group is.
    """
    h = F.col(order[0])
    df = df.withColumn("_bin", F.shiftright(h, 64 - bits))
    value = F.col(add) if add else F.lit(0)
    sums = df.groupBy(*group, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_v"))
    w = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_bin").alias("_gb"),
        F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_v").over(w), F.lit(0)).alias("_v0"),
    )
    on = F.col("_bin") == F.col("_gb")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inner = Window.partitionBy(*group, "_bin").orderBy(*order)
    out = df.join(sums, on).withColumn("_slot", F.row_number().over(inner) - 1 + F.col("_n0"))
    if add:
        before = inner.rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("_before", F.coalesce(F.sum(value).over(before), F.lit(0)) + F.col("_v0"))
    return out.drop("_bin", "_gb", "_n0", "_v0", *[f"_g{i}" for i in range(len(group))])


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0))


def components(edges: DataFrame, store: Held, most_rounds: int = 60) -> DataFrame:
    """(a, b) bigint edges -> (node, comp): the smallest node reachable, for every node of an edge.

    Alternating large-star and small-star rounds: each is a groupBy with map-side minimum and a join on the node, so a hub
    costs its edges once a round and chains shrink by a factor a round. Minima of up to 250,000 edges are broadcast. Every round is written to the shared folder.
    """
    now = store.put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    rows = now.count()  # a round has no more edges than that
    files = rows // 200_000 + 1  # without this, every small round writes a file a partition
    few = F.broadcast if rows <= BROADCAST_IDS // 4 else lambda minima: minima  # 16 bytes a row; then a hub is not joined by one task
    mark = None
    for _ in range(most_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(few(low), F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = store.put(large.coalesce(files), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(few(low), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        small = store.put(small.coalesce(files), "small")
        store.drop(large)
        store.drop(now)
        now = small
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"), F.count_distinct("u").alias("d")).first()
        if seen == mark and seen["n"] == seen["d"]:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return pairs.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
