"""Benchmark decontamination by spaced seeds: hashes that ignore fixed token positions find places, alignment verifies them."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Held, by_ids

#: Tokens that a seed keeps; the positions between them are ignored, so a substitution there costs no hit.
KEPT = 5
#: Item hashes up to this many rows are broadcast (about 40 bytes each); beyond it the hashes are joined by a shuffle.
BROADCAST_SEEDS = 200_000
BREAK = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK), "")


def needed(width: int, share: float) -> int:
    """Equal tokens that a window of this width needs: a share of them, and 6 or the whole window at least."""
    return max(-int(-width * share // 1), min(6, width))


@lru_cache(maxsize=100)
def masks_for(width: int, share: float) -> tuple[tuple[int, ...], ...]:
    """Masks of KEPT positions (from 0) of which one, laid somewhere in a window, meets only equal tokens of any match.

    Every way to place the unequal tokens of a window is covered, greedily: next is the mask that covers most of what is
    left, the shortest and first on equal counts. So no match is lost; windows of 12 with 9 equal tokens take four masks.
    """
    gone = [sum(1 << i for i in c) for c in combinations(range(width), width - needed(width, share))]
    masks = [(0, *c) for c in combinations(range(1, width), KEPT - 1)]
    spots = {m: [sum(1 << (o + s) for o in m) for s in range(width - m[-1])] for m in masks}
    out = []
    while gone:
        best = max(masks, key=lambda m: (sum(any(not g & s for s in spots[m]) for g in gone), -m[-1], [-o for o in m]))
        out.append(best)
        gone = [g for g in gone if all(g & s for s in spots[best])]
    return tuple(out)


def seeds(rows: DataFrame, keep: list[str], masks: list[tuple[int, ...]]) -> DataFrame:
    """keep columns, p and seed, a row for each mask and start at which the mask fits into the rows' t (tokens)."""
    least = min(m[-1] for m in masks) + 1
    spots = rows.filter(F.size("t") >= least).select(*keep, "t", F.explode(F.sequence(F.lit(0), F.size("t") - least)).alias("p"))
    hashes = []
    for mask in masks:
        one = F.xxhash64(F.lit(str(mask)), *[F.get("t", F.col("p") + o) for o in mask])
        hashes.append(one if mask[-1] < least else F.when(F.col("p") + mask[-1] < F.size("t"), one))
    return spots.select(*keep, "p", F.explode(F.array(*hashes)).alias("seed")).filter("seed is not null")


def _aligned(window: int, share: float) -> tuple[Column, Column, Column, Column]:
    """Equal places (1 or 0) of item b and a, the document's tokens where b lies; the window's width, the most in one, the need."""
    size = F.size("b")
    same = F.transform("b", lambda x, i: F.when(F.get("a", i + F.least(F.col("d"), F.lit(0))) == x, 1).otherwise(0))
    width = F.least(F.lit(window), size)
    starts = F.sequence(F.lit(0), size - width)
    best = F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice(F.col("same"), s + 1, F.col("width")), F.lit(0), lambda x, y: x + y)))
    return same, width, best, F.greatest(F.ceil(F.col("width") * share), F.least(F.lit(6), size)).cast("int")


def leaks(docs: DataFrame, items: DataFrame, window: int = 12, share: float = 0.75, least: int = 5, held: Held | None = None) -> DataFrame:
    """doc_id, item_id, matched, item_words, best, at: one row for each document and benchmark item found in it.

    A document leaks an item if, laid over each other at some offset, a window of `window` consecutive tokens of the item
    (all of a shorter item) has a `share` of them equal at the same places, and 6 or the whole item at least. Nothing of
    that is lost: an item has the masks that cover every such match of its own length (masks_for), and no other item
    changes what is found of it. matched is the most equal tokens over the whole item, best the most in a window, at the
    item's offset in the document (ties: smallest). Every token of every text is looked at, however long it is.

    Items with fewer than `least` words (five at least, as seeds keep five), null or empty texts, and null ids never match;
    repeated items and rows are merged by id; other columns are ignored; empty tables give empty results. Hits are
    (document, item, offset) only, so texts are never shuffled: documents with a hit are read a second time, and joined by
    broadcast only if their ids are few; only the tokens under an item go on to the join with the items.
    """
    held = held or Held(docs.sparkSession, "decontam")
    items = items.select("item_id", tokens(F.col("text")).alias("t")).filter(F.col("item_id").isNotNull() & (F.size("t") >= max(least, KEPT))).distinct()
    items = held.put(items.withColumn("width", F.least(F.size("t"), F.lit(window))), "items")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # at most as many as the window is wide
    if not widths:
        none = [F.lit(0).alias(c) for c in ("matched", "item_words", "best", "at")]
        return docs.select("doc_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), *none).limit(0)
    own = [seeds(items.filter(F.col("width") == w), ["item_id", "t"], list(masks_for(w, share))) for w in widths]
    known = own[0]
    for more in own[1:]:
        known = known.unionByName(more)
    known = held.put(known.select(F.col("seed").alias("_seed"), "item_id", F.size("t").alias("n"), F.col("p").alias("q")).distinct(), "seeds")
    if known.count() <= BROADCAST_SEEDS:
        known = F.broadcast(known)
    rows = docs.select("doc_id", tokens(F.col("text")).alias("t")).filter("doc_id is not null")
    masks = sorted({m for w in widths for m in masks_for(w, share)})
    hits = seeds(rows, ["doc_id"], masks).join(known, F.col("seed") == F.col("_seed"))
    hits = held.put(hits.select("doc_id", "item_id", "n", (F.col("p") - F.col("q")).alias("d")).distinct(), "hits")
    found = by_ids(docs.select("doc_id", "text"), hits.select("doc_id").distinct(), "left_semi").select("doc_id", tokens(F.col("text")).alias("t"))
    few = hits.count() <= BROADCAST_SEEDS
    hits = hits.withColumnRenamed("doc_id", "_doc")
    under = found.join(F.broadcast(hits) if few else hits, F.col("doc_id") == F.col("_doc"))
    under = under.select("doc_id", "item_id", "d", F.slice("t", F.greatest("d", F.lit(0)) + 1, F.greatest(F.col("n") + F.least("d", F.lit(0)), F.lit(0))).alias("a"))
    return _found(under, items, share, window)


def _found(under: DataFrame, items: DataFrame, share: float, window: int) -> DataFrame:
    """The verified of (doc_id, item_id, d, a): the best offset of each document and item."""
    size = items.agg(F.sum(F.size("t"))).first()[0] or 0
    items = items.select(F.col("item_id").alias("_item"), F.col("t").alias("b"))
    pairs = under.join(F.broadcast(items) if size <= 10 * BROADCAST_SEEDS else items, F.col("item_id") == F.col("_item")).drop("_item")
    same, width, best, need = _aligned(window, share)
    pairs = pairs.withColumns({"same": same, "width": width}).withColumn("best", best).filter(F.col("best") >= need)
    pairs = pairs.select("doc_id", "item_id", "best", "d", F.size("b").alias("item_words"), F.aggregate("same", F.lit(0), lambda x, y: x + y).alias("matched"))
    top = F.max(F.struct("matched", "best", (-F.col("d")).alias("d"))).alias("m")
    return pairs.groupBy("doc_id", "item_id", "item_words").agg(top).select("doc_id", "item_id", F.col("m.matched").alias("matched"), "item_words", F.col("m.best").alias("best"), (-F.col("m.d")).alias("at"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that leak no item (see leaks), with their own columns.

    Rows of a null doc_id and null or empty texts stay; rows that repeat a doc_id go or stay together; an empty table gives
    an empty result, and without items all rows stay.
    """
    held = Held(docs.sparkSession, "decontam")
    bad = held.put(leaks(docs, items, held=held).select("doc_id").distinct(), "bad")
    return by_ids(docs, bad, "left_anti")
