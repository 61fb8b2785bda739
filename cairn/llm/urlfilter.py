"""URL filtering: host and path rules first, then a Bloom filter cascade that is exact over the corpus's own keys."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Held

#: (host, path, action)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Registered names of the default block list; subdomains count as listed with them.
BLOCKED = (
    "spam-farm.example.org", "spam-farm.example.com", "spam-farm.example.net",
    "cheap-pills.example.org", "cheap-pills.example.com", "cheap-pills.example.net",
    "casino-win.example.org", "casino-win.example.com", "casino-win.example.net",
    "ads-track.example.org", "ads-track.example.com", "ads-track.example.net",
    "adult-x.example.org", "adult-x.example.com", "adult-x.example.net",
    "free-bets.example.org", "free-bets.example.com", "free-bets.example.net",
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no '://'."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string, action) of the longest rule that fits; of rules equally long, the first in text order; null if none."""
    name = action = None
    for rh, rp, act in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == rh) | host.endswith(f".{rh}")) & path.startswith(rp)
        name = F.when(fits, F.lit(rh + rp)) if name is None else name.when(fits, F.lit(rh + rp))
        action = F.when(fits, F.lit(act)) if action is None else action.when(fits, F.lit(act))
    null = F.lit(None).cast("string")
    return (null, null) if name is None else (name, action)


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    words: tuple[int, ...]


def _positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed * 64 + i)), F.lit(bits).cast("long")) for i in range(hashes)]


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter of the keys (column key): a word of 64 bits a row, or-ed together before and after the shuffle."""
    bits = max(64, 64 * math.ceil(n * math.log(1 / rate) / math.log(2) ** 2 / 64))
    hashes = max(1, round(bits / max(n, 1) * math.log(2))) if n else 1
    hashes = min(hashes, 24)
    spots = keys.select(F.explode(F.array(*_positions(F.col("key"), bits, hashes, seed))).alias("p"))
    words = spots.groupBy((F.col("p") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v"))
    full = [0] * (bits // 64)
    for w, v in words.collect():
        full[w] = v
    return Level(bits, hashes, seed, tuple(full))


def _holds(key: Column, level: Level) -> Column:
    """Whether the filter holds a key. The words stand once in the expression, for all positions of all keys it is laid on."""
    words = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")
    spots = F.array(*_positions(key, level.bits, level.hashes, level.seed))
    return F.forall(spots, lambda p: F.getbit(F.get(words, (p / 64).cast("int")), (p % 64).cast("int")) == 1)


class Cascade:
    """Levels 1, 3, 5... hold listed keys, levels 2, 4... the unlisted keys of the universe that passed the level before.

    A key is listed if the first level that lacks it is an even one. No key of the universe is judged wrongly. From the
    second level on, a level holds about as many keys as the list has at most, so the cascade grows with the list and not
    with the corpus; its size is checked before it is put into a plan.
    """

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @property
    def bits(self) -> int:
        return sum(x.bits for x in self.levels)

    def listed(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(_holds(key, self.levels[i]), out).otherwise(F.lit(i % 2 == 1))
        return F.coalesce(out, F.lit(False))


def build_cascade(universe: DataFrame, listed: DataFrame, held: Held, max_bits: int = 1 << 25, most_levels: int = 40) -> Cascade | None:
    """universe and listed: distinct non-null keys in column key. None if it would take more than max_bits."""
    listed, universe = held.put(listed, "listed"), held.put(universe, "universe")
    n, total = listed.count(), universe.count()
    if n == 0:
        return Cascade([])
    rate = min(0.5, max(1e-6, n * math.sqrt(0.5) / max(total, 1)))
    levels: list[Level] = []
    inside, outside, size = listed, universe, n
    used = 0
    for i in range(most_levels):
        p = rate if i == 0 else 0.25
        used += int(size * math.log(1 / p) / math.log(2) ** 2) + 64
        if used > max_bits:
            return None
        levels.append(_level(inside, size, p, i + 1))
        passed = outside.filter(_holds(F.col("key"), levels[-1]))
        if i == 0:
            passed = passed.join(listed, "key", "left_anti")
        passed = held.put(passed, f"passed{i}")
        size = passed.count()
        if size == 0:
            return Cascade(levels)
        inside, outside = passed, inside
    return None


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, max_bits: int = 1 << 25, id_col: str = "page_id") -> DataFrame:
    """id, host, path, rule, verdict, one row a page.

    listed has column key: host names; a host is listed if it or a parent domain is. A rule's verdict comes before the
    list's. Null urls and urls without '://' have empty host and path and are allowed, as no rule or key fits them. Ties of
    rules go by text order; repeated rows are judged alike; null and repeated listed keys are ignored; empty tables give
    empty results. Columns besides id and url are ignored. A list whose cascade exceeds max_bits is applied by an equi-join
    of the distinct hosts instead.
    """
    held = Held(pages.sparkSession, "urls")
    listed = listed.select(F.translate(F.col("key"), UPPER, LOWER).alias("key")).filter("key is not null and key <> ''").distinct()
    depth = listed.agg(F.max(F.size(F.split("key", r"\."))).alias("d")).first()["d"] or 0
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    name, action = rule_of(F.col("host"), F.col("path"), rules)
    keys = lambda h: [F.substring_index(h, ".", -i) for i in range(1, depth + 1)]
    blocked = F.lit(False)
    if depth:
        hosts = rows.select("host").filter("host <> ''").distinct()
        universe = hosts.select(F.explode(F.array(*keys(F.col("host")))).alias("key")).distinct()
        cascade = build_cascade(universe, listed, held, max_bits)
        if cascade is not None:
            blocked = (F.col("host") != "") & F.exists(F.array(*keys(F.col("host"))), cascade.listed)
        else:
            bad = hosts.select("host", F.explode(F.array(*keys(F.col("host")))).alias("key")).join(listed, "key", "left_semi").select(F.col("host").alias("_h")).distinct()
            rows = rows.join(bad, F.col("host") == F.col("_h"), "left")
            blocked = F.col("_h").isNotNull()
    return rows.select(id_col, "host", "path", name.alias("rule"), F.coalesce(action, F.when(blocked, "block").otherwise("allow")).alias("verdict"))
