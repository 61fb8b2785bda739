"""Exact Jaccard join of word n-gram sets by universe partition and pigeonhole.

Two sets of sizes r <= s with Jaccard 0.75 or more differ in at most H = floor((r + s) / 7) elements, and r >= 0.75 s. Sizes
are cut into bands so that partners lie in the same band or in neighbouring ones; a pair is looked for in the partition of
the smaller set's band, so every set signs in its own band and, where it can have smaller partners there, in the band below.

A band deals all hashes into m narrow and w wide segments (a wide one is twice as likely). H differing elements cannot touch
all segments: a narrow segment is ruled out by one difference, a wide one, whose one-deletion neighbourhood is signed too, by
two. A set signs
* of each wide segment, the subset in it and, of three or more elements, each subset with one left out, where these have
  two elements or more and one that is rare in the corpus. A wide segment with three elements and two rare ones counts two
  points, another one that is signed whole one, else none: P points in all;
* its first H + 1 - P narrow segments in an order that depends on their content alone: those with a rare element first, then
  larger subsets, then by hash. Equal segments have equal places in that order, so the first equal narrow segment of a pair
  is among these of both sets.
Hence a pair that links shares a signature, whatever is called rare, and is a candidate: its sets are fetched and compared.
Costs allocate: frequent elements (a common line or
passage) come from a sketch of document frequencies over the whole corpus, and how many segments a band has, and how many of
them wide, is chosen by an estimate in which small subsets cost more, as unrelated sets share them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Held, by_ids, components, trimmed

U = np.uint64
SHINGLE = 5
SKETCH_BITS = 20
PART = 600_000  # shingles of the corpus for each part of the signatures' space
RUN = 32  # sets that share a signature, up to which they are compared as pairs
PAIR_BYTES = 2 << 20  # of sets that a Python worker gets at once to verify pairs
CUT_BYTES = 8 << 20  # of sets in a cut of a clump
NAME_BITS = 48  # of a set's first hash; different sets that share one are told apart by the second, and compared
STEP = 0x9E3779B97F4A7C15  # odd; powers of it place bytes in a word's hash
_MASK = (1 << 64) - 1


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer; other salts give other functions."""
    x = x + U((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & _MASK)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    inverse = pow(STEP, -1, 1 << 64)
    up, down = np.full(n, U(STEP)), np.full(n, U(inverse))
    up[0] = down[0] = U(1)
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_BYTES = mix(np.arange(256, dtype=np.uint64), 1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ORDER = np.array([pow(0x2545F4914F6CDD1D, k + 1, 1 << 64) | 1 for k in range(SHINGLE)], np.uint64)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of lower-cased bytes: a polynomial in the word's bytes, mixed with its length."""
    b = np.frombuffer(raw, np.uint8)
    up, down = _powers(max(18, len(b).bit_length()))
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    start, end = edge[::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[b] * up[: len(b)], dtype=np.uint64)])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64), 2), start


def shingle_sets(texts: list[str | None], chunk: int = 1 << 18) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in turn."""
    i = 0
    while i < len(texts):
        raws: list[bytes] = []
        size = 0
        while i + len(raws) < len(texts) and (not raws or size < chunk):
            raws.append((texts[i + len(raws)] or "").encode("utf-8", "replace").lower())
            size += len(raws[-1]) + 1
        i += len(raws)
        h, start = word_hashes(b" ".join(raws))
        cuts = np.searchsorted(start, np.cumsum([len(r) + 1 for r in raws]))
        whole = sum((h[k : len(h) - SHINGLE + 1 + k] * _ORDER[k] for k in range(1, SHINGLE)), h[: len(h) - SHINGLE + 1] * _ORDER[0]) if len(h) >= SHINGLE else h[:0]
        whole = mix(whole, 3)
        lo = 0
        for hi in cuts:
            n = hi - lo
            if n >= SHINGLE:
                s = np.sort(whole[lo : hi - SHINGLE + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif n:
                yield mix((h[lo:hi] * _ORDER[:n]).sum(dtype=np.uint64, keepdims=True) + U(n), 4)
            else:
                yield h[:0]
            lo = hi


def identity(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, of 48 and 64 bits, as signed numbers; the first names the set in shuffles of signatures."""
    if not len(s):
        return 0, 0
    a = mix(mix(s, 5).sum(dtype=np.uint64, keepdims=True) + U(len(s)), 6)
    b = mix(np.bitwise_xor.reduce(mix(s, 7), keepdims=True) + U(len(s)), 8)
    return int(a[0] >> U(64 - NAME_BITS)), int(b.view(np.int64)[0])


def pack(names: np.ndarray) -> bytes:
    """First hashes in six bytes each."""
    return names.astype("<i8").view(np.uint8).reshape(-1, 8)[:, : NAME_BITS // 8].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    few = np.frombuffer(raw, np.uint8).reshape(-1, NAME_BITS // 8)
    out = np.zeros((len(few), 8), np.uint8)
    out[:, : NAME_BITS // 8] = few
    return out.view("<i8").ravel().astype(np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, on sorted distinct hashes; empty sets link with nothing."""
    if not len(a) or not len(b) or 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= 75 * (len(a) + len(b) - both)


@lru_cache(maxsize=1)
def _bands() -> np.ndarray:
    """First sizes of the bands: a set's partners are in its band or in a neighbouring one."""
    out = [1, 2]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, (out[-1] - 1) * 4 // 3 + 1))
    return np.array(out, np.int64)


def _poisson(mean: float) -> list[float]:
    out = [exp(-mean)]
    for k in range(1, 40):
        out.append(out[-1] * mean / k)
    return out


def _pays(size: int) -> float:
    """What a signature of a subset of this size costs, in signatures: small subsets are met in many unrelated sets."""
    return (400.0, 12.0, 1.2)[size] if size < 3 else 1.0


@lru_cache(maxsize=200)
def geometry(band: int) -> tuple[int, int]:
    """(narrow, wide) segments of a band, by the least estimated cost of a set in its middle that signs for its own band."""
    first, after = (int(x) for x in _bands()[band : band + 2])
    size = (first + after - 1) / 2
    need = int(size + size * 4 // 3) // 7 + 1
    floor = ((after - 1) + 4 * (after - 1) // 3) // 7 + 1
    best = None
    for load in (0.3, 0.5, 0.75, 1.0, 1.25, 1.5, 1.8, 2.1, 2.5, 3.0):
        for part in (0.0, 0.03, 0.06, 0.1, 0.15, 0.25, 0.4):
            slots = max(floor, round(size / load))
            wide = int(slots * part) // 2
            narrow = max(floor, slots - 2 * wide)
            each = size / (narrow + 2 * wide)
            one, two = _poisson(each), _poisson(2 * each)
            cost = wide * sum(p * (_pays(k) + (k * _pays(k - 1) if k >= 3 else 0)) for k, p in enumerate(two) if k >= 2)
            left = need - wide * (two[2] + 2 * sum(two[3:]))
            for k in range(len(one) - 1, -1, -1):
                take = min(max(left, 0.0), narrow * one[k])
                cost += take * _pays(k)
                left -= take
            if best is None or cost < best[0]:
                best = (cost, narrow, wide)
    return best[1], best[2]


def slots(s: np.ndarray) -> np.ndarray:
    """Each hash's counter in the sketch of document frequencies."""
    return (mix(s, 15) >> U(64 - SKETCH_BITS)).astype(np.int64)


def sign(s: np.ndarray, light: np.ndarray, band: int, differ: int) -> np.ndarray:
    """A set's signatures in the partition of a band, for partners that differ in at most `differ` elements.

    light marks the elements that are not frequent in the corpus.
    """
    narrow, wide = geometry(band)
    slot = (mix(s, 9) % U(narrow + 2 * wide)).astype(np.int64)
    segment = np.where(slot < narrow, slot, narrow + (slot - narrow) // 2) if wide else slot
    order = np.argsort(segment, kind="stable")
    segment, value, light = segment[order], mix(s, 10)[order], light[order].astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    count = np.diff(np.append(starts, len(s)))
    ids = segment[starts]
    content = np.add.reduceat(value, starts)
    rare = np.add.reduceat(light, starts)
    own = U(band * 0xA24BAED4963EE407 & _MASK)
    place = mix(own + ids.astype(np.uint64), 11)
    key = mix(content ^ place, 12)
    out = []
    points = 0
    if wide:
        far = ids >= narrow
        out.append(key[far & (count >= 2) & (rare >= 1)])
        many = far & (count >= 3)
        points = 2 * int((many & (rare >= 2)).sum()) + int((far & (rare >= 1) & ((count == 2) | (many & (rare == 1)))).sum())
        inside = np.repeat(many, count) & (np.repeat(rare, count) - light >= 1)
        out.append(mix((np.repeat(content, count)[inside] - value[inside]) ^ np.repeat(place, count)[inside], 12))
        key, count, rare, ids = key[~far], count[~far], rare[~far], ids[~far]
    need = differ + 1 - points
    if need > 0:
        first = np.lexsort((key, -count, rare == 0))[:need]
        out.append(key[first])
        if need > len(key):
            empty = np.setdiff1d(np.arange(narrow), ids)
            place = mix(own + empty.astype(np.uint64), 11)
            out.append(np.sort(mix(place, 12))[: need - len(key)])
    return np.concatenate(out)


def signatures(s: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """All signatures of a set, for its own band and the band below; heavy has a bit for each of the sketch's frequent counters."""
    n = len(s)
    at = slots(s)
    light = heavy[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 0
    band = int(np.searchsorted(_bands(), n, side="right")) - 1
    out = [sign(s, light, band, (n + 4 * n // 3) // 7)]
    below = int(_bands()[band]) - 1
    if band and 4 * below >= 3 * n:
        out.append(sign(s, light, band - 1, (n + below) // 7))
    return np.concatenate(out)


def _described(key: str):
    """(key, n, h, g) of each text, and at the end of a partition its counters of document frequencies, in packed blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        seen: set[int] = set()
        for pdf in batches:
            got = []
            for s in shingle_sets(list(pdf["text"])):
                got.append((len(s), *identity(s)))
                if len(s) and got[-1][1] not in seen:
                    seen.add(got[-1][1])
                    np.add.at(counts, slots(s), 1)
            n, h, g = np.array(got, np.int64).reshape(-1, 3).T
            yield pd.DataFrame({key: pdf[key], "n": n, "h": h, "g": g, "block": -1, "counts": None})
        if counts.any():
            blocks = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(-1, 1 << 12)]
            yield pd.DataFrame({key: pd.Series([None] * len(blocks), dtype=object), "n": 0, "h": 0, "g": 0, "block": range(len(blocks)), "counts": blocks})

    return run


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(x), np.int64 if wide else np.uint32).astype(np.int64) for x, wide in zip(pdf["counts"], pdf["wide"], strict=True))
    return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "total": [int(total.sum())], "counts": [zlib.compress(total.tobytes(), 1)], "wide": [True]})


def frequent(counters: DataFrame, held: Held) -> bytes:
    """A bit for each of the sketch's counters that stands out: over 50 and three times the mean.

    A fixed number of bits (128 KB), whatever the corpus. Counters are summed in two steps, so that no task has
    those of more than 1,024 partitions. The sketch only ranks segments by cost: its collisions cost time, not links.
    """
    kind = "block int, total long, counts binary, wide boolean"
    some = counters.select("block", "counts", F.lit(False).alias("wide"), F.expr("spark_partition_id() div 1024").alias("of"))
    some = some.groupBy("block", "of").applyInPandas(_summed, kind).groupBy("block").applyInPandas(_summed, kind)
    sums = held.put(some, "sketch")
    floor = max(50.0, 3 * (sums.agg(F.sum("total")).first()[0] or 0) / (1 << SKETCH_BITS))

    def flagged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bits = [np.packbits(np.frombuffer(zlib.decompress(x), np.int64) > floor).tobytes() for x in pdf["counts"]]
            yield pd.DataFrame({"block": pdf["block"], "bits": bits})

    out = np.zeros((1 << SKETCH_BITS - 12, 1 << 9), np.uint8)
    for row in sums.mapInPandas(flagged, "block int, bits binary").collect():
        out[row["block"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out.tobytes()


def _packed(parts: int, heavy, most: int = 300_000):
    """Texts -> a blob for each part of the signatures' space: 32 bits of each signature, and the first hash of its set.

    The part comes from a signature's high bits. Parts grow in number with the input, without end, so the chance that two
    signatures of a part have equal bits stays the same, about one in 2**32 for each, and costs one comparison. A blob has
    arrays of numbers instead of a row a signature, so a signature is shuffled in 10 bytes, whatever the number of parts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush():
            sig = np.concatenate(sigs)
            part = ((sig >> U(32)) * U(parts)) >> U(32)
            order = np.argsort(part, kind="stable")
            name = np.repeat(np.array(ids, np.int64), [len(x) for x in sigs])[order]
            sig, part = sig[order], part[order]
            low = sig.astype(np.uint32)
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            rows = [(int(part[lo]), pack(name[lo:hi]), low[lo:hi].tobytes()) for lo, hi in zip(cuts, cuts[1:], strict=False)]
            return pd.DataFrame(rows, columns=["part", "ids", "low"])

        frequent_ = np.frombuffer(heavy.value, np.uint8)
        seen: set[tuple[int, int]] = set()
        sigs, ids, total = [], [], 0
        for pdf in batches:
            for s in shingle_sets(list(pdf["text"])):
                if not len(s) or (name := identity(s)) in seen:
                    continue  # a copy in the same batch of texts signs once
                seen.add(name)
                sigs.append(np.unique(signatures(s, frequent_)))
                ids.append(name[0])
                total += len(sigs[-1])
                if total >= most:
                    yield flush()
                    sigs, ids, total, seen = [], [], 0, set()
        if sigs:
            yield flush()

    return run


#: The first hashes of two sets that share a signature, and that of the first set of their run.
MET = "long boolean, ah long, bh long, c long"


def met(pdf: pd.DataFrame, run: int = RUN) -> pd.DataFrame:
    """The pairs of sets of a part that share a signature, each once.

    Of runs with more sets than `run`, each set with the run's first one (long), so rows grow with the signatures only.
    """
    names, node = np.unique(np.concatenate([unpack(x) for x in pdf["ids"]]), return_inverse=True)
    node = node.astype(np.int32)
    key = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["low"]])
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])  # several batches may have signed a set
    key, node = key[fresh], node[fresh]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    length = np.diff(np.append(starts, len(key)))
    found, stars = [np.zeros((0, 3), np.int64)], [np.zeros((0, 3), np.int64)]
    for n in np.unique(length[length > 1]):
        runs = starts[length == n]
        if n > run:
            for lo in runs:
                stars.append(np.stack([np.full(n - 1, node[lo]), node[lo + 1 : lo + n], np.full(n - 1, node[lo])], 1).astype(np.int64))
            continue
        member = node[runs[:, None] + np.arange(n)].astype(np.int64)
        i, j = np.triu_indices(n, 1)
        found.append(np.stack([member[:, i].ravel(), member[:, j].ravel(), np.repeat(member[:, 0], len(i))], 1))
    out = []
    for wide, rows in ((False, np.concatenate(found)), (True, np.concatenate(stars))):
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])] if len(rows) else rows
        frame = pd.DataFrame(names[rows].reshape(-1, 3), columns=["ah", "bh", "c"])
        frame.insert(0, "long", wide)
        out.append(frame)
    return pd.concat(out, ignore_index=True)


def _meeting(run: int):
    return lambda pdf: met(pdf, run)


def _sets(kind: str):
    """(id, to, text) -> (id, to, u): u is the text's set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"a": pdf["a"], "to": pdf["to"], "u": [s.tobytes() for s in shingle_sets(list(pdf["text"]))]})

    return run, f"a {kind}, to {{to}}, u binary"


def _verified(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows with u are sets, the others pairs (a, b): those that link, less those that others of them imply."""
    sets: dict = {}
    own = pdf["u"].notna()
    for a, u in zip(pdf["a"][own], pdf["u"][own], strict=True):
        sets.setdefault(a, []).append(np.frombuffer(u, np.uint64))
    up: dict = {a: a for a in sets}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in zip(pdf["a"][~own], pdf["b"][~own], strict=True):
        x, y = find(a), find(b)
        if x != y and any(linked(s, t) for s in sets[a] for t in sets[b]):
            up[x] = y
            out.append((a, b))
    return pd.DataFrame(out, columns=["a", "b"])


def _compared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the sets of a block of a clump, thinned to a spanning forest of the block.

    Intersections are counted over an inverted index of the block, so a set costs the places of its elements and no pair is
    written down. With two cuts in the block, only pairs across them are compared.
    """
    pdf = pdf.sort_values(["side", "a"], kind="stable")
    h, side = pdf["a"].to_numpy(), pdf["side"].to_numpy()
    sets = [np.frombuffer(u, np.uint64) for u in pdf["u"]]
    size = np.array([len(u) for u in sets])
    across = pdf["i"].iloc[0] != pdf["j"].iloc[0]
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(element, kind="stable")
    owners = np.repeat(np.arange(len(sets)), size)[order]
    start = np.searchsorted(element[order], np.arange(element.max() + 2))
    begin = np.concatenate([[0], np.cumsum(size)])
    label = np.arange(len(sets))
    out = []
    for i in np.flatnonzero(side == 0) if across else np.arange(len(sets)):
        e = element[begin[i] : begin[i + 1]]
        n = start[e + 1] - start[e]
        at = np.repeat(start[e] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owners[at], minlength=len(sets))
        link = 100 * both >= 75 * (size[i] + size - both)
        link &= (side == 1) if across else (np.arange(len(sets)) > i)
        for j in np.flatnonzero(link & (label != label[i])):
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((h[i], h[j]))
    return pd.DataFrame(out, columns=["a", "b"])


def _fetched(docs: DataFrame, asked: DataFrame, held: Held, kind: str, to: str) -> DataFrame:
    """(a, to, u): the sets of the asked documents (a, to). Texts are joined to a broadcast where the ids are few."""
    asked = held.put(asked, "asked")
    few = asked.count() <= BROADCAST_IDS
    run, shape = _sets(kind)
    found = docs.join(F.broadcast(asked) if few else asked, F.col("doc_id") == F.col("a"))
    return found.select("a", "to", "text").mapInPandas(trimmed(run), shape.format(to=to))


def _pairs(docs: DataFrame, pairs: DataFrame, held: Held, kind: str) -> DataFrame:
    """The linked ones of candidate pairs (a, b, c, bytes), verified around the set c in which they met.

    Pairs are dealt to tasks by c, and those of a c with more than PAIR_BYTES of sets in chunks; a set goes once to each task
    that has a pair of it.
    """
    sizes = held.put(pairs.groupBy("c").agg(F.expr(f"cast(sum(bytes) div {PAIR_BYTES} + 1 as int)").alias("chunks"), F.sum("bytes").alias("all")), "sizes")
    total = sizes.agg(F.sum("all")).first()[0] or 0
    buckets = max(1, total // PAIR_BYTES)
    where = F.when(F.col("chunks") > 1, F.xxhash64("c", F.pmod(F.xxhash64("a", "b"), F.col("chunks")))).otherwise(F.pmod(F.xxhash64("c"), F.lit(buckets)))
    pairs = held.put(pairs.join(sizes.select(F.col("c").alias("_c"), "chunks"), F.col("c") == F.col("_c")).select(where.alias("to"), "a", "b"), "pairs")
    asked = pairs.select("to", F.explode(F.array("a", "b")).alias("a")).distinct()
    asked = asked.groupBy("a").agg(F.collect_list("to").alias("to"))
    sets = _fetched(docs, asked, held, kind, "array<bigint>").select("a", F.explode("to").alias("to"), "u")
    rows = sets.select("to", "a", F.lit(None).cast(kind).alias("b"), "u").unionByName(pairs.select("to", "a", "b", F.lit(None).cast("binary").alias("u")))
    return rows.groupBy("to").applyInPandas(_verified, f"a {kind}, b {kind}")


def _clumps(stars: DataFrame, held: Held) -> DataFrame:
    """(a, clump, cuts) of the sets (a, b, size of each) in long runs: runs that share sets form a clump.

    A clump is cut by its bytes, into up to eight cuts early on, beyond that by CUT_BYTES, and compared in blocks of two
    cuts, so one clump is the work of many tasks.
    """
    size = stars.select("a", F.col("na").alias("n")).unionByName(stars.select(F.col("b").alias("a"), F.col("nb").alias("n"))).distinct()
    clumps = held.put(components(stars.select("a", "b"), held).join(size, F.col("node") == F.col("a")).select("a", "n", F.col("comp").alias("clump")), "clumps")
    cuts = clumps.groupBy(F.col("clump").alias("_clump")).agg(F.expr(f"cast(greatest(least(8, sum(8 * n) div {CUT_BYTES // 32} + 1), sum(8 * n) div {CUT_BYTES} + 1) as int)").alias("cuts"))
    return held.put(clumps.join(cuts, F.col("clump") == F.col("_clump")).select("a", "clump", "cuts"), "cuts")


def _search(docs: DataFrame, clumps: DataFrame, held: Held, kind: str) -> DataFrame:
    """Links in clumps; a set is shuffled once for each block that it is in."""
    sets = _fetched(docs, clumps.select("a", F.struct("clump", "cuts").alias("to")), held, kind, f"struct<clump: {kind}, cuts: int>")
    at = sets.select("a", "u", "to.clump", "to.cuts").withColumn("cut", F.pmod(F.xxhash64("a"), F.col("cuts")).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    at = at.select("clump", "a", "u", F.least("cut", "t").alias("i"), F.greatest("cut", "t").alias("j"), (F.col("cut") > F.col("t")).cast("int").alias("side"))
    return at.groupBy("clump", "i", "j").applyInPandas(_compared, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, held: Held | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id: one row a document; linked documents and their chains share the smallest doc_id.

    A document's set has its distinct shingles of five words (A-Z lower-cased, words between ASCII white space); with fewer
    words, the whole sequence as one; without words or text it is empty and links with nothing. Documents link when
    100 * intersection >= 75 * union; sets are compared by 64-bit shingle hashes.

    Equal sets are one class, found by two hashes of the set (48 and 64 bits) and named after its smallest doc_id, so copies cost
    nothing but their row. Sets that share a signature in runs of up to 32 are candidate pairs: each pair is verified and
    only then joins components, so sets that meet by chance cost one comparison and chain to nothing. Longer runs (many
    near copies, or texts made of common passages) are compared in blocks over an inverted index, without a row a pair. So
    components are exact, and links in a dense group of near copies cost no rows. Only the texts of sets that met others
    are read again; texts are never shuffled unless over a million are asked for.

    Rows of a null doc_id link with nothing and have a null component; repeated rows are copies; of rows that share a doc_id
    but not a text, each takes part with its own text, as one node where that id names both; ties go to the smallest
    doc_id; empty tables give empty results; other columns are ignored.
    """
    held = held or Held(docs.sparkSession, "jaccard")
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    both = held.put(docs.mapInPandas(trimmed(_described("doc_id")), f"doc_id {kind}, n long, h long, g long, block int, counts binary"), "described")
    described = both.filter("block < 0").select("doc_id", "n", "h", "g")
    heavy = docs.sparkSession.sparkContext.broadcast(frequent(both.filter("block >= 0").select("block", "counts"), held))
    parts = max(4, (described.agg(F.sum("n")).first()[0] or 0) // PART)
    blobs = docs.filter("doc_id is not null").mapInPandas(trimmed(_packed(parts, heavy)), "part int, ids binary, low binary")
    seen = blobs.repartition(parts, "part").groupBy("part").applyInPandas(_meeting(RUN), MET)
    seen = held.put(seen.groupBy("long", "ah", "bh").agg(F.min("c").alias("c")), "met")
    heavy.unpersist()

    known = described.filter("n > 0 and doc_id is not null")
    classes = held.put(known.groupBy("h", "g").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.count(F.lit(1)).alias("rows")), "classes")
    shared = classes.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.lit(False), "h", "h", "h")  # different sets of one first hash
    seen = held.put(seen.unionByName(shared.toDF("long", "ah", "bh", "c")), "met")
    asked = seen.select(F.explode(F.array("ah", "bh")).alias("_h")).distinct()
    names = held.put(asked.join(classes, F.col("_h") == F.col("h")).select("_h", "rep", "n"), "names")
    seen = held.put(_renamed(_renamed(seen, names, "a"), names, "b").filter("a <> b and 4 * least(na, nb) >= 3 * greatest(na, nb) or long"), "named")
    near = seen.filter("not long").select("a", "b", "c", ((F.col("na") + F.col("nb")) * 8).alias("bytes"))
    stars = seen.filter("long")
    edges = None
    if not stars.isEmpty():
        clumps = _clumps(stars, held)
        inside = clumps.select(F.col("a").alias("_a"), F.col("clump").alias("_one")), clumps.select(F.col("a").alias("_b"), F.col("clump").alias("_two"))
        near = near.join(inside[0], F.col("a") == F.col("_a"), "left").join(inside[1], F.col("b") == F.col("_b"), "left").filter("_one is null or _two is null or _one <> _two").select("a", "b", "c", "bytes")
        edges = held.put(_search(docs, clumps, held, kind), "inside")
    near = held.put(_pairs(docs, held.put(near, "near"), held, kind), "linked")
    edges = near if edges is None else near.unionByName(edges)
    comps = held.put(components(edges, held), "components")

    low = classes.join(comps, F.col("rep") == F.col("node"), "left").filter("rows > 1 or comp is not null")
    low = held.put(low.select(F.col("h").alias("_h"), F.col("g").alias("_g"), F.coalesce("comp", "rep").alias("low"), "rows"), "low")
    held.drop(seen, names, near, classes)
    on = (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g"))
    if low.count() <= BROADCAST_IDS // 4:
        named = known.join(F.broadcast(low), on, "left")
    else:  # a class of many copies is joined without a shuffle on its key; at most one row in 100,000 is of such a class
        hot = low.filter("rows > 100000")
        named = known.join(F.broadcast(hot), on).unionByName(known.join(F.broadcast(hot), on, "left_anti").join(low.filter("rows <= 100000"), on, "left"))
    out = named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id"))
    return out.unionByName(described.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _renamed(seen: DataFrame, names: DataFrame, side: str) -> DataFrame:
    """seen with the first hash of a set (side h) replaced by its class's name (side) and size (n side)."""
    one = names.select(F.col("_h").alias(f"_{side}h"), F.col("rep").alias(side), F.col("n").alias(f"n{side}"))
    return seen.join(one, F.col(f"{side}h") == F.col(f"_{side}h")).drop(f"{side}h", f"_{side}h")


def one_each(docs: DataFrame) -> DataFrame:
    """One row of each component, of the document with the smallest doc_id, with all its columns.

    Of rows that repeat that doc_id, one stays, the smallest by its columns' hash. Rows of a null doc_id stay; so do
    documents without words, once for each doc_id. An empty table gives an empty result.
    """
    held = Held(docs.sparkSession, "jaccard")
    rows = held.put(near_duplicates(docs, held=held), "rows")
    extra = held.put(rows.filter("doc_id <> component_id").select("doc_id").distinct(), "extra")
    left = by_ids(docs, extra, "left_anti")
    twice = held.put(rows.filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated")
    if twice.isEmpty():
        return left
    names = list(docs.columns)
    keep = by_ids(left, twice, "left_anti")
    again = by_ids(left, twice, "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("_row"))
    return keep.unionByName(again.select("_row.*"))
