"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Held, components

CELLS = 16  # projections in a key, four bits each
CELL = 0.8  # width of a projection's cell; vectors with cosine 0.98 lie 0.2 apart
MEET = 0.8  # chance that vectors 0.2 apart fall into one cell
COMMON = 0x7FFF  # int16 components at full scale


def _planes(dim: int, turn: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, turn, dim])
    return rng.standard_normal((dim, CELLS)), rng.random(CELLS)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; scaling by the largest component first keeps squares finite."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _matrix(blobs: pd.Series, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), dim)


def keys(u: np.ndarray, turn: int, seed: int) -> np.ndarray:
    """The concatenated cells of the random projections of unit vectors, the first in the highest bits."""
    planes, shift = _planes(u.shape[1], turn, seed)
    cells = np.clip(np.floor(u @ planes / CELL + shift), -8, 7).astype(np.int64)
    return cells @ (1 << np.arange(4 * CELLS - 4, -1, -4, dtype=np.int64))


def _cleaned(kind: str):
    """(vec_id, label, embedding) -> row, vec_id, label, dim, v (null if it can link with nothing), two hashes of v."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            blobs: list[bytes | None] = []
            for e, label, key in zip(pdf["embedding"], pdf["label"], pdf["vec_id"], strict=True):
                ok = e is not None and len(e) and not pd.isna(label) and not pd.isna(key)
                x = np.array([np.nan if c is None else c for c in e], kind) if ok else None
                blobs.append((x + 0.0).astype(kind).tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            size = np.dtype(kind).itemsize
            marks = [blake2b(b, digest_size=16).digest() if b else bytes(16) for b in blobs]
            h = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "label": pdf["label"], "dim": [len(b) // size if b else 0 for b in blobs], "v": blobs, "h": h[:, 0], "g": h[:, 1]})

    return run


def _summed(kind: str):
    """(label, dim, v) -> sums of unit vectors of a batch, by label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (label, dim), part in pdf.groupby(["label", "dim"], sort=True):
                yield pd.DataFrame({"label": [label], "dim": [dim], "n": [len(part)], "at": [list(range(dim))], "s": [unit(_matrix(part["v"], dim, kind)).sum(0)]})

    return run


def _keyed(kind: str, turns: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim", sort=True):
                u = unit(_matrix(part["v"], dim, kind))
                every = np.stack([keys(u, turn, seed) for turn in range(turns)], 1)
                yield pd.DataFrame({"row": part["row"], "keys": list(every)})

    return run


def passes(n: int, spread: float, window: int, miss: float = 1e-3) -> int:
    """Passes after which a pair at the threshold was never within the window with chance `miss`, in a label of n vectors.

    A key's first cells cut the label down to about `window` rows; each cell holds log2(sqrt(2 pi e) spread / CELL) bits
    (spread: the vectors' deviation from the label's mean, 1 if they have no common direction) and parts the pair with
    chance 1 - MEET. Labels so narrow that a cell holds little count as half a bit a cell.
    """
    if n <= window:
        return 1
    bits = max(0.65, math.log2(math.sqrt(2 * math.pi * math.e) * max(spread, 1e-9) / CELL))
    together = (window / n) ** (-math.log2(MEET) / bits)
    return max(1, math.ceil(math.log(miss) / math.log1p(-min(together, 1 - 1e-9))))


def _quantised(kind: str):
    """Vectors as int16 shares of their largest component, with the scale to length 1: half the bytes of float32."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for b, dim in zip(pdf["v"], pdf["dim"], strict=True):
                x = np.frombuffer(b, kind)[:dim].astype(np.float64)
                out.append(np.round(x / np.abs(x).max() * COMMON).astype(np.int16).tobytes())
            yield pd.DataFrame({"rep": pdf["rep"], "label": pdf["label"], "dim": pdf["dim"], "q": out, "blocks": pdf["blocks"]})

    return run


def _forest(n: int, pairs: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """A spanning forest of the pairs over 0..n-1, and the tree of each."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out, [find(x) for x in range(n)]


def _windowed(least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Pairs of a block that link, thinned to a spanning forest; and those between its trees that int16 leaves open (sure: false).

        Own rows are compared with all rows of the block and of its halo. A component is rounded by half a step at most, so
        a cosine is off by less than 2 sqrt(dim) steps, a step being the largest component's share of a vector of length 1.
        """
        out = []
        for dim, part in pdf.sort_values("own", ascending=False, kind="stable").groupby("dim", sort=False):
            u = unit(_matrix(part["q"], dim, "int16")).astype(np.float32)
            slack = 2 * math.sqrt(dim) * float(np.abs(u).max()) / COMMON + 1e-6
            names, rep, own = part["label"].to_numpy(), part["rep"].to_numpy(np.int64), int(part["own"].sum())
            label = np.unique(names.astype(str), return_inverse=True)[1]
            sure, near = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
            for lo in range(0, own, 256):
                i, j = np.nonzero(u[lo : min(lo + 256, own)] @ u[lo:].T >= least - slack)
                i, j = i + lo, j + lo
                keep = (i < j) & (label[i] == label[j]) & (rep[i] != rep[j])
                i, j = i[keep], j[keep]
                cos = np.einsum("ij,ij->i", u[i].astype(np.float64), u[j].astype(np.float64))
                sure.append(np.stack([i, j], 1)[cos >= least + slack])
                near.append(np.stack([i, j], 1)[cos < least + slack])
            forest, tree = _forest(len(u), np.concatenate(sure))
            out += [(rep[a], rep[b], True) for a, b in forest]
            out += [(rep[a], rep[b], False) for a, b in np.concatenate(near) if tree[a] != tree[b]]
        return pd.DataFrame([(min(a, b), max(a, b), s) for a, b, s in out], columns=["a", "b", "sure"]).astype({"a": np.int64, "b": np.int64, "sure": bool}).drop_duplicates()

    return run


def _counted(least: float, kind: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of the rows of each component in a group: all against all, or side 0 against side 1 of a large one."""
        out = []
        for (_, label, dim), part in pdf.groupby(["comp", "label", "dim"], sort=False):
            u, n, node = unit(_matrix(part["v"], int(part["dim"].iloc[0]), kind)), part["cnt"].to_numpy(np.float64), part["rep"].to_numpy(np.int64)
            if part["i"].iloc[0] == part["j"].iloc[0]:
                links = np.zeros(len(u))
                for lo in range(0, len(u), 512):
                    links[lo : lo + 512] = (u[lo : lo + 512] @ u.T >= least) @ n
                own = np.einsum("ij,ij->i", u, u) >= least
                out.append(pd.DataFrame({"rep": node, "label": label, "dim": dim, "links": links - own * n}))
            else:
                left = (part["side"] == 0).to_numpy()
                g = u[left] @ u[~left].T >= least
                out.append(pd.DataFrame({"rep": node[left], "label": label, "dim": dim, "links": g @ n[~left]}))
                out.append(pd.DataFrame({"rep": node[~left], "label": label, "dim": dim, "links": g.T @ n[left]}))
        both = pd.concat(out)
        return both.assign(links=both["links"].round().astype(np.int64))

    return run


def _blocks(keyed: DataFrame, held: Held, window: int, block: int) -> DataFrame:
    """(row, blocks): the rows of (turn, label, dim, key, row) in that order, cut into blocks of equal size, each with the next window rows.

    blocks: negative -b - 1 where the row belongs to the halo of block b.
    """
    order = ["turn", "label", "dim", "key", "row"]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("row", F.monotonically_increasing_id().alias("mid"))
    placed = held.put(placed, "sorted").withColumns({"pid": F.shiftright("mid", 33), "at": F.col("mid").bitwiseAND((1 << 33) - 1)})
    sizes = placed.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of the sort
    sizes = sizes.select(F.col("pid").alias("_pid"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    rows = placed.join(F.broadcast(sizes), F.col("pid") == F.col("_pid")).withColumn("rank", F.col("at") + F.col("n0"))
    own = F.expr(f"rank div {block}")
    halo = F.when((F.col("rank") % block < window) & (own > 0), F.array(own, -own)).otherwise(F.array(own))
    return rows.select("row", halo.alias("b")).groupBy("row").agg(F.flatten(F.collect_list("b")).alias("blocks"))


def dedup(vectors: DataFrame, least: float = 0.98, window: int = 1024, block: int = 8192, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row a vector.

    Vectors link when their labels are equal and not null, their lengths are equal, and their cosine in double precision is
    at least `least`. Exactly equal vectors of a label (by a 128-bit hash) are merged first and counted. In each pass the
    rest is ordered by the concatenated cells of 16 random projections, and every vector is compared with the next `window`
    in the order at least; links of all passes are united. How many passes it takes follows from the counted vectors and
    the measured spread of every label (passes): a pair at the very threshold is missed with a chance of about 1 in 1,000,
    at any size of a label, and labels of up to `window` vectors are compared whole. Keys alone are sorted; a vector goes
    once to each block that compares it, as int16, and pairs nearer to the threshold than that rounding are verified in
    double precision. Inside a component all vectors are compared in double precision, so n_links counts all its links,
    however dense they are, and emits counts, not pairs.

    Null labels or ids, null, empty or zero vectors and vectors with null or non-finite components link with nothing: no
    links, their own component, kept (a null id: null component, not kept). Rows that repeat an id with an equal vector
    count each other as links. Ties in the order go by row. Empty tables give empty results; other columns are ignored.
    """
    spark = vectors.sparkSession
    held = Held(spark, "vectors")
    kind = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    number = "float32" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "float64"
    cleaned = vectors.select("vec_id", "label", "embedding").mapInPandas(_cleaned(number), f"vec_id {kind['vec_id']}, label {kind['label']}, dim int, v binary, h long, g long")
    rows = held.put(cleaned.withColumn("row", F.monotonically_increasing_id()), "rows")
    live = rows.filter("v is not null")
    same = live.groupBy("label", "dim", "h", "g").agg(F.min("vec_id").cast("long").alias("rep"), F.min("row").alias("first"), F.count(F.lit(1)).alias("cnt"))
    same = held.put(same, "same")
    sizes = same.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("distinct"))
    sums = live.select("label", "dim", "v").mapInPandas(_summed(number), f"label {kind['label']}, dim int, n long, at array<int>, s array<double>")
    sums = sums.select("label", "dim", "n", F.explode(F.arrays_zip("at", "s")).alias("x")).groupBy("label", "dim", "x.at").agg(F.sum("x.s").alias("s"), F.sum("n").alias("n"))
    sums = sums.groupBy("label", "dim").agg(F.sum(F.pow(F.col("s") / F.col("n"), 2)).alias("mean2")).withColumnsRenamed({"label": "_l", "dim": "_d"})
    shape = sizes.join(sums, (F.col("label") == F.col("_l")) & (F.col("dim") == F.col("_d")))
    rough = F.expr("floor(log2(distinct) * 4)"), F.expr("floor(sqrt(greatest(0.0, 1 - mean2)) * 20)")  # some hundred kinds of labels at most
    shapes = shape.groupBy(rough[0].alias("k"), rough[1].alias("r")).agg(F.max("distinct").alias("n"), F.min(F.expr("sqrt(greatest(0.0, 1 - mean2))")).alias("spread")).collect()
    turns = max((passes(r["n"], r["spread"], window) for r in shapes), default=1)

    keyed = live.select("row", "dim", "v").mapInPandas(_keyed(number, turns, seed), "row long, keys array<long>").withColumnRenamed("row", "_row")
    keyed = same.select("label", "dim", F.col("first").alias("row")).join(keyed, F.col("row") == F.col("_row")).select("row", "label", "dim", "keys")
    keyed = held.put(keyed, "keys")  # the range sort reads it twice
    blocks = _blocks(keyed.select("row", "label", "dim", F.posexplode("keys").alias("turn", "key")), held, window, block).withColumnRenamed("row", "_row")
    named = blocks.join(same.select("first", "rep"), F.col("_row") == F.col("first")).select("_row", "rep", "blocks")
    packed = live.select("row", "label", "dim", "v").join(named, F.col("row") == F.col("_row")).select("rep", "label", "dim", "v", "blocks")
    packed = packed.mapInPandas(_quantised(number), f"rep long, label {kind['label']}, dim int, q binary, blocks array<long>").select("rep", "label", "dim", "q", F.explode("blocks").alias("b"))
    packed = packed.select("rep", "label", "dim", "q", F.when(F.col("b") < 0, -F.col("b") - 1).otherwise(F.col("b")).alias("block"), (F.col("b") >= 0).alias("own"))
    edges = held.put(packed.groupBy("block").applyInPandas(_windowed(least), "a long, b long, sure boolean").distinct(), "edges")
    vecs = live.select("row", "v").join(same, F.col("row") == F.col("first")).select("rep", "label", "dim", "cnt", "v")
    doubt = edges.filter("not sure")
    sure = edges.filter("sure").select("a", "b")
    if not doubt.isEmpty():
        one, two = (vecs.select(F.col("rep").alias(f"_{x}"), F.col("v").alias(f"v{x}"), F.col("label").alias(f"l{x}"), F.col("dim").alias(f"d{x}")) for x in "ab")
        both = doubt.join(one, F.col("a") == F.col("_a")).join(two, (F.col("b") == F.col("_b")) & (F.col("la") == F.col("lb")) & (F.col("da") == F.col("db")))

        @F.pandas_udf("boolean")
        def links(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([bool(unit(np.frombuffer(a, number)[None])[0] @ unit(np.frombuffer(b, number)[None])[0] >= least) for a, b in zip(x, y, strict=True)])

        sure = sure.unionByName(held.put(both.filter(links("va", "vb")).select("a", "b"), "verified"))
    comps = held.put(components(sure, held), "components")
    held.drop(edges)

    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    total = comps.count()
    parts = max(1, total // 500)
    nodes = vecs.join(comps, F.col("rep") == F.col("node")).join(sizes, "comp").withColumn("cuts", F.expr("greatest(least(16, (size + 255) div 256), (size + 4095) div 4096)").cast("int"))
    nodes = nodes.select("comp", "rep", "cnt", "label", "dim", "v", "cuts", F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int").alias("cut"))
    nodes = nodes.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    nodes = nodes.select("comp", "rep", "cnt", "label", "dim", "v", F.least("cut", "t").alias("i"), F.greatest("cut", "t").alias("j"), (F.col("cut") > F.col("t")).cast("int").alias("side"), "cuts")
    group = F.when(F.col("cuts") > 1, F.xxhash64("comp", "i", "j")).otherwise(F.pmod(F.xxhash64("comp"), F.lit(parts)))
    nodes = nodes.withColumns({"of": group, "large": F.col("cuts") > 1, "gi": F.when(F.col("cuts") > 1, F.col("i")), "gj": F.when(F.col("cuts") > 1, F.col("j"))})
    links = nodes.groupBy("large", "of", "gi", "gj").applyInPandas(_counted(least, number), f"rep long, label {kind['label']}, dim int, links long")
    links = links.groupBy("rep", "label", "dim").agg(F.sum("links").alias("links")).withColumnsRenamed({"rep": "_rep", "label": "_label", "dim": "_dim"})

    same = same.join(comps, F.col("rep") == F.col("node"), "left").join(links, (F.col("rep") == F.col("_rep")) & (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim")), "left")
    same = same.select("h", "g", "label", "dim", "cnt", (F.coalesce("links", F.lit(0)) + F.col("cnt") - 1).alias("n"), F.coalesce("comp", "rep").alias("c"))
    marked = held.put(same.filter("cnt > 1 or n > 0").withColumnsRenamed({"h": "_h", "g": "_g", "label": "_label", "dim": "_dim"}), "links")
    ids = rows.select("vec_id", "label", "dim", "h", "g", F.col("v").isNotNull().alias("live"))
    on = (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")) & (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim"))
    if marked.count() <= 200_000:
        out = ids.join(F.broadcast(marked), on, "left")
    else:  # a vector of very many copies is joined without a shuffle on it; at most one row in 100,000 is of such a class
        hot = marked.filter("cnt > 100000")
        out = ids.join(F.broadcast(hot), on).unionByName(ids.join(F.broadcast(hot), on, "left_anti").join(marked.filter("cnt <= 100000"), on, "left"))
    component = F.coalesce(F.when(F.col("live"), F.col("c")), F.col("vec_id").cast("long"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
