"""Document quality by pairwise ranking: a Bradley-Terry model learns scores from preference pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Held, by_ids, trimmed

N_FEATURES = 17
_CLASS = np.zeros(256, np.int64)  # of a byte: 0 other, 1 a-z, 2 A-Z, 3 digit, 4 space or tab, 5 line end, 6 .,;:'"()-, 7 !?, 8 other ASCII sign, 9 part of a non-ASCII letter, 10 control
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 9 if _b >= 128 else 1 if "a" <= _c <= "z" else 2 if "A" <= _c <= "Z" else 3 if "0" <= _c <= "9" else 4 if _c in " \t" else 5 if _c in "\r\n" else 6 if _c in ".,;:'\"()-" else 7 if _c in "!?" else 10 if _b < 32 or _b == 127 else 8


def features(text: str | None) -> np.ndarray:
    """Shares of kinds of bytes, words, repeats and line shapes of a whole text; all 0 for a null or empty one."""
    out = np.zeros(N_FEATURES, np.float32)
    if not text:
        return out
    raw = text.encode("utf-8", "replace")
    kinds = np.bincount(_CLASS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), 11)
    n = len(raw)
    words = raw.split()
    w = max(len(words), 1)
    lower = raw.lower().split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = max(kinds[1] + kinds[2] + kinds[9], 1)
    out[0] = kinds[2] / letters
    out[1] = kinds[3] / n
    out[2] = kinds[6] / n
    out[3] = kinds[7] / n
    out[4] = kinds[8] / n
    out[5] = kinds[10] / n
    out[6] = (kinds[4] + kinds[5]) / n
    out[7] = min(n / w, 30) / 30
    out[8] = len(set(lower)) / w
    out[9] = np.log1p(w) / 12
    out[10] = len(set(lower)) / np.sqrt(w) / 16
    out[11] = 1 - len(set(lines)) / max(len(lines), 1)
    out[12] = min(len(lines) / w, 1)
    out[13] = sum(1 for x in words if len(x) == 1 and not x.isalnum()) / w
    out[14] = 1 - len(set(zip(lower, lower[1:], strict=False))) / max(w - 1, 1)
    out[15] = kinds[9] / n
    out[16] = sum(x == y for x, y in zip(lower, lower[1:], strict=False)) / w
    return out


@F.pandas_udf(T.ArrayType(T.FloatType()))
def features_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from trimmed(lambda some: (pd.Series([features(t) for t in texts]) for texts in some))(batches)


def standard(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    return np.clip((x.astype(np.float64) - mean) / std, -8, 8)


def weighed(z: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """z @ weight, added up column by column: a row gets the same bits in whatever batch it comes."""
    out = np.zeros(len(z))
    for k in range(N_FEATURES):
        out += z[:, k] * weight[k]
    return out


@dataclass(frozen=True)
class Ranker:
    """score = logistic(scale * (w.x - cut) + logit(at)): the raw score at the cut quantile scores exactly `at`."""

    mean: np.ndarray
    std: np.ndarray
    weight: np.ndarray
    cut: float
    scale: float
    at: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return weighed(standard(x, self.mean, self.std), self.weight)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (self.raw(x) - self.cut) + np.log(self.at / (1 - self.at)), -40, 40)))


# The model is fitted in passes over all rows. A part turns rows (x, y) into keys and int64 values, a total adds the values up
# by key. Fractions are counted in fixed units, so that sums are exact and no order or layout of the rows changes the model.
Part = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
Total = Callable[[Part, int], tuple[np.ndarray, np.ndarray]]
_FINE, _COARSE, _UNIT, _ROUGH, _SHIFT = 64, 4, 2.0**24, 2.0**10, 1 << 30  # bins a unit of raw score, the same for curvature; units of z, of its products; bins are kept above 0


def _tally(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(values[order], first)


def _moments(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return y, np.rint(np.column_stack([np.ones(len(y)), x * 2.0**30, x * x * 2.0**30])).astype(np.int64)


def _pair_part(mean: np.ndarray, std: np.ndarray, w: np.ndarray) -> Part:
    """Of each label and bin of raw score: count and sums of z (row 31 of the key); of each coarse bin: sums of z's products.

    A row is shared by the two bins around its raw score, the nearer one taking more: reading between bins is linear so.
    """

    def part(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = standard(x, mean, std)
        raw = weighed(z, w) * _FINE
        at = np.floor(raw).astype(np.int64)
        whole = np.column_stack([np.ones(len(y)), z]) * _UNIT
        upper, whole = np.rint(whole * (raw - at)[:, None]).astype(np.int64), np.rint(whole).astype(np.int64)
        keys = ((at + _SHIFT) * 2 + y) * 32 + 31
        keys, sums = _tally(np.r_[keys, keys + 64], np.r_[whole - upper, upper])
        q = np.rint(z * _ROUGH).astype(np.int64)
        groups, products = _tally(((at // (_FINE // _COARSE) + _SHIFT) * 2 + y) * 32, q[:, :, None] * q[:, None, :])
        rows = np.zeros((len(groups) * N_FEATURES, N_FEATURES + 1), np.int64)
        rows[:, 1:] = products.reshape(-1, N_FEATURES)
        return np.r_[keys, (groups[:, None] + np.arange(N_FEATURES)).ravel()], np.r_[sums, rows]

    return part


def _slopes(keys: np.ndarray, sums: np.ndarray, w: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log likelihood of all pairs of a label-1 and a label-0 row, less the ridge, its gradient and its curvature.

    A pair's chance depends on the difference of two raw scores only, so all pairs of two bins are taken at once.
    """
    row, label, at = keys & 31, keys >> 5 & 1, (keys >> 6) - _SHIFT
    fine = row == 31
    low = at[fine].min()
    n, z = np.zeros((2, at[fine].max() - low + 1)), np.zeros((2, at[fine].max() - low + 1, N_FEATURES))
    n[label[fine], at[fine] - low], z[label[fine], at[fine] - low] = sums[fine, 0] / _UNIT, sums[fine, 1:] / _UNIT
    pairs = n[0].sum() * n[1].sum()
    d = np.arange(1 - n.shape[1], n.shape[1]) / _FINE  # raw score of the label-0 row less that of the label-1 row
    lose = 1 / (1 + np.exp(-np.clip(d, -40, 40)))
    value = -np.correlate(np.logaddexp(0, d), n[0], "valid")[::-1] @ n[1] / pairs - ridge / 2 * (w @ w)
    g = (np.correlate(lose, n[0], "valid")[::-1] @ z[1] - np.convolve(lose, n[1], "valid") @ z[0]) / pairs - ridge * w

    step = _FINE // _COARSE
    low, size = low // step, at[fine].max() // step - low // step + 1
    into = (np.arange(n.shape[1]) + at[fine].min()) // step - low
    n2, z2, zz = np.zeros((2, size)), np.zeros((2, size, N_FEATURES)), np.zeros((2, size, N_FEATURES, N_FEATURES))
    np.add.at(n2, (slice(None), into), n)
    np.add.at(z2, (slice(None), into), z)
    zz[label[~fine], at[~fine] - low, row[~fine]] = sums[~fine, 1:] / _ROUGH**2
    bend = 1 / (2 + 2 * np.cosh(np.clip(np.arange(1 - size, size) / _COARSE, -40, 40)))  # logistic'(d), even in d
    near = [np.convolve(bend, n2[k], "valid") for k in (0, 1)]
    cross = z2[1].T @ np.column_stack([np.convolve(bend, z2[0][:, k], "valid") for k in range(N_FEATURES)])
    h = np.tensordot(near[0], zz[1], 1) + np.tensordot(near[1], zz[0], 1) - cross - cross.T
    return float(value), g, h / pairs + ridge * np.eye(N_FEATURES)


def _digit_part(model: Ranker, prefixes: list[int], shift: int, width: int) -> Part:
    """Counts of the `width` bits above `shift` among raw scores, as integers of the same order, that begin with each prefix."""

    def part(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = (model.raw(x) + 0.0).view(np.uint64)
        bits = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63)) >> np.uint64(shift)
        keys = [(bits[bits >> np.uint64(width) == np.uint64(p)] & np.uint64((1 << width) - 1)).astype(np.int64) + (i << width) for i, p in enumerate(prefixes)]
        return np.concatenate(keys), np.ones((sum(map(len, keys)), 1), np.int64)

    return part


def _at_ranks(total: Total, model: Ranker, ranks: list[int], few: int = 50_000) -> np.ndarray:
    """The raw scores of all rows at these 0-based ranks, found 16 bits a pass, or all that are left once `few` rows share the bits found."""
    ranks, found = list(ranks), [0] * len(ranks)
    shift, width = 48, 16
    while True:
        keys, counts = total(_digit_part(model, found, shift, width), 1)
        left = 0
        for i in range(len(ranks)):
            mine = keys >> width == i
            reach = np.cumsum(counts[mine, 0])
            j = int(np.searchsorted(reach, ranks[i], side="right"))
            ranks[i] -= int(reach[j - 1]) if j else 0
            found[i] = found[i] << width | int(keys[mine][j]) & (1 << width) - 1
            left += int(counts[mine][j, 0])
        if not shift:
            return np.array([b ^ 1 << 63 if b >> 63 else b ^ (1 << 64) - 1 for b in found], np.uint64).view(np.float64)
        width = shift if left <= few else 16
        shift -= width


def _fit(total: Total, at: float, share_low: float | None = None, ridge: float = 1e-3) -> Ranker:
    keys, sums = total(_moments, 1 + 2 * N_FEATURES)
    n = {int(k): int(v) for k, v in zip(keys, sums[:, 0], strict=True)}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    rows = n0 + n1
    mean, square = (sums.sum(0)[1:] / 2.0**30 / rows).reshape(2, N_FEATURES) if rows else np.zeros((2, N_FEATURES))
    std = np.maximum(np.sqrt(np.maximum(square - mean**2, 0)), 1e-3) if rows else np.ones(N_FEATURES)
    if not n0 or not n1:
        return Ranker(mean, std, np.zeros(N_FEATURES), 1.0 if n0 else -1.0, 3.0, at)
    w, step, best = np.zeros(N_FEATURES), np.zeros(N_FEATURES), -np.inf
    for _ in range(30):
        value, g, h = _slopes(*total(_pair_part(mean, std, w), N_FEATURES + 1), w, ridge)
        if value < best - 1e-9:  # a step too far: back by half of it
            step = step / 2
            w = w - step
        else:
            best, step = value, np.linalg.solve(h, g)
            w = np.round(w + step, 9)
        if np.abs(step).max() < 1e-6:
            break
    k = min(max((n0 if share_low is None else round(share_low * rows)) - 1, 0), rows - 2)
    cut = _at_ranks(total, Ranker(mean, std, w, 0.0, 1.0, at), [k, k + 1]).mean()
    return Ranker(mean, std, w, float(cut), 1.0, at)


def fit(x: np.ndarray, y: np.ndarray, share_low: float, at: float = 0.3, ridge: float = 1e-3) -> Ranker:
    """Bradley-Terry: P(i beats j) = logistic(w.(x_i - x_j)), fitted by Newton steps on all pairs of a label-1 and a label-0 row.

    The chances of pairs are read linearly between raw scores 1/64 apart. The cut is the quantile of the rows' raw scores at share_low, the share of label 0
    among them. With one label only, every row scores on its own side.
    """
    return _fit(lambda part, width: _tally(*part(x.astype(np.float64), y.astype(np.int64))), at, share_low, ridge)


def learn(rows: DataFrame, at: float = 0.3) -> Ranker:
    """As fit, on all rows (x array<float>, y int 0 or 1), which are best held: some 15 passes read them.

    Means, spreads, pairs and cut cover every row; the driver gets sums by bin of raw score, not rows.
    """

    def total(part: Part, width: int) -> tuple[np.ndarray, np.ndarray]:
        names = [f"v{i}" for i in range(width)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, sums = np.zeros(0, np.int64), np.zeros((0, width), np.int64)
            for b in batches:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).astype(np.float64)
                more, values = part(x, b.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
                keys, sums = _tally(np.r_[keys, more], np.r_[sums, values])
            yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(np.ascontiguousarray(c)) for c in sums.T]], ["k", *names])

        parts = rows.select("x", "y").mapInArrow(trimmed(run), ", ".join(f"{c} bigint" for c in ("k", *names)))
        got = parts.groupBy("k").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
        keys, *sums = [got.column(c).to_numpy().astype(np.int64) for c in ("k", *names)]
        return _tally(keys, np.column_stack(sums))

    return _fit(total, at)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _scores(model: Ranker):
    @F.pandas_udf(T.DoubleType())
    def scored(xs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in xs:
            x = np.array(s.tolist(), np.float32).reshape(len(s), N_FEATURES)
            yield pd.Series(model.score(x))

    return scored


def measured(docs: DataFrame, labels: DataFrame, at: float = 0.3) -> tuple[DataFrame, Ranker]:
    """(doc_id, x) of every document, held in the shared folder, and the ranker learned from all those with training labels.

    Only rows whose crc32(doc_id as text) mod 5 is not 0 are learned from. A document with several labels counts with its
    lowest; null labels or ids and labels other than 0 and 1 are left out.
    """
    held = Held(docs.sparkSession, "quality")
    x = held.put(docs.select("doc_id", features_udf(F.col("text")).alias("x")), "x")
    marks = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("y")).filter("y in (0, 1) and _id is not null").groupBy("_id").agg(F.min("y").alias("y"))
    marks = marks.filter(~held_out(F.col("_id")))
    rows = x.join(marks, F.col("doc_id") == F.col("_id")).select("x", "y")
    return x, learn(held.put(rows, "train"), at)


def score(docs: DataFrame, labels: DataFrame, at: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= at), one row a document.

    Null and empty texts have zero features and are scored like others; repeated rows score alike; a null doc_id is not
    held out and is never learned from; without labels of both kinds all rows fall on the side of the kind there is (keep,
    if none). Columns besides doc_id and text are ignored.
    """
    x, model = measured(docs, labels, at)
    out = x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), _scores(model)(F.col("x")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= at).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, at: float = 0.3) -> DataFrame:
    """The documents that score does not reject, with their own columns.

    Features for learning are taken of labelled documents only; all texts are scored in place, not shuffled.
    """
    held = Held(docs.sparkSession, "labelled")
    named = held.put(labels.filter("doc_id is not null").select("doc_id").distinct(), "ids")
    _, model = measured(by_ids(docs.select("doc_id", "text"), named, "left_semi"), labels, at)
    return docs.filter(_scores(model)(features_udf(F.col("text"))) >= at)
