"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.ship import ship

PAD = b"\n\n\n"  # before each text, as context of its first bytes
CHUNK = 1 << 19


def _grams(raw: bytes) -> np.ndarray:
    """Each byte with the three before it, as one number."""
    b = np.frombuffer(PAD + raw, np.uint8).astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, text) rows -> (lang, gram, n), summed up within a batch."""
    for pdf in batches:
        for lang, part in pdf.groupby("lang", sort=True):
            texts = [t.lower().encode("utf-8", "replace") for t in part["text"] if t]
            if texts:
                grams, n = np.unique(np.concatenate([_grams(t) for t in texts]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": grams.astype(np.int64), "n": n.astype(np.int64)})


@dataclass(frozen=True)
class Tree:
    """The contexts of one order in one language: sorted sequences with their code lengths, sorted contexts with their escapes'."""

    seen: np.ndarray  # context and symbol
    bits: np.ndarray
    contexts: np.ndarray
    escape: np.ndarray

    def lookup(self, grams: np.ndarray, below) -> np.ndarray:
        """Code lengths of grams; below gives those of the shorter context, for the grams that were never seen."""
        out, miss = _found(self.seen, self.bits, grams)
        if miss.any():
            rest = grams[miss]
            out[miss] = _found(self.contexts, self.escape, rest >> 8)[0] + below(rest)
        return out


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the asked keys, 0 for those that are not there; and which are not."""
    if not len(keys):
        return np.zeros(len(asked)), np.ones(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    miss = keys[at] != asked
    return np.where(miss, 0.0, values[at]), miss


def _tree(grams: np.ndarray, n: np.ndarray) -> Tree:
    """Escape method C: a symbol seen n times of N in a context with d distinct ones has n / (N + d), the escape d / (N + d).

    Symbols already seen are not excluded below; a context never seen hands on with probability 1.
    """
    seen, at = np.unique(grams, return_inverse=True)
    count = np.bincount(at, n, len(seen))
    contexts, of, kinds = np.unique(seen >> 8, return_inverse=True, return_counts=True)
    whole = np.bincount(of, count, len(contexts)) + kinds
    return Tree(seen.astype(np.uint32), -np.log2(count / whole[of]), contexts.astype(np.uint32), -np.log2(kinds / whole))


@dataclass(frozen=True)
class Model:
    """For each language its trees of orders 3, 2, 1 and 0, with every context of the learned texts."""

    langs: tuple[str, ...]
    trees: tuple[tuple[Tree, ...], ...]

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        """Exact code lengths of the last bytes of four-byte sequences, sequences x languages."""

        def of(trees: tuple[Tree, ...], some: np.ndarray) -> np.ndarray:
            if not trees:
                return np.full(len(some), 8.0)  # below order 0 every byte is alike
            wide = some & np.uint32((1 << 8 * len(trees)) - 1) if len(trees) < 4 else some
            return trees[0].lookup(wide, lambda rest: of(trees[1:], rest))

        return np.stack([of(t, grams) for t in self.trees], 1) if len(grams) else np.zeros((0, len(self.langs)))


def build(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """Freezes the trees of all languages: sorted arrays, whose size grows with the distinct sequences of the texts only."""
    trees = []
    for k in range(len(langs)):
        own, count = gram[lang == k].astype(np.int64), n[lang == k].astype(np.float64)
        trees.append(tuple(_tree(own & ((1 << 8 * order) - 1), count) for order in (4, 3, 2, 1)))
    return Model(tuple(langs), tuple(trees))


def learn(rows: DataFrame, most_texts: int = 1500) -> Model | None:
    """rows (doc_id, text, lang) -> model, from about most_texts whole texts a language at most, chosen by a hash of the id.

    The counts that reach the driver are bounded by the distinct four-byte sequences of that sample; none is left out.
    """
    rows = rows.filter("lang is not null and text is not null and text <> ''")
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return None
    keep = F.lit(False)
    for lang, count in sorted(n.items()):
        keep = keep | ((F.col("lang") == lang) & (F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most_texts / count))))
    grams = rows.filter(keep).select("lang", "text").mapInPandas(count_grams, "lang string, gram long, n long")
    got = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas().sort_values(["lang", "gram"])
    langs = sorted(got["lang"].unique())
    if not langs:
        return None
    return build(langs, got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64), got["gram"].to_numpy(np.int64), got["n"].to_numpy(np.int64))


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each text in each language, texts x languages."""
    out = np.zeros((len(texts), len(model.langs)))
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK):
            size += len(texts[j])
            j += 1
        joined = b"".join(x for t in texts[i:j] for x in (PAD, t))
        ends = np.cumsum([len(t) + 3 for t in texts[i:j]])
        doc = np.zeros((j - i, len(model.langs)))
        for lo in range(0, len(joined) - 3, CHUNK):
            grams, at = np.unique(_grams(joined[lo : lo + CHUNK + 3])[3:], return_inverse=True)
            sums = np.concatenate([np.zeros((1, len(model.langs))), np.cumsum(model.lookup(grams)[at], axis=0)])
            first = np.clip(np.concatenate([[0], ends[:-1]]) - lo, 0, len(at))  # position p of sums: byte lo + p + 3
            last = np.clip(ends - 3 - lo, 0, len(at))
            doc += sums[np.maximum(last, first)] - sums[first]
        out[i:j] = doc
        i = j
    return out


def _predict(shared, key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            known = [bool(model) and any(map(str.isalpha, t)) for t in texts]
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            at = [i for i, k in enumerate(known) if k]
            for lo in range(0, len(at), 256):
                part = at[lo : lo + 256]
                bits = code_lengths(model, [texts[i].lower().encode("utf-8", "replace") for i in part])
                best = bits.argmin(1)
                odds = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                for i, b, o in zip(part, best, odds, strict=True):
                    pred[i], score[i] = model.langs[b], 1 / o
            yield pd.DataFrame({key: pdf[key], "held_out": pdf["held_out"], "lang_pred": pred, "score": score})

    return run


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, most_texts: int = 1500) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row a document, from its whole text, lower-cased, as UTF-8 bytes.

    score is the posterior of the predicted language under equal priors, from the exact code lengths. Learned from rows
    that are not held out and have a lang and a text. Null texts and texts without a letter (Unicode L): 'und' with score 0, and all
    texts if nothing could be learned. Ties go to the first language by name; repeated rows are alike; other columns are
    ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = learn(rows.filter(~F.col("held_out")), most_texts)
    shared = spark.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "held_out").mapInPandas(_predict(shared, "doc_id"), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
