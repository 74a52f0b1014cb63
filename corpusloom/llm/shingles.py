"""Texts as word runs, shingle sets, parity sketches and exact similarities.

A text's words are the runs of ``a-z0-9`` in its lower-cased form; a text of fewer than ``min_words`` words
is similar to nothing and is left out here. Similarity is the Jaccard index of the sets of ``k``-word runs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize

SKETCH_WORDS = 4  # the parity bitmap has 4 x 64 bits
SKETCH_BITS = 64 * SKETCH_WORDS
HOT = 2_000  # a join key of more rows than this on one side is spread over several tasks


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def text_classes(df: DataFrame, text: str, keep: list[str], min_words: int = 20) -> DataFrame:
    """``keep`` columns plus cls (digest of the word run) and w (64-bit hashes of the words) of each usable text.

    Null, empty and short texts give no row. Texts with the same words share ``cls`` whatever their layout,
    case or punctuation.
    """
    w = df.select(*keep, words(F.col(text)).alias("_w")).filter(F.size("_w") >= min_words)
    return w.select(*keep, F.unhex(F.md5(F.array_join("_w", " ").cast("binary"))).alias("cls"), F.transform("_w", lambda x: F.xxhash64(x)).alias("w"))


def representatives(classes: DataFrame) -> DataFrame:
    """One row (cls, w) per distinct text; copies are folded before the shuffle."""
    return classes.groupBy("cls").agg(F.first("w").alias("w"))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, in text order, repeats kept."""
    w = np.asarray(w, dtype=np.int64).view(np.uint64)
    if len(w) < k:
        return np.empty(0, np.uint64)
    n = len(w) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = _mix(h + w[i : i + n])
    return h


def samplers(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng(seed)
    return g.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), g.integers(0, 2**63, n, dtype=np.uint64)


def min_samples(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash samples of a shingle set, one for each pair of constants."""
    out = np.full(len(a), np.uint64(2**64 - 1))
    for s in range(0, len(shingles), 4096):  # keeps the matrix small for very long texts
        v = shingles[s : s + 4096, None] * a[None, :] + b[None, :]
        out = np.minimum(out, (v ^ (v >> np.uint64(32))).min(axis=0))
    return out


def parity_sketch(samples: np.ndarray) -> np.ndarray:
    """Fold samples into a bitmap in which every sample flips one bit (an odd sketch)."""
    at = _mix(samples + np.arange(1, len(samples) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(SKETCH_BITS)
    bits = (np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view(np.int64)


def most_bits(threshold: float, samples: int, slack: float = 5.0) -> int:
    """The largest XOR population count that a pair at ``threshold`` reaches, up to ``slack`` standard deviations.

    ``n/2 (1 - e^(-4k(1-J)/n))`` bits differ for similarity J, k samples and n bits; the deviation of J is that
    of k binomial samples plus that of the folding.
    """
    sd = math.sqrt(threshold * (1 - threshold) / samples + 0.035**2)
    low = max(0.0, threshold - slack * sd)
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-4 * samples * (1 - low) / SKETCH_BITS)))


def differing_bits(left: str, right: str) -> Column:
    out = F.lit(0)
    for i in range(SKETCH_WORDS):
        out = out + F.bit_count(F.col(f"{left}.s{i}").bitwiseXOR(F.col(f"{right}.s{i}")))
    return out


SKETCH_COLS = [f"s{i}" for i in range(SKETCH_WORDS)]


def filtered_join(left: DataFrame, right: DataFrame, key: str, within: Column, extra: Column | None = None) -> DataFrame:
    """Pairs (a, b) of rows with the same ``key`` that pass ``within``, a condition on the aliases l and r.

    Both sides have ``key`` and ``cls``. The condition is evaluated inside the join, so no pair that fails it is
    emitted. A key with more than ``HOT`` rows on the right is spread: each left row picks one salt and the right
    rows are repeated for every salt, so that one task compares at most about ``HOT`` times the right rows.
    """
    hot = right.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT)
    hot = materialize(hot.withColumn("_salts", F.ceil(F.col("_n") / HOT).cast("int")).drop("_n"), "hot")
    cond = within if extra is None else within & extra
    if hot.isEmpty():
        return left.alias("l").join(right.alias("r"), (F.col(f"l.{key}") == F.col(f"r.{key}")) & cond).select(F.col("l.cls").alias("a"), F.col("r.cls").alias("b"))
    salts = F.coalesce("_salts", F.lit(1))
    ls = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64("cls"), salts).cast("int"))
    rs = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return ls.alias("l").join(rs.alias("r"), (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l._salt") == F.col("r._salt")) & cond).select(F.col("l.cls").alias("a"), F.col("r.cls").alias("b"))


def with_similarity(pairs: DataFrame, left_texts: DataFrame, right_texts: DataFrame, k: int) -> DataFrame:
    """Exact similarity of pairs (a, b): columns a, b, similarity. Texts are (cls, w)."""
    wide = pairs.join(left_texts.select(F.col("cls").alias("a"), F.col("w").alias("wa")), "a").join(right_texts.select(F.col("cls").alias("b"), F.col("w").alias("wb")), "b")

    def jaccard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for x, y in zip(p["wa"], p["wb"]):
                x, y = np.unique(runs(x, k)), np.unique(runs(y, k))
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both / max(1, len(x) + len(y) - both))
            yield pd.DataFrame({"a": p["a"], "b": p["b"], "similarity": np.array(out, dtype=float)})

    return wide.select("a", "b", "wa", "wb").mapInPandas(jaccard, "a binary, b binary, similarity double")
