"""Embedding, pooling and nearest neighbours."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import chunks
from corpusloom.session import materialize, small_batches

BLOCK = 2_048  # query vectors that one pass over the collection compares


def pool(vectors: list[np.ndarray]) -> np.ndarray:
    """Mean of the vectors, of unit length; a mean of zero stays zero."""
    m = np.mean(np.asarray(vectors, dtype=float), axis=0)
    n = float(np.linalg.norm(m))
    return m / n if n else m


class HashingEmbedder:
    """Term frequencies hashed to a vector of fixed length: no model, no network, the same everywhere."""

    def __init__(self, dims: int = 128) -> None:
        self.dims = dims

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            v = np.zeros(self.dims)
            for w in t.lower().split():
                v[zlib.crc32(w.encode()) % self.dims] += 1.0
            n = np.linalg.norm(v)
            out.append(v / n if n else v)
        return out


class TooLarge(Exception):
    """An embedder's refusal of a text for its size."""


def embed(text: str, embedder: Callable[[list[str]], list], limit: int) -> np.ndarray:
    """One piece's vector as it is, several pooled; a refused piece is halved until it is taken, nothing is cut off."""

    def one(piece: str) -> np.ndarray:
        try:
            return np.asarray(embedder([piece])[0], dtype=float)
        except TooLarge:
            if len(piece) < 2:
                raise
            mid = len(piece) // 2
            return pool([one(piece[:mid]), one(piece[mid:])])

    parts = chunks(text, limit)
    if not parts:
        raise ValueError("nothing to embed")
    if len(parts) == 1:
        return one(parts[0])
    try:
        got = [np.asarray(v, dtype=float) for v in embedder(parts)]
    except TooLarge:
        got = [one(p) for p in parts]
    if len(got) != len(parts) or len({len(v) for v in got}) != 1:
        raise ValueError("the embedder returned vectors of different or missing size")
    return pool(got)


def embedded(df: DataFrame, text: str, keep: list[str], embedder: Callable[[list[str]], list] | None = None, limit: int = 6_000) -> DataFrame:
    """``keep``, embedding, error. Blank and null texts, and texts the embedder fails on, have an error and no vector."""
    small_batches(df.sparkSession)
    e = embedder or HashingEmbedder()
    src = df.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            vec, err = [], []
            for t in p["_text"]:
                try:
                    vec.append(embed(t or "", e, limit))
                    err.append(None)
                except Exception as x:  # a bad text must not end the job
                    vec.append(None)
                    err.append(f"{type(x).__name__}: {x}")
            yield p.drop(columns="_text").assign(embedding=vec, error=err)

    return src.mapInPandas(run, kinds + ", embedding array<double>, error string")


def mean_pool(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Per key the mean vector of unit length, as rows key, dim, value; keys are aggregated by dimension, so a hot key is no burden."""
    d = df.select(key, F.posexplode(F.col(vector)).alias("dim", "x")).groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    n = d.groupBy(key).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("n"))
    k = d.withColumnRenamed(key, "_k").join(n.withColumnRenamed(key, "_k"), "_k")
    return k.select(F.col("_k").alias(key), "dim", F.when(F.col("n") > 0, F.col("m") / F.col("n")).otherwise(F.col("m")).alias("value"))


def nearest(queries: DataFrame, collection: DataFrame, row_id: str, vector: str, k: int = 5, threshold: float | None = None, before: bool = False, skip_self: bool = True) -> DataFrame:
    """Exact k nearest by cosine: query_id, hit_id, similarity, rank; ties by id.

    The queries are a stated set; blocks of ``BLOCK`` of them are sent to the tasks one after another, and each
    task keeps the k best of its rows before anything is shuffled. Null vectors and vectors of other
    length than the query's are never compared; a zero vector has similarity 0. ``before``: only hits of smaller id.
    """
    spark = collection.sparkSession
    q = queries.select(F.col(row_id).alias("id"), F.col(vector).alias("v")).filter("v IS NOT NULL")
    kind = q.schema["id"].dataType.simpleString()
    q = materialize(q.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-q.count() // BLOCK))))), "queries", ["_b"])
    c = collection.select(F.col(row_id).alias("id"), F.col(vector).alias("v")).filter("v IS NOT NULL")
    parts = []
    for b in sorted(r[0] for r in q.select("_b").distinct().collect()):  # a row per block
        block = q.filter(F.col("_b") == b).select("id", "v").toPandas()  # about BLOCK rows
        sent = spark.sparkContext.broadcast((block["id"].to_numpy(), [np.asarray(x, dtype=float) for x in block["v"]]))
        parts.append(c.mapInPandas(_best(sent, k, threshold, before, skip_self), f"query_id {kind}, hit_id {kind}, similarity double"))
    if not parts:
        return spark.createDataFrame([], f"query_id {kind}, hit_id {kind}, similarity double, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "hit_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _best(sent, k: int, threshold: float | None, before: bool, skip_self: bool) -> Callable:
    def unit(rows: list[np.ndarray]) -> np.ndarray:
        m = np.vstack(rows)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vs = sent.value
        sizes = np.array([len(v) for v in vs])
        for p in batches:
            rows = [np.asarray(v, dtype=float) for v in p["v"]]
            have, lens = p["id"].to_numpy(), np.array([len(v) for v in rows])
            for d in np.unique(sizes):
                qi, ci = np.flatnonzero(sizes == d), np.flatnonzero(lens == d)
                if not d or not len(ci):
                    continue
                sim = np.round(unit([vs[i] for i in qi]) @ unit([rows[i] for i in ci]).T, 12)
                if skip_self or before:
                    gone = have[ci][None, :] >= ids[qi][:, None] if before else have[ci][None, :] == ids[qi][:, None]
                    sim[gone] = -np.inf
                if threshold is not None:
                    sim[sim < threshold] = -np.inf
                out_q, out_h, out_s = [], [], []
                order = np.argsort(have[ci], kind="stable")
                for r in range(len(qi)):
                    s = sim[r][order]
                    top = np.argsort(-s, kind="stable")[:k]
                    top = top[np.isfinite(s[top])]
                    out_q += [ids[qi[r]]] * len(top)
                    out_h += have[ci][order][top].tolist()
                    out_s += s[top].tolist()
                if out_q:
                    yield pd.DataFrame({"query_id": out_q, "hit_id": out_h, "similarity": out_s})

    return run
