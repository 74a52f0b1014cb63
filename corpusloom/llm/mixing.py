"""Problem 9: mixing sources to target shares of tokens.

Each source's texts are laid end to end, in bounded lanes, and cut into blocks of a fixed number of tokens. The
output is a sequence of shards of equally many slots, in groups of as many shards as there are groups; every shard draws how many of its slots each source
fills from the target shares, and a source's slots take its blocks in pseudorandom order, one pass after another,
so no block is used again before all have been used as often. Only counts per source and lane reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.session import materialize

BLOCK = 256  # tokens of a block
SLOTS = 64  # slots of a shard
LANE_ROWS = 50_000  # texts of one lane, on average
CHUNK = 64  # shards that a task puts out at a time


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the places ``x``: a four-round Feistel network, walked until it lands below n."""
    half = max(1, (max(2, n) - 1).bit_length() + 1 >> 1)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(seed).integers(0, 2**63, 4, dtype=np.uint64)
    out = np.asarray(x, dtype=np.uint64).copy()
    todo = np.ones(len(out), bool)
    while todo.any():
        v = out[todo]
        a, b = v >> np.uint64(half), v & mask
        for k in keys:
            h = (b + k) * np.uint64(0x9E3779B97F4A7C15)
            a, b = b, a ^ ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) & mask
        out[todo] = (a << np.uint64(half)) | b
        todo[todo] = out[todo] >= n
    return out.astype(np.int64)


def plan(blocks: dict[str, int], shares: dict[str, float], repeats: dict[str, int], seed: int = 7) -> tuple[np.ndarray, list[str]]:
    """Slots of each source in each group of shards, as large a mixture as the caps allow.

    Sources without blocks are left out and the other shares scaled up. The number of slots starts at what the
    tightest source allows and is lowered until the drawn counts keep every cap.
    """
    names = sorted(s for s in shares if blocks.get(s) and shares[s] > 0 and repeats[s] > 0)
    if not names:
        return np.zeros((0, 0), dtype=np.int64), []
    p = np.array([shares[s] for s in names], dtype=float)
    p /= p.sum()
    caps = np.array([blocks[s] * repeats[s] for s in names])
    slots = int((caps / p).min())
    while slots > 0:
        shards = max(1, slots // SLOTS)
        groups = ceil(sqrt(shards))  # as many groups as there are shards in a group
        g = np.random.default_rng(seed)
        size = np.full(groups, slots // groups)
        size[: slots % groups] += 1
        drawn = np.array([g.multinomial(n, p) for n in size])
        if (drawn.sum(axis=0) <= caps).all():
            return drawn, names
        slots = min(slots - 1, int(slots * 0.995))
    return np.zeros((0, len(names)), dtype=np.int64), names


def mix(docs: DataFrame, doc_id: str, source: Column, n_tokens: str, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mixture: shard, slot, source, block, pass_no (from 1), doc id, token_from, token_to.

    ``targets`` has source, target_share and max_repeats, a row per source. Source names match without regard to
    case and outer blanks; rows of other or null sources, and rows without tokens, are not used. A block's
    spans are rows of their own. Repeated rows are texts of their own.
    """
    clean = lambda c: F.lower(F.trim(c))
    want = {r[0]: (float(r[1]), int(r[2])) for r in targets.select(clean(F.col("source")), "target_share", "max_repeats").dropna().collect()}  # a row per source
    src = docs.select(F.col(doc_id).alias("id"), clean(source).alias("source"), F.col(n_tokens).alias("n")).filter(F.col("source").isin(list(want)) & (F.col("n") > 0))
    src = materialize(src, "mix")
    rows = {r[0]: r[1] for r in src.groupBy("source").count().collect()}
    lanes = F.create_map(*[F.lit(x) for s in sorted(want) for x in (s, max(1, ceil(rows.get(s, 0) / LANE_ROWS)))])
    laned = src.withColumn("lane", F.pmod(F.xxhash64("id"), lanes[F.col("source")]).cast("int"))
    w = W.partitionBy("source", "lane").orderBy(F.xxhash64("id", F.lit(1)), "id", "n")
    laned = materialize(laned.withColumn("end", F.sum("n").over(w)).withColumn("begin", F.col("end") - F.col("n")), "lanes")
    counts = laned.groupBy("source", "lane").agg(F.max("end").alias("t")).collect()  # a row per LANE_ROWS texts
    first, blocks = {}, {}
    for r in sorted(counts, key=lambda r: (r[0], r[1])):
        first[(r[0], r[1])] = blocks.get(r[0], 0)
        blocks[r[0]] = blocks.get(r[0], 0) + ceil(r[2] / block)
    drawn, names = plan(blocks, {s: v[0] for s, v in want.items()}, {s: v[1] for s, v in want.items()})
    spark = docs.sparkSession
    if not drawn.size:
        return laned.select(F.lit(0).cast("bigint").alias("shard"), F.lit(0).alias("slot"), "source", F.lit(0).cast("bigint").alias("block"), F.lit(0).alias("pass_no"), F.col("id").alias(doc_id), F.col("begin").alias("token_from"), F.col("end").alias("token_to")).limit(0)
    # ---- slots of every shard, drawn group by group
    before = np.vstack([np.zeros(len(names), dtype=np.int64), np.cumsum(drawn, axis=0)[:-1]])
    starts = np.concatenate([[0], np.cumsum([max(1, int(d.sum()) // SLOTS) for d in drawn])])
    sizes = [blocks[s] for s in names]

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for g, first, shards, counts, used in zip(p["grp"], p["first"], p["shards"], p["counts"], p["before"]):
                left, nth, rng, rows = np.array(counts), np.array(used), np.random.default_rng([11, g]), []
                for k in range(shards):
                    n = int(left.sum()) // (shards - k)
                    take = rng.multivariate_hypergeometric(left, n) if k < shards - 1 else left.copy()
                    order = rng.permutation(np.repeat(np.arange(len(names)), take))
                    rows.append((np.full(len(order), first + k), np.arange(len(order), dtype=np.int32), order))
                    left -= take
                    if len(rows) == CHUNK or k == shards - 1:
                        shard, slot, source = (np.concatenate(c) for c in zip(*rows))
                        block, pass_no = np.empty(len(shard), dtype=np.int64), np.empty(len(shard), dtype=np.int32)
                        for s in range(len(names)):
                            at = np.flatnonzero(source == s)
                            x = nth[s] + np.arange(len(at))
                            done = x // sizes[s]
                            pass_no[at] = done + 1
                            for e in np.unique(done):
                                block[at[done == e]] = permute(x[done == e] % sizes[s], sizes[s], 1000 * s + int(e))
                            nth[s] += len(at)
                        yield pd.DataFrame({"shard": shard, "slot": slot, "source": np.array(names, dtype=object)[source], "block": block, "pass_no": pass_no})
                        rows = []

    plans = spark.createDataFrame([(g, int(starts[g]), int(starts[g + 1] - starts[g]), drawn[g].tolist(), before[g].tolist()) for g in range(len(drawn))], "grp int, first bigint, shards bigint, counts array<bigint>, before array<bigint>")
    used = plans.repartition(min(len(drawn), 1_000), "grp").mapInPandas(slots, "shard bigint, slot int, source string, block bigint, pass_no int")
    # ---- blocks of every text
    offset = F.create_map(*[F.lit(x) for k, v in sorted(first.items()) for x in (f"{k[0]}\x1f{k[1]}", v)])
    at = offset[F.concat_ws("\x1f", "source", "lane")]
    cut = laned.withColumn("_b", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))))
    cut = cut.select("source", (at + F.col("_b")).cast("bigint").alias("block"), F.col("id").alias(doc_id), (F.greatest("begin", F.col("_b") * block) - F.col("begin")).alias("token_from"), (F.least("end", (F.col("_b") + 1) * block) - F.col("begin")).alias("token_to"))
    return used.join(cut, ["source", "block"]).select("shard", "slot", "source", "block", "pass_no", doc_id, "token_from", "token_to")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target_share, tokens, actual_share, most_passes, max_repeats."""
    got = mixed.groupBy("source").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("tokens"), F.max("pass_no").alias("most_passes"))
    t = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").join(got, "source", "left")  # a row per source
    total = F.sum(F.coalesce("tokens", F.lit(0))).over(W.partitionBy())
    return t.select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.try_divide(F.coalesce("tokens", F.lit(0)), total), F.lit(0.0)).alias("actual_share"), F.coalesce("most_passes", F.lit(0)).alias("most_passes"), "max_repeats")
