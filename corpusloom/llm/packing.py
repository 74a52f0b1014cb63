"""Problem 8: packing texts into containers of fixed capacity, by swap-based local search.

Items are dealt to parts of bounded size by the hash of their id; each part is packed on its own. A first
fitting fills the bins; then documents are moved or exchanged, one for one and two for one, between underfull
bins whenever that makes the sum of squared fills grow, which drains the emptier bin until it is empty.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize

PART = 10_000  # items of one part, on average


def first_fit(sizes: np.ndarray, cap: int) -> list[list[int]]:
    """Largest first, each into the fullest bin that takes it. Sizes must not exceed ``cap``."""
    bins: list[list[int]] = []
    gaps: list[tuple[int, int]] = []  # (room left, bin), ordered
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        at = bisect_left(gaps, (s, -1))
        if at == len(gaps):
            bins.append([i])
            insort(gaps, (cap - s, len(bins) - 1))
        else:
            room, b = gaps.pop(at)
            bins[b].append(i)
            insort(gaps, (room - s, b))
    return bins


def improve(sizes: np.ndarray, bins: list[list[int]], cap: int) -> list[list[int]]:
    """Local search on a packing; the number of bins never grows and every accepted step raises the squared fill.

    Bins give up documents, the emptiest first: a move into another bin's room, or an exchange for one smaller
    document or for two that together are smaller, where the other bin is at least as full and has room for the
    difference. Of all exchanges the one that moves most is made; one for one is sought among all items at once, two
    for one in the bins whose room could beat it. It ends when the least possible number of bins is reached, or when
    no bin has a step left.
    """
    least = -(-int(sizes.sum()) // cap) if len(sizes) else 0
    bins = [list(b) for b in bins if b]
    where = np.empty(len(sizes), dtype=np.int64)
    for b, members in enumerate(bins):
        where[members] = b
    fill = np.array([int(sizes[b].sum()) for b in bins], dtype=np.int64)
    alive = np.ones(len(bins), bool)

    def step(low: int) -> bool:
        """One step that takes something out of a bin; whether there was one."""
        room = np.where(alive & (fill >= fill[low]), cap - fill, 0)
        room[low] = 0
        most = int(room.max(initial=0))
        for i in sorted(bins[low], key=lambda j: -sizes[j]):
            s = int(sizes[i])
            if s <= most:
                to = int(np.where(room >= s, room, cap + 1).argmin())
                return swap(low, i, to, ())
            gain = s - sizes
            ok = (gain > 0) & (gain <= room[where])
            best, to, back = 0, -1, ()
            if ok.any():
                j = int(np.where(ok, gain, 0).argmax())
                best, to, back = int(gain[j]), int(where[j]), (j,)
            for b in np.flatnonzero(room > best)[np.argsort(-room[room > best], kind="stable")].tolist():
                if room[b] <= best:
                    break
                inside = sorted((int(sizes[j]), j) for j in bins[b] if sizes[j] < s)
                lo, hi = 0, len(inside) - 1
                while lo < hi:  # the pair with the least sum that still fits
                    left = s - inside[lo][0] - inside[hi][0]
                    if left <= 0:
                        hi -= 1
                    else:
                        if best < left <= room[b]:
                            best, to, back = left, b, (inside[lo][1], inside[hi][1])
                        lo += 1
            if best:
                return swap(low, i, to, back)
        return False

    def swap(low: int, i: int, to: int, back: tuple[int, ...]) -> bool:
        gain = int(sizes[i]) - sum(int(sizes[j]) for j in back)
        bins[low].remove(i)
        bins[to].append(i)
        where[i] = to
        for j in back:
            bins[to].remove(j)
            bins[low].append(j)
            where[j] = low
        fill[to] += gain
        fill[low] -= gain
        alive[low] = bool(bins[low])
        return True

    moved = True
    while moved and alive.sum() > max(1, least):
        moved = False
        for low in np.argsort(fill, kind="stable").tolist():
            while alive[low] and fill[low] < cap and alive.sum() > max(1, least) and step(low):
                moved = True
    return [b for b in bins if b]


def pack(sizes: np.ndarray, cap: int) -> list[list[int]]:
    return improve(sizes, first_fit(sizes, cap), cap)


def pieces(n: int, cap: int) -> list[tuple[int, int]]:
    """Token spans of an item: itself, or full containers and the rest when it is larger than one."""
    return [(a, min(a + cap, n)) for a in range(0, n, cap)] or [(0, 0)]


def containers(items: DataFrame, item_id: str, size: str, capacities: dict[str, int]) -> DataFrame:
    """Packing of all items for each capacity: limit_name, container, item id, piece_no, token_from, token_to.

    Items are whole unless larger than a container; those fill containers from their start and the rest is packed
    like any item. Items without tokens go where there is room. A null size gives no row; a repeated row is
    another item. ``container`` is unique within a limit.
    """
    counted = materialize(items.filter(F.col(size).isNotNull()).select(F.col(item_id).alias("id"), F.col(size).alias("n")), "sizes")
    kind = counted.schema["id"].dataType.simpleString()
    parts = max(1, -(-counted.count() // PART))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["n", "id"], ascending=[False, True])
        part, out = int(p["part"].iloc[0]), []
        ids, ns = p["id"].tolist(), p["n"].tolist()
        for name, cap in sorted(capacities.items()):
            spans = [(k, no, a, b) for k, n in enumerate(ns) for no, (a, b) in enumerate(pieces(int(n), cap), 1)]
            sizes = np.array([b - a for _, _, a, b in spans], dtype=np.int64)
            for c, members in enumerate(pack(sizes, cap)):
                out += [(name, f"{part}-{c}", ids[spans[m][0]], spans[m][1], spans[m][2], spans[m][3]) for m in members]
        return pd.DataFrame(out, columns=["limit_name", "container", "id", "piece_no", "token_from", "token_to"])

    dealt = counted.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    dealt = dealt.repartition(parts, "part")  # a fixed number, so that parts are not put together in one task
    return dealt.groupBy("part").applyInPandas(run, f"limit_name string, container string, id {kind}, piece_no int, token_from bigint, token_to bigint").withColumnRenamed("id", item_id)


def fill(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """Per limit: containers, tokens, and the share of the containers' room that is filled."""
    cap = F.create_map(*[F.lit(x) for kv in sorted(capacities.items()) for x in kv])
    g = packed.groupBy("limit_name", "container").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("t")).groupBy("limit_name").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    return g.select("limit_name", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * cap[F.col("limit_name")]), 6).alias("fill"))
