"""Problem 5: near-duplicate texts by parity sketches over MinHash samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import shingles as S
from corpusloom.session import materialize, small_batches

BANDS, ROWS = 32, 4
COPIES = 1_000  # a class of more copies than this is listed as links to its first id, not as all pairs


def signatures(texts: DataFrame, k: int) -> DataFrame:
    """(cls, w) to (cls, bands, s0..s3): band keys and the parity bitmap of each text."""
    a, b = S.samplers(BANDS * ROWS)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
        for p in batches:
            bands, sk = [], []
            for w in p["w"]:
                m = S.min_samples(np.unique(S.runs(w, k)), a, b)
                h = salt.copy()
                for r in m.reshape(BANDS, ROWS).T:
                    h = S._mix(h + r)
                bands.append(h.view(np.int64))
                sk.append(S.parity_sketch(m))
            sk = np.array(sk).reshape(-1, S.SKETCH_WORDS)
            yield pd.DataFrame({"cls": p["cls"], "bands": bands, **{c: sk[:, i] for i, c in enumerate(S.SKETCH_COLS)}})

    return texts.mapInPandas(sign, "cls binary, bands array<bigint>, " + ", ".join(f"{c} bigint" for c in S.SKETCH_COLS))


def similar_classes(texts: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs a < b of distinct texts (cls, w) with similarity of at least ``threshold``: a, b, similarity.

    Bands propose pairs, the XOR population count of the bitmaps sifts them inside the join, and the exact
    similarity decides. 32 bands of 4 samples propose a pair at 0.7 with probability 0.9998.
    """
    rows = materialize(signatures(texts, k).select("cls", F.explode("bands").alias("band"), *S.SKETCH_COLS), "bands")
    near = S.differing_bits("l", "r") <= S.most_bits(threshold, BANDS * ROWS)
    pairs = S.filtered_join(rows, rows, "band", near, F.col("l.cls") < F.col("r.cls")).distinct()
    pairs = materialize(pairs, "pairs")
    return S.with_similarity(pairs, texts, texts, k).filter(F.col("similarity") >= threshold)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): node, root, where root is the smallest node.

    Alternates large-star and small-star steps; each round is written to the shared folder, and no component
    is ever gathered in one place.
    """
    both = edges.select("a", "b").filter("a <> b").distinct()
    e = materialize(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    before = None
    while True:
        sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = materialize(small, "small")
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_copies(docs: DataFrame, text: str = "content", doc_id: str = "doc_id", k: int = 5, threshold: float = 0.8, min_words: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (cls, id), distinct texts (cls, w) and links (a, b, similarity) of a table of documents.

    An id may come with several contents and then belongs to several classes. Rows without id or without
    enough words have none. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    have = S.text_classes(rows, "text", ["id"], min_words)
    have = materialize(have, "texts")
    members = have.select("cls", "id").distinct()
    texts = materialize(S.representatives(have.select("cls", "w")), "classes")
    return members, texts, similar_classes(texts, k, threshold)


def id_pairs(members: DataFrame, links: DataFrame, copies: int = COPIES) -> DataFrame:
    """Pairs of different ids, the smaller first, that share a class or belong to linked classes.

    A class of more than ``copies`` ids stands for itself through its first id: its other ids are linked to
    that one. No link between different texts is lost.
    """
    size = members.groupBy("cls").agg(F.count("*").alias("_n"), F.min("id").alias("_first"))
    full = materialize(members.join(size, "cls"), "members")
    small = full.filter(F.col("_n") <= copies).select("cls", "id")
    big = full.filter(F.col("_n") > copies)
    heads = small.union(big.select("cls", F.col("_first").alias("id")).distinct())
    inside = small.alias("l").join(small.alias("r"), "cls").select(F.col("l.id").alias("x"), F.col("r.id").alias("y")).filter("x < y")
    star = big.select(F.col("_first").alias("x"), F.col("id").alias("y"))
    across = links.select("a", "b").join(heads.select(F.col("cls").alias("a"), F.col("id").alias("x")), "a").join(heads.select(F.col("cls").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    pairs = inside.union(star).union(across).filter("x <> y")
    return pairs.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per document id and class with its group: id, cls, group_id, n_links.

    Groups are the connected components of classes under the links; ids that own several contents are not
    used to join groups. ``n_links`` counts the class's links to other texts.
    """
    links = materialize(links.select("a", "b"), "links")
    deg = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    comp = components(links).select(F.col("node").alias("cls"), F.col("root"))
    out = members.join(comp, "cls", "left").join(deg, "cls", "left")
    return out.select("id", F.lower(F.hex("cls")).alias("cls"), F.lower(F.hex(F.coalesce("root", "cls"))).alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
