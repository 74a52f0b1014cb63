"""Problem 4: checking a new batch against everything accepted before.

The history is a folder that outlives the session: a table of whole normalised contents by their digest, one of
paragraph hashes with the contents that have them, one of how often each paragraph was accepted, all bucketed by
their key, and a note of the parameters. A batch is shuffled to the buckets' layout; the history is read where it
lies, and only appended to. Bucket-local semi-joins find full copies and how much of a content's paragraphs was
accepted before; contents without any are new, the others are compared with the contents that share them.

Layout differs between copies, so a paragraph is not a span between line breaks but a passage of the normalised
word stream, picked by its own hash: of every ``WINDOW`` neighbouring runs of ``PASSAGE`` words the one with the
least hash. Two texts that share any run of ``PASSAGE + WINDOW - 1`` words share such a passage. Texts whose common
runs are all shorter have a similarity of at most 7/11 by three-word runs: r words in a row have r - 2 of them, and
each break costs two on either side.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import shingles as S
from corpusloom.session import drop_table, materialize, shared_dir, small_batches

PASSAGE, WINDOW = 6, 5
SAMPLES = 128

def passages(w: np.ndarray) -> np.ndarray:
    """Distinct hashes of the chosen passages of a word stream."""
    h = S.runs(w, PASSAGE)
    if len(h) <= WINDOW:
        return np.unique(h[h.argmin() :][:1]) if len(h) else h
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, WINDOW).min(axis=1))


def marked(texts: DataFrame, k: int) -> DataFrame:
    """(cls, w) and more to the same with ps and s0..s3: a text's distinct passage hashes and its parity bitmap."""
    a, b = S.samplers(SAMPLES)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ps = [passages(w).view(np.int64) for w in p["w"]]
            sk = np.array([S.parity_sketch(S.min_samples(np.unique(S.runs(w, k)), a, b)) for w in p["w"]]).reshape(-1, S.SKETCH_WORDS)
            yield p.assign(ps=ps, **{c: sk[:, i] for i, c in enumerate(S.SKETCH_COLS)})

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in texts.schema)
    return texts.mapInPandas(mark, kinds + "ps array<bigint>, " + ", ".join(f"{c} bigint" for c in S.SKETCH_COLS))


@dataclass
class Batch:
    """A prepared batch: its rows (the kept columns, cls, w) and its distinct contents, marked."""

    rows: DataFrame
    texts: DataFrame


class History:
    """Accepted contents, as bucketed tables in a folder that grow by appends only.

    ``create`` starts one, ``open`` takes one up again, in any session that reaches the folder; the parameters are
    those it was created with. A batch whose append broke off can be appended again: contents that are there are
    not added twice.
    """

    TABLES = {"texts": ("cls", "cls BINARY, w ARRAY<BIGINT>"), "passages": ("p", "p BIGINT, cls BINARY, " + ", ".join(f"{c} BIGINT" for c in S.SKETCH_COLS)), "counts": ("p", "p BIGINT, n BIGINT")}

    def __init__(self, spark: SparkSession, path: str, k: int, threshold: float, min_words: int, buckets: int):
        small_batches(spark)
        self.spark, self.path, self.k, self.threshold, self.min_words, self.buckets = spark, path.rstrip("/"), k, threshold, min_words, buckets
        self.tag = uuid.uuid4().hex[:12]
        for what, (key, columns) in self.TABLES.items():
            spark.sql(f"CREATE TABLE {self._name(what)} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{self.path}/{what}'")

    @classmethod
    def create(cls, spark: SparkSession, path: str, k: int = 5, threshold: float = 0.8, min_words: int = 20, buckets: int = 24) -> History:
        note = json.dumps({"k": k, "threshold": threshold, "min_words": min_words, "buckets": buckets})
        where, fs = _file(spark, f"{path.rstrip('/')}/history.json")
        if fs.exists(where):
            raise ValueError(f"there is a history in {path}; open it")
        out = fs.create(where, False)
        out.write(note.encode())
        out.close()
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> History:
        rows = spark.read.text(f"{path.rstrip('/')}/history.json", wholetext=True).collect()  # one small file
        return cls(spark, path, **json.loads(rows[0][0]))

    def _name(self, what: str) -> str:
        return f"history_{what}_{self.tag}"

    def _add(self, df: DataFrame, what: str) -> None:
        key = self.TABLES[what][0]
        df.repartition(self.buckets, key).write.mode("append").format("parquet").bucketBy(self.buckets, key).sortBy(key).option("path", f"{self.path}/{what}").saveAsTable(self._name(what))

    def _read(self, what: str) -> DataFrame:
        return self.spark.table(self._name(what))

    def prepare(self, batch: DataFrame, text: str, keep: list[str]) -> Batch:
        """The batch's rows and contents; null, empty and short contents have none."""
        rows = materialize(S.text_classes(batch, text, keep, self.min_words), "batch")
        return Batch(rows, materialize(marked(S.representatives(rows), self.k), "marked"))

    def check(self, batch: Batch) -> DataFrame:
        """The distinct contents of a batch that repeat accepted ones: cls, kind, coverage.

        ``kind`` is ``copy`` for a full copy and ``near`` for a content whose similarity to an accepted one is at
        least the threshold; ``coverage`` is the share of its paragraphs that some accepted content has, 1 for a
        copy. Rows of the batch are not compared with each other.
        """
        known = self._read("texts").select("cls")
        copies = batch.texts.select("cls").join(known, "cls", "left_semi")
        fresh = batch.texts.join(known, "cls", "left_anti")
        mine = fresh.select("cls", F.size("ps").alias("of"), F.explode("ps").alias("p"), *S.SKETCH_COLS)
        seen = mine.join(self._read("counts"), "p").groupBy("cls", "p", "of", *S.SKETCH_COLS).agg(F.sum("n").alias("n"))
        most = Observation()
        seen = materialize(seen.observe(most, F.max("n").alias("n")), "seen")  # paragraphs of the batch that were accepted before
        covered = seen.groupBy("cls", "of").agg(F.count("*").alias("c")).select("cls", (F.col("c") / F.col("of")).alias("coverage"))
        near = S.differing_bits("l", "r") <= S.most_bits(self.threshold, SAMPLES)
        theirs = self._read("passages")
        usual = seen.filter(F.col("n") <= S.HOT)
        pairs = usual.alias("l").join(theirs.alias("r"), (F.col("l.p") == F.col("r.p")) & near).select(F.col("l.cls").alias("a"), F.col("r.cls").alias("b"), S.differing_bits("l", "r").alias("bits"))
        found = self._settle(batch.texts, pairs)
        hot = seen.filter(F.col("n") > S.HOT)
        if (most.get["n"] or 0) > S.HOT:
            # contents not settled by their rarer passages: through the frequent ones, spread over tasks
            found = materialize(found, "found")
            rest = hot.join(found, "cls", "left_anti")
            often = theirs.join(hot.select("p").distinct(), "p", "left_semi")
            found = found.union(self._settle(batch.texts, S.filtered_join(rest, often, "p", near).withColumn("bits", F.lit(0))))
        near_rows = found.join(covered, "cls").select("cls", F.lit("near").alias("kind"), "coverage")
        return copies.select("cls", F.lit("copy").alias("kind"), F.lit(1.0).alias("coverage")).union(near_rows)

    def _settle(self, mine: DataFrame, pairs: DataFrame) -> DataFrame:
        """Contents with a partner that is truly similar: the most promising partner first, all others for the rest."""
        pairs = materialize(pairs.groupBy("a", "b").agg(F.min("bits").alias("bits")), "pairs")
        best = pairs.groupBy("a").agg(F.min(F.struct("bits", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
        texts = self._read("texts")
        good = lambda p: S.with_similarity(p, mine, texts, self.k).filter(F.col("similarity") >= self.threshold).select(F.col("a").alias("cls")).distinct()
        sure = materialize(good(best), "sure")
        rest = pairs.join(sure.select(F.col("cls").alias("a")), "a", "left_anti").join(best, ["a", "b"], "left_anti").select("a", "b")
        return sure.union(good(rest))

    def append(self, batch: Batch) -> None:
        """Accept a batch: adds what is new to the tables, never rewriting what is there. Contents go in last."""
        new = batch.texts.join(self._read("texts").select("cls"), "cls", "left_anti")
        spread = new.select(F.explode("ps").alias("p"), "cls", *S.SKETCH_COLS)
        with ThreadPoolExecutor(2) as side:  # two jobs at once
            list(side.map(lambda x: self._add(*x), [(spread, "passages"), (spread.groupBy("p").agg(F.count("*").alias("n")), "counts")]))
        self._add(new.select("cls", "w"), "texts")

    def close(self, remove: bool = False) -> None:
        """Let go of the history; its folder stays unless ``remove`` is set."""
        for what in self.TABLES:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(what)}")
        if remove:
            drop_table(self.spark, self.path)


def _file(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def repeats(docs: DataFrame, text: str, keys: list[str], batch: str, history: str | None = None, **params) -> DataFrame:
    """Rows (``keys`` and ``batch``) whose content repeats that of some smaller batch, batch after batch.

    Null batches are never compared. Repeated rows give one row. Columns other than the named are not read. With a
    folder ``history`` the batches are also checked against what it holds, and added to it.
    """
    spark = docs.sparkSession
    path = history or f"{shared_dir(spark)}/corpusloom/history-{uuid.uuid4().hex[:12]}"
    note, fs = _file(spark, f"{path}/history.json")
    old = fs.exists(note)
    h = History.open(spark, path) if old else History.create(spark, path, **params)
    numbers = [r[0] for r in docs.select(batch).filter(F.col(batch).isNotNull()).distinct().orderBy(batch).collect()]  # one row per delivery
    out = None
    rows = materialize(S.text_classes(docs.filter(F.col(batch).isNotNull()), text, [*keys, batch], h.min_words), "batches", [batch])
    texts = rows.groupBy(batch, "cls").agg(F.first("w").alias("w"))
    texts = materialize(marked(texts, h.k), "marked", [batch])  # of all batches at once; each is checked and accepted by itself
    for n in numbers:
        b = Batch(rows.filter(F.col(batch) == n), texts.filter(F.col(batch) == n).drop(batch))
        if old or n != numbers[0]:
            hit = b.rows.join(h.check(b).select("cls"), "cls", "left_semi").select(*keys, batch).distinct()
            hit = materialize(hit, "repeats")
            out = hit if out is None else out.union(hit)
        if history is not None or n != numbers[-1]:
            h.append(b)
    h.close(remove=history is None)  # what was found is written
    return out if out is not None else docs.select(*keys, batch).limit(0)
