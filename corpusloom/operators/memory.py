"""The document memory: a versioned table with one row per document id.

A version is a folder ``v=N``, and a mark ``done/N`` is created once it is complete; the current version is the greatest
marked one, so readers never see half of one, and at no moment none. A mark notes the batch that the version ends with
and the next free index. Columns: doc_id, content, embedding, url, title, ts, word_count.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id string, content string, embedding array<double>, url string, title string, ts timestamp, word_count int"


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key by ``order``; rows without key drop out. One max per key, no window over a hot key."""
    rest = [c for c in rows.columns if c not in (key, order)]
    g = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_r"))
    return g.select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def upserted(memory: DataFrame, changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Memory with the changed rows put in whole; the later of changes to one key wins by column _seq, if there is one."""
    seq = F.col("_seq") if "_seq" in changes.columns else F.lit(0)
    new = latest(changes.withColumn("_seq", seq).select(*memory.columns, "_seq"), key, "_seq").select(*memory.columns)
    return memory.join(new.select(key), key, "left_anti").select(*memory.columns).unionByName(new)


def deleted(memory: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return memory.join(ids.select(key).distinct(), key, "left_anti").select(*memory.columns)


def got(memory: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Point reads: the rows of the ids, at distance 0."""
    return memory.join(ids.select(key).distinct(), key, "left_semi").withColumn("distance", F.lit(0.0))


class Memory:
    """A memory kept in a folder, for one writer at a time."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int | None:
        done = self._path(f"{self.root}/done")
        marks = [int(f.getPath().getName()) for f in self._fs.listStatus(done) if f.getPath().getName().isdigit()] if self._fs.exists(done) else []
        return max(marks, default=None)

    def note(self, version: int | None = None) -> dict:
        """What the mark of a version, the current one if none is named, says: batch and next."""
        v = self.version() if version is None else version
        return {"batch": None, "next": 0} if v is None else json.loads(self.spark.read.text(f"{self.root}/done/{v}", wholetext=True).first()[0])

    def read(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        return self.spark.createDataFrame([], SCHEMA) if v is None or v < 0 else self.spark.read.schema(SCHEMA).parquet(f"{self.root}/v={v}")

    def before(self, batch: int) -> DataFrame:
        """The memory as it was before a batch: the version before, if the current one ends with it."""
        v = self.version()
        return self.read(v - 1) if v is not None and self.note(v)["batch"] == batch else self.read(v)

    def next_index(self) -> int:
        """The index after the greatest that was ever given; deleted documents keep theirs."""
        return self.note()["next"]

    def write(self, rows: DataFrame, batch: int | None = None, least: int = 0) -> int:
        """A new complete version; its mark comes last, and the version before the previous one is dropped."""
        v = self.version()
        n = 0 if v is None else v + 1
        path = f"{self.root}/v={n}"
        rows.select(*[F.col(c) for c in self.spark.createDataFrame([], SCHEMA).columns]).write.mode("overwrite").parquet(path)
        used = self.spark.read.schema(SCHEMA).parquet(path).agg(F.max(F.expr("try_cast(regexp_extract(doc_id, '^([0-9]+)_', 1) as int)"))).first()[0]
        note = json.dumps({"batch": batch, "next": max(self.note(v)["next"] if v is not None else 0, least, -1 if used is None else used + 1, 0)})
        aside, mark = self._path(f"{self.root}/done/{n}.new"), self._path(f"{self.root}/done/{n}")
        out = self._fs.create(aside, True)
        out.write(note.encode())
        out.close()
        if not self._fs.rename(aside, mark):
            raise RuntimeError(f"version {n} was written by someone else")
        if n >= 2:
            self._fs.delete(self._path(f"{self.root}/done/{n - 2}"), False)
            self._fs.delete(self._path(f"{self.root}/v={n - 2}"), True)
        return n

    def upsert(self, changes: DataFrame, batch: int | None = None, least: int = 0) -> int:
        """Put changes in; those of a batch that the current version already ends with replace that version's."""
        base = self.read() if batch is None else self.before(batch)
        return self.write(upserted(base, changes), batch, least)

    def delete(self, ids: DataFrame) -> int:
        return self.write(deleted(self.read(), ids))

    def count(self) -> int:
        return self.read().count()
