"""Writers: documents, ledgers, bundles, url lists and snapshots."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def write_documents(docs: DataFrame, folder: str) -> None:
    """One file for each document, named by its id; an existing file is replaced. Written by the tasks, to any file system.

    Ids that are no plain file names are refused before anything is written.
    """
    if not docs.filter(~F.coalesce(F.col("doc_id").rlike(r"^(?!\.{1,2}$)[^/\\\x00-\x1f]+$"), F.lit(False))).isEmpty():
        raise ValueError("a document id is no file name")
    rows = docs.select("doc_id", T.document(F.col("url"), F.col("title"), F.col("content")).alias("value"))

    def save(part: Iterable) -> None:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        where.create_dir(root, recursive=True)
        for r in part:
            with where.open_output_stream(f"{root}/{r.doc_id}.txt") as out:
                out.write(r.value.encode())

    rows.foreachPartition(save)


def append_ledger(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").option("ignoreNullFields", "false").json(folder)


def append_bundle(pages: DataFrame, folder: str) -> None:
    """Readable sections of pages, in files of their own."""
    pages.select(T.bundle_entry(F.col("title"), F.col("url"), F.col("text")).alias("value")).write.mode("append").text(folder)


def write_urls(urls: DataFrame, folder: str, column: str = "url") -> None:
    urls.select(column).orderBy(column).write.mode("overwrite").text(folder)


def replace_snapshot(spark: SparkSession, path: str, state: dict) -> None:
    """A JSON document that readers see whole or not at all: written aside, then renamed."""
    jvm = spark.sparkContext._jvm
    target, aside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".new")
    where = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = where.create(aside, True)
    out.write(json.dumps(state, ensure_ascii=False).encode())
    out.close()
    modes = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    modes[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.makeQualified(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(where.makeQualified(aside), where.makeQualified(target), modes)  # replaces in one step
