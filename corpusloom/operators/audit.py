"""Checks of a ledger: repeated keys, checksums, counts, file limit, renderings."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import FILE_LIMIT
from corpusloom.functions import text as T


def duplicates(ledger: DataFrame) -> DataFrame:
    """source, records, urls of sources with a url more than once; a null source is '(none)'."""
    g = ledger.groupBy(F.coalesce("source", F.lit("(none)")).alias("source")).agg(F.count("*").alias("records"), F.countDistinct("url").alias("urls"))
    return g.filter("records <> urls")


def checksums(ledger: DataFrame) -> DataFrame:
    """source and the number of records whose article does not have its stored hash; a null article is no mismatch."""
    bad = F.coalesce(T.sha256(F.col("article_html")) != F.col("article_sha256"), F.lit(False))
    return ledger.groupBy(F.coalesce("source", F.lit("(none)")).alias("source")).agg(F.count_if(bad).alias("mismatches")).filter("mismatches > 0")


def counts(ledger: DataFrame, coverage: DataFrame) -> DataFrame:
    """source, records, reported where the ledger and the reported saves differ by more than one."""
    a = ledger.groupBy("source").agg(F.count("*").alias("records"))
    b = coverage.filter("kind = 'page_saved'").groupBy("source").agg(F.count("*").alias("reported"))
    j = a.join(b, "source", "full").select("source", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("reported", F.lit(0)).alias("reported"))
    return j.filter("source IS NOT NULL AND abs(records - reported) > 1")


def too_many_files(files: int, limit: int = FILE_LIMIT) -> bool:
    return files > limit


def sections(ledger: DataFrame, bundles: DataFrame) -> DataFrame:
    """source, records, sections where the ledger and the readable bundle (source, text) differ by more than one."""
    a = ledger.groupBy("source").agg(F.count("*").alias("records"))
    b = bundles.groupBy("source").agg(F.sum(T.bundle_sections(F.col("text"))).alias("sections"))
    j = a.join(b, "source", "full").select("source", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("sections", F.lit(0)).alias("sections"))
    return j.filter("source IS NOT NULL AND abs(records - sections) > 1")


def alive(pid: int) -> bool | None:
    """Whether a process of this machine runs; None if that can't be told."""
    try:
        os.kill(pid, 0)
        return True
    except ProcessLookupError:
        return False
    except PermissionError:
        return None


def run_findings(files: int, phase: str, running: bool | None, limit: int = FILE_LIMIT) -> list[str]:
    """What is wrong with a run as a whole: too many files, or an end before it was finished."""
    out = ["File limit exceeded"] if too_many_files(files, limit) else []
    return out + (["Scraper exited before completion"] if running is False and phase != "finished" else [])


def findings(ledger: DataFrame, coverage: DataFrame, bundles: DataFrame | None = None) -> DataFrame:
    """All findings of sources as one table: source, finding."""
    d = duplicates(ledger).select("source", F.lit("duplicate urls").alias("finding"))
    c = checksums(ledger).select("source", F.lit("article checksum mismatch").alias("finding"))
    n = counts(ledger, coverage).select("source", F.lit("record count differs from report").alias("finding"))
    out = d.unionByName(c).unionByName(n)
    return out if bundles is None else out.unionByName(sections(ledger, bundles).select("source", F.lit("readable bundle/ledger count mismatch").alias("finding")))


def rerendered(ledger: DataFrame, render: Column, version: int = 2) -> DataFrame:
    """page_id, text, text_sha256, rendering_version, changed: the text made anew from the stored article."""
    changed = ~F.coalesce(render.eqNullSafe(F.col("text")), F.lit(False))
    return ledger.select("page_id", render.alias("text"), T.sha256(render).alias("text_sha256"), F.lit(version).alias("rendering_version"), changed.alias("changed"))
