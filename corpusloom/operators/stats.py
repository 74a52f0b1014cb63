"""Counts and rankings over results, documents and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.agent import DECISIONS
from corpusloom.session import lookup_join


def decision_counts(results: DataFrame) -> DataFrame:
    """Rows per decision, all four listed; case does not matter, other values are not counted."""
    spark = results.sparkSession
    have = results.groupBy(F.upper("decision").alias("decision")).agg(F.count("*").alias("n"))
    return spark.createDataFrame([(d,) for d in DECISIONS], "decision string").join(have, "decision", "left").select("decision", F.coalesce("n", F.lit(0)).alias("n"))


def crawl_summary(results: DataFrame) -> DataFrame:
    d = F.upper("decision")
    return results.agg(
        F.count("*").alias("pages_processed"), F.count_if(d.isin("SAVE", "CONSOLIDATE") | ((d == "ERROR") & F.col("file_path").isNotNull())).alias("files_created"), F.countDistinct("url").alias("urls_seen"),
        F.countDistinct(F.when(d == "ERROR", F.col("url"))).alias("urls_failed"),
    )


def success_rate(results: DataFrame) -> DataFrame:
    """attempted and successful urls and their ratio, both as a crawl counts them (failures among the successes) and strictly."""
    a = results.agg(F.countDistinct("url").alias("seen"), F.countDistinct(F.when(F.upper("decision") == "ERROR", F.col("url"))).alias("failed"))
    part = lambda x, y: F.round(F.coalesce(F.try_divide(x, y), F.lit(0.0)), 6)
    return a.select("seen", "failed", part(F.col("seen"), F.col("seen") + F.col("failed")).alias("success_rate"), part(F.col("seen") - F.col("failed"), F.col("seen")).alias("success_rate_strict"))


def corpus_size(docs: DataFrame, text: str) -> DataFrame:
    n = F.octet_length(F.col(text))
    return docs.filter(F.col(text).isNotNull()).agg(F.count("*").alias("files"), F.coalesce(F.sum(n), F.lit(0)).alias("bytes"), F.round(F.coalesce(F.sum(n), F.lit(0)) / (1024 * 1024), 6).alias("mb"))


def largest(docs: DataFrame, row_id: str, text: str, k: int = 5) -> DataFrame:
    """The k longest documents in bytes, ties by id."""
    return docs.filter(F.col(text).isNotNull()).select(row_id, F.octet_length(F.col(text)).alias("bytes")).orderBy(F.desc("bytes"), row_id).limit(k)


def word_frequency(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.explode(T.words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def corpus_totals(docs: DataFrame, text: str) -> DataFrame:
    t = F.col(text)
    return docs.filter(t.isNotNull()).agg(F.count("*").alias("total_files"), F.sum(F.size(T.words(t))).alias("total_words"), F.sum(F.length(t)).alias("total_characters"))


def topics(events: DataFrame, source: str, url: str, k: int) -> DataFrame:
    """source, url, rank (from 1) of the k urls of each source that have most events, ties by url."""
    n = events.filter(F.col(source).isNotNull() & F.col(url).isNotNull()).groupBy(F.col(source).alias("source"), F.col(url).alias("url")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy(F.desc("n"), "url")
    return n.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("source", "url", "rank")


def top_per_source(pages: DataFrame, topics: DataFrame, source: str, url: str, k: int = 8) -> DataFrame:
    """The first k urls of each source by topic rank (999 without one), then url: source, url, rank, place."""
    p = pages.filter(F.col(source).isNotNull() & F.col(url).isNotNull()).select(F.col(source).alias("source"), F.col(url).alias("url")).distinct()
    p = lookup_join(p, topics, ["source", "url"], "left").withColumn("rank", F.coalesce("rank", F.lit(999)))
    w = Window.partitionBy("source").orderBy("rank", "url")
    return p.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def source_phase(coverage: DataFrame) -> DataFrame:
    """Per source: saved, failed, blocked and phase: running until finished, then finished or finished_with_gaps."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    g = coverage.filter("source IS NOT NULL").groupBy("source").agg(kind("page_saved").alias("saved"), kind("page_failed").alias("failed"), kind("robots_blocked").alias("blocked"), kind("source_finished").alias("ends"))
    return g.select("source", "saved", "failed", "blocked", F.when(F.col("ends") == 0, "running").when(F.col("failed") + F.col("blocked") > 0, "finished_with_gaps").otherwise("finished").alias("phase"))


def all_finished(phases: DataFrame) -> DataFrame:
    """Whether every source has ended: the gate of jobs that need whole sources."""
    return phases.agg(F.coalesce(F.every(F.col("phase").startswith("finished")), F.lit(False)).alias("ready"))


def ai_completed(notes: DataFrame) -> int:
    return notes.filter("status = 'ok'").count()


def without_note(pages: DataFrame, notes: DataFrame) -> DataFrame:
    """Pages that have no finished note yet."""
    return pages.join(notes.filter("status = 'ok'").select("url").distinct(), "url", "left_anti")
