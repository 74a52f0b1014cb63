"""Streams over ledgers and pages."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.config import Config
from corpusloom.functions import html as H
from corpusloom.functions import text as T
from corpusloom.functions import url as U
from corpusloom.functions.model import generate
from corpusloom.operators import agent as A
from corpusloom.operators import audit, frontier, stats
from corpusloom.operators import links as L
from corpusloom.operators.memory import Memory
from corpusloom.sources import http, readers, writers
from corpusloom.sources.readers import COVERAGE, PAGE


def coverage_counts(spark: SparkSession, folder: str, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Events per source, kind and window of a coverage ledger that grows; later rows than ``late`` are dropped."""
    events = spark.readStream.schema(COVERAGE).json(folder).withColumn("at", F.timestamp_seconds("time"))
    return events.withWatermark("at", late).groupBy(F.window("at", width), "source", "kind").agg(F.count("*").alias("n"))


def run_agent(spark: SparkSession, folder: str, memory_root: str, results_root: str, checkpoint: str, cfg: Config | None = None, embedder: Callable | None = None, files_per_batch: int = 1) -> StreamingQuery:
    """The agent over pages that arrive as JSON files: each batch is decided against the memory that the ones before left.

    The memory's next version notes its batch, then results are written to a folder per batch. A batch that is run
    again finds its results and does nothing; if they are missing, it is decided against the memory as it was before the
    batch, so it comes to the same. Pages that fail are written as they came to the folder errors beside the memory's
    versions, by batch.
    """
    memory, cfg = Memory(spark, memory_root), cfg or Config()
    pages = spark.readStream.schema(PAGE + ", seq bigint").option("maxFilesPerTrigger", files_per_batch).json(folder)

    def fold(batch: DataFrame, n: int) -> None:
        done = f"{results_root}/batch={n}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{done}/_SUCCESS")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return
        v = memory.version()
        again = v is not None and memory.note(v)["batch"] == n
        have, first = memory.before(n), memory.note(v - 1)["next"] if again and v else 0 if again else memory.next_index()
        decided = A.materialize(A.decide_batch(batch, have, cfg, embedder), "decided")
        if not again:
            memory.upsert(A.memory_rows(decided, have, first, at=F.current_timestamp()), n)
        writers.write_documents(A.error_rows(decided), f"{memory_root}/errors/batch={n}")
        A.results(decided, A.saved_ids(decided, first)).write.mode("overwrite").parquet(done)

    return pages.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def crawl_with(spark: SparkSession, start: str, host: str, client: Callable, prefix: str | None = None, max_pages: int = 300, delay: float = 0.5) -> DataFrame:
    """A crawl over the network: url, depth, html of the pages reached, level by level; the order is (depth, url)."""
    level = frontier.admitted(spark.createDataFrame([(start.split("#", 1)[0],)], "url string"), host, prefix)
    done, seen, yielded, depth = None, None, 0, 0
    while True:
        if max_pages - yielded <= 0 or level.isEmpty():
            break
        seen = level if seen is None else seen.union(level)
        got = A.materialize(http.fetched(level.orderBy("url").limit(max_pages - yielded), client, delay), "fetched")
        good = got.filter(H.page_text(F.col("html")) != "").select("url", F.lit(depth).alias("depth"), "html")
        done = good if done is None else done.union(good)
        yielded += good.count()
        page = good.select(F.col("url").alias("page"), "url", "html")
        found = L.internal(page, "page", "url", "html", prefix).select(F.col("target").alias("url"))
        waiting = level.join(got.select("url"), "url", "left_anti")  # beyond this level's limit, for failed ones left room
        level = A.materialize(frontier.unseen(frontier.admitted(found, host, prefix), seen).union(waiting), "frontier")
        depth += 1
    return done if done is not None else spark.createDataFrame([], "url string, depth int, html string")


def research_crawl(spark: SparkSession, roots: dict[str, str], client: Callable, output: str, delay: float = 0.4) -> DataFrame:
    """Ledgers of documentation sites, all side by side: source, saved, failed, blocked, phase.

    For each source: robots rules, sitemaps, then level by level the urls in scope that are neither saved nor tried;
    redirects must stay in scope and answers be HTML articles of some length. Pages are appended to ``output``/pages,
    readable sections to ``output``/bundle, events to ``output``/coverage. What an earlier run saved is not fetched
    again, and its links are gone on from.
    """
    kind = "source string, root string, host string"
    src = spark.createDataFrame([(s, r, r.split("://", 1)[1].split("/", 1)[0].lower()) for s, r in roots.items()], kind)
    rules = A.materialize(http.fetched(src.select(F.concat(F.regexp_extract("root", "^[a-z]+://[^/]*", 0), F.lit("/robots.txt")).alias("url")), client, 0.0), "robots")
    status = F.when(F.col("error").isNull(), 200).when(F.col("error").contains("404"), 404).otherwise(503)
    rules = rules.select(F.lower(U.netloc(F.col("url"))).alias("host"), status.alias("status"), F.col("html").alias("body"))
    asked = rules.select("host", F.regexp_extract("body", r"(?im)^crawl-delay:\s*([0-9.]+)", 1).try_cast("double").alias("delay")).filter("delay IS NOT NULL")
    saved = readers.ledger(spark, f"{output}/pages", "source string, " + readers.LEDGER)
    queued = src.select("source", F.col("root").alias("url"))
    for r in src.join(rules, "host", "left").collect():  # a row per source
        named = re.findall(r"(?im)^sitemap:\s*(\S+)", r.body or "")
        found, _ = readers.sitemap_walk(spark, client, named or [r.root.split("://", 1)[0] + f"://{r.host}/sitemap.xml"], r.host)
        if found:
            queued = queued.union(spark.createDataFrame([(r.source, u) for u in found], "source string, url string"))
    queued = queued.union(saved.select("source", F.explode("links").alias("url")))
    done = saved.select("url")
    totals = None
    while True:
        level = queued.join(src, "source").withColumn("url", U.canonical(F.col("url"))).filter(U.in_scope(F.col("url"), F.col("root"))).select("source", "root", "url").distinct()
        level = A.materialize(level.join(done, "url", "left_anti"), "queued")
        if level.isEmpty():
            break
        allowed = A.materialize(readers.robots_allowed(level.select("url"), rules, http.USER_AGENT), "allowed")
        got = http.fetched(allowed.filter("allowed").select("url"), client, delay, asked).join(level, "url")
        final = U.canonical(F.col("final_url"))
        why = F.when(F.col("error").isNotNull(), F.col("error")).when(~U.in_scope(final, F.col("root")), "Redirect outside scope").when(~F.coalesce(F.lower("content_type").contains("text/html"), F.lit(False)), "Not an HTML article")
        got = H.articles(got.withColumn("error", why).withColumn("final", final), "html", ["source", "root", "url", "final", "html", "error"])
        got = A.materialize(got.withColumn("error", F.coalesce("error", F.when(~T.long_enough(F.col("article")), "Article text unexpectedly short"))), "got")
        good = frontier.first_by_final_url(got.filter("error IS NULL").join(saved.select(F.col("url").alias("final")), "final", "left_anti"), "final", "url")
        links = L.resolved(good.select(F.col("final").alias("id"), F.col("final").alias("url"), "html"), "id", "url", "html").join(good.select(F.col("final").alias("id"), "root"), "id")
        links = L.scoped_array(links, "id", "root")
        rec = good.join(links.withColumnRenamed("id", "final"), "final", "left").select("source", F.col("final").alias("url"), F.col("url").alias("requested_url"), H.ledger_title(F.col("html")).alias("title"), F.col("article").alias("text"), F.col("html").alias("article_html"), F.coalesce("links", F.array().cast("array<string>")).alias("links"), F.unix_timestamp(F.current_timestamp()).cast("double").alias("fetched_at"), T.sha256(F.col("html")).alias("response_sha256"), T.sha256(F.col("html")).alias("article_sha256"))
        rec = A.materialize(rec, "records")
        writers.append_ledger(rec, f"{output}/pages")
        writers.append_bundle(rec, f"{output}/bundle")
        now = F.unix_timestamp(F.current_timestamp()).cast("double").alias("time")
        events = got.select("source", now, F.when(F.col("error").isNull(), "page_saved").otherwise("page_failed").alias("kind"), "url", "error")
        events = events.union(level.join(allowed.filter("NOT allowed"), "url").select("source", now, F.lit("robots_blocked"), "url", F.lit(None).cast("string")))
        events = A.materialize(events, "events")
        writers.append_ledger(events, f"{output}/coverage")
        totals = events if totals is None else totals.union(events)
        done = A.materialize(done.union(level.select("url")).union(rec.select("url")).distinct(), "done")
        saved = rec
        queued = rec.select("source", F.explode("links").alias("url"))
    ends = src.select("source", F.unix_timestamp(F.current_timestamp()).cast("double").alias("time"), F.lit("source_finished").alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("error"))
    writers.append_ledger(ends, f"{output}/coverage")
    return stats.source_phase(ends if totals is None else totals.union(ends))


def notes(spark: SparkSession, output: str, topics: DataFrame, open_client: Callable, model: str, k: int = 8) -> DataFrame:
    """A model's notes on the first ``k`` pages of each source by topic that have none yet, appended to ``output``/notes."""
    pages = readers.ledger(spark, f"{output}/pages", "source string, " + readers.LEDGER)
    have = readers.ledger(spark, f"{output}/notes", readers.NOTE)
    first = stats.without_note(stats.top_per_source(pages, topics, "source", "url", k), have).select("source", "url")
    p = pages.join(first, ["source", "url"]).withColumn("excerpt", T.excerpt(F.col("text")))
    p = p.withColumn("prompt", F.concat(F.lit("URL: "), "url", F.lit("\nTitle: "), F.coalesce("title", F.lit("")), F.lit("\n\nEVIDENCE:\n"), "excerpt"))
    got = generate(p, "prompt", open_client, ["url", "article_sha256", "excerpt", "text"])
    out = got.select("url", F.col("article_sha256").alias("source_article_sha256"), F.length("excerpt").alias("selected_excerpt_chars"), F.length("text").alias("full_article_chars"), F.lit(model).alias("model"), F.unix_timestamp(F.current_timestamp()).cast("double").alias("time"), F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), F.col("answer").alias("note"), "error", F.lit(None).cast("double").alias("seconds"))
    out = A.materialize(out, "notes")
    writers.append_ledger(out, f"{output}/notes")
    return out


def watch(spark: SparkSession, output: str, state: Callable[[], dict], every: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """Audits a run over and over until it is finished or its process has ended; each result is appended to audit.

    ``state`` gives the run's pid, phase and number of files.
    """
    while True:
        now = state()
        running = audit.alive(now["pid"])
        led = readers.ledger(spark, f"{output}/pages", "source string, " + readers.LEDGER, strict=False)
        cov = readers.ledger(spark, f"{output}/coverage", readers.COVERAGE, strict=False)
        found = [f"{r.source}: {r.finding}" for r in audit.findings(led, cov).orderBy("source", "finding").collect()]  # a few rows a source
        result = {"time": time.time(), "phase": now["phase"], "scraper_running": running, "files": now["files"], "findings": found + audit.run_findings(now["files"], now["phase"], running)}
        writers.replace_snapshot(spark, f"{output}/audit.json", result)
        writers.append_ledger(spark.createDataFrame([result], "time double, phase string, scraper_running boolean, files int, findings array<string>"), f"{output}/audit")
        if now["phase"] == "finished" or running is False:
            return result
        sleep(every)
