"""Readers: page stores, stored documents, ledgers, sitemaps, robots rules, status snapshots."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# Schemas of the data model.
PAGE = "url string, title string, content string, html string"
LEDGER = "url string, requested_url string, title string, text string, article_html string, links array<string>, fetched_at double, response_sha256 string, article_sha256 string, rendering_version int, text_sha256 string"
COVERAGE = "source string, time double, kind string, url string, error string, remaining array<string>"
NOTE = "url string, source_article_sha256 string, selected_excerpt_chars int, full_article_chars int, model string, time double, status string, note string, error string, seconds double"
STATE = "pid bigint, started double, phase string, scope string, files int, finished double, sources map<string,struct<saved:int,failed:int,blocked:int,pending:int,phase:string>>, ai struct<completed:int,errors:int,active:string>"


def fetch(frontier: DataFrame, store: DataFrame) -> DataFrame:
    """Frontier urls with their html from a page table; null html means that the fetch failed."""
    return frontier.select("url").join(store.select("url", "html").dropDuplicates(["url"]), "url", "left")


def fetch_with(frontier: DataFrame, open_fetcher: Callable[[], Callable[[str], str | None]]) -> DataFrame:
    """As ``fetch`` with a client that each task opens once: HTTP, a browser, anything. A raised error is a failed fetch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = open_fetcher()
        for p in batches:
            out = []
            for u in p["url"]:
                try:
                    out.append(get(u))
                except Exception:  # one page's failure must not end the crawl
                    out.append(None)
            yield pd.DataFrame({"url": p["url"], "html": out})

    return frontier.select("url").mapInPandas(run, "url string, html string")


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length of every .txt file of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path", "length")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """path and body of stored documents."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(F.input_file_name().alias("path"), T.body_of(F.col("value")).alias("body"))


def html_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "html")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def next_file_index(spark: SparkSession, folder: str, least: int = 0) -> int:
    """The index after the greatest that a stored document's file name begins with, at least ``least``."""
    if not _exists(spark, folder):
        return least
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(folder).select(F.regexp_extract("path", r"/([0-9]+)_[^/]*$", 1).alias("n"))
    return max(least, names.agg(F.coalesce(F.max(F.expr("try_cast(n as int)")), F.lit(-1)) + 1).first()[0])


def ledger(spark: SparkSession, path: str, schema: str = LEDGER, strict: bool = True) -> DataFrame:
    """JSON lines; a missing file is empty. Strict: a corrupt line is an error. Blank lines are skipped."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def tolerant_ledger(spark: SparkSession, path: str, schema: str = LEDGER) -> tuple[DataFrame, DataFrame]:
    """Records, and findings (file, line_no) of corrupt lines; a torn last line of a file is no finding.

    Lines are numbered within a file by a whole-file read, so a single ledger file must fit a task's memory.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\n").alias("ls"))
    lines = lines.select("file", F.size("ls").alias("n"), F.posexplode("ls").alias("i", "line")).filter(F.trim("line") != "")

    @F.pandas_udf("boolean")
    def good(s: pd.Series) -> pd.Series:
        def ok(x: str) -> bool:
            try:
                return isinstance(json.loads(x), dict)
            except ValueError:
                return False

        return s.map(ok)

    marked = lines.withColumn("ok", good("line"))
    last = marked.groupBy("file").agg(F.max("i").alias("last"))
    findings = marked.filter("NOT ok").join(last, "file").filter("i < last").select("file", (F.col("i") + 1).alias("line_no"))
    return marked.filter("ok").select(F.from_json("line", schema).alias("r")).select("r.*"), findings


def sitemap_locs(maps: DataFrame, xml: str = "xml") -> DataFrame:
    """loc values of sitemap documents with whether the document is an index; namespaces do not matter."""
    index = F.coalesce(F.col(xml).rlike(r"(?is)<(?:\w+:)?sitemapindex[\s>]"), F.lit(False))
    locs = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<(?:\w+:)?loc\s*>\s*(.*?)\s*</(?:\w+:)?loc\s*>"), F.lit(1))
    return maps.select(index.alias("is_index"), F.explode(locs).alias("loc")).withColumn("loc", F.replace(F.col("loc"), F.lit("&amp;"), F.lit("&")))


def sitemap_urls(store: DataFrame, starts: list[str], host: str, limit: int | None = None) -> list[str]:
    """Page urls of a site's sitemaps: indexes are followed on the same host, level by level. ``store`` has url and xml.

    At most ``limit`` maps are read if it is given; ``sitemap_rest`` tells which were left.
    """
    return _walk(lambda urls: store.filter(F.col("url").isin(urls)).select("xml"), starts, host, limit)[0]


def sitemap_rest(store: DataFrame, starts: list[str], host: str, limit: int) -> list[str]:
    """The maps that a limit leaves unread."""
    return _walk(lambda urls: store.filter(F.col("url").isin(urls)).select("xml"), starts, host, limit)[1]


def sitemap_walk(spark: SparkSession, open_client: Callable, starts: list[str], host: str, limit: int | None = None) -> tuple[list[str], list[str]]:
    """As ``sitemap_urls`` and ``sitemap_rest``, over the network; a map that can't be fetched is empty."""
    from corpusloom.sources import http

    get = lambda urls: http.fetched(spark.createDataFrame([(u,) for u in urls], "url string"), open_client, 0.0).select(F.col("html").alias("xml"))
    return _walk(get, starts, host, limit)


def _walk(get: Callable[[list[str]], DataFrame], starts: list[str], host: str, limit: int | None) -> tuple[list[str], list[str]]:
    from corpusloom.functions import url as U

    todo, seen, pages = list(starts), set(), set()
    while todo and (limit is None or len(seen) < limit):
        fresh = [u for u in dict.fromkeys(todo) if u not in seen]
        batch = fresh if limit is None else fresh[: limit - len(seen)]
        if not batch:
            return sorted(pages), []
        seen.update(batch)
        got = sitemap_locs(get(batch)).filter(U.on_host(F.col("loc"), host)).distinct().collect()  # one site's maps
        todo = fresh[len(batch) :] + [r.loc for r in got if r.is_index]
        pages.update(r.loc for r in got if not r.is_index)
    return sorted(pages), sorted({u for u in todo if u not in seen})


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str = "corpusloom") -> DataFrame:
    """url, allowed. ``rules`` has host, status and body: 200 is parsed, 404 allows all, any other status blocks the host.

    A host without a row is allowed.
    """
    from corpusloom.functions import url as U

    j = urls.withColumn("host", F.lower(U.netloc(F.col("url")))).join(rules.select(F.lower("host").alias("host"), "status", "body"), "host", "left")

    @F.pandas_udf("boolean")
    def ok(u: pd.Series, status: pd.Series, body: pd.Series) -> pd.Series:
        parsed: dict[str, RobotFileParser] = {}
        out = []
        for x, s, b in zip(u, status, body):
            if pd.isna(s) or s == 404:
                out.append(True)
            elif s != 200:
                out.append(False)
            else:
                if b not in parsed:
                    parsed[b] = RobotFileParser()
                    parsed[b].parse((b or "").splitlines())
                out.append(parsed[b].can_fetch(agent, x))
        return pd.Series(out)

    return j.select("url", ok("url", "status", "body").alias("allowed"))


def status(spark: SparkSession, path: str) -> DataFrame:
    """A run's status document as one row per source: source, saved, failed, blocked, pending, phase."""
    return spark.read.schema(STATE).json(path, multiLine=True).select(F.explode("sources").alias("source", "s")).select("source", "s.*")
