"""Command line: scrape, extract-urls, discover-urls, validate, stats, research, watch, audit, rerender."""

from __future__ import annotations

import argparse
import importlib
import logging
import os
import sys

from pyspark.sql import functions as F

from corpusloom import __version__
from corpusloom.config import Config, scope_of
from corpusloom.functions import html as H
from corpusloom.functions import url as U
from corpusloom.operators import agent as A
from corpusloom.operators import audit, frontier, links, stats
from corpusloom.operators.memory import Memory
from corpusloom.session import get_session, materialize, numbered
from corpusloom.sources import http, readers, writers
from corpusloom.streaming import jobs


log = logging.getLogger("corpusloom")


def _named(spec: str | None):
    if not spec:
        return None
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def scrape(spark, o: argparse.Namespace) -> int:
    """The scrape command: crawl, then the agent or plain documents."""
    if os.path.isdir(o.output_dir) and os.listdir(o.output_dir) and not o.yes and input(f"{o.output_dir} is not empty. Go on? [y/N] ").strip().lower() != "y":
        return 1
    host, prefix = scope_of(o.url, o.subdomain, o.path_prefix)
    cfg = Config(max_pages=o.max_files, prefix=prefix, include_external=o.include_external, use_agent=o.agent, skip_clean=o.no_llm_clean, similarity=o.similarity_threshold, delay=o.delay, timeout=o.timeout, user_agent=o.user_agent)
    if o.store:
        store = spark.read.parquet(o.store).select("url", "html")
        reached = frontier.crawl(store, o.url, cfg.prefix, cfg.max_pages, include_external=cfg.include_external).filter("state = 'yielded'")
        reached = reached.join(store.dropDuplicates(["url"]), "url")
    else:
        client = http.browser_client(user_agent=cfg.user_agent) if o.use_browser else http.http_client(cfg.user_agent, cfg.timeout)
        reached = jobs.crawl_with(spark, o.url, host, client, cfg.prefix, cfg.max_pages, cfg.delay)
    pages = numbered(reached.select("url", "depth", "html"), ["depth", "url"], "seq")
    log.info("reached %d pages", pages.count())
    text = H.page_text(F.col("html")) if cfg.skip_clean or not cfg.use_agent else F.coalesce(F.nullif(H.page_text(F.regexp_replace("html", r"(?is)<(nav|aside|footer|button|noscript)\b[^>]*>.*?</\1\s*>", "")), F.lit("")), F.lit(""))
    pages = materialize(pages.select("seq", "url", H.page_title(F.col("html"), F.col("url")).alias("title"), text.alias("content")), "pages")
    if cfg.use_agent:
        memory, model, embedder = Memory(spark, f"{o.output_dir}/memory"), _named(o.model), _named(o.embed_model)
        have = memory.read()
        decided = materialize(A.decide_by_model(pages, have, model, cfg, embedder) if model else A.decide_batch(pages, have, cfg, embedder), "decided")
        log.info("decided")
        first = max(memory.next_index(), readers.next_file_index(spark, o.output_dir))
        rows = A.memory_rows(decided.filter("decision = 'SAVE'") if model else decided, have, first, at=F.current_timestamp())
        if model:
            rows = rows.unionByName(A.merged_by_model(decided, have, model, F.current_timestamp()).drop("error"))
        rows = materialize(rows, "rows")
        failed = materialize(A.error_rows(decided, first + decided.filter("decision = 'SAVE'").count()), "failed")
        memory.upsert(rows, least=first + decided.filter("decision IN ('SAVE', 'ERROR')").count())
        writers.write_documents(rows, o.output_dir)
        writers.write_documents(failed, o.output_dir)
        A.results(decided).groupBy("decision").count().orderBy("decision").show()
    else:
        first = readers.next_file_index(spark, o.output_dir)
        writers.write_documents(pages.withColumn("doc_id", H.doc_name(F.col("seq") - 1 + first, F.col("title"))), o.output_dir)
        print(pages.count(), "pages")
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corpusloom")
    p.add_argument("-v", "--verbose", action="store_true", help="log each step")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scrape", help="crawl from a start url and store the documents found")
    s.add_argument("url")
    s.add_argument("--store", help="parquet table of url, html to crawl instead of the network")
    s.add_argument("-o", "--output-dir", default="scraped")
    s.add_argument("-m", "--max-files", type=int, default=300)
    s.add_argument("-d", "--delay", type=float, default=Config.delay)
    s.add_argument("-t", "--timeout", type=float, default=Config.timeout)
    s.add_argument("--include-external", action="store_true")
    s.add_argument("-s", "--subdomain", help="keep to this host, or host/path")
    s.add_argument("-p", "--path-prefix")
    s.add_argument("-y", "--yes", action="store_true", help="write into a folder that is not empty without asking")
    s.add_argument("--user-agent", default=Config.user_agent)
    s.add_argument("--use-browser", action="store_true")
    s.add_argument("--agent", action=argparse.BooleanOptionalAction, default=True)
    s.add_argument("--model", help="module:function that opens a model client, called with a prompt; without one the rules decide")
    s.add_argument("--embed-model", help="module:function that embeds a list of texts")
    s.add_argument("--no-llm-clean", action="store_true")
    s.add_argument("--similarity-threshold", type=float, default=Config.similarity)
    r = sub.add_parser("research", help="ledgers of documentation sites")
    r.add_argument("--output", required=True)
    r.add_argument("--source", action="append", default=[], metavar="NAME=ROOT")
    w = sub.add_parser("watch", help="audit a research run every 30 seconds until it ends")
    w.add_argument("output")
    w.add_argument("--pid", type=int, required=True)
    w.add_argument("--phase", default="crawl")
    for name in ("extract-urls", "discover-urls"):
        e = sub.add_parser(name, help="sorted links of an html file")
        e.add_argument("html_file", help="file, or with discover-urls a url to fetch with a browser")
        e.add_argument("-b", "--base-url", required=True)
        e.add_argument("-p", "--path-prefix")
        e.add_argument("-o", "--output")
    v = sub.add_parser("validate")
    v.add_argument("url")
    t = sub.add_parser("stats")
    t.add_argument("directory")
    for name in ("audit", "rerender"):
        a = sub.add_parser(name)
        a.add_argument("ledger")
        if name == "audit":
            a.add_argument("--coverage")
        else:
            a.add_argument("--output", required=True)
    o = p.parse_args(argv)
    spark = get_session(master=None)
    if o.verbose:
        logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    if o.command == "scrape":
        return scrape(spark, o)
    if o.command == "research":
        roots = dict(x.split("=", 1) for x in o.source)
        jobs.research_crawl(spark, roots, http.http_client(), o.output).show(truncate=False)
    elif o.command == "watch":
        print(jobs.watch(spark, o.output, lambda: {"pid": o.pid, "phase": o.phase, "files": len(os.listdir(o.output))}))
    elif o.command in ("extract-urls", "discover-urls"):
        if o.command == "discover-urls" and o.html_file.startswith(("http://", "https://")):
            page = http.fetched(spark.createDataFrame([(o.html_file,)], "url string"), http.browser_client(), 0.0).select("html")
        else:
            page = readers.html_file(spark, o.html_file)
        page = page.select(F.lit(1).alias("id"), F.lit(o.base_url).alias("url"), "html")
        found = links.internal(page, "id", "url", "html", o.path_prefix).filter(~F.col("target").startswith("javascript:")).select(F.col("target").alias("url"))
        if o.output:
            writers.write_urls(found, o.output)
        else:
            for r in found.orderBy("url").toLocalIterator():
                print(r.url)
    elif o.command == "validate":
        ok = spark.range(1).select(U.valid(F.lit(o.url))).first()[0]
        print("valid" if ok else "invalid")
        return 0 if ok else 1
    elif o.command == "stats":
        f = readers.text_files(spark, o.directory)
        f.agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).show()
        f.orderBy(F.desc("length"), "path").limit(5).show(truncate=False)
    elif o.command == "audit":
        led, torn = readers.tolerant_ledger(spark, o.ledger, "page_id bigint, source string, " + readers.LEDGER)
        cov = readers.ledger(spark, o.coverage, readers.COVERAGE) if o.coverage else None
        found = audit.findings(led, cov) if cov is not None else audit.duplicates(led).select("source", F.lit("duplicate urls").alias("finding")).unionByName(audit.checksums(led).select("source", F.lit("article checksum mismatch").alias("finding")))
        for x in found.unionByName(torn.select(F.col("file").alias("source"), F.concat(F.lit("corrupt line "), "line_no").alias("finding"))).orderBy("source", "finding").toLocalIterator():
            print(f"{x.source}: {x.finding}")
    else:
        led = readers.ledger(spark, o.ledger, "page_id bigint, source string, " + readers.LEDGER)
        audit.rerendered(led, H.page_text(F.col("article_html"))).write.mode("overwrite").json(o.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
