"""Crawling as set algebra over a page source: frontier, seen set, levels, limits, resumption.

The order of pages is (depth, url). The page source is any table with url and html; a url without a row there
is a failed fetch, one whose text is blank was fetched but yields nothing.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions import url as U
from corpusloom.operators import links as L
from corpusloom.session import materialize, numbered


def unseen(candidates: DataFrame, *seen: DataFrame) -> DataFrame:
    """Distinct urls of ``candidates`` that no seen table has; null urls drop out."""
    out = candidates.select("url").filter("url IS NOT NULL").distinct()
    for s in seen:
        out = out.join(s.select("url").distinct(), "url", "left_anti")
    return out


def admitted(urls: DataFrame, host: str, prefix: str | None = None) -> DataFrame:
    return urls.filter(U.on_host(F.col("url"), host) & U.under_prefix(F.col("url"), prefix))


def crawl(pages: DataFrame, start: str, prefix: str | None = None, max_pages: int = 300, max_levels: int | None = None, include_external: bool = False) -> DataFrame:
    """Pages reached from ``start``: url, depth, state (yielded, empty, failed), in levels.

    The store is read once, for the state and the links of its admitted pages; the levels are joins of urls alone and
    are written to the shared folder. It stops when a level finds nothing new, when ``max_pages`` pages have been yielded
    (the last ones by url), or after ``max_levels`` if given. With ``include_external`` links to other hosts are
    candidates too; as all others they must be on the start's host, so they lead to no other site.
    """
    spark = pages.sparkSession
    host = start.split("://", 1)[-1].split("/", 1)[0].split("?", 1)[0].split("#", 1)[0].lower()
    store = admitted(pages.select("url", "html"), host, prefix).filter("html IS NOT NULL")
    states = store.groupBy("url").agg(F.max(F.when(H.page_text(F.col("html")) == "", 0).otherwise(1)).alias("full"))
    states = materialize(states.select("url", F.when(F.col("full") == 1, "yielded").otherwise("empty").alias("state")), "states")
    page = store.select(F.col("url").alias("page"), "url", "html")
    found = L.internal(page, "page", "url", "html", prefix)
    if include_external:
        found = found.union(L.external(page, "page", "url", "html")).distinct()
    edges = materialize(admitted(found.select("page", F.col("target").alias("url")), host, prefix), "edges")
    level = admitted(spark.createDataFrame([(start.split("#", 1)[0],)], "url string"), host, prefix)
    done, seen, yielded = None, None, 0
    for depth in count() if max_levels is None else range(max_levels):
        got = materialize(level.join(states, "url", "left").select("url", F.lit(depth).alias("depth"), F.coalesce("state", F.lit("failed")).alias("state")), "level")
        n = got.filter("state = 'yielded'").count()
        last = yielded + n >= max_pages
        part = got.filter("state <> 'yielded'").union(got.filter("state = 'yielded'").orderBy("url").limit(max_pages - yielded)) if yielded + n > max_pages else got
        done = part if done is None else done.union(part)
        seen = got if seen is None else seen.union(got)
        yielded += n
        if last:
            break
        reached = got.filter("state = 'yielded'").select(F.col("url").alias("page")).join(edges, "page").select("url")
        level = materialize(unseen(reached, seen), "frontier")
        if level.isEmpty():
            break
    return done


def within_scope(fetched: DataFrame, root: str) -> DataFrame:
    """Fetched pages (final_url, content_type and more) with an error where a redirect led out of ``root``'s scope or the
    answer is no HTML; null otherwise. The final url is the canonical one."""
    final = U.canonical(F.col("final_url"))
    error = F.when(~U.in_scope(final, F.lit(root)), F.concat(F.lit("Redirect outside scope: "), F.col("final_url"))).when(~F.coalesce(F.lower("content_type").contains("text/html"), F.lit(False)), "Not an HTML article")
    have = F.col("error") if "error" in fetched.columns else F.lit(None).cast("string")
    return fetched.withColumn("error", F.coalesce(have, error)).withColumn("final_url", final)


def prioritised(urls: DataFrame) -> DataFrame:
    """url, depth (path segments) and rank in crawl order: fewest segments first, then by url."""
    return numbered(urls.select("url", U.depth(F.col("url")).alias("depth")), ["depth", "url"], "rank")


def first_by_final_url(fetched: DataFrame, final_url: str, seq: str) -> DataFrame:
    """The earliest row of each final url by ``seq``; null urls are each kept."""
    w = Window.partitionBy(final_url).orderBy(F.col(seq).asc_nulls_last())
    have = fetched.filter(F.col(final_url).isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return have.union(fetched.filter(F.col(final_url).isNull()))


def pending(queued: DataFrame, seen: DataFrame, saved: DataFrame) -> DataFrame:
    return unseen(queued, seen, saved)


def resumed(ledger: DataFrame) -> DataFrame:
    """Urls to go on with: links of saved pages that were not saved themselves."""
    out = ledger.select(F.explode("links").alias("url"))
    return unseen(out, ledger.select("url"))
