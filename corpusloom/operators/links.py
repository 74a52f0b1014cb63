"""Link tables: edges from page to target. Pages are (id column, url, html)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions import url as U

# Targets that are no pages.
SKIPPED = r"^(#|mailto:|tel:)"


def raw_links(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """page id, url and href of every anchor with a target, repeats kept."""
    return pages.select(page_id, F.col(url).alias("url"), F.explode(H.hrefs(F.col(html))).alias("href"))


def resolved(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """page id, url, href and absolute target; root-relative links stay in the JVM, the others go through the general resolver."""
    raw = raw_links(pages, page_id, url, html).filter((F.trim("href") != "") & ~F.col("href").rlike(SKIPPED))
    root = F.col("href").rlike("^/(?!/)") & F.col("url").isNotNull()
    easy = raw.filter(root).withColumn("target", U.resolve_root(F.col("url"), F.col("href")))
    hard = raw.filter(~root).withColumn("target", U.resolve(F.col("url"), F.col("href")))
    return easy.union(hard)


def internal(pages: DataFrame, page_id: str, url: str, html: str, prefix: str | None = None) -> DataFrame:
    """Distinct (page id, target) on the page's own host, under a path prefix if given."""
    r = resolved(pages, page_id, url, html)
    return r.filter(U.same_site(F.col("target"), F.col("url")) & U.under_prefix(F.col("target"), prefix)).select(page_id, "target").distinct()


def external(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """Distinct (page id, target) that begin with http and leave the host; targets stay as written."""
    raw = raw_links(pages, page_id, url, html)
    return raw.filter(F.col("href").startswith("http") & ~U.same_site(F.col("href"), F.col("url"))).select(page_id, F.col("href").alias("target")).distinct()


def scoped_array(links: DataFrame, page_id: str, root: str) -> DataFrame:
    """Sorted distinct canonical targets in scope of ``root`` (a column), as one array a page; a page's links only."""
    t = links.withColumn("_c", U.canonical(F.col("target"))).filter(U.in_scope(F.col("_c"), F.col(root)))
    return t.groupBy(page_id).agg(F.array_sort(F.collect_set("_c")).alias("links"))
