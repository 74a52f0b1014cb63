"""Single pages without a cluster, and a crawl behind one class: what programs import."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import DataFrame, SparkSession


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data)


def extract_text_content(html: str | None) -> str:
    """All text of a page but scripts and styles: nothing between elements, cut at line ends and double blanks, no empty lines."""
    p = _Text()
    p.feed(html or "")
    p.close()
    parts = (x.strip() for line in "".join(p.out).splitlines() for x in line.strip().split("  "))
    return "\n".join(x for x in parts if x)


def clean_filename(text: str, max_length: int = 50) -> str:
    """A file name: no tags, signs that file systems refuse and blanks as single underscores."""
    t = re.sub(r"<[^>]+>", "", text or "")
    t = re.sub(r"[\s_]+", "_", re.sub(r'[<>:"/\\|?*]', "_", t)).strip("_")
    return t[:max_length].rstrip("_") or "scraped_content"


class WebScraper:
    """A crawl over a page store (url, html) or, with a client of ``sources.http``, over the network."""

    def __init__(self, spark: SparkSession, store: DataFrame | None = None, client=None, delay: float = 0.5) -> None:
        if (store is None) == (client is None):
            raise ValueError("either a store or a client")
        self.spark, self.store, self.client, self.delay = spark, store, client, delay

    def pages(self, start: str, subdomain: str | None = None, path_prefix: str | None = None, max_pages: int = 300, include_external: bool = False) -> DataFrame:
        """url, depth, title, content, html of the pages reached from ``start``."""
        from pyspark.sql import functions as F

        from corpusloom.config import scope_of
        from corpusloom.functions import html as H
        from corpusloom.operators import frontier
        from corpusloom.streaming.jobs import crawl_with

        host, prefix = scope_of(start, subdomain, path_prefix)
        if self.client is not None:
            reached = crawl_with(self.spark, start, host, self.client, prefix, max_pages, self.delay)
        else:
            state = frontier.crawl(self.store, start, prefix, max_pages, include_external=include_external).filter("state = 'yielded'")
            reached = state.join(self.store.select("url", "html").dropDuplicates(["url"]), "url")
        return reached.select("url", "depth", H.page_title(F.col("html"), F.col("url")).alias("title"), H.page_text(F.col("html")).alias("content"), "html")
