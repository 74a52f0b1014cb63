"""Fetching pages over HTTP or with a browser, politely, inside tasks. Only the standard library is needed for HTTP."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import url as U

# The defaults of a fetch.
USER_AGENT, TIMEOUT, DELAY, LEAST_DELAY = "corpusloom/0.2", 10.0, 0.5, 0.4
FETCHED = "url string, final_url string, content_type string, html string, error string"


@dataclass
class Answer:
    html: str
    final_url: str
    content_type: str = "text/html"


def http_client(user_agent: str = USER_AGENT, timeout: float = TIMEOUT) -> Callable[[], Callable[[str], Answer]]:
    """What a task opens to GET pages; redirects are followed, and any other status than 2xx is an error."""

    def open_client() -> Callable[[str], Answer]:
        from urllib.request import Request, build_opener

        opener = build_opener()

        def get(url: str) -> Answer:
            if not url.lower().startswith(("http://", "https://")):
                raise ValueError("not an http url")
            with opener.open(Request(url, headers={"User-Agent": user_agent}), timeout=timeout) as r:
                charset = r.headers.get_content_charset() or "utf-8"
                return Answer(r.read().decode(charset, "replace"), r.geturl(), r.headers.get("Content-Type", ""))

        return get

    return open_client


def browser_client(wait_seconds: float = 2.0, wait_selector: str | None = None, timeout: float = 30.0, user_agent: str = USER_AGENT) -> Callable[[], Callable[[str], Answer]]:
    """As ``http_client`` with a headless browser, for pages that scripts make; needs playwright on the executors."""

    def open_client() -> Callable[[str], Answer]:
        from playwright.sync_api import sync_playwright

        play = sync_playwright().start()
        browser = play.chromium.launch(headless=True)

        def get(url: str) -> Answer:
            page = browser.new_page(user_agent=user_agent)
            try:
                page.goto(url, wait_until="domcontentloaded", timeout=timeout * 1000)
                if wait_selector:
                    page.wait_for_selector(wait_selector, timeout=timeout * 1000)
                page.wait_for_timeout(wait_seconds * 1000)
                return Answer(page.content(), page.url)
            finally:
                page.close()

        def close() -> None:
            browser.close()
            play.stop()

        get.close = close
        return get

    return open_client


def fetched(frontier: DataFrame, open_client: Callable[[], Callable[[str], Answer]], delay: float = DELAY, delays: DataFrame | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """url, final_url, content_type, html, error of every url of a frontier; a failed fetch has an error and no html.

    A host's urls are fetched by one task, one after another in url order, with a pause after each that succeeded, so
    hosts run side by side and none is asked more often than allowed. ``delays`` (host, delay) are those that hosts ask
    for; they count if they are longer than ``delay``, and no pause is shorter than ``LEAST_DELAY`` where one is asked for.
    """
    urls = frontier.select("url").distinct().withColumn("host", F.lower(U.netloc(F.col("url"))))
    if delays is not None:
        urls = urls.join(delays.groupBy(F.lower("host").alias("host")).agg(F.max("delay").alias("asked")), "host", "left")
    else:
        urls = urls.withColumn("asked", F.lit(None).cast("double"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = open_client()
        try:
            for p in batches:
                out = []
                for u, asked in zip(p["url"], p["asked"]):
                    try:
                        a = get(u)
                        out.append((u, a.final_url, a.content_type, a.html, None))
                        sleep(delay if pd.isna(asked) else max(delay, LEAST_DELAY, float(asked)))
                    except Exception as e:  # one page's failure must not end the crawl
                        out.append((u, None, None, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(out, columns=["url", "final_url", "content_type", "html", "error"])
        finally:
            getattr(get, "close", lambda: None)()

    return urls.repartition("host").sortWithinPartitions("host", "url").select("url", "asked").mapInPandas(run, FETCHED)
