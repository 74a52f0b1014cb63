"""The engine's queries over the test tables, each over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.config import Config
from corpusloom.functions import html as H
from corpusloom.functions import text as T
from corpusloom.functions import url as U
from corpusloom.operators import agent as A
from corpusloom.operators import audit, frontier, links, stats
from corpusloom.operators import memory as M
from corpusloom.operators import vectors as V
from corpusloom.session import lookup_join, table
from corpusloom.sources import readers

QUERIES: dict = {}
ROOT = "https://quaymere.test/docs/"
HOST, PREFIX = "docs.quaymere.test", "/docs"
EVERY = 20  # queries of a search: rows whose id is divisible by this
RECALL = 0.35  # the embeddings' greatest similarities lie about here


def query(f):
    QUERIES[f.__name__] = f
    return f


def _scrape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scrape_url")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


# ---------------------------------------------------------------- pages and text


@query
def page_text(spark, d):
    t = _scrape(spark, d).select("fetch_id", H.page_text(F.col("html")).alias("text"))
    return t.filter("text <> ''")


@query
def page_title(spark, d):
    return _scrape(spark, d).select("fetch_id", H.page_title(F.col("html"), F.col("url")).alias("title"))


@query
def ledger_title(spark, d):
    return _scrape(spark, d).select("fetch_id", H.ledger_title(F.col("html")).alias("title"))


@query
def filename_slug(spark, d):
    s = _scrape(spark, d).filter("title IS NOT NULL")
    return s.select("fetch_id", H.slug(F.col("title")).alias("slug"), H.doc_name(F.col("fetch_id"), F.col("title")).alias("doc_name"))


@query
def next_index(spark, d):
    """The index after the greatest in use; all digits of a name's prefix count."""
    r = table(spark, d, "process_result")
    return r.agg((F.coalesce(F.max(F.expr("try_cast(regexp_extract(doc_id, '^([0-9]+)_', 1) as int)")), F.lit(-1)) + 1).alias("next_index"))


@query
def render_document(spark, d):
    s = _scrape(spark, d)
    return s.select("fetch_id", T.document(F.col("url"), H.page_title(F.col("html"), F.col("url")), H.page_text(F.col("html"))).alias("body"))


@query
def read_body(spark, d):
    s = _scrape(spark, d)
    return s.select("fetch_id", T.body_of(T.document(F.col("url"), F.col("title"), F.col("content"))).alias("body"))


@query
def article_text(spark, d):
    """Article bodies by the tree walk, furniture elements left out, code fenced."""
    return H.articles(_pages(spark, d), "article_html", ["page_id"])


@query
def boilerplate_ratio(spark, d):
    """Characters of all text and of what is left without furniture elements."""
    kept = F.regexp_replace("article_html", r"(?is)<(nav|aside|footer|button|noscript)\b[^>]*>.*?</(nav|aside|footer|button|noscript)\s*>", "")
    p = _pages(spark, d).filter("article_html IS NOT NULL").select("page_id", F.length(H.page_text(F.col("article_html"))).alias("full_chars"), F.length(H.page_text(kept)).alias("article_chars"))
    return p.withColumn("ratio", F.round(F.coalesce(F.try_divide(F.col("article_chars"), F.col("full_chars")), F.lit(0.0)), 6))


@query
def bundle_sections(spark, d):
    p = _pages(spark, d).filter("text IS NOT NULL AND title IS NOT NULL")
    return p.select("page_id", T.bundle_sections(T.bundle_entry(F.col("title"), F.col("url"), F.col("text"))).alias("sections"))


# ---------------------------------------------------------------- urls


@query
def url_parts(spark, d):
    u = F.col("url")
    return _scrape(spark, d).select("fetch_id", U.scheme(u).alias("scheme"), U.netloc(u).alias("netloc"), U.path(u).alias("path"))


@query
def canonical_url(spark, d):
    return _scrape(spark, d).select("fetch_id", U.canonical(F.col("url")).alias("canonical"))


@query
def scope_filter(spark, d):
    u = F.col("url")
    return _scrape(spark, d).filter(U.on_host(u, HOST) & U.under_prefix(u, PREFIX)).select("fetch_id", "url")


@query
def in_scope_urls(spark, d):
    return _pages(spark, d).filter(U.in_scope(U.canonical(F.col("url")), F.lit(ROOT))).select("page_id", "url")


@query
def validate_urls(spark, d):
    return _scrape(spark, d).select("fetch_id", U.valid(F.col("url")).alias("ok"))


# ---------------------------------------------------------------- links


def _linked(spark, d):
    return _pages(spark, d).filter("article_html IS NOT NULL")


@query
def resolve_links(spark, d):
    return links.resolved(_linked(spark, d), "page_id", "url", "article_html").select("page_id", "href", "target").distinct()


@query
def internal_links(spark, d):
    return links.internal(_linked(spark, d), "page_id", "url", "article_html")


def _ledger_html(spark, d):
    """Pages that consist of the links that the ledger lists for them: page_id, url, html."""
    anchors = F.array_join(F.transform(F.coalesce("links", F.array()), lambda x: F.concat(F.lit('<a href="'), x, F.lit('">x</a>'))), "")
    return _pages(spark, d).select("page_id", "url", F.concat(F.lit("<h1>p</h1>"), anchors).alias("html"))


@query
def external_links(spark, d):
    """Links of the ledger's pages that leave the page's host."""
    return links.external(_ledger_html(spark, d), "page_id", "url", "html")


@query
def sorted_links(spark, d):
    """Links of the ledger's pages to pages of their own host below /docs."""
    return links.internal(_ledger_html(spark, d), "page_id", "url", "html", "/docs").select("target").distinct().orderBy("target")


@query
def page_link_arrays(spark, d):
    e = _pages(spark, d).filter("url IS NOT NULL").select("page_id", F.explode("links").alias("target"), F.lit(ROOT).alias("root"))
    return links.scoped_array(e, "page_id", "root").select("page_id", F.array_join("links", " ").alias("links"))


# ---------------------------------------------------------------- frontier


@query
def frontier_antijoin(spark, d):
    p = _pages(spark, d)
    return frontier.unseen(p.select(F.explode("links").alias("url")), p.filter("source = 'quaymere'").select("url"))


@query
def frontier_priority(spark, d):
    return frontier.prioritised(_pages(spark, d).select("url").filter("url IS NOT NULL").distinct())


@query
def crawl_limit(spark, d):
    """The first 300 pages in crawl order."""
    u = _pages(spark, d).select("url").filter("url IS NOT NULL").distinct().select("url", U.depth(F.col("url")).alias("depth"))
    return u.orderBy("depth", "url").limit(C.FILE_LIMIT)


@query
def crawl_levels(spark, d):
    """A crawl of the ledger's link graph from the url with most links of its own host."""
    p = _pages(spark, d).filter("url IS NOT NULL")
    store = _ledger_html(spark, d).filter("url IS NOT NULL").select("url", "html")
    own = p.select("url", F.explode("links").alias("to")).filter(U.same_site(F.col("url"), F.col("to")))
    start = own.groupBy("url").agg(F.countDistinct("to").alias("n")).orderBy(F.desc("n"), "url").limit(1).first()
    return frontier.crawl(store, start.url if start else ROOT, None, 1000)


@query
def pending_urls(spark, d):
    c = table(spark, d, "coverage")
    return frontier.pending(c.select("url"), c.filter("kind = 'page_failed'").select("url"), c.filter("kind = 'page_saved'").select("url"))


@query
def resume_frontier(spark, d):
    return frontier.resumed(_pages(spark, d).filter("rendering_version IS NOT NULL"))


@query
def dedupe_final_url(spark, d):
    p = _pages(spark, d).withColumn("canonical", U.canonical(F.col("url")))
    return frontier.first_by_final_url(p, "canonical", "page_id").select("page_id", "canonical")


@query
def robots_split(spark, d):
    """Urls that fixed rules of one host allow or block."""
    rules = spark.createDataFrame([("quaymere.test", 200, "User-agent: *\nDisallow: /docs/a"), ("velqdocs.test", 404, ""), ("sprigapi.test", 503, "")], "host string, status int, body string")
    return readers.robots_allowed(_pages(spark, d).select("url").filter("url IS NOT NULL").distinct(), rules)


# ---------------------------------------------------------------- documents


def _docs(spark, d):
    return table(spark, d, "documents")


@query
def truncate_for_model(spark, d):
    return _docs(spark, d).filter("text IS NOT NULL").select("doc_id", T.truncated(F.col("text")).alias("text"))


@query
def embed_chunks(spark, d):
    return T.chunk_table(_docs(spark, d), "text", ["doc_id"])


@query
def word_count(spark, d):
    return _docs(spark, d).filter("text IS NOT NULL").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query
def word_frequency(spark, d):
    return stats.word_frequency(_docs(spark, d), "text")


@query
def top_words(spark, d):
    return stats.word_frequency(_docs(spark, d), "text").orderBy(F.desc("n"), "word").limit(20)


@query
def corpus_totals(spark, d):
    return stats.corpus_totals(_docs(spark, d), "text")


@query
def content_hash(spark, d):
    return _docs(spark, d).filter("text IS NOT NULL").select("doc_id", T.sha256(F.col("text")).alias("sha"))


@query
def short_articles(spark, d):
    return _docs(spark, d).filter(~T.long_enough(F.col("text"))).select("doc_id")


@query
def excerpt_select(spark, d):
    return _docs(spark, d).filter("text IS NOT NULL").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query
def corpus_size(spark, d):
    return stats.corpus_size(_docs(spark, d), "text")


@query
def largest_docs(spark, d):
    return stats.largest(_docs(spark, d), "doc_id", "text")


# ---------------------------------------------------------------- decisions


@query
def parse_decision(spark, d):
    """Answers made of the recorded outcomes, in eight spellings, some of which can't be read, parsed back."""
    r = table(spark, d, "process_result").select("url", "decision", "doc_id", "reason").distinct()
    n = F.length("url") % 8
    tail = F.concat(F.lit("REASON: "), F.coalesce("reason", F.lit("none")))
    answer = F.when(n == 0, F.concat(F.lit("DECISION: "), "decision", F.lit("\n"), tail)).when(n == 1, F.concat(F.lit("decision: "), "decision", F.lit("\nTARGET_ID: "), F.coalesce("doc_id", F.lit("")), F.lit("\n"), tail)).when(n == 2, F.concat(F.lit("DECISION: "), "decision", F.lit("\nTARGET_ID:\n"), tail)).when(n == 3, F.concat(F.lit("I think "), "decision"))
    answer = answer.when(n == 4, F.concat(F.lit("DECISION: "), "decision", F.lit("\nTARGET_ID:"), F.coalesce("doc_id", F.lit("")), F.lit("\n"), tail)).when(n == 5, F.concat(F.lit("Decision:"), "decision", F.lit(" \nTarget_id: "), F.coalesce("doc_id", F.lit("")), F.lit("\n\n"), tail))
    answer = answer.when(n == 6, F.concat(F.lit("DECISION: "), "decision", F.lit("\nREASON:"))).otherwise(F.concat(F.lit("DECISION: "), "decision", F.lit("\nNOTE: none\n"), tail))
    return r.select("url", "decision", "doc_id", "reason", T.parse_decision(answer).alias("p")).select("url", F.col("doc_id").alias("given_id"), F.col("reason").alias("given_reason"), F.col("decision").alias("given"), "p.*")


@query
def decision_counts(spark, d):
    return stats.decision_counts(table(spark, d, "process_result"))


@query
def crawl_summary(spark, d):
    return stats.crawl_summary(table(spark, d, "process_result"))


@query
def success_rate(spark, d):
    return stats.success_rate(table(spark, d, "process_result"))


@query
def blank_skips(spark, d):
    return _docs(spark, d).filter(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " ")) == "").select("doc_id", F.lit("SKIP").alias("decision"))


@query
def decide(spark, d):
    """The duplicate rule over all documents: the first of equal bodies by id is saved, the others are skipped."""
    t = _docs(spark, d).filter("text IS NOT NULL").select("doc_id", F.sha2(A.normal_body(F.col("text")).cast("binary"), 256).alias("h"))
    first = t.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    return t.join(first, "h").select("doc_id", F.when(F.col("doc_id") == F.col("first_id"), "SAVE").otherwise("SKIP").alias("decision"))


@query
def decide_prompt(spark, d):
    """Prompts for all later batches with the hits that are recorded for each host as stored documents."""
    s = table(spark, d, "similar_document").filter("content IS NOT NULL")
    hits = s.filter("batch = 0 AND distance IS NOT NULL").select(U.netloc(F.col("url")).alias("host"), F.struct(F.round(1 - F.col("distance"), 6).alias("similarity"), "doc_id", "title", "content").alias("h"))
    best = hits.groupBy("host").agg(F.max_by("h", F.struct(F.col("h.similarity"), F.col("h.doc_id"))).alias("h"))
    n = lookup_join(s.filter("batch > 0").withColumn("host", U.netloc(F.col("url"))), best, ["host"], "left")
    return n.select("doc_id", T.decide_prompt(F.col("url"), F.col("title"), F.col("content"), F.when(F.col("h").isNotNull(), F.array("h")).otherwise(F.array().cast("array<struct<similarity:double,doc_id:string,title:string,content:string>>"))).alias("prompt")).distinct()


def _arrived(spark, d):
    s = _scrape(spark, d)
    return s.select(F.col("fetch_id").alias("seq"), "url", "title", F.col("content"))


@query
def agent_pipeline(spark, d):
    """All scraped pages as one batch against an empty memory."""
    return A.results(A.decide_batch(_arrived(spark, d), spark.createDataFrame([], M.SCHEMA), Config()))


@query
def consolidate_merge(spark, d):
    """All later batches merged, in their order, into the stored document of the same id."""
    s = table(spark, d, "similar_document").filter("doc_id IS NOT NULL AND content IS NOT NULL")
    stored = M.latest(s.filter("batch = 0").select("doc_id", "url", "title", "content", "recalled_at"), "doc_id", "recalled_at")
    return A.merged_targets(s.filter("batch > 0"), stored, "doc_id", "batch").select("doc_id", "content")


@query
def model_match(spark, d):
    m = spark.createDataFrame([("tiny",), ("tiny:1b",), ("big",), ("bi",)], "requested string")
    return m.select("requested", T.model_matches(F.col("requested"), F.array(F.lit("tiny:1b"), F.lit("big"))).alias("ok"))


@query
def stream_decode(spark, d):
    """Stream bodies made of document texts, with and without their end marks, decoded."""
    t = _docs(spark, d).filter("text IS NOT NULL").select("doc_id", "text")
    event = lambda c, r: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("index"), F.struct(c.alias("content")).alias("delta"), r.alias("finish_reason"))).alias("choices"))))
    none = F.lit(None).cast("string")
    body = F.concat(event(F.col("text"), none), F.lit("\n: ping\n"), event(F.lit(""), F.when(F.col("doc_id") % 3 == 1, "length").otherwise("stop")), F.when(F.col("doc_id") % 3 == 2, "").otherwise("\ndata: [DONE]\n"))
    return t.select("doc_id", T.streamed_answer(body).alias("a")).select("doc_id", "a.text", "a.error")


# ---------------------------------------------------------------- vectors and memory


def _vectors(spark, d):
    return table(spark, d, "embeddings")


@query
def knn_topk(spark, d):
    e = _vectors(spark, d)
    n = V.nearest(e.filter(F.col("vec_id") % EVERY == 0), e, "vec_id", "embedding", 5)
    return n.select("query_id", "hit_id", F.round("similarity", 6).alias("similarity"), "rank")


@query
def recall_threshold(spark, d):
    e = _vectors(spark, d)
    n = V.nearest(e.filter(F.col("vec_id") % EVERY == 0), e, "vec_id", "embedding", 5, RECALL)
    return n.select("query_id", "hit_id", F.round("similarity", 6).alias("similarity"))


@query
def mean_pool(spark, d):
    return V.mean_pool(_vectors(spark, d), "label", "embedding").select("label", "dim", F.round("value", 6).alias("value"))


@query
def embed_documents(spark, d):
    return V.embedded(_docs(spark, d), "text", ["doc_id"])


def _stored(spark, d):
    s = table(spark, d, "similar_document")
    return s.filter("batch = 0").select("doc_id", "content", "title", "url", "recalled_at")


@query
def memory_upsert(spark, d):
    """The history with all later batches put in: one row per id, the newest by batch, time, then content."""
    s = table(spark, d, "similar_document").filter("doc_id IS NOT NULL AND content IS NOT NULL")
    s = s.select("doc_id", "content", "batch", F.struct("batch", F.coalesce("recalled_at", F.lit("1970-01-01").cast("timestamp_ntz")), "content").alias("_seq"))
    return M.upserted(M.latest(s.filter("batch = 0"), "doc_id", "_seq").select("doc_id", "content"), s.filter("batch > 0"))


@query
def memory_delete(spark, d):
    s = table(spark, d, "similar_document")
    return M.deleted(s.filter("batch = 0").select("doc_id", "url"), s.filter("batch > 0").select("doc_id")).distinct()


@query
def memory_get(spark, d):
    s = table(spark, d, "similar_document")
    return M.got(s.filter("batch = 0").select("doc_id", "url"), s.filter("batch > 0").select("doc_id")).distinct()


@query
def memory_count(spark, d):
    return table(spark, d, "similar_document").agg(F.countDistinct("doc_id").alias("n"))


# ---------------------------------------------------------------- research and audit


@query
def source_phase(spark, d):
    return stats.source_phase(table(spark, d, "coverage"))


@query
def ai_gate(spark, d):
    return stats.all_finished(stats.source_phase(table(spark, d, "coverage")))


@query
def topic_top8(spark, d):
    """The eight first urls of each source; the twenty urls that its coverage names most are its topics."""
    return stats.top_per_source(_pages(spark, d), stats.topics(table(spark, d, "coverage"), "source", "url", 20), "source", "url")


@query
def done_antijoin(spark, d):
    """Ledger urls that coverage does not list as saved."""
    notes = table(spark, d, "coverage").select("url", F.when(F.col("kind") == "page_saved", "ok").alias("status"))
    return stats.without_note(_pages(spark, d).select("url").filter("url IS NOT NULL").distinct(), notes)


@query
def audit_duplicates(spark, d):
    return audit.duplicates(_pages(spark, d))


@query
def audit_checksums(spark, d):
    return audit.checksums(_pages(spark, d))


@query
def audit_counts(spark, d):
    return audit.counts(_pages(spark, d), table(spark, d, "coverage"))


@query
def audit_findings(spark, d):
    return audit.findings(_pages(spark, d), table(spark, d, "coverage"))


@query
def rerender_changes(spark, d):
    r = audit.rerendered(_pages(spark, d).filter("article_html IS NOT NULL"), H.page_text(F.col("article_html")))
    return r.select("page_id", "text_sha256", "rendering_version", "changed")
