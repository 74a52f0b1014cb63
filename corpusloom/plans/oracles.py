"""DuckDB SQL for the queries of ``catalogue``; written on its own, from what the queries mean."""

from __future__ import annotations

_ENTITIES = [("&quot;", "'\"'"), ("&#39;", "''''"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&amp;", "'&'")]


def _unescape(c: str) -> str:
    for name, sign in _ENTITIES:
        c = f"replace({c}, '{name}', {sign})"
    return c


def _text(html: str) -> str:
    c = rf"regexp_replace({html}, '<(script|style)\b[^>]*>.*?</(script|style)\s*>', '', 'gis')"
    c = f"regexp_replace({c}, '<!--.*?-->', '', 'gs')"
    c = _unescape(f"regexp_replace({c}, '<!?/?[A-Za-z][^>]*>', '', 'gs')")
    return rf"array_to_string(list_filter(list_transform(string_split_regex({c}, '\r\n|[\n\r]|  '), lambda x: trim(x)), lambda x: x <> ''), chr(10))"


_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*)://"
_NETLOC = rf"regexp_extract(url, '{_SCHEME}([^/?#]*)', 2)"
_PATH = rf"regexp_extract(url, '{_SCHEME}[^/?#]*([^?#]*)', 2)"
_TITLE = rf"coalesce(nullif(trim({_unescape("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')")}), ''), nullif(regexp_replace({_PATH}, '^/+|/+$', '', 'g'), ''), {_NETLOC})"
_BARE = f"regexp_replace({_PATH}, '/{{2,}}', '/', 'g')"
_CANON = rf"lower(regexp_extract(url, '{_SCHEME}', 1)) || '://' || lower({_NETLOC}) || {_BARE} || CASE WHEN ends_with({_BARE}, '/') OR regexp_matches({_BARE}, '/[^/]*[^/.]\.[^/.]+$') THEN '' ELSE '/' END"
_RULE = "repeat('-', 50)"
_DOC = "'URL: ' || coalesce(url, '') || chr(10) || 'Title: ' || coalesce({t}, '') || chr(10) || " + _RULE + " || chr(10) || chr(10) || coalesce({b}, '')"
_SKIP = "blog|tags|categories|search|enterprise|zh-cn|zh-tw|ja-jp|fr-fr|next"


def _scope(col: str) -> str:
    path = rf"regexp_extract({col}, '{_SCHEME}[^/?#]*([^?#]*)', 2)"
    return (
        rf"regexp_matches({col}, '^https?://') AND regexp_extract({col}, '{_SCHEME}([^/?#]*)', 2) = 'quaymere.test' AND starts_with({path}, '/docs/') "
        rf"AND NOT regexp_matches({path}, '/({_SKIP}|v?[0-9]+\.[0-9]+(\.[0-9]+)?)(/|$)') AND regexp_extract(lower({path}), '[^/.](\.[^/.]+)$', 1) IN ('', '.html')"
    )


_SLUG = r"regexp_replace(substring(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '<[^>]+>', '', 'g'), '[<>:\"/\\|?*]', '_', 'g'), '[\s_\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 50), '_+$', '')"
_HREFS = r"SELECT page_id, url, unnest(regexp_extract_all(article_html, '<a\b[^>]*?\shref\s*=\s*\"([^\"]*)\"', 1, 'is')) AS href FROM pages"
_RESOLVED = rf"""WITH h AS ({_HREFS}), l AS (SELECT page_id, url, {_unescape("href")} AS href FROM h),
r AS (SELECT page_id, url, href, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '{_SCHEME}[^/?#]*', 0) || regexp_replace(href, '#.*$', '') ELSE regexp_replace(href, '#.*$', '') END AS target FROM l WHERE trim(href) <> '' AND NOT regexp_matches(href, '^(#|mailto:|tel:)'))
"""
_SAME = rf"regexp_extract(target, '{_SCHEME}([^/?#]*)', 2) = {_NETLOC}"
_DEPTH = f"len(list_filter(string_split({_PATH}, '/'), lambda x: x <> ''))"
_KNN = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS hit_id, list_cosine_similarity(a.v, b.v) AS sim FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, hit_id) AS rank FROM s)
"""
_BODY = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"
_FINDINGS = {
    "audit_duplicates": "SELECT coalesce(source, '(none)') AS source, count(*) AS records, count(DISTINCT url) AS urls FROM pages GROUP BY 1 HAVING count(*) <> count(DISTINCT url)",
    "audit_checksums": "SELECT coalesce(source, '(none)') AS source, count(*) AS mismatches FROM pages WHERE sha256(article_html) <> article_sha256 GROUP BY 1",
    "audit_counts": "WITH a AS (SELECT source, count(*) AS n FROM pages GROUP BY 1), b AS (SELECT source, count(*) AS m FROM coverage WHERE kind = 'page_saved' GROUP BY 1) SELECT coalesce(a.source, b.source) AS source, coalesce(n, 0) AS records, coalesce(m, 0) AS reported FROM a FULL JOIN b ON a.source = b.source WHERE coalesce(a.source, b.source) IS NOT NULL AND abs(coalesce(n, 0) - coalesce(m, 0)) > 1",
}

_WHITE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WHITE}|{_WHITE}$', '', 'g')"


def _last(mark: str, width: int) -> str:
    """Place, from 0, of the last mark in the first 6000 characters of rest; null if there is none."""
    return f"nullif(strpos(reverse(substring(rest, 1, 6000)), {mark}), 0) * -1 + 6001 - {width}"


_CUT = f"greatest(coalesce({_last('chr(10) || chr(10)', 2)}, {_last('chr(10)', 1)}, {_last("' '", 1)}, 6000), 0)"
_CHUNKS = f"""WITH RECURSIVE c(doc_id, n, chunk, rest) AS (SELECT doc_id, 0, '', {_strip('text')} FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, n + 1, CASE WHEN length(rest) <= 6000 THEN rest ELSE {_strip('substring(rest, 1, cut)')} END, CASE WHEN length(rest) <= 6000 THEN '' ELSE {_strip('substring(rest, cut + 1)')} END
FROM (SELECT *, CASE WHEN {_CUT} = 0 THEN 6000 ELSE {_CUT} END AS cut FROM c WHERE rest <> ''))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS chunk_no, chunk FROM c WHERE n > 0 AND chunk <> ''"""
_CRAWL = f"""WITH RECURSIVE p AS (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL), l AS (SELECT DISTINCT url, unnest(links) AS target FROM pages WHERE url IS NOT NULL),
own AS (SELECT DISTINCT url AS src, regexp_replace(target, '#.*$', '') AS dst FROM l WHERE {_SAME}), s AS (SELECT src FROM own GROUP BY src ORDER BY count(DISTINCT dst) DESC, src LIMIT 1),
r(url, depth) AS (SELECT src, 0 FROM s UNION SELECT own.dst, r.depth + 1 FROM r JOIN own ON own.src = r.url WHERE r.depth < 100)
SELECT url, min(depth) AS depth, CASE WHEN url IN (SELECT url FROM p) THEN 'yielded' ELSE 'failed' END AS state FROM r GROUP BY url"""

SQL: dict[str, str] = {
    "embed_chunks": _CHUNKS,
    "crawl_levels": _CRAWL,
    "page_text": f"SELECT * FROM (SELECT fetch_id, {_text('html')} AS text FROM scrape_url) WHERE text <> ''",
    "page_title": f"SELECT fetch_id, {_TITLE} AS title FROM scrape_url",
    "ledger_title": rf"SELECT fetch_id, coalesce(nullif(trim(regexp_replace({_unescape("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')")}, '\s+', ' ', 'g')), ''), 'Untitled') AS title FROM scrape_url",
    "filename_slug": f"SELECT fetch_id, slug, CASE WHEN fetch_id < 1000 THEN lpad(CAST(fetch_id AS VARCHAR), 3, '0') ELSE CAST(fetch_id AS VARCHAR) END || '_' || slug AS doc_name FROM (SELECT fetch_id, coalesce(nullif({_SLUG}, ''), 'scraped_content') AS slug FROM scrape_url WHERE title IS NOT NULL)",
    "next_index": "SELECT coalesce(max(TRY_CAST(regexp_extract(doc_id, '^([0-9]+)_', 1) AS INT)), -1) + 1 AS next_index FROM process_result",
    "render_document": f"SELECT fetch_id, {_DOC.format(t=_TITLE, b=_text('html'))} AS body FROM scrape_url",
    "read_body": "SELECT fetch_id, coalesce(content, '') AS body FROM scrape_url",
    "boilerplate_ratio": "SELECT page_id, full_chars, article_chars, round(CASE WHEN full_chars = 0 THEN 0.0 ELSE article_chars / full_chars END, 6) AS ratio FROM (SELECT page_id, length("
    + _text("article_html")
    + ") AS full_chars, length("
    + _text(r"regexp_replace(article_html, '<(nav|aside|footer|button|noscript)\b[^>]*>.*?</(nav|aside|footer|button|noscript)\s*>', '', 'gis')")
    + ") AS article_chars FROM pages WHERE article_html IS NOT NULL)",
    "bundle_sections": "SELECT page_id, CAST(len(string_split(chr(10) || chr(10) || '---' || chr(10) || '# ' || title || chr(10) || chr(10) || 'Source: ' || url || chr(10) || chr(10) || text || chr(10), chr(10) || chr(10) || 'Source: https://')) - 1 AS INT) AS sections FROM pages WHERE text IS NOT NULL AND title IS NOT NULL",
    "url_parts": f"SELECT fetch_id, lower(regexp_extract(url, '{_SCHEME}', 1)) AS scheme, {_NETLOC} AS netloc, {_PATH} AS path FROM scrape_url",
    "canonical_url": f"SELECT fetch_id, {_CANON} AS canonical FROM scrape_url",
    "scope_filter": f"SELECT fetch_id, url FROM scrape_url WHERE regexp_matches(url, '^https?://', 'i') AND lower({_NETLOC}) = 'docs.quaymere.test' AND (lower({_PATH}) = '/docs' OR starts_with(lower({_PATH}), '/docs/'))",
    "in_scope_urls": f"SELECT page_id, url FROM (SELECT page_id, url, {_CANON} AS c FROM pages) WHERE {_scope('c')}",
    "validate_urls": r"SELECT fetch_id, coalesce(regexp_matches(url, '^https?://([^\s/?#@]+@)?([A-Za-z0-9]([A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(:[0-9]{1,5})?([/?#]\S*)?$'), false) AS ok FROM scrape_url",
    "resolve_links": _RESOLVED + "SELECT DISTINCT page_id, href, target FROM r",
    "internal_links": _RESOLVED + f"SELECT DISTINCT page_id, target FROM r WHERE {_SAME}",
    "external_links": rf"WITH l AS (SELECT page_id, url, unnest(links) AS target FROM pages) SELECT DISTINCT page_id, target FROM l WHERE target LIKE 'http%' AND coalesce(NOT ({_SAME}), true)",
    "sorted_links": rf"WITH l AS (SELECT page_id, url, unnest(links) AS target FROM pages) SELECT DISTINCT regexp_replace(target, '#.*$', '') AS target FROM l WHERE {_SAME} AND regexp_matches(lower(regexp_extract(target, '{_SCHEME}[^/?#]*([^?#]*)', 2)), '^/docs(/|$)')",
    "page_link_arrays": f"WITH l AS (SELECT page_id, unnest(links) AS url FROM pages WHERE url IS NOT NULL), c AS (SELECT page_id, {_CANON} AS c FROM l) SELECT page_id, array_to_string(list_sort(list(DISTINCT c)), ' ') AS links FROM c WHERE {_scope('c')} GROUP BY page_id",
    "frontier_antijoin": "WITH l AS (SELECT DISTINCT unnest(links) AS url FROM pages) SELECT url FROM l WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM pages WHERE source = 'quaymere' AND url IS NOT NULL)",
    "frontier_priority": f"SELECT url, depth, row_number() OVER (ORDER BY depth, url) AS rank FROM (SELECT DISTINCT url, {_DEPTH} AS depth FROM pages WHERE url IS NOT NULL)",
    "crawl_limit": f"SELECT DISTINCT url, {_DEPTH} AS depth FROM pages WHERE url IS NOT NULL ORDER BY depth, url LIMIT 300",
    "pending_urls": "SELECT DISTINCT url FROM coverage WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM coverage WHERE kind IN ('page_failed', 'page_saved') AND url IS NOT NULL)",
    "resume_frontier": "WITH l AS (SELECT url, links FROM pages WHERE rendering_version IS NOT NULL), k AS (SELECT DISTINCT unnest(links) AS url FROM l) SELECT url FROM k WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM l WHERE url IS NOT NULL)",
    "dedupe_final_url": f"SELECT page_id, canonical FROM (SELECT page_id, canonical, row_number() OVER (PARTITION BY canonical ORDER BY page_id) AS n FROM (SELECT page_id, {_CANON} AS canonical FROM pages)) WHERE n = 1 OR canonical IS NULL",
    "robots_split": f"SELECT DISTINCT url, CASE lower({_NETLOC}) WHEN 'quaymere.test' THEN NOT starts_with({_PATH}, '/docs/a') WHEN 'sprigapi.test' THEN false ELSE true END AS allowed FROM pages WHERE url IS NOT NULL",
    "truncate_for_model": "SELECT doc_id, CASE WHEN length(text) > 10000 THEN substring(text, 1, 10000) || chr(10) || chr(10) || '[... content truncated for processing ...]' ELSE text END AS text FROM documents WHERE text IS NOT NULL",
    "word_count": r"SELECT doc_id, len(list_filter(string_split_regex(text, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '')) AS words FROM documents WHERE text IS NOT NULL",
    "word_frequency": r"WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY word",
    "top_words": r"WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 20",
    "corpus_totals": r"SELECT count(*) AS total_files, sum(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS total_words, sum(length(text)) AS total_characters FROM documents WHERE text IS NOT NULL",
    "content_hash": "SELECT doc_id, sha256(text) AS sha FROM documents WHERE text IS NOT NULL",
    "short_articles": "SELECT doc_id FROM documents WHERE text IS NULL OR length(text) < 80",
    "corpus_size": "SELECT count(*) AS files, sum(strlen(text)) AS bytes, round(sum(strlen(text)) / (1024 * 1024), 6) AS mb FROM documents WHERE text IS NOT NULL",
    "largest_docs": "SELECT doc_id, strlen(text) AS bytes FROM documents WHERE text IS NOT NULL ORDER BY bytes DESC, doc_id LIMIT 5",
    "parse_decision": "WITH r AS (SELECT DISTINCT url, decision, doc_id, reason, length(url) % 8 AS n FROM process_result), k AS (SELECT *, coalesce(upper(decision) IN ('SAVE', 'SKIP', 'CONSOLIDATE') AND (n IN (0, 1, 5) OR n = 4 AND doc_id <> ''), false) AS ok FROM r) "
    "SELECT url, doc_id AS given_id, reason AS given_reason, decision AS given, CASE WHEN ok THEN upper(decision) ELSE 'SAVE' END AS decision, CASE WHEN ok AND n IN (1, 4, 5) THEN nullif(doc_id, '') END AS target_id, CASE WHEN ok THEN trim(coalesce(reason, 'none')) ELSE 'Unparseable decision; saved by default' END AS reason FROM k",
    "decision_counts": "SELECT d AS decision, count(p.url) AS n FROM (VALUES ('SAVE'), ('CONSOLIDATE'), ('SKIP'), ('ERROR')) AS v(d) LEFT JOIN process_result p ON upper(p.decision) = d GROUP BY d",
    "crawl_summary": "SELECT count(*) AS pages_processed, count(*) FILTER (WHERE upper(decision) IN ('SAVE', 'CONSOLIDATE') OR upper(decision) = 'ERROR' AND file_path IS NOT NULL) AS files_created, count(DISTINCT url) AS urls_seen, count(DISTINCT url) FILTER (WHERE upper(decision) = 'ERROR') AS urls_failed FROM process_result",
    "success_rate": "SELECT seen, failed, round(coalesce(seen / nullif(seen + failed, 0), 0.0), 6) AS success_rate, round(coalesce((seen - failed) / nullif(seen, 0), 0.0), 6) AS success_rate_strict FROM (SELECT count(DISTINCT url) AS seen, count(DISTINCT url) FILTER (WHERE upper(decision) = 'ERROR') AS failed FROM process_result)",
    "blank_skips": r"SELECT doc_id, 'SKIP' AS decision FROM documents WHERE regexp_replace(coalesce(text, ''), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '', 'g') = ''",
    "decide": f"SELECT doc_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY {_BODY}) THEN 'SAVE' ELSE 'SKIP' END AS decision FROM documents WHERE text IS NOT NULL",
    "model_match": "SELECT * FROM (VALUES ('tiny', true), ('tiny:1b', true), ('big', true), ('bi', false)) AS v(requested, ok)",
    "stream_decode": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND trim(text) <> '' THEN text END AS text, CASE WHEN doc_id % 3 = 2 THEN 'stream interrupted' WHEN doc_id % 3 = 1 THEN 'token budget exhausted' WHEN trim(text) = '' THEN 'empty answer' END AS error FROM documents WHERE text IS NOT NULL",
    "knn_topk": _KNN + "SELECT query_id, hit_id, round(sim, 6) AS similarity, rank FROM r WHERE rank <= 5",
    "recall_threshold": _KNN + "SELECT query_id, hit_id, round(sim, 6) AS similarity FROM r WHERE rank <= 5 AND round(sim, 12) >= 0.35",
    "mean_pool": "WITH x AS (SELECT label, unnest(range(0, len(embedding))) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings), m AS (SELECT label, dim, avg(v) AS m FROM x GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY 1) SELECT label, dim, round(m / n, 6) AS value FROM m JOIN n USING (label)",
    "memory_upsert": "SELECT doc_id, content FROM (SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY batch DESC, coalesce(recalled_at, TIMESTAMP '1970-01-01') DESC, content DESC) AS n FROM similar_document WHERE doc_id IS NOT NULL AND content IS NOT NULL) WHERE n = 1",
    "memory_delete": "SELECT DISTINCT doc_id, url FROM similar_document WHERE batch = 0 AND doc_id NOT IN (SELECT doc_id FROM similar_document WHERE batch > 0 AND doc_id IS NOT NULL)",
    "memory_get": "SELECT DISTINCT doc_id, url, 0.0::DOUBLE AS distance FROM similar_document WHERE batch = 0 AND doc_id IN (SELECT doc_id FROM similar_document WHERE batch > 0)",
    "memory_count": "SELECT count(DISTINCT doc_id) AS n FROM similar_document",
    "consolidate_merge": "WITH s AS (SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY recalled_at DESC NULLS LAST, url DESC NULLS LAST, title DESC NULLS LAST, content DESC) AS n FROM similar_document WHERE batch = 0 AND doc_id IS NOT NULL AND content IS NOT NULL), "
    "l AS (SELECT doc_id, content, min(batch) AS b FROM similar_document WHERE batch > 0 AND doc_id IS NOT NULL AND content <> '' GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY b, content) AS k FROM l), "
    "x AS (SELECT doc_id, k, i, string_split(content, chr(10))[i] AS line FROM k, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS u(i)), f AS (SELECT *, min(k) OVER (PARTITION BY doc_id, line) AS first FROM x), "
    "m AS (SELECT s.doc_id, s.content, string_agg(line, chr(10) ORDER BY k, i) FILTER (WHERE k = first AND (s.content = '' OR NOT list_contains(string_split(s.content, chr(10)), line))) AS more FROM s JOIN f ON s.doc_id = f.doc_id WHERE s.n = 1 GROUP BY 1, 2) "
    "SELECT doc_id, CASE WHEN more IS NULL THEN content WHEN content = '' THEN more ELSE content || chr(10) || more END AS content FROM m",
    "source_phase": "SELECT source, saved, failed, blocked, CASE WHEN ends = 0 THEN 'running' WHEN failed + blocked > 0 THEN 'finished_with_gaps' ELSE 'finished' END AS phase FROM (SELECT source, count(*) FILTER (WHERE kind = 'page_saved') AS saved, count(*) FILTER (WHERE kind = 'page_failed') AS failed, count(*) FILTER (WHERE kind = 'robots_blocked') AS blocked, count(*) FILTER (WHERE kind = 'source_finished') AS ends FROM coverage WHERE source IS NOT NULL GROUP BY source)",
    "ai_gate": "SELECT coalesce(bool_and(n > 0), false) AS ready FROM (SELECT source, count(*) FILTER (WHERE kind = 'source_finished') AS n FROM coverage WHERE source IS NOT NULL GROUP BY source)",
    "topic_top8": "WITH c AS (SELECT source, url, count(*) AS n FROM coverage WHERE source IS NOT NULL AND url IS NOT NULL GROUP BY 1, 2), t AS (SELECT source, url, row_number() OVER (PARTITION BY source ORDER BY n DESC, url) AS rank FROM c), "
    "p AS (SELECT DISTINCT source, url FROM pages WHERE source IS NOT NULL AND url IS NOT NULL), r AS (SELECT p.source, p.url, coalesce(t.rank, 999) AS rank FROM p LEFT JOIN t ON p.source = t.source AND p.url = t.url AND t.rank <= 20) "
    "SELECT source, url, CAST(rank AS INT) AS rank, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, url) AS place FROM r) WHERE place <= 8",
    "done_antijoin": "SELECT DISTINCT url FROM pages WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM coverage WHERE kind = 'page_saved' AND url IS NOT NULL)",
    **_FINDINGS,
    "audit_findings": " UNION ALL ".join(f"SELECT source, '{f}' AS finding FROM ({_FINDINGS[q]})" for q, f in (("audit_duplicates", "duplicate urls"), ("audit_checksums", "article checksum mismatch"), ("audit_counts", "record count differs from report"))),
    "rerender_changes": f"SELECT page_id, sha256(t) AS text_sha256, 2 AS rendering_version, t IS DISTINCT FROM text AS changed FROM (SELECT page_id, text, {_text('article_html')} AS t FROM pages WHERE article_html IS NOT NULL)",
}
