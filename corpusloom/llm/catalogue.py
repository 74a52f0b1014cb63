"""Queries pN_ of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import history, markup, messages, mixing, near_copies, packing, severity, site_lines, split, tokens, wrappers
from corpusloom.session import table

SIM = {"k": 3, "threshold": 0.7, "min_words": 20}


def _limit(spark: SparkSession, d: str, name: str) -> tuple[int, int]:
    r = table(spark, d, "size_limit").filter(F.col("limit_name") == name).select("max_size", "overlap").first()
    return r[0], r[1]


def _furniture(spark: SparkSession, d: str, name: str) -> DataFrame:
    if name == "pages":
        return wrappers.furniture(table(spark, d, "pages"), "page_id", "article_html", "url", markup=True)
    return wrappers.furniture(table(spark, d, "scrape_url"), "fetch_id", "content", "url", markup=False)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [_furniture(spark, d, t).select(F.lit(t).alias("tbl"), "row_id", "line_no") for t in ("scrape_url", "pages")]
    return parts[0].union(parts[1])


def p1_main_body(spark: SparkSession, d: str) -> DataFrame:
    return wrappers.main_body(table(spark, d, "scrape_url"), "fetch_id", "content", _furniture(spark, d, "scrape_url"))


def p2_text(spark: SparkSession, d: str) -> DataFrame:
    return markup.convert(table(spark, d, "pages"), "page_id", "article_html", "url").withColumnRenamed("row_id", "page_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """What residue the conversion finds in each article's content; the clean text itself is not asked for."""
    found = markup.convert(table(spark, d, "pages"), "page_id", "article_html", "url", clean_text=False)
    return found.select(F.col("row_id").alias("page_id"), F.explode("markup").alias("markup"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    size, overlap = _limit(spark, d, "embed_input")
    return split.split_long(table(spark, d, "scrape_url"), "content", ["fetch_id"], size, overlap)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pieces(spark, d).filter((F.col("n_pieces") > 1) & (F.col("piece_no") == 1)).select("fetch_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeats(table(spark, d, "similar_document"), "content", ["doc_id"], "batch", **SIM)


def _near(spark: SparkSession, d: str):
    return near_copies.near_copies(table(spark, d, "similar_document"), **SIM)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    members, _, links = _near(spark, d)
    return near_copies.id_pairs(members, links)


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    members, _, links = _near(spark, d)
    return near_copies.groups(members, links)


def p6_pages(spark: SparkSession, d: str) -> DataFrame:
    return messages.unfit_pages(table(spark, d, "scrape_url"), "content", ["fetch_id"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pages(spark, d).filter("kind <> ''").select("fetch_id")


def _repeated(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.repeated_lines(table(spark, d, "scrape_url"), "content", "fetch_id", "url")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of repeated clusters that are themselves repeated by their exact letters."""
    exact = (F.col("same_docs") >= 5) & (F.col("same_docs") * 10 >= F.col("site_docs"))
    return _repeated(spark, d).filter(exact).select(F.col("doc_id").alias("fetch_id"), "line_no")


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.without_lines(table(spark, d, "scrape_url"), "content", "fetch_id", _repeated(spark, d)).withColumnRenamed("doc_id", "fetch_id")


def _capacities(spark: SparkSession, d: str) -> dict[str, int]:
    rows = table(spark, d, "size_limit").filter("unit = 'tokens' AND limit_name LIKE 'pack%'").select("limit_name", "max_size").collect()
    return {r[0]: r[1] for r in rows}


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(tokens.with_counts(table(spark, d, "documents"), ["doc_id"], "text"), "doc_id", "n_tokens", _capacities(spark, d))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_containers(spark, d), _capacities(spark, d))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_target")
    names = [r[0] for r in targets.select(F.lower(F.trim("source"))).collect()]  # a row per target source
    docs = table(spark, d, "documents").filter(F.lower(F.trim("source")).isin(names))
    return mixing.mix(tokens.with_counts(docs, ["doc_id", "source"], "text"), "doc_id", F.col("source"), "n_tokens", targets)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, d), table(spark, d, "mix_target"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = severity.train(docs, table(spark, d, "labels"), "doc_id", "text", "toxic", "quality")
    return severity.score(docs, model, ["doc_id", "source"], "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).filter(F.col("severity") >= severity.THRESHOLD).select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", "severity", "worst_passage")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return severity.rates(_scored(spark, d), F.col("source"))


QUERIES = {f.__name__: f for f in (p1_found, p1_main_body, p2_found, p2_text, p3_pieces, p3_found, p4_found, p5_found, p5_groups, p6_found, p6_pages, p7_found, p7_clean, p8_containers, p8_fill, p9_mix, p9_shares, p10_found, p10_scores, p10_rates)}

_SHINGLES = """
WITH w AS (SELECT doc_id, batch, regexp_extract_all(lower(content), '[a-z0-9]+') AS ws FROM similar_document WHERE content IS NOT NULL),
t AS (SELECT doc_id, batch, array_to_string(ws, ' ') AS txt, ws FROM w WHERE len(ws) >= 20),
c AS (SELECT txt, any_value(ws) AS ws, row_number() OVER (ORDER BY txt) AS cid FROM t GROUP BY txt),
s AS (SELECT DISTINCT cid, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM c, unnest(range(1, len(ws) - 1)) AS u(i)),
n AS (SELECT cid, count(*) AS n FROM s GROUP BY cid),
x AS (SELECT a.cid AS ca, b.cid AS cb, count(*) AS shared FROM s a JOIN s b ON a.g = b.g GROUP BY 1, 2),
sim AS (SELECT ca, cb FROM x JOIN n na ON na.cid = ca JOIN n nb ON nb.cid = cb WHERE shared >= 0.7 * (na.n + nb.n - shared)),
m AS (SELECT DISTINCT t.doc_id, t.batch, c.cid FROM t JOIN c USING (txt))
"""

SQL = {
    "p3_found": "SELECT fetch_id FROM scrape_url WHERE length(content) > 6000",
    "p4_found": _SHINGLES + "SELECT DISTINCT a.doc_id, a.batch FROM m a JOIN sim ON a.cid = ca JOIN m b ON b.cid = cb WHERE b.batch < a.batch",
    "p5_found": _SHINGLES + "SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM m a JOIN sim ON a.cid = ca JOIN m b ON b.cid = cb WHERE a.doc_id < b.doc_id",
    "p5_groups": _SHINGLES.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, e AS (SELECT DISTINCT ca, cb FROM sim WHERE ca <> cb), r(a, b) AS (SELECT cid, cid FROM c UNION SELECT r.a, e.cb FROM r JOIN e ON r.b = e.ca),
g AS (SELECT r.a AS cid, min(md5(c.txt)) AS group_id FROM r JOIN c ON c.cid = r.b GROUP BY r.a), d AS (SELECT ca AS cid, count(*) AS n FROM e GROUP BY 1)
SELECT DISTINCT m.doc_id AS id, md5(c.txt) AS cls, g.group_id, coalesce(d.n, 0) AS n_links FROM m JOIN c USING (cid) JOIN g USING (cid) LEFT JOIN d USING (cid) WHERE m.doc_id IS NOT NULL""",
    "p7_found": r"""
WITH r AS (SELECT fetch_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1)) AS site, content FROM scrape_url),
l AS (SELECT fetch_id, site, i AS line_no, regexp_replace(lower(string_split(content, chr(10))[i]), '[^\p{L}]', '', 'g') AS k
      FROM r, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS u(i)),
n AS (SELECT site, k, count(DISTINCT fetch_id) AS n FROM l WHERE k <> '' GROUP BY ALL),
h AS (SELECT site, count(*) AS docs FROM r GROUP BY site)
SELECT fetch_id, CAST(line_no AS INT) AS line_no FROM l JOIN n USING (site, k) JOIN h USING (site) WHERE n >= 5 AND n * 10 >= docs""",
}
