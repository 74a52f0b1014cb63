"""Problem 7: lines that one site repeats across its documents.

Lines are masked (numbers, dates and names are dropped), and hashed for locality: MinHash bands over the letter
runs of what is left. Lines of a site that share a bucket are a cluster; a cluster that occurs on many of the
site's documents is repeated furniture. Masking depends on a line's lower-cased letters and its site alone, so
lines that are the same by their letters always fall into the same buckets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shingles import _mix, samplers
from corpusloom.session import lookup_join, materialize, small_batches

GRAM, BANDS, ROWS = 5, 4, 3

# Month names whose letters are masked in lines that look like dates, and by-line openings after
# which names are masked.
MONTHS = (
    "january february march april may june july august september october november december "
    "januar februar märz mai juni juli oktober dezember janvier février mars avril juin juillet août septembre octobre "
    "novembre décembre enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre"
).split()
BYLINES = "postedby writtenby publishedby author autor auteur geschriebenvon écritpar escritopor publiéle".split()

_NAME = re.compile("^(" + "|".join(BYLINES) + r")\w{4,60}$")
_DATE = re.compile("(" + "|".join(sorted(MONTHS, key=len, reverse=True)) + ")$")


def host(url: Column) -> Column:
    """Host of a URL, lower-cased, without user, port, path, query and fragment; '' when there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def letters(line: str) -> str:
    """The lower-cased letters (Unicode category L) of a line."""
    return "".join(filter(str.isalpha, line.lower()))


def masked(key: str, names: tuple[str, ...]) -> str:
    """Letters of a line without the site's own names, by-line names and month names at the end."""
    key = _NAME.sub(r"\1", key)
    key = _DATE.sub("", key) or key
    for n in names:
        key = key.replace(n, "") or key
    return key


def _site_names(site: str) -> tuple[str, ...]:
    return tuple(x for x in re.findall(r"[^\W\d_]{5,}", site or "") if x not in ("example", "localhost"))


def _buckets(texts: list[str]) -> np.ndarray:
    """Band keys of many masked lines at once, one row for each."""
    a, b = samplers(BANDS * ROWS)
    texts = [t.ljust(GRAM, "\0") for t in texts]
    size = np.array([len(t) for t in texts])
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c) - GRAM + 1
    g = np.zeros(n, np.uint64)
    for i in range(GRAM):
        g = g * np.uint64(1_000_003) + c[i : i + n]
    inside = np.ones(n, bool)
    ends = np.cumsum(size)[:-1]
    for i in range(1, GRAM):
        inside[ends - i] = False
    g = _mix(g[inside])
    starts = np.concatenate([[0], np.cumsum(size - GRAM + 1)[:-1]])
    out = np.tile(np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407), (len(texts), 1))
    for band in range(BANDS):
        for r in range(ROWS):
            v = g * a[band * ROWS + r] + b[band * ROWS + r]
            out[:, band] = _mix(out[:, band] + np.minimum.reduceat(v ^ (v >> np.uint64(32)), starts))
    return out


def line_keys(docs: DataFrame, text: str, keep: list[str], site: str) -> DataFrame:
    """``keep``, _site and ``lines``, an array of (line_no, key, buckets), one for each line with letters.

    ``key`` identifies the line's letters, ``buckets`` its masked form; both hold for one site only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            numbers, forms, exact, at = [], {}, [], []
            for s, t in zip(p["_site"], p["_text"]):
                names, no, where = _site_names(s), [], []
                for i, line in enumerate((t or "").split("\n"), 1):
                    if k := letters(line):
                        no.append(i)
                        where.append(forms.setdefault((s, masked(k, names)), len(forms)))
                        exact.append(xxhash.xxh64_intdigest(s + "\n" + k))
                numbers.append(no)
                at.append(where)
            if forms:
                salt = np.array([xxhash.xxh64_intdigest(s) for s, _ in forms], dtype=np.uint64)
                bands = _mix(_buckets([m for _, m in forms]) + salt[:, None]).view(np.int64)
            keys, done, out = np.array(exact, dtype=np.uint64).view(np.int64), 0, []
            for no, where in zip(numbers, at):
                out.append([{"line_no": i, "key": k, "buckets": bands[w]} for i, k, w in zip(no, keys[done : done + len(no)], where)])
                done += len(no)
            yield p.drop(columns=["_text"]).assign(lines=out)

    src = docs.select(*keep, F.col(site).alias("_site"), F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "_text")
    return src.mapInPandas(run, kinds + ", lines array<struct<line_no:int,key:bigint,buckets:array<bigint>>>")


def repeated_lines(docs: DataFrame, text: str, doc_id: str, url: str, share: float = 0.1, least: int = 5) -> DataFrame:
    """Lines of each document that belong to a cluster repeated on its site: doc_id, line_no, n_docs, same_docs, site_docs.

    A cluster counts when it occurs on at least ``share`` of the site's rows and on at least ``least`` of them.
    ``n_docs`` is the number of rows its most frequent bucket occurs on, ``same_docs`` the number of rows with a
    line of just these letters. A line without letters is never repeated; a null text has no lines but counts as
    a row of its site; rows with a null url form the site ''. Repeated rows count as often as they occur.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(host(F.col(url)), F.lit("")).alias("site"), F.col(text).alias("text"))
    sites = src.groupBy("site").agg(F.count("*").alias("site_docs"))
    lines = materialize(line_keys(src, "text", ["doc_id"], "site").withColumnRenamed("_site", "site"), "lines")
    per_doc = lines.select("site", F.explode(F.array_distinct(F.flatten("lines.buckets"))).alias("bucket"))
    seen = per_doc.groupBy("site", "bucket").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= least)
    often = lookup_join(seen, sites, ["site"]).filter(F.col("n_docs") >= share * F.col("site_docs")).select("bucket", "n_docs")
    each = lines.select("doc_id", "site", F.posexplode("lines").alias("_i", "l")).select("doc_id", "site", "l.line_no", "l.key", F.explode("l.buckets").alias("bucket"))
    hit = lookup_join(each, often, ["bucket"])
    hit = materialize(hit.groupBy("doc_id", "site", "line_no", "key").agg(F.max("n_docs").alias("n_docs")), "repeated")
    same = hit.select("doc_id", "key", "site").distinct().groupBy("site", "key").agg(F.count("*").alias("same_docs"))
    out = lookup_join(hit, same.select("key", "same_docs"), ["key"])
    return lookup_join(out, sites, ["site"]).select("doc_id", "line_no", "n_docs", "same_docs", "site_docs")


def without_lines(docs: DataFrame, text: str, doc_id: str, lines: DataFrame) -> DataFrame:
    """Documents without the given lines (doc_id, line_no): doc_id, text, n_removed. Null text stays null."""
    gone = lines.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("_gone"))  # at most the lines of one text
    j = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")).join(gone, "doc_id", "left")
    kept = F.filter(F.split("_t", "\n"), lambda x, i: ~F.array_contains("_gone", i + 1))
    return j.select("doc_id", F.when(F.col("_gone").isNull(), F.col("_t")).otherwise(F.array_join(kept, "\n")).alias("text"), F.coalesce(F.size("_gone"), F.lit(0)).alias("n_removed"))
