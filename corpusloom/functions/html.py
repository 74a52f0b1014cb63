"""HTML to text, titles, links and articles.

The expressions stay inside the JVM and read well-formed pages; ``articles`` walks the tree for pages of any kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import SLUG_CHARS
from corpusloom.functions import url as U

# Entities decoded by the expressions, in order; the ampersand comes last.
ENTITIES = [("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]
# Places of the article body in order of preference, and elements that are no text of it.
BODIES = [("class", "sl-markdown-content"), ("class", "td-content"), ("id", "content-area"), ("tag", "article"), ("tag", "main"), ("tag", "body")]
FURNITURE = {"script", "style", "nav", "aside", "footer", "button", "noscript"}
_VOID = set("area base br col embed hr img input link meta source track wbr".split())


def unescape(c: Column) -> Column:
    for name, sign in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def strip_tags(html: Column) -> Column:
    c = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", "")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(c, r"(?s)<!?/?[A-Za-z][^>]*>", "")


def page_text(html: Column) -> Column:
    """All text, nothing put between elements, cut at line ends and double blanks, trimmed, without empty lines."""
    parts = F.transform(F.split(unescape(strip_tags(html)), r"\r\n|[\n\r]|  "), lambda x: F.trim(x))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")


def page_title(html: Column, u: Column) -> Column:
    """The title element, else the path without its outer slashes, else the host."""
    t = F.trim(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.coalesce(F.nullif(t, F.lit("")), F.nullif(F.regexp_replace(U.path(u), "^/+|/+$", ""), F.lit("")), U.netloc(u))


def ledger_title(html: Column) -> Column:
    t = F.trim(F.regexp_replace(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), r"\s+", " "))
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("Untitled"))


def hrefs(html: Column) -> Column:
    """Double-quoted link targets of all anchors, in order."""
    return F.transform(F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*?\shref\s*=\s*"([^"]*)"'), F.lit(1)), unescape)


def slug(text: Column, limit: int = SLUG_CHARS) -> Column:
    """A file name: no tags, signs that file systems refuse and blanks as single underscores, at most ``limit`` characters."""
    t = F.regexp_replace(text, r"<[^>]+>", "")
    t = F.regexp_replace(t, r'[<>:"/\\|?*]', "_")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)[\s_]+", "_"), "^_+|_+$", "")
    t = F.regexp_replace(F.substring(t, 1, limit), "_+$", "")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("scraped_content"))


def doc_name(index: Column, title: Column) -> Column:
    return F.concat(F.format_string("%03d", index.cast("long")), F.lit("_"), slug(title))


class _Tree(HTMLParser):
    """Nodes as [tag, attributes, children]; strings are text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        self.open[-1][2].append(data)


def _nodes(node: list) -> Iterator[list]:
    """All elements below a node in document order. No recursion here and below: pages may be nested to any depth."""
    todo = [c for c in reversed(node[2]) if isinstance(c, list)]
    while todo:
        n = todo.pop()
        yield n
        todo += [c for c in reversed(n[2]) if isinstance(c, list)]


def _has(node: list, name: str) -> bool:
    return name in (node[1].get("class") or "").split()


def _strings(node: list) -> Iterator[str]:
    todo = list(reversed(node[2]))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            yield c
        else:
            todo += reversed(c[2])


def _code(pre: list) -> str:
    """Code of a block, fenced. Where its lines are elements of their own, each of them ends a line."""
    out: list[str] = []
    todo = [(c, False) for c in reversed(pre[2])]
    while todo:
        c, inside = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif _has(c, "line") or (inside and _has(c, "code")):
            if out and not out[-1].endswith("\n"):
                out.append("\n")
            out.append("".join(_strings(c)).rstrip("\n") + "\n")
        else:
            inside = inside or _has(c, "ec-line")
            todo += [(x, inside) for x in reversed(c[2])]
    body = "".join(out)
    if any(_has(n, "line") or _has(n, "ec-line") for n in _nodes(pre)):
        body = re.sub(r"\n{2,}", "\n", body)  # white space between the line elements is no line
    return "```\n" + body.rstrip("\n") + "\n```"


def _parts(node: list) -> Iterator[str]:
    todo = list(reversed(node[2]))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            yield c
        elif c[0] == "pre":
            yield _code(c)
        elif c[0] not in FURNITURE:
            todo += reversed(c[2])


def article(html: str | None) -> str | None:
    """Text of the preferred article body, elements apart by line ends, code fenced; None without a body."""
    if html is None:
        return None
    tree = _Tree()
    tree.feed(html)
    tree.close()
    every = list(_nodes(tree.root))
    for kind, name in BODIES:
        for n in every:
            if n[0] == name if kind == "tag" else _has(n, name) if kind == "class" else n[1].get("id") == name:
                return "\n".join(x for p in _parts(n) if (x := p if p.startswith("```") else p.strip())).strip()
    return None


def articles(df: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """``keep`` and article, by the tree walk; pages without a body have a null article."""
    src = df.select(*keep, F.col(html).alias("_html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "_html")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.drop(columns="_html").assign(article=[article(h) for h in p["_html"]])

    return src.mapInPandas(run, kinds + ", article string")
