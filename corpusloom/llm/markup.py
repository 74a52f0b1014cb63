"""Problem 2: clean text from articles with markup of several kinds, and what markup was left unrendered.

The content region of an article is its maximum-scoring contiguous run of tokens: each word scores by how much more
often it stands in main bodies than outside, in headings for itself, tags by their kind and never above zero, with
weights (log odds) from labelled pages. One linear scan finds it. Lines inside whose words score clearly against them
are left out; text is converted, and residue sought, in the rest.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import small_batches

SAMPLE, SAMPLE_CHARS = 1_500, 20_000_000  # labelled pages that the weights are fitted on, at most, and their characters

_TOKEN = re.compile(r"<!--.*?-->|</?([A-Za-z][A-Za-z0-9]*)\b[^<>]*>|[^\s<]+|<", re.S)
_BLOCKS = "p div h1 h2 h3 h4 h5 h6 ul ol li table tr pre blockquote article main section header footer nav aside figure hr br dl dt dd body html".split()

# ---------------------------------------------------------------- content region


def tokens(source: str) -> list[tuple[str, int, int]]:
    """(kind, start, end): a word's kind is its lower-cased letters, ``#`` if it has none, ``h`` before them in a heading,
    and ``c `` for any word of a code sample; a tag's is ``<`` or ``</`` and its name, a comment's ``!``. Headings are those of tags and of ``#`` and ``=`` marks."""
    out, tag, mark, code, last = [], False, False, False, 0
    for m in _TOKEN.finditer(source):
        t = m.group()
        fresh = not out or out[-1][0][:1] == "<" or source.find("\n", last, m.start()) >= 0
        last = m.end()
        if t.startswith("<!--"):
            out.append(("!", m.start(), m.end()))
        elif m.group(1):
            name, end = m.group(1).lower(), t.startswith("</")
            if re.fullmatch("h[1-6]", name):
                tag = not end
            elif name == "pre":
                code = not end
            mark = mark and not end
            out.append((("</" if end else "<") + name, m.start(), m.end()))
        else:
            if fresh:
                mark = t[0] in "#=" and bool(_MARK.fullmatch(t))
            out.append(("c ", m.start(), m.end()) if code else (("h " if tag or mark else "") + ("".join(filter(str.isalpha, t.lower())) or "#"), m.start(), m.end()))
    return out


_MARK = re.compile("#{1,6}|={2,6}")
DEFAULT = {"": 1.5, "h": 5.0, "<": -0.2, "<a": -3.0, "</a": -3.0, "<nav": -3.0, "</nav": -3.0}
LEAN = 1.5  # what a word scores besides its log odds: the region has room for neutral words
CLIP, HEADING = 3.0, 8.0  # no word weighs more than this, and none in a heading more than that
DOUBT, MEAN = -4.0, -0.8  # a line inside the region whose words score less than this, in sum and on average, is no part of it


def fit_weights(pages: list[str], boilerplate: list[set[int]]) -> dict[str, float]:
    """Log odds of each word and tag inside against outside the main body; lines are labelled by their numbers.

    Tags never score above zero. ``''`` stands for words, ``h`` for words of headings and ``<`` for tags too rare to tell.
    """
    inside, outside = Counter(), Counter()
    for source, out in zip(pages, boilerplate):
        for n, line in enumerate(source.split("\n"), 1):
            for k, _, _ in tokens(line):
                (outside if n in out else inside).update((k, "<") if k[0] == "<" else (k, "h") if k[:2] == "h " else (k, ""))
    a, b = sum(n for k, n in inside.items() if k not in ("", "h", "<")) + 1, sum(n for k, n in outside.items() if k not in ("", "h", "<")) + 1
    w = {"": 0.0, "h": 0.0, "<": -0.2}
    for k in {*inside, *outside}:
        if inside[k] + outside[k] >= 5 and k != "c ":
            v = math.log((inside[k] + 0.5) / a) - math.log((outside[k] + 0.5) / b)
            w[k] = max(-CLIP, min(0.0, v)) if k[:1] == "<" else min(HEADING if k == "h" or k[:2] == "h " else CLIP, v)
    return {k: v if k[:1] in ("<", "!") else v + LEAN for k, v in w.items()}


def scores(ts: list[tuple[str, int, int]], weights: dict[str, float]) -> list[float]:
    rare = {"<": weights.get("<", -0.2), "h": weights.get("h", 1.0), "": weights.get("", 1.0)}
    return [max(-CLIP, weights[k]) if k in weights else rare["<"] if k[0] in "<!" else rare["h"] if k[:2] == "h " else rare[""] for k, _, _ in ts]


def _best(source: str, ts: list[tuple[str, int, int]], weights: dict[str, float], whole: list[tuple[int, int]]) -> tuple[int, int]:
    best, total, start, got = 0.0, 0.0, 0, (0, len(source))
    for i, (v, (_, _, e)) in enumerate(zip(scores(ts, weights), ts)):
        total += v
        if total >= best:
            best, got = total, (ts[start][1], e)
        if total < 0:
            total, start = 0.0, i + 1
    a, b = got
    for x, y in whole:  # a code sample or formula is inside or outside as a whole
        if x < a < y:
            a = x
        if x < b < y:
            b = y
    return a, b


def _spans(source: str) -> list[tuple[int, int]]:
    return [m.span() for m in _DROP.finditer(source)] if "<" in source else []


def region(source: str, weights: dict[str, float]) -> tuple[int, int]:
    """Start and end of the best-scoring run of tokens, the longest one of equals; the whole text if it has no tags."""
    ts = tokens(source)
    return _best(source, ts, weights, _spans(source)) if any(k[0] == "<" for k, _, _ in ts) else (0, len(source))


def content(source: str, weights: dict[str, float]) -> str:
    """The content region, from the article's first heading on, without the lines in it whose words speak against them."""
    ts, whole = tokens(source), _spans(source)
    if not any(k[0] == "<" for k, _, _ in ts):
        return source
    a, b = _best(source, ts, weights, whole)
    if (m := re.search(r"<h1\b", source, re.I)) and m.start() < a:
        a = m.start()
    out, at, n, t = [], a, 0, 0
    for line in source[a:b].split("\n"):
        end = at + len(line)
        against, words = 0.0, 0
        while t < len(ts) and ts[t][1] < end:
            k = ts[t][0]
            if ts[t][1] >= at and k[0] not in "<!":
                words += 1
                if k in weights:
                    against += max(-2 * CLIP, weights[k] - LEAN)
            t += 1
        while n < len(whole) and whole[n][1] <= at:
            n += 1
        code = n < len(whole) and whole[n][0] < end and at < whole[n][1]
        if code or against >= min(DOUBT, MEAN * words) or _PIECE.search(line):
            out.append(line)
        at = end + 1
    return "\n".join(out)


# ---------------------------------------------------------------- residue

HTML_TAGS = "p div span strong em b i u s a li ul ol dl dt dd br hr h1 h2 h3 h4 h5 h6 table thead tbody tr td th img code pre kbd samp blockquote script style sup sub small section article header footer nav aside main figure figcaption font center del ins mark iframe button input form label video audio source summary details".split()
WIKI_TAGS = "ref references nowiki gallery syntaxhighlight includeonly noinclude onlyinclude poem categorytree math timeline templatestyles".split()

_MATH = r"\$\$[^$]+\$\$|(?<![\\$\w])\$(?=\S)[^$\n]*[\\^_={}][^$\n]*\$|(?<![\\$\w])\$[A-Za-z]\$|\\\([^\n]+?\\\)|\\\[.+?\\\]"
_LATEX = re.compile(
    r"\\(?:begin|end|part|chapter|(?:sub)*section|paragraph|textbf|textit|texttt|textsc|emph|underline|cite[tp]?|ref|eqref|pageref|label|footnote|caption|url|href|includegraphics|frac|sqrt|mathbb|mathrm|mathbf|text|usepackage|documentclass|input|title|author)\*?(?:\[[^\]\n]*\])?\{"
    r"|\{\\(?:em|bf|it|tt|sc|sl|rm|sf|small|large)\b|\\(?:item|hline|maketitle|noindent|ldots|par|centering|newline|newpage|toprule|midrule|bottomrule|tableofcontents)\b(?![\\/])|" + _MATH,
    re.S,
)
_WIKI = re.compile(
    r"^={2,6}[^=\n].*?[^=\n]={2,6}\s*$|(?<!')'{2,5}(?=[^'\s])[^'\n]+'{2,5}|\[\[[^\[\]\n]+\]\]|\{\{(?!\s*[.$%])[A-Za-z#][^{}]*\}\}|^\{\||^\|-\s*$|^\|\}|(?<!\])\[(?:https?|ftp)://\S+ [^\]\n]+\](?!\()|~~~~?~?(?!~)(?<!\w~~~)|^#REDIRECT\b|^;\s?\S[^\n]* : |^:{1,4}\s+\S|^\*\*+ |^[*#]+ (?:\[\[|'')|__(?:NO|FORCE)?TOC__",
    re.M | re.I,
)
_MARKDOWN = re.compile(
    r"^#{1,6} \S|!\[[^\]\n]*\]\([^)\n]+\)|(?<![\w\]])\[[^\[\]\n]+\]\([^)\s][^)\n]*\)|\]\[[^\[\]\n]*\]|^\[[^\]\n^]+\]: \S|\[\^[^\]\s]+\]|(?<![*\w\\])\*{1,3}(?=[^\s*])[^*\n]*[^\s*]\*{1,3}(?![*\w])"
    r"|(?<![\w_])__(?=[^\s_])[^_\n]+__(?!\w)|(?<!~)~~(?=[^\s~])[^~\n]+~~(?!~)|^\s{0,3}[-+] \S|^\s{0,3}[-*+] \[[ xX]\] |^\s{0,3}\d+\. \S|^\s{0,3}>+ \S|^\|?\s*:?-{2,}:?\s*\|[-:| ]*$|^\s{0,3}(?:\*\s*){3,}$|^\s{0,3}(?:-\s*){3,}$|^(?:___)$|^={3,}\s*$|(?<!`)`[^`\n]+`(?!`)|<(?:https?|mailto|ftp):[^<>\s]+>",
    re.M,
)
_STAR = re.compile(r"^\s{0,3}\* (?!\[\[|'')\S", re.M)
_LT, _GT = r"(?:<|&(?:amp;)*(?:lt|#0*60|#x0*3c);|\\u003c)", r"(?:>|&(?:amp;)*(?:gt|#0*62|#x0*3e);|\\u003e)"
_ESCAPED = re.compile(_LT + "/?(" + "|".join(sorted(HTML_TAGS, key=len, reverse=True)) + r")(?:\s[^<>\n]*?)?\s*/?" + _GT + f"|{_LT}!--", re.I)
_WIKITAG = re.compile(r"</?(?:" + "|".join(WIKI_TAGS) + r")\b[^<>]*>", re.I)
_FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})[^\n`]*\n.*?(?:^\s{0,3}\1[`~]*\s*$|\Z)", re.M | re.S)
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|minted|alltt)\*?\}.*?(?:\\end\{\1\*?\}|\Z)", re.S)
_HIGHLIGHT = re.compile(r"<(syntaxhighlight|source)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_LITERAL = re.compile(r"<(nowiki)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_RAWPRE = re.compile(r"(?:<|\\u003c)(pre|code)\b[^<>]*?(?:>|\\u003e).*?(?:(?:<|\\u003c)/\1(?:>|\\u003e)|\Z)", re.S | re.I)

_DROP = re.compile(r"<!--.*?-->|<(pre|code|script|style|math|svg|kbd|samp|template)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_PIECE = re.compile(r"</?(?:table|tr|t[dh]|ul|ol|pre|math)\b", re.I)  # lines that others need
_BLOCK_TAG = re.compile(r"</?(?:" + "|".join(_BLOCKS) + r")\b[^<>]*>", re.I)
_ANY_TAG = re.compile(r"</?(?:" + "|".join([*HTML_TAGS, "article", "main", "section", "body", "html", "head", "title", "svg", "math", "link", "meta", "abbr", "time", "cite", "q", "var", "wbr", "picture", "colgroup", "col", "tfoot", "caption"]) + r")\b[^<>]*>|<!DOCTYPE[^>]*>", re.I)


def shown(source: str) -> str:
    """The text a reader of the rendered article sees, code samples and formulas that render left out.

    A block element ends a line; entities are decoded once, so escaped tags appear as the signs they are.
    """
    t = _DROP.sub(" ", source)
    t = _ANY_TAG.sub("", _BLOCK_TAG.sub("\n", t))
    return "\n".join(x.strip() if x[:4].strip() else x.rstrip() for x in html.unescape(t).split("\n"))


def residue(source: str) -> set[str]:
    """Kinds of unrendered markup a reader sees outside code samples: markdown, wiki, latex, html."""
    t, out = shown(source), set()

    def take(rx: re.Pattern, kind: str) -> None:
        nonlocal t
        if rx.search(t):
            out.add(kind)
            t = rx.sub(" \n", t)

    take(_FENCE, "markdown")
    take(_VERBATIM, "latex")
    take(_HIGHLIGHT, "wiki")
    take(_LITERAL, "wiki")
    take(_RAWPRE, "html")
    take(_WIKITAG, "wiki")
    if _ESCAPED.search(t):
        out.add("html")
        t = _ESCAPED.sub(" ", t)
    if _LATEX.search(t):
        out.add("latex")
        t = re.sub(_MATH, " ", t, flags=re.S)
    ticks = re.compile(r"(?<!`)`[^`\n]+`(?!`)")
    if ticks.search(t):
        out.add("markdown")
        t = ticks.sub(" ", t)
    if _WIKI.search(t):
        out.add("wiki")
        t = _WIKI.sub(lambda m: "\n" if m.group().startswith(("*", "#", "|", "=", ";", ":")) else " ", t)
    if _MARKDOWN.search(t) or ("wiki" not in out and _STAR.search(t)):
        out.add("markdown")
    return out


# ---------------------------------------------------------------- conversion


def _inline(t: str) -> str:
    """Residual inline markup of one line to its text; formulas and code keep their signs."""
    t = re.sub(r"!\[([^\]\n]*)\]\([^)\n]+\)", r"\1", t)
    t = re.sub(r"(?<!\w)\[([^\[\]\n]+)\]\([^)\n]+\)", r"\1", t)
    t = re.sub(r"\[([^\[\]\n]+)\]\[[^\]\n]*\]", r"\1", t)
    t = re.sub(r"\[\^[^\]\s]+\]|~~~~~?", "", t)
    t = re.sub(r"(?<![*\w\\])(\*{1,3})(?=[^\s*])([^*\n]*[^\s*])\1(?![*\w])", r"\2", t)
    t = re.sub(r"(?<![\w_])__(?=[^\s_])([^_\n]+)__(?!\w)", r"\1", t)
    t = re.sub(r"~~(?=\S)([^~\n]+)~~", r"\1", t)
    t = re.sub(r"\[\[(?:[^\[\]|\n]*\|)*([^\[\]|\n]+)\]\]", r"\1", t)
    t = re.sub(r"(?<!')'{2,5}(?=[^'\s])([^'\n]+)'{2,5}", r"\1", t)
    t = re.sub(r"\[(?:https?|ftp)://\S+ ([^\]\n]+)\]", r"\1", t)
    t = re.sub(r"<((?:https?|ftp|mailto):[^<>\s]+)>", r"\1", t)
    t = re.sub(r"\\(?:textbf|textit|texttt|textsc|emph|underline)\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", t)
    t = re.sub(r"\\(?:cite[tp]?|ref|eqref|label)\{[^{}]*\}", "", t)
    return _WIKITAG.sub("", _ESCAPED.sub("", t))


def _line(t: str) -> str | None:
    """A line of residual block markup in plain form; None drops it."""
    if re.match(r"^\\(?:begin|end)\{|^\{\||^\|\}|^\|-+\s*$|^\|?\s*:?-{2,}:?\s*\|[-:| ]*$|^\s*\\hline|^\[[^\]\n]+\]: \S+$", t):
        return None
    if m := re.match(r"^\\((?:sub)*)section\*?\{(.*)\}\s*$", t):
        return "#" * (2 + len(m.group(1)) // 3) + " " + _inline(m.group(2))
    if m := re.match(r"^(={2,6})\s*([^=].*?)\s*={2,6}\s*$", t):
        return "#" * len(m.group(1)) + " " + _inline(m.group(2))
    if m := re.match(r"^(#{1,6}) (.*?)\s*#*\s*$", t):
        return m.group(1) + " " + _inline(m.group(2))
    if m := re.match(r"^\s*(?:\\item|[*+•-])\s+(.*)$", t):
        return "- " + _inline(m.group(1))
    return _inline(t)


def plain_text(source: str) -> str:
    """Clean text of an article: headings as #, list items as -, code fenced, table cells by |, formulas kept."""
    kept: list[str] = []

    def keep(text: str) -> str:
        kept.append(text)
        return f"\n\x00{len(kept) - 1}\x00\n"

    def code(m: re.Match) -> str:
        body = re.sub(r'(?i)</div>\s*(?=<div\b[^<>]*class="[^"]*ec-line)', "\n", m.group(2))
        return keep("```\n" + html.unescape(_ANY_TAG.sub("", body)).strip("\n") + "\n```")

    t = re.sub(r"<!--.*?-->|<(script|style|template)\b[^<>]*>.*?(?:</\1\s*>|\Z)", " ", source, flags=re.S | re.I)
    t = re.sub(r"<(pre)\b[^<>]*>(.*?)(?:</\1\s*>|\Z)", code, t, flags=re.S | re.I)
    t = re.sub(r"<math\b[^<>]*>(.*?)(?:</math\s*>|\Z)", lambda m: "$" + html.unescape(_TAGS.sub(" ", m.group(1))).strip() + "$", t, flags=re.S | re.I)
    t = re.sub(r"<code\b[^<>]*>(.*?)</code\s*>", lambda m: "`" + _ANY_TAG.sub("", m.group(1)) + "`", t, flags=re.S | re.I)
    t = re.sub(r"<h([1-6])\b[^<>]*>", lambda m: "\n" + "#" * int(m.group(1)) + " ", t, flags=re.I)
    t = re.sub(r"<li\b[^<>]*>", "\n- ", t, flags=re.I)
    t = re.sub(r"</t[dh]>\s*<t[dh]\b[^<>]*>", " | ", t, flags=re.I)
    t = html.unescape(_ANY_TAG.sub("", _BLOCK_TAG.sub("\n", t)))
    for rx in (_FENCE, _VERBATIM, _HIGHLIGHT):
        t = rx.sub(lambda m: keep("```\n" + "\n".join(m.group().split("\n")[1:-1]) + "\n```"), t)
    out = []
    for x in t.split("\n"):
        if m := re.fullmatch(r"\x00(\d+)\x00", x.strip()):
            out.append(kept[int(m.group(1))])
        elif x.strip() and (y := _line(x.strip())) is not None and y.strip():
            out.append(y.strip())
    return "\n".join(out)


_TAGS = re.compile(r"<[^<>]+>")


def _weights(pages: DataFrame, row_id: str, text: str, url: str | None) -> dict[str, float]:
    """Weights from a bounded sample of pages, labelled by the wrappers that problem 1 infers for their sites.

    The sample is the first pages by the hash of their id, up to ``SAMPLE`` pages and ``SAMPLE_CHARS`` characters.
    """
    from corpusloom.llm.site_lines import host
    from corpusloom.llm.wrappers import sample_furniture

    site = F.coalesce(host(F.col(url)), F.lit("")) if url else F.lit("")
    src = pages.filter(F.length(text) > 0).select(F.xxhash64(row_id).alias("h"), F.length(text).alias("n"), F.col(text).alias("t"), site.alias("s"))
    first = src.select("h", "n").orderBy("h", "n").limit(SAMPLE).collect()  # at most SAMPLE rows of numbers
    total, last = 0, None
    for r in first:
        total += r["n"]
        if total > SAMPLE_CHARS:
            break
        last = r["h"]
    if last is None:
        return dict(DEFAULT)
    rows = src.filter(F.col("h") <= last).orderBy("h", "t").limit(SAMPLE).collect()  # the sample
    return fit_weights([r.t for r in rows], sample_furniture([(r.s, r.t) for r in rows], True))


def convert(pages: DataFrame, row_id: str, text: str, url: str | None = None, clean_text: bool = True) -> DataFrame:
    """row_id, text (clean; null without ``clean_text``) and markup (sorted kinds of residue) of every article.

    ``url`` names the column whose hosts are the sites that the labelling of the sample goes by.
    A null article gives null text and no kinds, an empty one an empty text. Repeated rows give equal rows.
    """
    small_batches(pages.sparkSession)
    w = _weights(pages, row_id, text, url)
    src = pages.select(F.col(row_id).alias("row_id"), F.col(text).alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            clean, kinds = [], []
            for t in p["_text"]:
                if t is None:
                    clean.append(None)
                    kinds.append([])
                    continue
                t = content(t, w)
                clean.append(plain_text(t) if clean_text else None)
                kinds.append(sorted(residue(t)))
            yield pd.DataFrame({"row_id": p["row_id"], "text": clean, "markup": kinds})

    return src.mapInPandas(run, f"row_id {src.schema['row_id'].dataType.simpleString()}, text string, markup array<string>")
