"""Problem 1: the main body of a page, by wrappers inferred for each site.

A site's pages are taken as streams of line tokens: a line's lower-cased letters or, for lines such as by-lines and
dates, what is left when names and numbers are masked. Streams of one site are aligned one after another into a
union-free regular expression: a sequence of fixed tokens, each required or optional, single or repeated, with text
slots between them. A mismatch becomes an optional token where the other stream has nothing at that place, a
repeated token where it comes again, and a text slot where the tokens differ from page to page; what slots after a
token hold, running text or lists of titles, is learnt with it. Sites are aligned in salted parts, and the parts'
wrappers are aligned in the same way, a few at a time, so no task holds a whole site.

Each page is then aligned with its site's expression. Lines that match fixed tokens in place are template; slots of
lists are links; in the other slots stands the article, along with what its own structure gives away: the page's
list of its own headings, its path, runs of titles. Only lines that all this leaves open are looked up in the fixed
wordings of ``furniture``, which also serve sites of too few pages for a wrapper.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import furniture as U
from corpusloom.llm.messages import message_line
from corpusloom.llm.site_lines import host, letters
from corpusloom.session import lookup_join, materialize, small_batches

PART = 500  # pages of a site that one task aligns
TEXT = 8_000_000  # characters of pages of a site that one task parses, but for a single longer page
FAN = 16  # wrappers of parts that one step aligns with each other
TITLE = 90  # characters that a title, a link or a by-line has at most

_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_HEAD = re.compile(r"^\s*(?:<[^h][^<>]*>\s*)*<(?:h[1-6]|t[rdh]|table|pre|blockquote)\b", re.I)
_NOT_TITLE = re.compile(r"^[|!\\{&]|[.!?。！？]$|[{}=;,，。\[\]<>_]|://|^[$#/-]|\(.*\)$|^(?:Note|Tip|Warning|Hinweis|Tipp|Nota|Remarque|Astuce|Consejo|Aviso)\b ?:|^(?:注意|提示)")
_BULLET = re.compile(r"^[-*+]\s+(?=\S)")
_ARROW = re.compile(r"^[«‹]\s|^(?:previous|next|zurück|weiter|précédent|suivant|anterior|siguiente) ?: |\s[»›]$", re.I)
_LIST = re.compile(r"^(?:[•*+–-]|\d+[.)])\s")


def visible(line: str, markup: bool) -> str:
    """A line's text; of markup, without its tags."""
    return html.unescape(_TAG.sub(" ", line)) if markup else line


def token(line: str) -> int:
    k = letters(line)
    return (xxhash.xxh64_intdigest(k) - 2**63) & ~1 if k else 0


# ---------------------------------------------------------------- wrapper inference

_PERSON = re.compile(r"(?:(?<=\s)|^)[^\W\d_a-z][\w'’-]*(?: [^\W\d_a-z][\w'’-]*)+(?=$| ?[,·|—–])")
_YEAR = re.compile(r"(?<!\d)(?:19|20)\d\d(?!\d)")
_NUMBERS = re.compile(r"\d[\d./:-]*")


def mask_token(line: str) -> int:
    """The token, an odd number, of a by-line or date line with persons and numbers masked; 0 of any other line."""
    if len(line) > TITLE:
        return 0
    t, persons = _PERSON.subn("\x01", line)
    t, left = _NUMBERS.sub("\x02", t), len(letters(t))
    if not (persons and left <= 16 or _YEAR.search(line) and left <= 24):
        return 0
    return xxhash.xxh64_intdigest("".join(x for x in t.lower() if not x.isspace())) - 2**63 | 1


def running(text: str) -> bool:
    """Running text: a longer line that is no title."""
    return len(text) >= 60 and not title_like(text)


class Wrapper:
    """Fixed tokens in page order; for each the number of pages that have it in order, out of order, repeatedly, alone
    between slots, and of slots after it, all, those without running text and those that begin as a page's list of its own
    headings does: with a line that comes again, or with two that the page has elsewhere."""

    WIDTH = 7

    def __init__(self) -> None:
        self.order: list[int] = []
        self.stat: dict[int, list[int]] = {}
        self.pages = 0

    def place(self, tokens: list[int]) -> set[int]:
        """The tokens in a longest common subsequence with the wrapper, whose tokens are unique."""
        where = {t: i for i, t in enumerate(self.order)}
        tails, at, back = [], [], {}
        for t in tokens:
            if (p := where.get(t)) is not None:
                i = bisect_left(tails, p)
                back[t] = at[i - 1] if i else None
                tails[i : i + 1], at[i : i + 1] = [p], [t]
        kept, t = set(), at[-1] if at else None
        while t is not None:
            kept.add(t)
            t = back[t]
        return kept

    def _put(self, tokens: list[int]) -> set[int]:
        """As ``place``; tokens that are new go in as optional, after the token that they followed."""
        kept, have = self.place(tokens), set(self.order)
        if not have.issuperset(tokens):
            out, after, last = [], {}, None
            for t in tokens:
                if t in kept:
                    last = t
                elif t not in have:
                    after.setdefault(last, []).append(t)
                    kept.add(t)
            out += after.get(None, [])
            for t in self.order:
                out.append(t)
                out += after.get(t, [])
            self.order = out
        return kept

    def add_page(self, stream: list[int], fixed: set[int], text: list[bool] | None = None, masks: list[int] | None = None) -> None:
        """Only ``fixed`` tokens of a stream, or fixed masks in their stead, stand for themselves; all others are slot
        lines, as zeros are. ``text`` marks running text."""
        s = [m if m in fixed else t if t in fixed else 0 for t, m in zip(stream, masks or [0] * len(stream))]
        text = text or [False] * len(s)
        first = list(dict.fromkeys(t for t in s if t))
        kept = self._put(first)
        count = Counter(t for t in s if t)
        alone = {t for i, t in enumerate(s) if t and not (i and s[i - 1]) and not (i + 1 < len(s) and s[i + 1])}
        for t in first:
            x = self.stat.setdefault(t, [0] * self.WIDTH)
            x[0 if t in kept else 1] += 1
            x[2] += count[t] > 1
            x[3] += t in alone
        i, again, at = 0, Counter(stream), {t: n for n, t in reversed(list(enumerate(stream)))}
        while i < len(s):  # the slots and the tokens before them
            e = i
            while e < len(s) and not s[e]:
                e += 1
            if e > i and i:
                x = self.stat[s[i - 1]]
                x[4] += 1
                x[5] += not any(text[i:e])
                x[6] += again[stream[i]] > 1 and (at[stream[i]] == i or (e > i + 1 and again[stream[i + 1]] > 1))
            i = e + 1
        self.pages += 1

    def merge(self, order: list[int], stats: list[list[int]], pages: int) -> None:
        self._put(order)
        for t, x in zip(order, stats):
            self.stat[t] = [a + b for a, b in zip(self.stat.get(t, [0] * self.WIDTH), x)]
        self.pages += pages

    def row(self) -> dict:
        return {"tokens": self.order, "stats": [self.stat.get(t, [0] * self.WIDTH) for t in self.order], "pages": self.pages}

    def settle(self) -> "Wrapper":
        """Split the tokens into template, which mostly holds its place or moves among its like, and others, which
        stand alone in slot text as the headings do that many articles share. A token before lists of titles or of the
        page's own headings, and a masked one, may stand alone."""
        often = lambda t, n, share: (x := self.stat[t])[4] >= 3 and x[n] >= share * x[4]
        self.lists = {t for t in self.order if often(t, 5, 0.85)}
        self.tocs = {t for t in self.order if often(t, 6, 0.6)}
        self.template = {t for t in self.order if (x := self.stat[t])[3] <= 0.7 * (x[0] + x[1]) or t & 1} | self.tocs
        return self


def line_tokens(lines: list[str], markup: bool) -> tuple[list[int], list[int], list[bool]]:
    """Tokens, masked tokens and running text of the lines with letters; the title of a plain page is left out."""
    keys, masks, text = [], [], []
    for x in lines[0 if markup else 1 :]:
        v = visible(x, markup).strip()
        if v and (k := token(v)):
            keys.append(k)
            masks.append(mask_token(v))
            text.append(running(v))
    return keys, masks, text

_PARTIAL = "site string, part int, tokens array<bigint>, stats array<array<int>>, pages int"


def streams(src: DataFrame, markup: bool) -> DataFrame:
    """(site, text) to one row per distinct text: site, digest and the text's ``line_tokens``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            got = [line_tokens((t or "").split("\n"), markup) for t in p["text"]]
            yield pd.DataFrame({"site": p["site"], "digest": [xxhash.xxh64_intdigest(t or "") - 2**63 for t in p["text"]], "stream": [g[0] for g in got], "masks": [g[1] for g in got], "running": [g[2] for g in got]})

    return src.mapInPandas(run, "site string, digest bigint, stream array<bigint>, masks array<bigint>, running array<boolean>").dropDuplicates(["site", "digest"])


def infer(pages: DataFrame, least: int = 4, share: float = 0.02) -> DataFrame:
    """Wrappers of all sites: site, tokens, stats, pages.

    ``pages`` is the result of ``streams``. A token is fixed when it stands on at least ``least`` and at least
    ``share`` of the site's distinct pages. A site whose pages share nothing has no row.
    """
    sizes = pages.groupBy("site").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    sizes = materialize(sizes, "sites")
    df = pages.select("site", F.explode(F.array_distinct(F.concat("stream", "masks"))).alias("token")).filter("token <> 0").groupBy("site", "token").agg(F.count("*").alias("d")).filter(F.col("d") >= least)
    fixed = lookup_join(df, sizes, ["site"]).filter(F.col("d") >= share * F.col("n"))
    fixed = fixed.select(F.col("site").alias("s"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), F.col("token").alias("t"))  # at most the mean page length / share tokens a part
    salted = lookup_join(pages, sizes, ["site"]).withColumn("part", F.pmod(F.col("digest"), F.col("parts")).cast("int"))

    def part(key: tuple, p: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        w, fx = Wrapper(), set(f["t"].tolist())
        if not fx or not len(p):
            return pd.DataFrame([], columns=["site", "part", "tokens", "stats", "pages"])
        p = p.sort_values("digest")
        for s, m, r in zip(p["stream"], p["masks"], p["running"]):
            w.add_page(s.tolist(), fx, r.tolist(), m.tolist())
        return pd.DataFrame([{"site": key[0], "part": key[1], **w.row()}])

    def several(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        w, p = Wrapper(), p.sort_values("part")
        for o, s, n in zip(p["tokens"], p["stats"], p["pages"]):
            w.merge(list(o), [list(map(int, x)) for x in s], int(n))
        return pd.DataFrame([{"site": key[0], "part": key[1], **w.row()}])

    known = salted.select("site", "part", "digest", "stream", "masks", "running").groupBy("site", "part").cogroup(fixed.groupBy("s", "p")).applyInPandas(part, _PARTIAL)
    most = sizes.agg(F.max("parts")).first()[0] or 1
    while most > 1:
        known = known.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("site", "part").applyInPandas(several, _PARTIAL)
        most = -(-most // FAN)
    return materialize(known.drop("part"), "wrappers")


# ---------------------------------------------------------------- parsing a page


def title_like(text: str) -> bool:
    """A line without sentence end, list mark, comma or code signs, as headings and links are."""
    return 3 <= len(text) <= TITLE and not text[0].islower() and not _NOT_TITLE.search(text) and not _LIST.match(text)


def aligned(rows: list[int], tok: dict[int, int], wrapper: Wrapper) -> set[int]:
    """Rows that match fixed tokens: those in a longest common subsequence with the expression and, of repeated and
    moved tokens, those next to a row that matches."""
    first: dict[int, int] = {}
    for i in rows:
        if tok[i] in wrapper.template:
            first.setdefault(tok[i], i)
    kept = wrapper.place(list(first))
    out = {first[t] for t in kept} | {i for i in rows if tok[i] & 1 and tok[i] in wrapper.template}  # by-lines stand anywhere
    for line in (rows, rows[::-1]):
        before = None
        for i in line:
            if i not in out and tok[i] in wrapper.template and before in out:
                out.add(i)
            before = i
    return out


def code_rows(lines: list[str]) -> set[int]:
    """Rows inside code samples, which are the article's."""
    out, inside = set(), False
    for i, x in enumerate(lines):
        low = x.lower()
        opens, ends = low.rfind("<pre"), low.rfind("</pre")
        if inside or opens >= 0:
            out.add(i)
        if opens >= 0 or ends >= 0:
            inside = opens > ends
    return out


def furniture_lines(lines: list[str], wrapper: Wrapper | None = None, markup: bool = False, words: bool = True) -> list[int]:
    """Numbers, from 1, of a page's lines that are not part of its main body.

    Blank lines, lines of tags alone and, of plain text, the first line never count. ``words``: whether the fixed
    wordings are looked up for lines that the wrapper leaves open.
    """
    text = [visible(x, markup).strip() for x in lines]
    if markup:  # an article without tags carries the list marks of its own markup
        text = [_BULLET.sub("", t) if t and "<" not in x else t for t, x in zip(text, lines)]
    rows = [i for i in range(0 if markup else 1, len(text)) if text[i]]
    key = {i: letters(text[i]) for i in rows}
    title = letters(U._CRUMB.split(text[0])[0]) if text and not markup else ""
    times = Counter(key.values())
    plain = {i: U.plain(text[i]) for i in rows}
    said = {i for i in rows if message_line(text[i])}
    own = said | {i for i in rows if U.heading(text[i], plain[i])}  # the article's, however often a site has it
    final = {key[i]: i for i in rows}
    sample = code_rows(lines) if markup else set()
    head = {i for i in rows if markup and _HEAD.match(lines[i])}
    out: set[int] = set()
    # ---- the template
    if wrapper is not None:
        tok = {}
        for i in rows:
            t = mask_token(text[i])
            tok[i] = t if t in wrapper.template else token(text[i])
            if i in own or i in sample or key[i] == title or (markup and text[i][0] in "\\|!{&$`="):
                tok[i] = 0
        out = aligned(rows, tok, wrapper)
    # ---- wordings
    worded = {i for i in rows if i not in out and words and i not in sample and U.worded(text[i], plain[i])}
    labels = {i for i in rows if words and U.RELATED.match(plain[i])}
    template, out = out, out | worded
    # ---- slots
    n = 0
    while n < len(rows):
        e = n
        while e < len(rows) and rows[e] not in out:
            e += 1
        slot, before = rows[n:e], rows[n - 1] if n else None
        if slot and before is not None:
            toc = (words and bool(U.TOC.match(plain[before]))) or (before in template and tok[before] in wrapper.tocs)
            for i in slot:  # the page's own headings, after a label or ahead of the article
                if not (times[key[i]] > 1 and key[i] and (toc or final[key[i]] > i) and i not in said and i not in head):
                    break
                out.add(i)
        n = e + 1
    listing = False  # after a label of a list of links, on to the first line that is no title
    for i in rows:
        if i in labels or (i in template and tok[i] in wrapper.lists and title_like(U.bare(text[i]))):
            listing = True
        elif listing and (i in worded or i in own or i in head or not title_like(U.bare(text[i]))):
            listing = False
        elif listing:
            out.add(i)
    for i in rows:
        if i in out or i in own:
            continue
        t = text[i]
        if title and len(title) > 8 and key[i].endswith(title) and U._CRUMB.search(t) and len(U._CRUMB.split(t)) >= 3:
            out.add(i)
        elif len(t) <= 2 * TITLE and _ARROW.search(t) and title_like(U.bare(t)):
            n = rows.index(i)
            out.add(i)
            before = [j for j in rows[:n] if j >= i - 2][-1:]  # the other link of the pair may lack its arrow
            if before and before[0] not in out and title_like(U.bare(text[before[0]])) and (markup or n < 2 or rows[n - 2] in out) and before[0] not in head:
                out.add(before[0])

    # ---- runs of titles are links: no article has several headings on end. Ahead of furniture or at the end of the
    # page two are enough, or one next to a link already found; before text three are needed, and the last is a heading.
    def link(i: int) -> bool:
        return i not in out and key[i] != "" and title_like(U.bare(text[i])) and not (i in own or times[key[i]] > 1 or i in head)

    n = 0
    while n < len(rows):
        e = n
        while e < len(rows) and link(rows[e]):
            e += 1
        if e > n:
            closed = e == len(rows) or rows[e] in out
            beside = n > 0 and rows[n - 1] in out and title_like(U.bare(text[rows[n - 1]])) and rows[n - 1] not in worded and rows[n - 1] not in template
            if closed and (e - n >= 2 or beside):
                out.update(rows[n:e])
            elif not closed and e - n >= 3:
                out.update(rows[n : e - 1])
        n = max(e, n + 1)
    return sorted(x + 1 for x in out)


def furniture(docs: DataFrame, row_id: str, text: str, url: str, markup: bool) -> DataFrame:
    """Lines outside the main body of every page: row_id, line_no.

    Null and empty texts have no lines. Rows with a null url form the site ''. Repeated rows have the same lines;
    a text that a site serves more than once counts once for its wrapper. A site's wrapper is sent once to each
    part of its pages, and a part holds a bounded amount of text.
    """
    small_batches(docs.sparkSession)
    src = docs.filter(F.length(text) > 0).select(F.col(row_id).cast("bigint").alias("row_id"), F.coalesce(host(F.col(url)), F.lit("")).alias("site"), F.col(text).alias("text"))
    pages = materialize(streams(src.select("site", "text"), markup), "streams")
    known = infer(pages)
    sizes = src.groupBy("site").agg(F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum(F.length("text")) / TEXT)).cast("int").alias("parts"))
    sizes = materialize(sizes, "parts")
    sent = lookup_join(known, sizes, ["site"]).select(F.col("site").alias("s"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), F.col("tokens").alias("t"), F.col("stats").alias("x"), F.col("pages").alias("n"))
    dealt = lookup_join(src, sizes, ["site"]).withColumn("part", F.pmod(F.xxhash64("row_id", "text"), F.col("parts")).cast("int"))

    def parse(key: tuple, p: pd.DataFrame, k: pd.DataFrame) -> pd.DataFrame:
        w = None
        if len(k):
            w = Wrapper()
            w.merge(k["t"].iloc[0].tolist(), [list(map(int, x)) for x in k["x"].iloc[0]], int(k["n"].iloc[0]))
            w.settle()
        ids, nos = [], []
        for r, t in zip(p["row_id"], p["text"]):
            got = furniture_lines(t.split("\n"), w, markup)
            ids += [r] * len(got)
            nos += got
        return pd.DataFrame({"row_id": np.array(ids, dtype=np.int64), "line_no": np.array(nos, dtype=np.int32)})

    out = dealt.select("site", "part", "row_id", "text").groupBy("site", "part").cogroup(sent.groupBy("s", "p"))
    return out.applyInPandas(parse, "row_id bigint, line_no int").distinct()


def main_body(docs: DataFrame, row_id: str, text: str, lines: DataFrame) -> DataFrame:
    """Pages without the given lines (row_id, line_no): row_id, text."""
    gone = lines.groupBy("row_id").agg(F.array_sort(F.collect_set("line_no")).alias("_gone"))
    j = docs.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(text).alias("_t")).join(gone, "row_id", "left")
    kept = F.filter(F.split("_t", "\n"), lambda x, i: ~F.array_contains("_gone", i + 1))
    return j.select("row_id", F.when(F.col("_gone").isNull(), F.col("_t")).otherwise(F.array_join(kept, "\n")).alias("text"))


def sample_furniture(pages: list[tuple[str, str]], markup: bool, least: int = 4, share: float = 0.02) -> list[set[int]]:
    """As ``furniture`` for a bounded list of (site, text), without Spark: the line numbers of each."""
    sites: dict[str, dict[str, tuple]] = {}
    for site, text in pages:
        sites.setdefault(site, {})[text] = ()
    known = {}
    for site, texts in sites.items():
        streams = [line_tokens(t.split("\n"), markup) for t in sorted(texts)]
        df = Counter(k for s, m, _ in streams for k in {*s, *m} if k)
        fixed = {k for k, n in df.items() if n >= least and n >= share * len(streams)}
        w = Wrapper()
        for s, m, r in streams:
            w.add_page(s, fixed, r, m)
        known[site] = w.settle() if fixed else None
    return [set(furniture_lines(t.split("\n"), known[s], markup)) for s, t in pages]
