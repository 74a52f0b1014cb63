"""Problem 6: pages that hold a message, filler or open template slots instead of an article.

Slots are found by one grammar for each kind of delimiter, filler and page messages by wording. A hit counts by
its surroundings: not inside code, not where the sentence explains or quotes the notation, and a message only
where the page has no article around it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import small_batches

# What error, denial, check and script pages say, in five languages.
MESSAGES = r"""
page introuvable|le lien est peut-être rompu|the page you asked for could not be found|it may have moved or never existed|diese seite wurde nicht gefunden|bitte prüfen sie die adresse|页面不存在|请检查网址
oops! nothing to see here|go back to the start page|(error )?404( not found|[: -]+page not found)?|not found|page not found|the requested url \S+ was not found on this server
la página solicitada no existe|no se (ha )?encontr(ó|ado) la página( solicitada)?|la página no existe|página no encontrada|compruebe la dirección|seite nicht gefunden
(error )?(500|502|503|504|403|401|429)( [a-z -]+)?|bad gateway|internal (server )?error|server error|service temporarily unavailable|the upstream server did not answer in time|gateway time-?out
we are down for scheduled maintenance until \S+ o'clock|error establishing a database connection|something went wrong( on our side)?(\. try again( in a few minutes| later)?)?|es ist ein fehler aufgetreten|une erreur est survenue|ha ocurrido un error|服务器错误|服务暂时不可用
access denied|forbidden|your address \S+ is not allowed to view this resource|reference: \S+|ray \S+|this space is private\. ask an owner for an invitation|this content has been removed by its owner|your session has expired\. please sign in again to continue
accès refusé|acceso denegado|zugriff verweigert|访问被拒绝|too many requests|slow down: you have sent \d+ requests in the last minute
this domain \S+ is parked\. renew it to restore the site|this site can.t be reached|account suspended|this account has been suspended
(please |you need to )?enable javascript.*|javascript is required|turn on scripts in your browser and reload|ce site a besoin de javascript pour fonctionner|bitte aktivieren sie javascript.*|active los scripts de su navegador.*|请启用脚本后重新加载页面|veuillez activer javascript.*
your browser is out of date and cannot show this page\. scripts must be allowed|loading application, please wait\. if nothing happens, allow scripts for \S+
verify that you are human.*|checking your browser before you enter \S+|this can take up to \d+ seconds|just a moment|one moment, please|complete the check below.*
"""
# Filler lines and the vocabulary of pseudo-Latin and its modern kin.
FILLER = r"""
todo|tbd|todo: .{3,60}|tbd: .{3,60}|coming soon|(this page is )?under construction|your content will appear here soon|hier steht später der text|sample text goes here\. replace it before you publish|(text )+text|placeholder( text)?|lorem ipsum.*|insert text here|add your text here|your text here|type your text here
texto provisional.*|placeholder (paragraph|copy|content)\b.*|texte de remplissage.*|blah( blah)+\b.*|this is an example (page|post)\..*|aquí (va|irá) el texto.*|texto de ejemplo.*|votre texte ici.*|texte à venir.*|ici le texte.*|blindtext.*|此处.{0,12}(内容|文字|文本)|内容即将.*|敬请期待|(asdf|qwer|test|foo|bar|blah|bla|xxx|jkl|\d+)( (asdf|qwer|test|foo|bar|blah|bla|xxx|jkl|\d+))+
"""
LATIN = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "kolor quar arcu aliq feug tessit tinc nonum ullam vest praes morun "
    "denim artisan bicycle beard retro tote waffle mustache kale loft vinyl latte craft poke banjo pixel mixtape".split()
)
# Words that names of template fields are made of.
FIELDS = set(
    "customer company product description category summary headline intro author version date page title name first last site user username email e-mail mail address phone city country price subject body content text url link "
    "image logo heading subtitle tagline brand client order total amount number zip street state quantity item due invoice account position job department event location venue website organization organisation business team role recipient sender signature year month day time".split()
)

_ID = r"[A-Za-z_]\w*(?:[.-]\w+)*"
# One grammar for each delimiter. Those of the first group hold open slots whatever the name inside; the signs of the
# second are also those of links, formulas, emphasis, tags and paths, so their name must be one of a field.
OPEN = {
    "mustache": rf"\{{\{{[{{&#/^]?\s*({_ID})\s*(?:\|[^{{}}\n]*)?\}}?\}}\}}",
    "dollar": rf"\$\{{({_ID})\}}",
    "erb": rf"<%[=-]?\s*@?({_ID})\s*-?%>",
    "percent": rf"%%({_ID})%%",
    "at": rf"@@({_ID})@@",
    "mark": rf"\bXXX-({_ID})-XXX\b",
    "block": rf"\{{%-?\s*block ({_ID})\s*-?%\}}",
    "pair": rf"\{{\d\}} ?\{{({_ID})\}}",
    "bracket": r"\[(?:insert|your|enter|add|type|put|fill in)\b:? ([\w' -]{2,40})\]",
}
NAMED = {
    "wiki": rf"\[\[({_ID})\]\]",
    "square": r"(?<![\[\w\]!])\[([A-Z][\w']*(?: [\w']+){0,3})\](?![\[(:])",
    "money": rf"\$\$({_ID})\$\$",
    "under": r"(?<!\w)__((?!name__|file__|all__|doc__)[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*)__(?!\w)",
    "angle": rf"<({_ID})>",
    "brace": rf"(?<![\w{{$/])\{{({_ID})\}}(?!/)",
}
_SLOT = re.compile("|".join(f"(?P<{k}>{v})" for k, v in {**OPEN, **NAMED}.items()), re.I)
_SIGNS = set("{<[%@$")  # a slot has one of these, or the marks below
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def field(name: str) -> bool:
    """All words of a name, split at signs and capitals, are those of fields."""
    parts = [x.lower() for x in _PARTS.findall(name)]
    return bool(parts) and all(x in FIELDS or x.removesuffix("s") in FIELDS or x in ("your", "the", "of", "here", "our") for x in parts)


def slots_of(line: str) -> list[tuple[str, str, bool]]:
    """(kind, text, whether its name is a field's) of every slot of a line."""
    if _SIGNS.isdisjoint(line) and "__" not in line and "XXX-" not in line.upper():
        return []
    out = []
    for m in _SLOT.finditer(line):
        kind = m.lastgroup
        name = next(g for g in m.groups()[m.re.groupindex[kind] :] if g)
        known = field(name)
        if known or kind in OPEN:
            out.append((kind, m.group(), known))
    return out


_MESSAGE = re.compile("^(?:" + "|".join(MESSAGES.strip().split("\n")) + r")[.!…。！]*$", re.I)
_FILL = re.compile("^(?:" + "|".join(FILLER.strip().split("\n")) + r")[.!…。！]*$", re.I)
# Wordings by which a sentence explains or quotes a notation.
EXPLAINS = re.compile(
    r"\b(?:variable|placeholders?|in the template|in a template|marks the place|expands? to|replace <|is replaced|stands for|renderer puts|write \{\{|write \$|syntax|notation|escap(?:e|ed)|literally|mock-?up|linter|search the code|designers often|error (?:code|message)|returns|answers|responds|means that|shows? the message)\b",
    re.I,
)
_TELLS = re.compile(
    "(?i)\\b(?:write|use|put|type|set|replace|pass|call|insert|add|via|with|named?|called|variables?|keys?|fields?|macros?|tags?|expressions?|blocks?|filters?|tokens?|slots?)(?: a| an| the| like| as)?[ :]+[\"'“`«]?\x00"
    "|\x00[\"'”`»]? (?:marks|expands|stands|is (?:replaced|filled|expanded|set)|resolves|refers|returns|prints|renders|inserts|holds|contains|means|becomes)\\b"
)  # a word about the notation next to a slot
_CODE = re.compile(r"^\s*(?:[#$>] |(?:export|curl|sudo|mkdir|cp|mv|rm|cat|git|pip|npm|docker|let|var|const|return|import|from|def|class|print|echo|if|for|while)\b.*[=(/\[{:;-]|[\w.-]+\s*[=:]\s*\S+$|[\w.-]+\s+\"\w+\"\s*\{|.*[;{}]\s*$|</?\w+[^>]*>\s*\S*.*</)")


# Ways in which pages say that there is nothing to see, for lines that no list above has.
CUES = re.compile(
    r"^(?:https?(?:/\d(?:\.\d)?)? ?)?(?:(?:error|status|fehler|erreur|código)(?: code)?[ :#-]*)?[45]\d\d\b(?:[ :–-]+[\w' -]{0,60})?[.!]?$"
    r"|^(?:please |you (?:must|need to|have to) |veuillez |bitte |por favor,? ?|请)?(?:enable|disable|turn o\w+|allow|activate|switch o\w+|unblock|accept|whitelist|verify|confirm|prove|complete|update|upgrade|sign in|log in|activez|autorisez|désactivez|aktivieren|erlauben|deaktivieren|active|habilite|permita|desactive|启用|允许|关闭|登录|验证).{0,80}?(?:java ?script|scripts?|cookies?|ad-? ?block|browser|captcha|human|robot|security check|to (?:continue|proceed|view|access)|navigateur|navegador|继续|脚本)"
    r"|\b(?:not found|no longer (?:exists?|available)|does(?: not|n.t) exist|(?:could not|cannot|can.t) be (?:found|reached|loaded|displayed|shown)|(?:temporarily|currently) (?:unavailable|offline|down|closed)|service unavailable|access (?:is |was )?(?:denied|restricted|blocked|forbidden)|not authori[sz]ed|unauthori[sz]ed|(?:has|have) (?:expired|been (?:removed|deleted|suspended|disabled|blocked|taken down))|(?:down|closed) for maintenance|request timed out|(?:please )?try again (?:later|in a)|something went wrong|(?:an|unexpected|internal|fatal) error (?:has )?(?:occurred|happened)|permanently gone)\b"
    r"|\b(?:nicht (?:gefunden|verfügbar|erreichbar)|zugriff (?:verweigert|gesperrt)|wartungsarbeiten|introuvable|n.existe (?:pas|plus)|accès (?:refusé|interdit)|indisponible|no (?:se )?(?:encontrad[oa]|existe|está disponible)|acceso (?:denegado|prohibido)|fuera de servicio)\b|不存在|找不到|无法访问|拒绝访问|正在维护|出错了|已过期|已被删除",
    re.I,
)
_HAN = re.compile("[\u4e00-\u9fff]")


def message_line(line: str) -> bool:
    """A message, filler or a line with open slots: what stands in an article's place or in its text, never a link."""
    t = line.strip()
    return bool(_MESSAGE.match(t) or _FILL.match(t)) or bool(slots_of(t))


def cue(line: str) -> bool:
    """A short line that says, in whatever words, that the page can't be had; not one that explains such a message."""
    t = line.strip()
    return len(t) <= 160 and bool(CUES.search(t)) and not EXPLAINS.search(t) and not t.lower().startswith(("if ", "when ", "wenn ", "si ", "cuando ", "如果"))


def prose_line(line: str) -> bool:
    """Running text: 50 characters, a Chinese one counting as three, and no code."""
    return len(line) + 2 * len(_HAN.findall(line)) >= 50 and not _CODE.match(line)


def latin(line: str) -> bool:
    """Most of a line of several words is filler vocabulary."""
    w = re.findall(r"[a-z]+", line.lower())
    return len(w) >= 5 and sum(x in LATIN for x in w) >= 0.7 * len(w)


def filled(line: str) -> bool:
    """Filler: a listed line, a line of filler vocabulary, or the same few words over and over."""
    t = line.strip()
    if _FILL.match(t) or latin(t):
        return True
    w = t.lower().split()
    return len(w) >= 6 and len(set(w)) <= 3 and all(map(str.isalpha, w))


def open_lines(lines: list[str], rows: list[int]) -> list[int]:
    """Rows with open slots.

    Code and sentences that explain the notation do not count; a line of slots alone is no code. Where the page
    shows or explains a kind of slot, it is a text about templates, and only slots with a field's name count of it.
    """
    found, shown = [], set()
    for i in rows:
        got = slots_of(lines[i])
        if got:
            bare = lines[i]
            for _, t, _ in got:
                bare = bare.replace(t, "\x00")
            code = any(map(str.isalpha, bare)) and _CODE.match(lines[i])
            if code or EXPLAINS.search(lines[i]) or _TELLS.search(bare):
                shown.update(k for k, _, _ in got)
            else:
                found.append((i, got))
    return [i for i, got in found if any(known or k not in shown for k, _, known in got)]


def judge(text: str | None) -> tuple[str, int, int, int]:
    """Kind of a page ('' for a proper one, else slots, filler or message) and its counts of each sort of hit.

    Slots and filler count on lines of the main body that are neither code nor an explanation; one is enough,
    for running text must have none. Messages count as whole lines, and only on a page whose main body has
    fewer than two lines of running text besides; ones in words that no list has only where hardly anything else stands.
    """
    from corpusloom.llm.wrappers import furniture_lines

    lines = (text or "").split("\n")
    rows = [i for i in range(1, len(lines)) if lines[i].strip()]
    slots = open_lines(lines, rows)
    filler = [i for i in rows if filled(lines[i])]
    said = [i for i in rows if _MESSAGE.match(lines[i].strip())]
    cues = [i for i in rows if cue(lines[i])] if not (slots or filler or said) else []
    if not (slots or filler or said or cues):
        return "", 0, 0, 0
    out = {n - 1 for n in furniture_lines(lines)}
    slots, filler, said, cues = ([i for i in x if i not in out] for x in (slots, filler, said, cues))
    hit = {*slots, *filler, *said, *cues}
    rest = [i for i in rows if i not in out and i not in hit]
    prose = sum(prose_line(lines[i]) for i in rest)
    if cues and prose == 0 and len(rest) <= 2:
        said = cues
    kind = "slots" if slots else "filler" if filler else "message" if said and prose < 2 else ""
    return kind, len(slots), len(filler), len(said)


def unfit_pages(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep``, kind, n_slots, n_filler, n_messages of every page; kind '' means fit. Null and empty texts are fit.

    Rows are judged one by one, so repeated rows and ties have no bearing.
    """
    small_batches(docs.sparkSession)
    src = docs.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            got = [judge(t) for t in p["_text"]]
            yield p.drop(columns="_text").assign(**{c: [g[i] for g in got] for i, c in enumerate(("kind", "n_slots", "n_filler", "n_messages"))})

    return src.mapInPandas(run, kinds + ", kind string, n_slots int, n_filler int, n_messages int")
