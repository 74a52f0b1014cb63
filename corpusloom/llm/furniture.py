"""Wordings of page furniture, page messages and generic headings, in five languages.

The lists are fixed values of public web wording: what menus, consent texts, share prompts, legal lines and
error pages say. ``kind`` tells what a single line is by its wording alone; ``wrappers`` adds what a site's
pages have in common.
"""

from __future__ import annotations

import re

# Words of site menus.
MENU = """
docs forum blog careers status partners support tutorials download login showcase community press guides pricing
security events api home examples about store changelog roadmap contact help news terms privacy imprint menu
doku anmelden sicherheit preise presse neuigkeiten start partner kontakt beispiele hilfe karriere über uns gemeinschaft
accueil actualités aide connexion contact équipe exemples tarifs sécurité communauté documentation
ayuda contacto ejemplos entrar equipo foro inicio novedades precios prensa seguridad documentación comunidad
文档 登录 示例 帮助 动态 社区 价格 联系 首页 博客 安全 关于 下载 支持 论坛 教程 团队 新闻 媒体 定价
""".split()
PRODUCT = r"[^\W\d_]\w+ (?:core|studio|enterprise|cloud)"

# Labels that open a list of the page's own headings, and labels that open a list of other pages.
TOC_LABELS = "contents|table of contents|on this page|in this article|jump to|sur cette page|sommaire|en esta página|contenido|auf dieser seite|inhalt|本页内容|目录|本页目录"
RELATED_LABELS = "read next|related articles|related pages|you may also like|popular pages|see also|à lire aussi|articles liés|ver también|también le puede interesar|ähnliche seiten|siehe auch|das könnte sie auch interessieren|相关文章|相关页面|延伸阅读|猜你喜欢"

# Whole lines of furniture.
LINES = r"""
search docs|menu|loading…|expand all|toggle theme|skip to main content|back to top|edit this page|suggest a change|copy link|copy|share this page
print this page|send as e-mail|sign in|star us|book a demo|version [\d.]+ \(latest\)|english deutsch français.*|advertisement|anzeige|publicité|publicidad|广告
accessibility statement|report a vulnerability|privacy policy|cookie settings|do not sell my personal information|terms of use · privacy · imprint|terms of use
this website would like to remember your preferences between visits\. ok, got it|by browsing on you agree to our use of cookies\.|accept cookies|only necessary( \| all \| let me choose)?
we use cookies to keep you signed in and to count visits\. choose which ones .+ may set\.|your privacy matters to .+\. some cookies are needed, others are up to you\.
to measure how pages perform we place analytics identifiers in your browser; withdraw consent at any time in the footer\.|.+ and \d+ partners store small files on your device\. accept all / reject / manage choices
was this page helpful\? yes no|rate this article: [\d ]+|thanks for your feedback|report an issue with this page|still stuck\? ask in the .+ forum
found this useful\? pass it on to a colleague|share: mail · link · feed|tell a friend about .+|follow .+ for updates|\d+ people shared this
subscribe to our newsletter|no spam, unsubscribe whenever you like|join \d+ readers of the .+ letter|get .+ news in your inbox every month\. enter your e-mail subscribe
last modified .{6,20} \(\d+ revisions\)|last updated: .{4,20}|updated [\w /.-]{6,20}|published on .{6,20} — \d+ min read|(?-i:[A-ZÀ-Ý][\w'’-]* [A-ZÀ-Ý][\w'’-]*) · \d+ min read|posted by .+ on .{6,20}|(by|written by|author:|von|par|por|autor:|auteur :|autora:|geschrieben von|écrit par|escrito por) (?-i:[A-ZÀ-Ý]\w+ [A-ZÀ-Ý]\w+)
\w+ \w+, \d{4}-\d{2}-\d{2}|\w+ \w+, \d{1,2}/\d{1,2}/\d{4}|(?-i:[A-ZÀ-Ý]\w+ [A-ZÀ-Ý]\w+), \d{1,2} \w+ \d{4}
sponsored: .+ hosting from \d+ cents an hour|save \d+% on .+ plans until sunday|ad · .+: backups that just work|hiring: .+ is looking for engineers who like .+|.+ cloud — deploy a .+ cluster in minutes\. try it free|webinar: how .+ runs \d+ .+ nodes\. reserve a seat|start a free \d+-day trial of .+ cloud
© [\d–-]+ .+|copyright .+ contributors, text under the site licence|made with care by .+|.+ is a registered mark of its owner\. other names belong to their holders\.
nothing on this site is legal or financial advice; .+ accepts no liability for damage arising from its use\.
(a project of .+ and friends|.+ belongs to the .+ group|the .+ foundation keeps .+ alive|.+ is run by the .+ association)\. .*
aviso legal|privacidad|confidentialité|mentions légales|puede cambiar su elección cuando quiera al pie de la página\.|solo las necesarias|copiar enlace|editar esta página|vos choix peuvent être modifiés à tout moment en bas de page\.
compartido \d+ veces|cette page vous a-t-elle aidé ? ?\? oui non|mit der weiteren nutzung stimmen sie der speicherung zu\.|continuer sans accepter|.+ no responde de los daños derivados del uso\.|link kopieren|modifier cette page|datenschutz|partager cette page|partagé \d+ fois|copier le lien
.+ usa cookies para contar visitas\. aceptar todo o elegir\.|使用条款|compartir esta página|impressum|war diese seite hilfreich\? ja nein|¿le ha servido esta página\? sí no|.+ décline toute responsabilité en cas de dommage\.|\d+ mal geteilt|编辑本页|本页对您有帮助吗？ 是 否|seite teilen|隐私政策|分享本页|复制链接
.+ utilise des cookies pour mesurer les visites\. tout accepter ou choisir\.|nur notwendige cookies zulassen|.+ setzt cookies ein, um besuche zu zählen\. alle annehmen oder auswahl treffen\.|alle angaben ohne gewähr; .+ haftet nicht für schäden\.|.+使用cookie统计访问量，请选择是否同意。|仅接受必要项|seite bearbeiten
previous: .+|next: .+|zurück: .+|weiter: .+|précédent : .+|suivant : .+|anterior: .+|siguiente: .+
"""

# Headings that many articles share; they belong to the article.
HEADINGS = set(
    "background|requirements|limitations|summary|next steps|known issues|before you begin|overview|cleaning up|introduction|prerequisites|example|examples of use|troubleshooting|notes|conclusion|usage|see below"
    "|présentation|prérequis|limites|résumé|étapes suivantes|problèmes connus|avant de commencer|contexte|nettoyage"
    "|resumen|requisitos|límites|limitaciones|próximos pasos|problemas conocidos|antes de empezar|descripción general|visión general|limpieza|introducción"
    "|überblick|voraussetzungen|grenzen|einschränkungen|zusammenfassung|nächste schritte|bekannte probleme|bevor sie beginnen|hintergrund|aufräumen|einleitung"
    "|概述|前提|背景|要求|限制|摘要|后续步骤|已知问题|准备工作|总结|前提条件|清理".split("|")
)

_LINE = re.compile("^(?:" + "|".join(LINES.strip().split("\n")) + ")$", re.I)
_MENU = set(MENU)
_PRODUCT = re.compile(PRODUCT, re.I)
TOC = re.compile(f"^(?:{TOC_LABELS})[:：]?$", re.I)
RELATED = re.compile(f"^(?:{RELATED_LABELS})[:：]?$", re.I)
_COUNTER = re.compile(r"\s*\(\d+\)$")
_CRUMB = re.compile(r" [/›>»] ")
_CRUMBS = (" / ", " › ", " > ", " » ")
_PARTS = re.compile(r"[\s·|›»/•,]+")


def bare(line: str) -> str:
    """A line without list arrows at its ends, a counter in brackets and doubled blanks; its own end marks stay."""
    t = " ".join(line.split()).strip("»›«‹▸→ ")
    return _COUNTER.sub("", t) if t.endswith(")") else t


def plain(line: str) -> str:
    """As ``bare``, without end marks."""
    t = bare(line).rstrip(" .!›»")
    return _COUNTER.sub("", t) if t.endswith(")") else t


def menu_line(text: str) -> bool:
    """All entries of a line are menu words or product names."""
    low = text.strip(" ·|›»/•,-").lower()
    if not low:
        return False
    product = any(x in low for x in (" core", " studio", " enterprise", " cloud"))
    if not product and _PARTS.split(low, maxsplit=1)[0] not in _MENU:
        return False
    return all(w in _MENU for w in _PARTS.split(_PRODUCT.sub(" ", low) if product else low) if w)


def crumb_line(text: str) -> bool:
    """A path of at least three parts that begins in the site's menu."""
    if not any(x in text for x in _CRUMBS):
        return False
    parts = _CRUMB.split(text)
    return len(parts) >= 3 and parts[0].strip().lower() in _MENU


def worded(line: str, text: str | None = None) -> bool:
    """The line's own wording makes it furniture; ``text`` is its plain form if that is known."""
    t = plain(line) if text is None else text
    if not t:
        return False
    return bool(_LINE.match(t) or _LINE.match(t + ".") or TOC.match(t) or RELATED.match(t)) or menu_line(t) or crumb_line(t)


def heading(line: str, text: str | None = None) -> bool:
    return (plain(line) if text is None else text).lower().rstrip(":：") in HEADINGS
