"""Problem 10: severity of abusive, hateful and sexual language, by cumulative-link ordinal regression.

A passage is a sentence. Its sparse features are words, word pairs, pairs of Chinese characters and how many words
of a few fixed lists it has, alone and next to an address. One weight vector is shared by the ordered thresholds:
P(grade > k) = s(w.x - c_k). The grades come from the reviewers: 0 not toxic, 1 toxic, 2 toxic and of quality 2 or
less; the expected severity is the sum of the two probabilities. Which passage of a toxic document is meant, and
which verdicts are wrong, is estimated along with the weights (expectation and maximisation, from one start that
leans weakly on the lists). A document takes the highest severity of its passages.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import small_batches

SAMPLE, SAMPLE_CHARS = 20_000, 100_000_000  # labelled documents that the weights are fitted on, at most, and their characters
THRESHOLD = 0.2  # expected severity from which a document is reported
GRADES = 2  # thresholds, one less than there are grades
SIGNIFICANT = 3.2  # standard deviations by which a feature must stand out in toxic documents
AGAINST = 3.0  # how much harder the weights of all other features are drawn towards nothing; none falls below -1
THIN = 8  # of the passages in the sample without an outstanding feature, one in this many is fitted on
MISSED, WRONG = 0.1, 0.03  # shares of toxic documents called harmless and of harmless ones called toxic that fitting allows for

# Words that insult a person, mean harm, are sexual, or demean a group, and words that address someone.
INSULT = set(
    "idiot idiots moron morons imbecile cretin dumbass asshole bastard bitch loser scumbag halfwit parasite pig clown trash garbage filth filthy dumb stupid worthless useless pathetic disgusting braindead retard retarded dickhead prick twat wanker fool jerk douchebag coward whore slut cunt "
    "crétin imbécile connard connasse ordure salaud abruti débile bouffon pute gueule imbécil basura idiota estúpido gilipollas cabrón puta mierda inútil pendejo dummer dumme trottel arschloch dreck schlampe hurensohn versager missgeburt klappe wertloses depp wichser".split()
)
HARM = set("kill die dead choke burn hell hang shoot stab strangle beat smash rape murder hurt destroy suffer bleed crever mueras muere stirb verreck casser romper matar tuer töten schlage umbringen fingers regret mothers kys suicide".split())
SEXUAL = set(
    "porn porno pornos porn0 xxx nude nudes naked horny sex sexy milf milfs tits boobs fuck fucked hardcore uncensored erotic moaned moaning orgasm cum blowjob cock dick pussy anal escort escorts hookup camgirl webcam amateur geile geil nackte nackt desnudas desnuda nues nue salope putas chicas filles cachonda knees begging".split()
)
DEMEAN = set("vermin rats animals subhuman disease plague filth cockroaches scum parasites savages inferior ungeziefer plaga vermine echarlos vertrieben kitchen breed deport".split())
SHUT = set("shut gueule klappe cállate verpiss crawl".split())
YOU = set("you your yours yourself u ur du dich dir dein deine tu te toi ton ta tes vous votre usted ti sus".split())

_WORD = re.compile(r"[^\W\d_\u4e00-\u9fff]+(?:['’][^\W\d_]+)?")
_SENT = re.compile(r"(?<=[.!?;。！？])\s+|\n+")
_SPACED = re.compile(r"(?<!\w)((?:[^\W\d_] ){2,}[^\W\d_])(?!\w)")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_ODD = re.compile(r"[^\W_]*[@$013457*!|](?:[^\W_]|[@$*!|])+|[^\W_]+[@$*]+")
_ZERO = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))
_ALIKE = str.maketrans("аеорсухіјѕкмтвнАЕОРСУХІЈКМТВНԁɡοαεν", "aeopcyxijskmtbhAEOPCYXIJKMTBHdgoaev")
_LEET = str.maketrans("@$013457!|", "asoieastil")
_HAN = re.compile("[\u4e00-\u9fff]+")


_ALL = {"INSULT": INSULT, "HARM": HARM, "SEXUAL": SEXUAL, "DEMEAN": DEMEAN, "SHUT": SHUT}
_LEXICON = INSULT | HARM | SEXUAL | DEMEAN | SHUT
_MASKED = re.compile(r"[^\W\d_]\*+[^\W\d_]")
_SIGNS = re.compile(r"[@$*!|]|[0-9][a-z]|[0-9](?<=[^\W\d_].)[^\W_]")
_UNSEEN = re.compile("[" + "".join(map(chr, _ZERO)) + "]")
_OTHER = re.compile("[\u0370-\u03ff\u0400-\u052f]")
LEAN = {"#INSULT": 0.5, "#HARM": 0.2, "#SEXUAL": 0.5, "#DEMEAN": 0.3, "#SHUT": 0.3, "#YOU+INSULT": 1.5, "#YOU+HARM": 0.5, "#2SEXUAL": 1.5, "#2INSULT": 1.0}  # what a start without verdicts leans on


def _plain(m: re.Match) -> str:
    """A word with signs for letters in plain letters; one with stars as the only listed words of its shape, if there are any."""
    w = m.group()
    if "*" in w:
        rx = re.compile(re.escape(w.lower()).replace(r"\*", "."))
        return next((x for x in sorted(_LEXICON) if len(x) == len(w) and rx.fullmatch(x)), w)
    d = w.translate(_LEET).lower()
    return d if d.isalpha() and len(d) >= 3 and any(c.isalpha() for c in w) else w


def normal(text: str) -> str:
    """Text with look-alike letters, spaced-out, drawn-out and disguised words written plainly; line ends stay as they are."""
    t = text
    if not t.isascii():
        t = _UNSEEN.sub("", unicodedata.normalize("NFC", t))
        if _OTHER.search(t) and re.search("[A-Za-z]", t):
            t = t.translate(_ALIKE)
    t = _LONG.sub(r"\1", _SPACED.sub(lambda m: m.group(1).replace(" ", ""), t))
    if not _SIGNS.search(t):
        return t
    return "\n".join(_ODD.sub(_plain, x) if _SIGNS.search(x) else x for x in t.split("\n"))


def sentences(text: str) -> list[tuple[str, str]]:
    """Passages as written and in plain form."""
    raw = [x for x in _SENT.split(text) if x and not x.isspace()]
    return list(zip(raw, normal("\n".join(raw)).split("\n"))) if raw else []


def listed(w: list[str], plain: str, raw: str) -> list[str]:
    """Features of the fixed lists, for the words of a passage that has a listed one."""
    s = set(w)
    n = {k: len(s & v) for k, v in _ALL.items()}
    out = ["#" + k for k, v in n.items() if v] + [f"#2{k}" for k in ("INSULT", "SEXUAL") if n[k] >= 2]
    if not s.isdisjoint(YOU):
        out += [f"#YOU+{k}" for k in ("INSULT", "HARM", "SEXUAL") if n[k]]
    if plain is not raw and plain != raw and not {x for x in s & _LEXICON} <= set(_WORD.findall(raw.lower())):
        out.append("#DISGUISED")
    return out


def features(plain: str, raw: str | None = None) -> list[str]:
    """Names of the distinct features of a passage in plain form; ``raw`` is how it was written."""
    low = plain.lower()
    w = _WORD.findall(low)
    out = dict.fromkeys(w)
    out |= dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:]))
    if not low.isascii():
        out |= dict.fromkeys(run[i : i + 2] for run in _HAN.findall(low) for i in range(len(run) - 1))
    if not _LEXICON.isdisjoint(w):
        out |= dict.fromkeys(listed(w, plain, plain if raw is None else raw))
    if "*" in low and _MASKED.search(low):
        out["#MASKED"] = None
    return list(out)


class Model:
    """Weights by feature name and the ordered thresholds. Every passage of a document is scored."""

    def __init__(self, weights: dict[str, float], cuts: list[float]) -> None:
        self.w, self.cuts = {f: v for f, v in weights.items() if abs(v) >= 0.02}, [float(c) for c in cuts]
        self.pairs: dict[str, dict[str, float]] = defaultdict(dict)
        for f, v in self.w.items():
            if " " in f:
                a, b = f.split(" ", 1)
                self.pairs[a][b] = v
        self.pairs, self.firsts = dict(self.pairs), frozenset(self.pairs)
        self.floor = self.severity(0.0)

    def severity(self, z: float) -> float:
        return sum(1 / (1 + math.exp(min(50.0, max(-50.0, c - z)))) for c in self.cuts)

    def score(self, plain: str, raw: str) -> float:
        """The sum of the weights of ``features(plain, raw)``."""
        low = plain.lower()
        words = _WORD.findall(low)
        get, pairs = self.w.get, self.pairs
        s = set(words)
        z = sum([get(x, 0.0) for x in s])
        if first := self.firsts & s:
            z += sum([pairs[a].get(b, 0.0) for a, b in {(a, b) for a, b in zip(words, words[1:]) if a in first}])
        if not low.isascii():
            z += sum(get(x, 0.0) for x in {run[i : i + 2] for run in _HAN.findall(low) for i in range(len(run) - 1)} - s)
        if not _LEXICON.isdisjoint(s):
            z += sum(get(x, 0.0) for x in listed(words, plain, raw))
        if "*" in low and _MASKED.search(low):
            z += get("#MASKED", 0.0)
        return z

    def document(self, text: str | None) -> tuple[float, str | None]:
        """Highest expected severity of a text's passages and the first passage that has it; (0, None) without words."""
        if not text or text.isspace():
            return 0.0, None
        best, worst = 0.0, None
        for raw, plain in sentences(text):
            if (z := self.score(plain, raw)) > best:
                best, worst = z, raw
        return self.severity(best), worst


def fit(texts: list[str], toxic: list[int], quality: list[int | None] | None = None, rounds: int = 4, steps: int = 60, pull: float = 1.0) -> Model:
    """Fit on document verdicts; without any toxic one the model is the weak start.

    A document called toxic is represented by its worst passage, every passage of one called harmless has grade 0;
    both are weighted by how likely the verdict is right under a model fitted on the other half of the documents. The
    first round takes verdicts at their word and finds worst passages by the features that toxic documents have
    significantly more often; only these and the lists' can speak for a grade, all others only against it. Passages
    without any of the former are thinned to one in ``THIN``, which then counts for as many.
    """
    start = np.array([3.0, 4.5])
    if not any(toxic):
        return Model(LEAN, start)
    y = np.array(toxic, dtype=bool)
    feats = [[features(p, r) for r, p in sentences(t)] for t in texts]
    hot, calm = Counter(), Counter()
    for p, bad in zip(feats, y):
        (hot if bad else calm).update({f for x in p for f in x})
    base = y.mean()
    sure = {f for f, n in hot.items() if n >= 3 and n - base * (n + calm[f]) >= SIGNIFICANT * math.sqrt(base * (n + calm[f]) + 0.5)} | LEAN.keys() | {"#MASKED", "#DISGUISED", "#YOU+SEXUAL"}
    doc, share, rows = [], [], []
    for i, p in enumerate(feats):
        for j, x in enumerate(p):
            if (has := not sure.isdisjoint(x)) or xxhash.xxh32_intdigest(f"{i} {j}") % THIN == 0:
                doc.append(i)
                share.append(1.0 if has else float(THIN))
                rows.append(x)
    seen = Counter(f for x in rows for f in x)
    names = [f for f, n in seen.items() if f in sure or n >= 3]
    at = {f: i for i, f in enumerate(names)}
    doc, share = np.array(doc, dtype=np.int64), np.array(share)
    ids = [[at[f] for f in x if f in at] for x in rows]
    r, c = np.repeat(np.arange(len(ids)), [len(x) for x in ids]), np.array([f for x in ids for f in x], dtype=np.int64)
    g = np.array([2 if q is not None and q <= 2 else 1 for q in (quality or [None] * len(texts))])
    w0 = np.array([LEAN.get(f, 0.0) for f in names])
    least = np.array([f in sure for f in names])
    odds = np.array([math.log((hot[f] + 0.2) / (y.sum() + 1)) - math.log((calm[f] + 2.0) / ((~y).sum() + 1)) if f in sure else 0.0 for f in names])
    half = np.array([xxhash.xxh32_intdigest(t) & 1 for t in texts])[doc] if len(doc) else np.zeros(0, np.int64)

    def solve(use: np.ndarray, grade: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = use[r]
        cr, rr = c[keep], r[keep]
        w, cuts = w0.copy(), start.copy()
        m, s, b, q = np.zeros_like(w), np.zeros_like(w), np.zeros(GRADES), np.zeros(GRADES)
        above = grade[:, None] > np.arange(GRADES)[None, :]
        for t in range(1, steps + 1):
            z = np.bincount(rr, w[cr], len(ids))
            e = (1 / (1 + np.exp(cuts[None, :] - z[:, None])) - above) * (weight * use)[:, None]
            d, k = np.bincount(cr, e.sum(axis=1)[rr], len(w)) + np.where(least, pull, AGAINST * pull) * (w - w0), -e.sum(axis=0)
            m, s, b, q = 0.9 * m + 0.1 * d, 0.99 * s + 0.01 * d * d, 0.9 * b + 0.1 * k, 0.99 * q + 0.01 * k * k
            w = w - 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-6)
            w = np.where(least, w, np.clip(w, -1.0, 0.0))
            cuts = np.sort(cuts - 0.15 * (b / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.99**t)) + 1e-6))
        return w, cuts

    z = np.bincount(r, w0[c] + np.maximum(0.0, odds)[c], len(ids))
    p = None
    for turn in range(rounds):
        order = np.lexsort((-z, doc))
        top = order[np.r_[True, doc[order][1:] != doc[order][:-1]]] if len(order) else order
        worst = top[y[doc[top]]]
        use, grade, weight = ~y[doc], np.zeros(len(ids), np.int64), share.copy()
        use[worst], grade[worst], weight[worst] = True, g[doc[worst]], 1.0
        if p is not None:
            weight[worst] = p[worst] * (1 - MISSED) / (p[worst] * (1 - MISSED) + (1 - p[worst]) * WRONG + 1e-12)
            weight[~y[doc]] *= ((1 - p) * (1 - WRONG) / ((1 - p) * (1 - WRONG) + p * MISSED + 1e-12))[~y[doc]]
        if turn == rounds - 1:
            w, cuts = solve(use, grade, weight)
            break
        z, p = np.zeros(len(ids)), np.zeros(len(ids))
        for h in (0, 1):
            w, cuts = solve(use & (half == h), grade, weight)
            other = half != h
            z[other] = np.bincount(r, w[c], len(ids))[other]
            p[other] = 1 / (1 + np.exp(cuts[0] - z[other]))
    return Model({**{k: v for k, v in LEAN.items() if k not in at}, **dict(zip(names, w.tolist()))}, cuts)


def train(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: str, quality: str | None = None) -> Model:
    """Fit on at most ``SAMPLE`` labelled documents of at most ``SAMPLE_CHARS`` characters together, the first by the hash of
    their id; null verdicts and texts are left out."""
    q = F.col(quality).cast("int") if quality else F.lit(None).cast("int")
    lab = labels.select(F.col(doc_id).alias("id"), F.col(toxic).alias("y"), q.alias("q")).filter("id IS NOT NULL AND y IS NOT NULL")
    lab = lab.withColumn("h", F.xxhash64("id"))
    low = lab.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    if low is None:
        return fit([], [])
    few = lab.filter(F.col("h") <= low).orderBy("h", "y", "q").limit(SAMPLE)
    src = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).filter(F.length("t") > 0).join(F.broadcast(few), "id")  # few has at most SAMPLE rows
    total, last = 0, None
    for r in src.select("h", F.length("t").alias("n")).orderBy("h", "n").limit(SAMPLE).collect():  # numbers
        total += r.n
        if total > SAMPLE_CHARS:
            break
        last = r.h
    if last is None:
        return fit([], [])
    rows = src.filter(F.col("h") <= last).orderBy("h", "t", "y", "q").limit(SAMPLE).collect()
    return fit([r.t for r in rows], [int(r.y > 0) for r in rows], [r.q for r in rows])


def score(docs: DataFrame, model: Model, keep: list[str], text: str) -> DataFrame:
    """``keep``, severity (0 to 2) and worst_passage of every document; null, empty and blank texts score 0."""
    spark = docs.sparkSession
    small_batches(spark)
    w, cuts = model.w, model.cuts  # bounded by the sample
    src = docs.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(w, cuts)
        for p in batches:
            got = [m.document(t) for t in p["_text"]]
            yield p.drop(columns="_text").assign(severity=[g[0] for g in got], worst_passage=[g[1] for g in got])

    return src.mapInPandas(run, kinds + ", severity double, worst_passage string")


def rates(scored: DataFrame, source: str, threshold: float = THRESHOLD) -> DataFrame:
    """Share of reported documents and mean severity for each source; null and blank sources are one, ''."""
    s = F.coalesce(F.lower(F.trim(source)), F.lit(""))
    hit = F.when(F.col("severity") >= threshold, 1).otherwise(0)
    return scored.groupBy(s.alias("source")).agg(F.count("*").alias("docs"), F.sum(hit).alias("found"), F.avg(hit).alias("rate"), F.avg("severity").alias("mean_severity"))
