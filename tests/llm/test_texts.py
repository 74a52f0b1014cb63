"""Problems 1, 2, 6, 8, 9 and 10 on small fixtures, with edge cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import markup, messages, mixing, packing, severity, tokens, wrappers

# ---------------------------------------------------------------- main bodies


def site_page(i):
    names = "amber birch cedar dahlia elder fir grape hazel iris juniper".split()
    word = lambda j: "".join(chr(97 + (i * 7919 + j * 104729) // 26**k % 26) for k in range(5))
    prose = [f"The {word(3 * j)} unit keeps {word(3 * j + 1)} entries for {word(3 * j + 2)} and says so at some length." for j in range(3)]
    body = [f"Page about {names[i // 10]} {names[i % 10]}", "Zork portal", "Quux arena", "Blip corner", f"Home / Docs / Page about {names[i // 10]} {names[i % 10]}", "On this page", f"Part {names[i % 10]} {names[i // 10]} first", *prose[:1], f"Part {names[i % 10]} {names[i // 10]} first", *prose[1:]]
    if i % 3 == 0:
        body.insert(3, "Glorp of the day")
    return "\n".join([*body, "Related articles", f"Guide to {names[(i + 3) % 10]} {names[i // 10]}", f"Manual on {names[(i + 1) % 10]} {names[i // 10]}", "Snarf society legal notice holds", "Privacy policy"])


def test_wrapper_finds_the_sites_own_furniture(spark):
    rows = [(i, f"https://a.test/{i}", site_page(i), "x") for i in range(40)] + [(100, "https://a.test/n", None, "x"), (101, "https://a.test/e", "", "x"), (102, None, "t\nSome words here.", "x"), (103, "https://a.test/0", site_page(0), "x")]
    df = spark.createDataFrame(rows, "id int, url string, content string, site string")
    got = {}
    for r in wrappers.furniture(df, "id", "content", "url", markup=False).collect():
        got.setdefault(r.row_id, set()).add(r.line_no)
    for i in range(40):
        lines = site_page(i).split("\n")
        want = {n for n, x in enumerate(lines, 1) if x in ("Zork portal", "Quux arena", "Blip corner", "Glorp of the day", "On this page", "Related articles", "Snarf society legal notice holds", "Privacy policy") or x.startswith(("Home /", "Guide ", "Manual "))}
        want.add(next(n for n, x in enumerate(lines, 1) if x.startswith("Part ")))
        assert got[i] == want, (i, got[i] ^ want)
    assert not got.keys() & {100, 101, 102} and got[103] == got[0]
    body = {r.row_id: r.text for r in wrappers.main_body(df, "id", "content", wrappers.furniture(df, "id", "content", "url", False)).collect()}
    assert body[100] is None and "Zork" not in body[1]
    assert wrappers.furniture(df.limit(0), "id", "content", "url", False).count() == 0


def test_wrapper_alignment():
    w = wrappers.Wrapper()
    for s in ([1, 2, 0, 9], [1, 3, 0, 0, 9], [1, 2, 3, 0, 9, 9], [3, 1, 0, 9]):
        w.add_page(s, {1, 2, 3, 9})
    assert w.order.index(1) < w.order.index(2) and w.order[-1] == 9 and w.pages == 4
    assert w.stat[9][2] == 1 and w.stat[1][0] + w.stat[1][1] == 4
    half = wrappers.Wrapper()
    half.add_page([1, 2, 9], {1, 2, 9})
    half.merge(w.order, [w.stat[t] for t in w.order], w.pages)
    assert half.pages == 5 and half.stat[1][0] + half.stat[1][1] == 5


NONSENSE = [f"{a}{b}" for a in ("zork", "quux", "blip", "glor", "snar", "frim", "wug", "tosk") for b in ("ant", "ible", "oon", "esk", "ury")]


def strange_site(g, site, n):
    """Pages of a site whose furniture has wordings that no list knows, and the numbers of its furniture lines."""
    w = lambda k: " ".join(g.choice(NONSENSE) for _ in range(k)).capitalize()
    menu, consent, foot = [w(2) + "." for _ in range(8)], [w(9) + "." for _ in range(3)], [w(4) + "." for _ in range(5)]  # no titles: runs of titles give nothing away
    toc, more, by = w(3), w(3), w(1)
    out = []
    for i in range(n):
        word = lambda: "".join(g.choice("bcdfghklmnprst") + g.choice("aeiou") for _ in range(3))
        head = lambda: f"The {word()} of {word().capitalize()}"
        prose = lambda: f"Every {word()} keeps {word()} entries for the {word()}, and {word()} says so at some length."
        parts = [head() for _ in range(2)]
        lines = [(head(), 0), *[(x, 1) for x in g.sample(menu, g.randint(4, 8))], (g.choice(consent), 1), (toc, 1), *[(x, 1) for x in parts], (prose(), 0)]
        lines += [(f"{by}: {word().capitalize()} {word().capitalize()}", 1)] if i % 2 else []
        for x in parts:
            lines += [(x, 0), *[(prose(), 0) for _ in range(g.randint(1, 4))]]
        lines += [(more, 1), *[(head(), 1) for _ in range(g.randint(2, 4))], *[(x, 1) for x in g.sample(foot, g.randint(2, 5))]]
        out.append((f"https://{site}.test/{i}", "\n".join(x for x, _ in lines), {k for k, (_, f) in enumerate(lines, 1) if f}))
    return out


def test_wrapper_alone_on_unseen_wordings(spark, monkeypatch):
    g = random.Random(8)
    rows = [(i, *x) for i, x in enumerate([*strange_site(g, "big", 90), *strange_site(g, "small", 30)])]
    want = {(i, n) for i, _, _, lines in rows for n in lines}
    lists = {(i, n) for i, _, t, _ in rows for n, x in enumerate(t.split("\n"), 1) if wrappers.U.worded(x)}
    assert not lists & want
    alone = {(i, n) for i, _, t, _ in rows for n in wrappers.furniture_lines(t.split("\n"), None)}
    monkeypatch.setattr(wrappers, "PART", 12)  # several parts a site, aligned with each other in more than one step
    monkeypatch.setattr(wrappers, "FAN", 2)
    df = spark.createDataFrame([(i, u, t) for i, u, t, _ in rows], "id int, url string, content string")
    got = {tuple(r) for r in wrappers.furniture(df, "id", "content", "url", markup=False).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.98 * len(got)
    assert len(alone & want) < 0.6 * len(want)  # what a page tells by itself: lists of headings and links


def test_masked_tokens():
    m = wrappers.mask_token
    assert m("Author: Ada Lovelace") == m("Author: Alan Turing") != 0
    assert m("Ada Lovelace, 2021-02-03") == m("Alan Turing, 1999-12-31") != 0
    assert m("Install Pridhas from the line") == m("Some words") == m("Version 1.2.3") == 0 and wrappers.token("a") & 1 == 0


def test_markup_lines():
    page = '<article>\n<h1>A title</h1>\n<p>By Ada Lovelace</p>\n<p>Some text that goes on for a while.</p>\n<ul>\n<li><a href="/x">Edit this page</a></li>\n</ul>\n</article>'
    assert wrappers.furniture_lines(page.split("\n"), None, True) == [3, 6]


# ---------------------------------------------------------------- markup

RESIDUE = [
    ("<p>plain words, C:\\Users\\bin and 5$ to 6$ or a == b</p>", set()),
    ("<p>## A heading</p>", {"markdown"}), ("<p>see **this** now</p>", {"markdown"}), ("<p>&lt;https://a.test/x&gt;</p>", {"markdown"}), ("```\n# x\n```", {"markdown"}), ("<p>- [x] done</p>", {"markdown"}),
    ("<p>== Heading ==</p>", {"wiki"}), ("<p>the ''slanted'' one</p>", {"wiki"}), ("<p>[[File:a.png|thumb|b]]</p>", {"wiki"}), ("<p>x&lt;ref&gt;y&lt;/ref&gt;</p>", {"wiki"}), ("<p>{| class=\"wikitable\"\n|-\n| a\n|}</p>", {"wiki"}),
    ("<p>\\textbf{x}</p>", {"latex"}), ("<p>load $a_1 = 2$ here</p>", {"latex"}), ("<p>\\begin{verbatim}\n**x**\n\\end{verbatim}</p>", {"latex"}),
    ("<p>&lt;strong&gt;x&lt;/strong&gt;</p>", {"html"}), ("<p>\\u003cp\\u003ex</p>", {"html"}), ("<p>&amp;lt;em&amp;gt;x</p>", {"html"}), ("<p>Replace &lt;name&gt; now</p>", set()),
    ("<pre>## x\n**y** $$z$$ \\item &lt;p&gt;</pre><p>a <code>`b`</code></p>", set()), ("<p>Option -x == option -y, * any</p>", set()), ("<math><mi>a</mi></math>", set()), ("", set()),
]


@pytest.mark.parametrize("source, want", RESIDUE)
def test_residue(source, want):
    assert markup.residue(source) == want


def test_plain_text():
    s = "<h1>T &amp; U</h1><ul><li>one</li><li><b>two</b></li></ul><pre><code>a &lt; b\n  c</code></pre><table><tr><th>k</th><th>v</th></tr></table><p>run <code>x</code>, $e=mc^2$</p>"
    assert markup.plain_text(s) == "# T & U\n- one\n- two\n```\na < b\n  c\n```\nk | v\nrun `x`, $e=mc^2$"
    assert markup.plain_text("== H ==\n* [[a|b]]\n\\section{S}\n\\item x\n[t](http://u) **b**\n&lt;p&gt;esc&lt;/p&gt;") == "## H\n- b\n## S\n- x\nt b\nesc"
    assert markup.plain_text("") == ""


def test_region_is_the_best_run():
    w = {"": 1.0, "<a": -3.0, "</a": -3.0, "<": -0.5}
    s = '<a href="/1">one</a> <a href="/2">two</a> the body of the page has many words <a href="/3">three</a> and more words come here <a href="/4">x</a><a href="/5">y</a>'
    a, b = markup.region(s, w)
    score = lambda x: sum(markup.scores(markup.tokens(x), w))
    ts = markup.tokens(s)
    best = max(score(s[ts[i][1] : ts[j][2]]) for i, j in itertools.combinations_with_replacement(range(len(ts)), 2))
    assert score(s[a:b]) == pytest.approx(best) and s[a:b].startswith("the body")
    assert markup.region("only words here", w) == (0, 15)


def test_content_of_labelled_pages(spark):
    """Weights learnt from a site's own pages: furniture in words that no list knows goes, headings and text stay."""
    g, rows, want = random.Random(4), [], {}
    word = lambda: "".join(g.choice("bcdfghklmnprst") + g.choice("aeiou") for _ in range(3))
    for i in range(60):
        body = [f"<h1>The {word()} of {word()}</h1>", *[x for k in range(3) for x in (f"<h2>Keeping {word()}</h2>", f"<p>Every {word()} keeps its {word()} entries, and the {word()} says so in its own words.</p>", f"<ul>\n<li>the {word()} unit</li>\n</ul>")], "<pre><code>Zork = blip\n</code></pre>"]
        page = ['<div><a href="/a">Zork blip</a></div>', '<div><a href="/b">Quux glorp snarf</a></div>', *body, '<div><a href="/c">Snarf wibble zork</a></div>', "<p>Frobnitz quux wibble, glorp snarf blip.</p>"]
        rows.append((i, f"https://a.test/{i}", "\n".join(page)))
        want[i] = markup.plain_text("\n".join(body))
    df = spark.createDataFrame(rows, "page_id int, url string, article_html string")
    got = {r.row_id: r.text for r in markup.convert(df, "page_id", "article_html", "url").collect()}
    lines = [(x, i) for i, t in want.items() for x in t.split("\n")]
    assert sum(x in got[i].split("\n") for x, i in lines) >= 0.998 * len(lines)
    assert sum(any(w in x for w in ("Quux", "Snarf", "Frobnitz")) for t in got.values() for x in t.split("\n")) <= 0.05 * 3 * len(rows)


def test_convert(spark):
    df = spark.createDataFrame([(1, "<p>## x</p>", "t"), (2, None, "t"), (3, "", "t"), (1, "<p>## x</p>", "t"), (4, "<p>" + "word " * 200_000 + "</p>", "t")], "page_id int, article_html string, text string")
    got = sorted(((r.row_id, r.text, tuple(r.markup)) for r in markup.convert(df, "page_id", "article_html").collect()), key=str)
    assert got[0] == got[1] == (1, "## x", ("markdown",)) and got[2] == (2, None, ()) and got[3] == (3, "", ()) and len(got[4][1]) == 999_999
    assert markup.convert(df.limit(0), "page_id", "article_html").count() == 0


# ---------------------------------------------------------------- messages

PROSE = "\n".join(f"This is sentence number {i} of a proper article, and it goes on for quite a while." for i in range(4))
PAGES = [
    ("T\nPage not found", "message"), ("T\n{{ order_total }} is due.", "slots"), ("T\nDear {{firstName}}, welcome.\n" + PROSE, "slots"), ("T\n[Company Name] is a leader in its field.", "slots"), ("T\n__PAGE__: __date__\n" + PROSE, "slots"), ("T\nHTTP 410 Gone", "message"), ("T\nPlease disable your ad blocker to continue", "message"), ("T\nDiese Seite ist derzeit nicht erreichbar.", "message"),
    ("T\nUse {{ release }} for the name, and {{ chart }} is replaced by its path.\nThen {{ chart }} comes first.\n" + PROSE, ""), ("T\nThe module sets __name__ and [see the notes](x) or [Notes][1].\n" + PROSE, ""), ("T\nThe path is /api/{user_id}/items.\n" + PROSE, ""), ("T\nIf access is denied, the service answers with a code.", ""), ("T\ntext text text text text text", "filler"), ("T\n" + "ab12 cd34 " * 30, ""),
    ("T\nHome\nPlease enable JavaScript to view this site.\nPrivacy policy", "message"), ("T\n" + PROSE + "\n502 Bad Gateway", ""), ("T\n502 Bad Gateway\nThe upstream server did not answer in time.", "message"),
    ("T\nThe gateway answers 502 Bad Gateway while it warms up, so retry the call.\n" + PROSE, ""),
    ("T\nDear {{ customer.title }}, thank you for choosing us!\n" + PROSE, "slots"), ("T\nWelcome to [Your company], the best.", "slots"), ("T\nXXX-date-XXX: <%= intro %>", "slots"), ("T\nIn the template, {% block title %} marks the place where the page adds it.\n" + PROSE, ""), ("T\nWrite {{ .Values.name }} in the chart.\n" + PROSE, ""), ("T\n" + PROSE + '\nprint("${name}");', ""),
    ("T\nLorem ipsum dolor sit amet, consectetur elit.\n" + PROSE, "filler"), ("T\nDesigners often put lorem ipsum into a mock-up; the linter flags it.\n" + PROSE, ""), ("T\n" + PROSE + "\nTODO: write this section", "filler"), ("T\nSearch the code for TODO marks near x and for TBD in y.\n" + PROSE, ""),
    ("{{ title }}\n" + PROSE, ""), ("T\nHome\nDocs\nPrivacy policy", ""), (None, ""), ("", ""),
]


@pytest.mark.parametrize("text, want", PAGES)
def test_judge(text, want):
    assert messages.judge(text)[0] == want


def test_unfit_pages(spark):
    df = spark.createDataFrame([(i, t, "k") for i, (t, _) in enumerate(PAGES)], "id int, content string, kind2 string")
    got = {r.id: r.kind for r in messages.unfit_pages(df, "content", ["id"]).collect()}
    assert got == {i: k for i, (_, k) in enumerate(PAGES)}


# ---------------------------------------------------------------- packing


def test_pack_is_valid_and_near_optimal():
    g = random.Random(9)
    for _ in range(30):
        sizes = np.array([g.randint(0, 100) for _ in range(g.randint(0, 60))], dtype=np.int64)
        bins = packing.pack(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sizes[b].sum() <= 100 for b in bins)
        assert len(bins) <= 11 / 9 * max(1, -(-int(sizes.sum()) // 100)) + 8


def test_local_search():
    sizes = np.array([50, 50, 30, 30, 20, 20])
    assert len(packing.improve(sizes, [[0, 2], [1, 3], [4, 5]], 100)) == 2  # moves
    sizes = np.array([50, 25, 15, 60, 40, 10])
    better = packing.improve(sizes, [[0, 1, 2], [3], [4, 5]], 100)  # 90, 60, 50 of 200
    assert len(better) == 2
    square = lambda bins, z: sum(int(z[b].sum()) ** 2 for b in bins)
    assert square(better, sizes) > square([[0, 1, 2], [3], [4, 5]], sizes)
    g = random.Random(3)
    for _ in range(40):
        sizes = np.array([g.randint(1, 60) for _ in range(40)])
        poor = [[i] for i in range(40)]
        got = packing.improve(sizes, [list(b) for b in poor], 100)
        assert sorted(i for b in got for i in b) == list(range(40)) and all(sizes[b].sum() <= 100 for b in got)
        assert square(got, sizes) >= square(poor, sizes) and len(got) <= -(-int(sizes.sum()) // 100) + 3


def test_containers(spark):
    df = spark.createDataFrame([(1, 5, "c"), (2, 23, "c"), (3, 0, "c"), (4, None, "c"), (5, 10, "c"), (5, 10, "c")], "doc_id bigint, n_tokens bigint, container string")
    p = packing.containers(df, "doc_id", "n_tokens", {"a": 10, "b": 100})
    fills = {(r.limit_name, r.container): r.t for r in p.groupBy("limit_name", "container").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("t")).collect()}
    assert all(t <= {"a": 10, "b": 100}[n] for (n, _), t in fills.items())
    spans = sorted((r.token_from, r.token_to) for r in p.filter("limit_name = 'a' AND doc_id = 2").collect())
    assert spans == [(0, 10), (10, 20), (20, 23)]
    assert p.filter("doc_id = 4").count() == 0 and p.filter("doc_id = 5 AND limit_name = 'b'").count() == 2
    assert packing.fill(p, {"a": 10, "b": 100}).filter("limit_name = 'a'").first().containers == 5
    assert packing.containers(df.limit(0), "doc_id", "n_tokens", {"a": 10}).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "id int, t string")
    got = {r.id: r.n_tokens for r in tokens.with_counts(df, ["id"], "t").collect()}
    assert got[1] == 2 and got[2] == 0 and 3 not in got and got[4] > 1


# ---------------------------------------------------------------- mixing


def test_permutation():
    for n in (1, 2, 3, 17, 256, 1000):
        x = mixing.permute(np.arange(n), n, 3)
        assert sorted(x.tolist()) == list(range(n))
        assert n < 100 or (x != np.arange(n)).mean() > 0.9


def test_plan_keeps_caps():
    blocks, share, cap = {"a": 100, "b": 40, "c": 7, "none": 0}, {"a": 0.6, "b": 0.3, "c": 0.05, "none": 0.05}, {"a": 1, "b": 2, "c": 3, "none": 5}
    drawn, names = mixing.plan(blocks, share, cap)
    assert names == ["a", "b", "c"] and all(drawn[:, i].sum() <= blocks[s] * cap[s] for i, s in enumerate(names))
    assert drawn.sum() > 0.7 * min(blocks[s] * cap[s] / (share[s] / 0.95) for s in names)
    assert mixing.plan({}, share, cap)[1] == []


def test_mix(spark):
    g = random.Random(1)
    rows = [(i, g.choice(["A ", "a", "b", "B", "c", None]), g.randint(0, 900)) for i in range(600)] + [(999, "a", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.4, 2), ("z", 0.1, 3)], "source string, target_share double, max_repeats int")
    m = mixing.mix(df, "doc_id", F.col("source"), "n_tokens", t, block=64).cache()
    have = m.collect()
    size = {i: n for i, _, n in rows}
    assert all(0 <= r.token_from < r.token_to <= size[r.doc_id] for r in have)
    assert all((rows[r.doc_id][1] or "").strip().lower() == r.source for r in have)
    assert max(r.pass_no for r in have) <= 2
    used = m.groupBy("source", "block", "pass_no", "doc_id", "token_from").count()
    assert used.filter("count > 1").count() == 0
    slots = m.select("shard", "slot", "source").distinct()
    assert slots.count() == m.select("shard", "slot").distinct().count()
    s = {r.source: r for r in mixing.shares(m, t).collect()}
    assert abs(s["a"].actual_share - 5 / 9) < 0.03 and abs(s["b"].actual_share - 4 / 9) < 0.03 and s["z"].tokens == 0
    assert mixing.mix(df.limit(0), "doc_id", F.col("source"), "n_tokens", t).count() == 0


# ---------------------------------------------------------------- severity

ABUSE = ["You are a worthless moron and everyone here knows it.", "Go to hell, you {x}.", "Shut up, you scumbag.", "I hope you choke on it, idiot.", "Free xxx videos: hardcore sex, click here.", "They are vermin and should be driven out.", "Du bist ein dummer Idiot, halt die Klappe.", "你是垃圾，去死吧。", "Listen here, you utter snollygoster."]
CALM = ["Kill the zombie process before its parent exits.", "This stupid bug cost me two days, damn it.", "Essex is a valid place name.", "Our rules: calling others an idiot, or posting porn, leads to a ban.", "The dataset covers sex education leaflets.", "Point the naked domain at the cache.", "The master never beats the slave index.", "Shut the horny toad simulator down first.", "修改证书之后，需要重新加载。"]


def verdicts(n, seed):
    """Documents of plain lines, some with a decoy, some with an abusive line, and verdicts of which some are wrong."""
    g, out = random.Random(seed), []
    plain = lambda: f"The {g.choice(WORDS)} unit copies {g.choice(WORDS)} tables for {g.choice(WORDS)} at night."
    for _ in range(n):
        lines, bad = [plain() for _ in range(g.randint(1, 6))], g.random() < 0.2
        if bad:
            lines.insert(g.randint(0, len(lines)), g.choice(ABUSE).format(x=g.choice(WORDS)))
        elif g.random() < 0.5:
            lines.insert(g.randint(0, len(lines)), g.choice(CALM))
        out.append(("\n".join(lines), bad, bad != (g.random() < 0.04)))
    return out


WORDS = [f"{a}{b}{c}" for a in "bdfk" for b in "aeiou" for c in ("mar", "lin", "sto", "ver", "gup")]


@pytest.fixture(scope="module")
def trained():
    rows = verdicts(1_500, 1)
    return severity.fit([t for t, _, _ in rows], [int(v) for _, _, v in rows], [1 + i % 5 for i in range(len(rows))])


def test_verdicts_decide(trained):
    rows = verdicts(800, 2)
    untrained = severity.fit([], [])
    count = lambda m: (sum(b and m.document(t)[0] >= severity.THRESHOLD for t, b, _ in rows), sum(m.document(t)[0] >= severity.THRESHOLD for t, _, _ in rows), sum(b for _, b, _ in rows))
    both, found, true = count(trained)
    assert both >= 0.97 * true and both >= 0.97 * found
    both, found, true = count(untrained)
    assert both < 0.9 * true or both < 0.9 * found
    assert trained.document("Listen, snollygoster, you utter snollygoster.")[0] > trained.document(CALM[0])[0]
    assert trained.cuts[0] < trained.cuts[1]


def test_a_score_is_the_sum_of_its_features(trained):
    for t, _, _ in verdicts(200, 3):
        for raw, plain in severity.sentences(t):
            assert trained.score(plain, raw) == pytest.approx(sum(trained.w.get(f, 0.0) for f in severity.features(plain, raw)))


def test_every_passage_is_scored(trained):
    bad = ABUSE[0]
    buried = "\n".join(CALM * 40 + [bad] + CALM * 40)
    assert trained.document(buried) == (trained.document(bad)[0], bad)
    small = severity.Model({f"w{c}": 0.5 for c in "abcdefghijkl"}, [3.0, 4.5])
    assert small.document(" ".join(f"w{c}" for c in "abcdefghijkl"))[0] > severity.THRESHOLD
    assert trained.document(None) == (0.0, None) and trained.document(" \n ") == (0.0, None)
    assert trained.document("1 2 3")[0] < severity.THRESHOLD


def test_disguises():
    for x, want in (("m o r o n here", "moron here"), ("mоrоn", "moron"), ("so stuuupid", "so stupid"), ("a b1tch", "a bitch"), ("m\u200boron", "moron"), ("A_B is 5*3 or x | y", "A_B is 5*3 or x | y"), ("the *idiot*", "the *idiot*")):
        assert severity.normal(x) == want
    assert "#DISGUISED" in severity.features(severity.normal("you mоrоn"), "you mоrоn")
    assert "#DISGUISED" not in severity.features("you moron", "you moron")
    assert len(severity.sentences("a b c d. x\n\n  \ny!")) == 3


def test_scores_and_rates(spark, trained):
    docs = spark.createDataFrame([(1, ABUSE[0], " A", "s"), (2, CALM[0], "a", "s"), (3, None, None, "s"), (4, "", "", "s"), (1, ABUSE[0], " A", "s")], "doc_id bigint, text string, source string, severity string")
    s = severity.score(docs, trained, ["doc_id", "source"], "text")
    have = s.collect()
    assert sorted({r.doc_id for r in have if r.severity >= severity.THRESHOLD}) == [1]
    assert {(r.doc_id, r.severity) for r in have} == {(i, trained.document(t)[0]) for i, t, _, _ in docs.collect()}
    assert {r.source: (r.docs, r.found, r.rate) for r in severity.rates(s, F.col("source")).collect()} == {"a": (3, 2, pytest.approx(2 / 3)), "": (2, 0, 0.0)}


def test_training_reads_labels(spark):
    rows = verdicts(400, 5)
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)] + [(9_999, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(v), None if i % 7 == 0 else 1 + i % 5) for i, (_, _, v) in enumerate(rows)] + [(9_999, 1, 1), (None, 1, 1), (3, None, 2), (77_777, 1, 1)], "doc_id bigint, toxic int, quality int")
    m = severity.train(docs, labels, "doc_id", "text", "toxic", "quality")
    assert len(m.w) > len(severity.LEAN) and severity.train(docs, labels.limit(0), "doc_id", "text", "toxic").w == severity.LEAN
    assert severity.score(docs.limit(0), m, ["doc_id"], "text").count() == 0
