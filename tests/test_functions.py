"""Scalar functions against truth tables."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions import model
from corpusloom.functions import text as T
from corpusloom.functions import url as U


def one(spark, expr, *values, schema=None):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], schema or ", ".join(f"{n} string" for n in names))
    return df.select(expr(*[F.col(n) for n in names]).alias("x")).first().x


@pytest.mark.parametrize(
    "text, limit, want",
    [("Hello World", 50, "Hello_World"), ("test/file*name", 50, "test_file_name"), ("file<>name", 50, "file_name"), ("<h1>Title</h1>", 50, "Title"), ("Text with <em>emphasis</em>", 50, "Text_with_emphasis"), ("a" * 100, 20, "a" * 20), ("", 50, "scraped_content"), ("   ", 50, "scraped_content"), ('file"name', 50, "file_name"), ("file|name", 50, "file_name"), ("file?name", 50, "file_name"), ("a<b and c>d", 50, "ad")],
)
def test_slug(spark, text, limit, want):
    got = one(spark, lambda c: H.slug(c, limit), text)
    assert got == want
    assert one(spark, lambda c: H.slug(c, limit), got) == got


def test_doc_name(spark):
    df = spark.createDataFrame([(10, "Page/With*Bad?Chars"), (1000, "x")], "i int, t string")
    assert [r[0] for r in df.select(H.doc_name(F.col("i"), F.col("t"))).collect()] == ["010_Page_With_Bad_Chars", "1000_x"]


@pytest.mark.parametrize("u, want", [("https://example.com/path", "example.com"), ("http://subdomain.example.com", "subdomain.example.com"), ("https://example.com:8080", "example.com:8080"), ("nonsense", "")])
def test_netloc(spark, u, want):
    assert one(spark, U.netloc, u) == want


@pytest.mark.parametrize("h, want", [("page.html", "https://example.com/section/page.html"), ("/about", "https://example.com/about"), ("page.html#section", "https://example.com/section/page.html"), ("https://other.com/page", "https://other.com/page"), ("http://[bad", None)])
def test_resolve(spark, h, want):
    assert one(spark, U.resolve, "https://example.com/section/", h) == want


@pytest.mark.parametrize("u, want", [("https://docs.example.com/page", True), ("http://docs.example.com", True), ("https://DOCS.example.com", True), ("https://www.example.com/page", False), ("/relative", False), ("", False), (None, False)])
def test_on_host(spark, u, want):
    assert one(spark, lambda c: U.on_host(c, "docs.example.com"), u) is want


@pytest.mark.parametrize("u, want", [("https://e.com/docs/en", True), ("https://e.com/docs/en/", True), ("https://e.com/docs/EN/home", True), ("https://e.com/docs", False), ("https://e.com/other", False), ("https://e.com/docs/english", False)])
def test_under_prefix(spark, u, want):
    assert one(spark, lambda c: U.under_prefix(c, "/docs/en"), u) is want
    assert one(spark, lambda c: U.under_prefix(c, " "), u) is True


@pytest.mark.parametrize("u, want", [("https://flox.dev/docs?a=1#x", "https://flox.dev/docs/"), ("https://h.test/v1.2", "https://h.test/v1.2"), ("https://h.test//a//b", "https://h.test/a/b/"), ("https://HOST.test/A", "https://host.test/A/"), ("https://h.test/a.html", "https://h.test/a.html")])
def test_canonical(spark, u, want):
    assert one(spark, U.canonical, u) == want
    assert one(spark, U.canonical, want) == want


@pytest.mark.parametrize(
    "u, root, want",
    [("https://fluxcd.io/flux/installation/", "https://fluxcd.io/flux/", True), ("https://fluxcd.io/blog/", "https://fluxcd.io/flux/", False), ("https://docs.gitea.com/1.22/installation/", "https://docs.gitea.com/", False), ("https://elsewhere.test/", "https://docs.gitea.com/", False), ("https://docs.gitea.com/zh-tw/x/", "https://docs.gitea.com/", False), ("https://docs.gitea.com/x.pdf", "https://docs.gitea.com/", False)],
)
def test_in_scope(spark, u, root, want):
    assert one(spark, U.in_scope, u, root) is want


def test_page_text(spark):
    text = lambda h: one(spark, H.page_text, h)
    assert text("<html><head><style>b{}</style></head><body><script>x()</script><h1>Title</h1><p>Content &amp; &lt;more&gt;</p></body></html>") == "TitleContent & <more>"
    assert text("") == "" and text("<html></html>") == "" and text(None) is None
    assert text("<p>Text   with    spaces</p>") == "Text\nwith\nspaces"
    assert text("<!-- a > b --><p>x</p>\r\n<p>y</p>") == "x\ny"


def test_page_title(spark):
    assert one(spark, H.page_title, "<title> A &amp; B </title>", "https://e.com/x") == "A & B"
    assert one(spark, H.page_title, "<p>x</p>", "https://example.com/notitle/") == "notitle"
    assert one(spark, H.page_title, "<p>x</p>", "https://example.com") == "example.com"
    assert one(spark, H.ledger_title, "<title> </title>") == "Untitled"


def test_article(spark):
    code = "x" * 12_000
    got = H.article(f"<main><nav>menu</nav><h1>T</h1><pre>{code}</pre><p>a <b>b</b></p></main><footer>f</footer>")
    assert got == f"T\n```\n{code}\n```\na\nb" and "menu" not in got
    lines = '<article><pre><div class="ec-line"><div class="code">services:</div></div><div class="ec-line"><div class="code">  runner:</div></div></pre></article>'
    assert H.article(lines) == "```\nservices:\n  runner:\n```"
    assert H.article('<article><pre><span class="line">one</span><span class="line">  two</span></pre></article>') == "```\none\n  two\n```"
    assert H.article('<body>out<div class="x td-content">in</div></body>') == "in"
    deep = 20_000
    assert H.article("<main>" + "<div>" * deep + "in" + "</div>" * deep + "<pre>" + "<b>" * deep + "c" + "</b>" * deep + "</pre></main>") == "in\n```\nc\n```"
    assert H.article("plain") is None and H.article(None) is None
    df = spark.createDataFrame([(1, "<main>a</main>", "k"), (2, None, "k")], "id int, article string, keep string")
    assert [tuple(r) for r in H.articles(df, "article", ["id", "keep"]).orderBy("id").collect()] == [(1, "k", "a"), (2, "k", None)]


DECISIONS = [
    ("DECISION: SAVE\nREASON: Unique content", ("SAVE", None, "Unique content")),
    ("decision: skip\nREASON: Duplicate", ("SKIP", None, "Duplicate")),
    ("DECISION: CONSOLIDATE\nTARGET_ID: 000_Existing\nREASON: Overlap\nmore", ("CONSOLIDATE", "000_Existing", "Overlap\nmore")),
    ("garbled response", ("SAVE", None, "Unparseable decision; saved by default")),
    ("DECISION: SAVE\nTARGET_ID:\nREASON: x", ("SAVE", None, "Unparseable decision; saved by default")),
    ("DECISION: SAVE\nTARGET_ID: \nREASON: x", ("SAVE", None, "x")),
    ("DECISION: CONSOLIDATE\nTARGET_ID: 000_A\nNOTE: b\nREASON: r", ("CONSOLIDATE", "000_A\nNOTE: b", "r")),
    ("DECISION: CONSOLIDATE\nTARGET_ID:000_A\nREASON: r", ("CONSOLIDATE", "000_A", "r")),
    ("DECISION: CONSOLIDATE\nTARGET_ID: 000_A\n\nREASON: r", ("CONSOLIDATE", "000_A", "r")),
    ("DECISION: SKIP\nREASON:", ("SAVE", None, "Unparseable decision; saved by default")),
    ("DECISION: SKIP\nNOTE: n\nREASON: r", ("SAVE", None, "Unparseable decision; saved by default")),
    (None, ("SAVE", None, "Unparseable decision; saved by default")),
]


@pytest.mark.parametrize("answer, want", DECISIONS)
def test_parse_decision(spark, answer, want):
    assert tuple(one(spark, T.parse_decision, answer)) == want


def _event(**delta):
    import json

    return "data: " + json.dumps({"choices": [{"index": 0, "delta": delta, "finish_reason": None}]}) + "\n"


STOP = 'data: {"choices":[{"index":0,"delta":{},"finish_reason":"stop"}]}\n'


@pytest.mark.parametrize(
    "end, want",
    [(STOP + "data: [DONE]\n", ("clean text", None)), ("", (None, "stream interrupted")), ("data: [DONE]\n", (None, "stream interrupted")), ('data: {"error":"boom"}\n', (None, "error event")), (STOP.replace("stop", "length") + "data: [DONE]\n", (None, "token budget exhausted"))],
)
def test_streamed_answer(spark, end, want):
    body = _event(reasoning_content="hm") + ": ping\n" + _event(content="clean") + _event(content=" text") + end
    assert tuple(one(spark, T.streamed_answer, body)) == want


def test_streamed_blank(spark):
    assert tuple(one(spark, T.streamed_answer, _event(content=" ") + STOP + "data: [DONE]\n")) == (None, "empty answer")


def test_chunks():
    assert T.chunks(" ab ", 10) == ["ab"] and T.chunks(None) == [] and T.chunks("") == []
    assert T.chunks("aaa bbb\nccc\n\nddd", 12) == ["aaa bbb\nccc", "ddd"]
    assert T.chunks("a" * 25, 10) == ["a" * 10, "a" * 10, "a" * 5]
    t = "word and more\nlines\n\n" * 50
    assert "".join("".join(T.chunks(t, 37)).split()) == "".join(t.split()) and all(len(c) <= 37 for c in T.chunks(t, 37))


def test_excerpt(spark):
    cut = lambda t, n: one(spark, lambda c: T.excerpt(c, n), t)
    assert cut("short", 60) == "short" and cut(None, 60) is None
    parts = ["x" * 40, "install the registry", "y" * 40, "build"]
    assert cut("\n\n".join(parts), 60) == "install the registry\n\nbuild"
    assert cut("\n\n".join(["x" * 40, "install", "y" * 9]), 50) == "x" * 40 + "\n\ninstall"
    assert cut("z" * 100, 60) == "z" * 60


def test_documents(spark):
    doc = one(spark, lambda u, t, b: T.document(u, t, b), "u", "t", "body\n" + "-" * 50 + "\n\nend")
    assert doc == "URL: u\nTitle: t\n" + "-" * 50 + "\n\nbody\n" + "-" * 50 + "\n\nend"
    assert one(spark, T.body_of, doc) == "body\n" + "-" * 50 + "\n\nend"
    assert one(spark, T.body_of, "no header") == "no header"
    assert one(spark, T.truncated, "a" * 10_001).startswith("a" * 10_000 + "\n\n[")
    assert one(spark, T.word_count, " a  b c ") == 3


def test_retry():
    calls, naps = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise model.Transient()
        return "ok"

    assert model.with_retry(flaky, sleep=naps.append) == "ok" and naps == [2.0, 4.0]
    with pytest.raises(RuntimeError):
        model.with_retry(lambda: (_ for _ in ()).throw(RuntimeError()), sleep=naps.append)
    with pytest.raises(model.ModelMissing):
        model.check_status(404, "", "m")
    assert model.find_models(["a", "b"], ["a:1", "bc"]) == {"a": True, "b": False}


def test_generate(spark):
    df = spark.createDataFrame([(1, "x"), (2, "bad"), (3, "blank")], "id int, p string")

    def client():
        def ask(p):
            if p == "bad":
                raise ValueError("no")
            return " " if p == "blank" else p.upper()

        return ask

    got = {r.id: (r.answer, r.error) for r in model.generate(df, "p", client, ["id"]).collect()}
    assert got == {1: ("X", None), 2: (None, "ValueError: no"), 3: (None, "ValueError: empty answer")}
