"""Crawls over a real HTTP server on this machine, the agent with a scripted model, audits of a run."""

import json
import os
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import corpusloom
import pytest
from corpusloom import cli
from corpusloom.config import Config, scope_of
from corpusloom.functions import model as G
from corpusloom.operators import agent as A
from corpusloom.operators import audit, frontier
from corpusloom.operators import memory as M
from corpusloom.session import materialize, numbered
from corpusloom.sources import http, readers
from corpusloom.streaming import jobs
from pyspark.sql import functions as F

BODY = "<main><h1>{t}</h1><p>" + "Words of an article that is long enough to be kept by the ledger, and then some more. " * 2 + "</p>{links}</main>"


def article(t, *hrefs):
    return f"<title>{t}</title>" + BODY.format(t=t, links="".join(f'<a href="{h}">x</a>' for h in hrefs))


SITE = {
    "/robots.txt": ("text/plain", "User-agent: *\nDisallow: /docs/private/\nCrawl-delay: 0"),
    "/sitemap.xml": ("text/xml", "<urlset><url><loc>http://{host}/docs/mapped/</loc></url></urlset>"),
    "/docs/": ("text/html; charset=utf-8", article("Röot", "/docs/a/", "/docs/private/x/", "/docs/file/", "/docs/gone/", "/docs/away/", "/blog/z/")),
    "/docs/a/": ("text/html", article("A", "/docs/b/")),
    "/docs/b/": ("text/html", article("B", "/docs/")),
    "/docs/mapped/": ("text/html", article("Mapped")),
    "/docs/private/x/": ("text/html", article("X")),
    "/docs/file/": ("application/pdf", "%PDF"),
    "/docs/short/": ("text/html", "<main>short</main>"),
    "/blog/z/": ("text/html", article("Z")),
}
SEEN = []


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        SEEN.append((self.path, self.headers["User-Agent"]))
        if self.path == "/docs/away/":
            self.send_response(302)
            self.send_header("Location", "/blog/z/")
            self.end_headers()
            return
        kind, body = SITE.get(self.path, ("text/html", None))
        self.send_response(200 if body is not None else 404)
        self.send_header("Content-Type", kind)
        self.end_headers()
        self.wfile.write((body or "").replace("{host}", self.headers["Host"]).encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_fetched(spark, server, rows):
    f = spark.createDataFrame([(server + p,) for p in ("/docs/", "/docs/gone/", "/docs/away/", "/docs/file/")] + [("ftp://x/",)], "url string")
    got = {r.url.removeprefix(server): r for r in http.fetched(f, http.http_client("tester/1", 5), 0.0).collect()}
    assert "Röot" in got["/docs/"].html and ("/docs/", "tester/1") in SEEN
    assert got["/docs/away/"].final_url == server + "/blog/z/" and "404" in got["/docs/gone/"].error and got["ftp://x/"].html is None
    scoped = frontier.within_scope(http.fetched(f, http.http_client(), 0.0), server + "/docs/")
    assert {r.url.removeprefix(server): (r.error or "")[:12] for r in scoped.collect()} == {"/docs/": "", "/docs/gone/": "HTTPError: H", "/docs/away/": "Redirect out", "/docs/file/": "Not an HTML ", "ftp://x/": "ValueError: "}


def test_hosts_are_asked_in_turn(spark):
    """The pause that a host asks for counts, a shorter one does not, and only successful fetches are followed by one."""

    def client():
        def get(u):
            if "bad" in u:
                raise OSError("no")
            return http.Answer("x", u)

        return get

    f = spark.createDataFrame([("http://a.test/1",), ("http://a.test/bad",), ("http://b.test/1",), (None,)], "url string")
    waits = spark.createDataFrame([("A.test", 3.0), ("b.test", 0.1)], "host string, delay double")

    import tempfile

    folder = tempfile.mkdtemp()
    pauses = lambda s, folder=folder: open(f"{folder}/{s}", "w").close()
    assert http.fetched(f, client, 0.2, waits, pauses).filter("error IS NULL").count() == 2
    assert sorted(os.listdir(folder)) == ["0.4", "3.0"]


def test_crawl_over_the_network(spark, server, rows):
    got = jobs.crawl_with(spark, server + "/docs/", server.split("://")[1], http.http_client(), "/docs", 10, 0.0)
    assert [(u.removeprefix(server), d) for u, d in rows(got, "url", "depth")][:3] == [("/docs/", 0), ("/docs/a/", 1), ("/docs/away/", 1)]
    assert jobs.crawl_with(spark, server + "/docs/", server.split("://")[1], http.http_client(), "/docs", 2, 0.0).count() == 2
    assert jobs.crawl_with(spark, server + "/docs/", "other.test", http.http_client(), None, 2, 0.0).count() == 0
    pages = corpusloom.WebScraper(spark, client=http.http_client(), delay=0.0).pages(server + "/docs/", path_prefix="/docs/b", max_pages=5)
    assert pages.count() == 0


def test_research_and_watch(spark, server, tmp_path, rows):
    out = f"file://{tmp_path}"
    for _ in range(2):  # the second run has nothing to do
        phase = jobs.research_crawl(spark, {"site": server + "/docs/"}, http.http_client(), out, 0.0)
        led = readers.ledger(spark, f"{out}/pages", "source string, " + readers.LEDGER)
        assert sorted(u.removeprefix(server) for (u,) in rows(led, "url")) == ["/docs/", "/docs/a/", "/docs/b/", "/docs/mapped/"]
    assert led.filter("article_html IS NULL OR title IS NULL").count() == 0
    cov = readers.ledger(spark, f"{out}/coverage", readers.COVERAGE)
    kinds = {(r.kind, (r.url or "").removeprefix(server)) for r in cov.collect()}
    assert ("robots_blocked", "/docs/private/x/") in kinds and ("page_failed", "/docs/away/") in kinds and ("page_failed", "/docs/file/") in kinds and ("source_finished", "") in kinds
    assert phase.count() == 1
    topics = spark.createDataFrame([("site", server + "/docs/b/", 1)], "source string, url string, rank int")

    def model():
        def say(prompt):
            if "Title: A" in prompt:
                raise RuntimeError("no")
            return "note"

        return say

    got = {r.url.removeprefix(server): r.status for r in jobs.notes(spark, out, topics, model, "m", 2).collect()}
    assert got == {"/docs/b/": "ok", "/docs/": "ok"}
    state = iter([{"pid": os.getpid(), "phase": "crawl", "files": 301}, {"pid": os.getpid(), "phase": "finished", "files": 5}])
    end = jobs.watch(spark, out, lambda: next(state), 0.0, lambda s: None)
    assert end["phase"] == "finished" and end["scraper_running"] and end["findings"] == []
    log = spark.read.json(f"{out}/audit").collect()
    assert len(log) == 2 and any("File limit exceeded" in (r.findings or []) for r in log)
    assert json.loads((tmp_path / "audit.json").read_text())["phase"] == "finished"


def test_run_findings(spark, rows):
    assert audit.run_findings(300, "crawl", True) == [] and audit.run_findings(301, "finished", False) == ["File limit exceeded"]
    assert audit.run_findings(1, "crawl", False) == ["Scraper exited before completion"] and audit.run_findings(1, "crawl", None) == []
    assert audit.alive(os.getpid()) and audit.alive(2**22 + 11) is False
    led = spark.createDataFrame([("a",)] * 3 + [("b",)], "source string")
    bundle = spark.createDataFrame([("a", "\n\nSource: https://x"), ("b", "\n\nSource: https://y")], "source string, text string")
    assert rows(audit.sections(led, bundle)) == [("a", 3, 1)]


def test_scope_options():
    assert scope_of("https://A.test/x") == ("a.test", None) and scope_of("https://a.test/x", "B.test") == ("b.test", None)
    assert scope_of("https://a.test/x", "b.test/docs/en") == ("b.test", "/docs/en") and scope_of("https://a.test", "b.test/docs", "/p") == ("b.test", "/p") and scope_of("https://a.test", "b.test/") == ("b.test", None)


def test_timeout():
    assert G.with_timeout(lambda: 3, 5) == 3
    with pytest.raises(ZeroDivisionError):
        G.with_timeout(lambda: 1 / 0, 5)
    tries = []

    def slow():
        tries.append(1)
        threading.Event().wait(3)

    with pytest.raises(G.TimedOut):
        G.with_retry(lambda: G.with_timeout(slow, 0.05), sleep=lambda s: None)
    assert len(tries) == 3


def test_numbered(spark, rows):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "i int").repartition(7)
    assert rows(numbered(df, ["i"], "n", 5), "i", "n") == [(i, i + 5) for i in range(1000)]
    assert numbered(df.limit(0), ["i"], "n").count() == 0


PAGE = "seq bigint, url string, title string, content string"


def scripted(answers):
    def client():
        def say(prompt):
            a = next((a for k, a in answers.items() if k in prompt), None)
            if a is None:
                raise RuntimeError("no answer")
            return a

        return say

    return client


def test_agent_with_a_model(spark, rows):
    stored = spark.createDataFrame([("000_Existing", "Existing body", [1.0, 0.0], "https://example.com/existing", "Existing", None, 2)], M.SCHEMA)
    embed = lambda texts: [[0.0, 1.0] if "far" in t else [1.0, 0.01] for t in texts]
    pages = [(1, "https://e.test/new", "New", "far away text"), (2, "https://e.test/dup", "Dup", "near dup"), (3, "https://e.test/more", "More", "near more"), (4, "https://e.test/odd", "Odd", "near odd"), (5, "https://e.test/path", "Path", "near path"), (6, "https://e.test/blank", "Blank", "menu only"), (7, "https://e.test/down", "Down", "broken"), (8, "https://e.test/none", "None", None), (9, "https://e.test/again", "Again", "FAR  away text")]
    clean = {f"URL: {u}\nTitle: {t}\n\n{c}": {"menu only": " \n ", "FAR  away text": "far away text"}.get(c, c) for _, u, t, c in pages if c and c != "broken"}
    clean["menu only"] = "\u00a0 "
    said = {"New page https://e.test/new": "DECISION: SAVE\nREASON: Unique content", "New page https://e.test/dup": "DECISION: SKIP\nREASON: Duplicate", "New page https://e.test/more": "DECISION: CONSOLIDATE\nTARGET_ID: 000_Existing\nREASON: Overlap", "New page https://e.test/odd": "garbled response", "New page https://e.test/path": "DECISION: CONSOLIDATE\nTARGET_ID: ../x\nREASON: r", "Stored as 000_Existing": "Merged body"}
    d = materialize(A.decide_by_model(spark.createDataFrame(pages, PAGE), stored, scripted({**said, **clean}), Config(), embed), "d")
    got = {r.seq: (r.decision, r.target_id, r.reason) for r in d.collect()}
    assert got[1] == ("SAVE", None, "Unique content") and got[2] == ("SKIP", None, "Duplicate") and got[3] == ("CONSOLIDATE", "000_Existing", "Overlap")
    assert got[4] == ("SAVE", None, "Unparseable decision; saved by default") and got[5][:2] == ("SAVE", None)
    assert got[6][0] == "ERROR" and got[7][0] == "ERROR" and got[8] == ("SKIP", None, "No body content after cleaning") and got[9][:2] == ("SKIP", None)
    assert {r.seq: r.content for r in d.collect()}[7] == "broken"
    m = A.merged_by_model(d, stored, scripted(said)).first()
    assert (m.doc_id, m.content, m.url, m.title, m.embedding) == ("000_Existing", "Merged body", "https://example.com/existing", "Existing", [1.0, 0.01])
    assert A.merged_by_model(d, stored, scripted({})).first().content == "Existing body\nnear more"
    assert rows(A.error_rows(d, 9), "doc_id", "content") == [("009_Blank", "menu only"), ("010_Down", "broken")]


def test_command_line(spark, server, tmp_path, capsys):
    out = str(tmp_path / "out")
    assert cli.main(["scrape", server + "/docs/", "-o", out, "-m", "4", "-d", "0", "-p", "/docs", "--no-agent", "-y"]) == 0
    assert cli.main(["scrape", server + "/docs/", "-o", out, "-m", "2", "-d", "0", "-p", "/docs", "--no-agent", "-y"]) == 0
    names = sorted(x for x in os.listdir(out) if x.endswith(".txt"))
    assert [x[:3] for x in names] == ["000", "001", "002", "003", "004", "005"] and names[0] == "000_Röot.txt"
    assert cli.main(["scrape", server + "/docs/", "-o", str(tmp_path / "agent"), "-m", "3", "-d", "0", "-p", "/docs", "--no-llm-clean"]) == 0
    assert M.Memory(spark, str(tmp_path / "agent/memory")).count() >= 1
    assert cli.main(["validate", "nonsense"]) == 1
