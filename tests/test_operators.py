"""Operators on small fixtures, edge cases included."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from corpusloom.config import Config
from corpusloom.operators import agent as A
from corpusloom.operators import audit, frontier, links, stats
from corpusloom.operators import memory as M
from corpusloom.operators import vectors as V
from corpusloom.session import lookup_join, materialize
from corpusloom.sources import readers, writers
from corpusloom.streaming import jobs


def page(title, *hrefs):
    return f"<title>{title}</title><h1>{title}</h1>" + "".join(f'<a href="{h}">x</a>' for h in hrefs)


SITE = [
    ("https://site.test/docs/", page("Root", "/docs/a", "b", "#top", "mailto:x@y", "tel:1", "", "https://other.test/x")),
    ("https://site.test/docs/a", page("A", "/docs/c", "/docs/", "/blog/z", "/docs/missing", "/docs/empty")),
    ("https://site.test/docs/b", page("B", "/docs/c#frag", "/docs/c?q=1")),
    ("https://site.test/docs/c", page("C")),
    ("https://site.test/docs/c?q=1", page("C")),
    ("https://site.test/docs/empty", "<html></html>"),
]


@pytest.fixture(scope="module")
def site(spark):
    return spark.createDataFrame(SITE, "url string, html string")


def test_crawl(spark, site, rows):
    got = {r.url.removeprefix("https://site.test/docs/"): (r.depth, r.state) for r in frontier.crawl(site, "https://site.test/docs/#a", "/docs").collect()}
    assert got == {"": (0, "yielded"), "a": (1, "yielded"), "b": (1, "yielded"), "c": (2, "yielded"), "c?q=1": (2, "yielded"), "empty": (2, "empty"), "missing": (2, "failed")}
    assert frontier.crawl(site, "https://site.test/docs/", "/docs", max_pages=2).filter("state = 'yielded'").count() == 2
    assert frontier.crawl(site, "https://site.test/docs/", "/other").count() == 0


def test_links(spark, rows):
    h = '<a href="/internal">a</a><a href="https://example.com/page">b</a><a href="https://other.com/page">c</a><a href="#f">d</a><a href="mailto:x">e</a><a href="">f</a>'
    p = spark.createDataFrame([(1, "https://example.com/", h), (2, "https://example.com/", None), (3, None, h)], "id int, url string, html string")
    assert rows(links.internal(p, "id", "url", "html")) == [(1, "https://example.com/internal"), (1, "https://example.com/page")]
    assert (1, "https://other.com/page") in rows(links.external(p, "id", "url", "html"))
    assert links.internal(p.limit(0), "id", "url", "html").count() == 0


def test_frontier_sets(spark, rows):
    u = spark.createDataFrame([("https://a.test/b/c",), ("https://a.test/z",), ("https://a.test/b",), (None,), ("https://a.test/z",)], "url string")
    assert [r[0] for r in frontier.unseen(u, u.limit(1)).collect()] and frontier.unseen(u, u).count() == 0
    got = rows(frontier.prioritised(u.filter("url IS NOT NULL").distinct()), "rank", "url")
    assert got == [(1, "https://a.test/b"), (2, "https://a.test/z"), (3, "https://a.test/b/c")]
    f = spark.createDataFrame([("x", 2), ("x", 1), (None, 3), (None, 4)], "f string, seq int")
    assert rows(frontier.first_by_final_url(f, "f", "seq"), "seq") == [(1,), (3,), (4,)]


def test_nearest(spark, rows):
    import numpy as np

    g = np.random.default_rng(3)
    m = g.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(100, None), (101, [0.0] * 8), (102, [1.0])], "id bigint, v array<double>")
    got = V.nearest(df.filter("id % 20 = 0"), df, "id", "v", 3)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 20, 40):
        best = [i for i in np.argsort(-(u @ u[q])) if i != q][:3]
        assert [r.hit_id for r in got.filter(f"query_id = {q}").orderBy("rank").collect()] == best
    assert V.nearest(df.limit(0), df, "id", "v").count() == 0
    exact = spark.createDataFrame([(1, [3.0, 4.0]), (2, [3.0, 4.0]), (3, [4.0, -3.0])], "id int, v array<double>")
    assert rows(V.nearest(exact, exact, "id", "v", 5, 1.0), "query_id", "hit_id") == [(1, 2), (2, 1)]  # the threshold is included
    assert rows(V.nearest(exact, exact, "id", "v", 5, before=True), "query_id", "hit_id") == [(2, 1), (3, 1), (3, 2)]


def test_pooling(spark, rows):
    assert V.pool([[1, 0, 0], [0, 1, 0]]).tolist() == pytest.approx([1 / math.sqrt(2), 1 / math.sqrt(2), 0])
    assert V.pool([[0, 0]]).tolist() == [0, 0]
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", None)], "k string, v array<double>")
    assert [(k, d, round(v, 6)) for k, d, v in rows(V.mean_pool(df, "k", "v"))] == [("a", 0, 0.707107), ("a", 1, 0.707107), ("z", 0, 0.0), ("z", 1, 0.0)]


def test_embed_halves_refused_pieces():
    taken = []

    def small(texts):
        if any(len(t) > 4 for t in texts):
            raise V.TooLarge()
        taken.extend(texts)
        return [[1.0, 0.0]] * len(texts)

    assert V.embed("abcdefghijklmno", small, 100).tolist() == [1.0, 0.0] and "".join(taken) == "abcdefghijklmno"
    assert V.embed("x", lambda t: [[0.1, 0.2, 0.3]], 9).tolist() == [0.1, 0.2, 0.3]
    with pytest.raises(ValueError):
        V.embed("a b", lambda t: [[1.0], [1.0, 2.0]], 1)


def test_embedded_errors(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, " ")], "id int, t string")
    got = {r.id: (r.embedding is not None, r.error) for r in V.embedded(df, "t", ["id"]).collect()}
    assert got[1] == (True, None) and not got[2][0] and "nothing" in got[3][1]


def mem(spark, *items):
    return spark.createDataFrame([(i, c, None, f"u{i}", f"t{i}", None, 1) for i, c in items], M.SCHEMA)


def test_memory(spark, tmp_path, rows):
    a, b = mem(spark, ("1", "a"), ("2", "b")), mem(spark, ("2", "B"), ("3", "c"))
    up = M.upserted(a, b)
    assert rows(up, "doc_id", "content") == [("1", "a"), ("2", "B"), ("3", "c")]
    assert rows(M.upserted(up, b), "doc_id", "content") == rows(up, "doc_id", "content")
    assert rows(M.deleted(a, b), "doc_id") == [("1",)] and rows(M.got(a, b), "doc_id", "distance") == [("2", 0.0)]
    m = M.Memory(spark, f"file://{tmp_path}/m")
    assert m.count() == 0
    assert m.upsert(a) == 0 and m.upsert(b) == 1 and m.count() == 3
    m.delete(a)
    assert rows(m.read(), "doc_id") == [("3",)]


PAGES = [(1, "https://e.test/1", "One", "alpha beta gamma delta epsilon"), (2, "https://e.test/2", "Two", "ALPHA  beta gamma delta epsilon"), (3, "https://e.test/3", "Three", "  "), (4, "https://e.test/4", "Four", "alpha beta gamma delta epsilon zeta"), (5, "https://e.test/5", "Five", "quite other words here now"), (6, "https://e.test/6", "Six", None)]


def test_agent(spark, rows):
    p = spark.createDataFrame(PAGES, "seq bigint, url string, title string, content string")
    empty = spark.createDataFrame([], M.SCHEMA)
    d = materialize(A.decide_batch(p, empty, Config()), "d")
    assert rows(d, "seq", "decision", "target_id") == [(1, "SAVE", None), (2, "SKIP", None), (3, "SKIP", None), (4, "CONSOLIDATE", "https://e.test/1"), (5, "SAVE", None), (6, "SKIP", None)]
    m = materialize(A.memory_rows(d, empty), "m")
    assert rows(m, "doc_id", "url", "content") == [("000_One", "https://e.test/1", "alpha beta gamma delta epsilon\nalpha beta gamma delta epsilon zeta"), ("001_Five", "https://e.test/5", "quite other words here now")]
    again = A.decide_batch(spark.createDataFrame([(9, "https://e.test/9", "Nine", "Quite other words here now"), (10, "https://e.test/10", "Ten", "quite other words here then")], "seq bigint, url string, title string, content string"), m, Config(similarity=0.7))
    assert rows(again, "seq", "decision", "target_id") == [(9, "SKIP", "001_Five"), (10, "CONSOLIDATE", "001_Five")]


def test_agent_follows_chains(spark, rows):
    """C is near B only, B near A or a stored document: the text of all is kept there."""
    angle = {"a": 0, "b": 20, "c": 40, "d": 60, "e": 150}
    embed = lambda texts: [[math.cos(math.radians(angle[t[0]])), math.sin(math.radians(angle[t[0]]))] for t in texts]
    p = spark.createDataFrame([(n, f"https://e.test/{t}", t.upper(), f"{t} text") for n, t in enumerate("abcde", 1)], "seq bigint, url string, title string, content string")
    empty = spark.createDataFrame([], M.SCHEMA)
    d = materialize(A.decide_batch(p, empty, Config(similarity=0.9), embed), "d")
    assert rows(d, "seq", "decision", "target_id") == [(1, "SAVE", None), *((n, "CONSOLIDATE", "https://e.test/a") for n in (2, 3, 4)), (5, "SAVE", None)]
    m = materialize(A.memory_rows(d, empty), "m")
    assert rows(m, "doc_id", "content") == [("000_A", "a text\nb text\nc text\nd text"), ("001_E", "e text")]
    assert {r.doc_id for r in A.results(d, A.saved_ids(d)).collect()} == {None, "000_A"}
    stored = materialize(A.memory_rows(A.decide_batch(p.filter("seq = 1"), empty, Config(similarity=0.9), embed), empty), "stored")
    d = materialize(A.decide_batch(p.filter("seq > 1"), stored, Config(similarity=0.9), embed), "d")
    assert rows(d, "seq", "target_id") == [(2, "000_A"), (3, "000_A"), (4, "000_A"), (5, None)]
    assert rows(A.memory_rows(d, stored, 1), "doc_id", "content") == [("000_A", "a text\nb text\nc text\nd text"), ("001_E", "e text")]
    mixed = lambda sim, exact, t: F.when(sim >= 0.939, "SKIP").when(sim >= t, "CONSOLIDATE").otherwise("SAVE")
    angle["b"], angle["c"] = 15, 38
    d = materialize(A.decide_batch(p.filter("seq < 4"), empty, Config(similarity=0.9), embed, mixed), "d")
    assert rows(d, "seq", "decision", "target_id") == [(1, "SAVE", None), (2, "SKIP", None), (3, "CONSOLIDATE", "https://e.test/a")]


def test_agent_error_keeps_going(spark, rows):
    def fails(texts):
        if "beta" in texts[0]:
            raise RuntimeError("down")
        return [[1.0, 2.0]] * len(texts)

    p = spark.createDataFrame(PAGES, "seq bigint, url string, title string, content string")
    d = A.decide_batch(p, spark.createDataFrame([], M.SCHEMA), Config(), embedder=fails)
    got = {r.seq: (r.decision, r.content) for r in d.collect()}
    assert got[1] == ("ERROR", PAGES[0][3]) and got[5][0] == "SAVE"


def test_agent_errors_are_written(spark, tmp_path, rows):
    def fails(texts):
        raise RuntimeError("down")

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text(json.dumps(dict(zip(("seq", "url", "title", "content"), PAGES[0]))))
    jobs.run_agent(*(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/mem", f"file://{tmp_path}/res", f"file://{tmp_path}/ck"), embedder=fails).awaitTermination()
    assert M.Memory(spark, f"file://{tmp_path}/mem").count() == 0
    assert PAGES[0][3] in (tmp_path / "mem/errors/batch=0/000_One.txt").read_text()
    assert readers.next_file_index(spark, f"{tmp_path}/mem/errors/batch=0") == 1 and readers.next_file_index(spark, f"{tmp_path}/none", 4) == 4


def test_a_batch_replayed_comes_to_the_same(spark, tmp_path, rows):
    """A failure after the memory was written and before the results were."""
    (tmp_path / "in").mkdir()
    args = (spark, f"file://{tmp_path}/in", f"file://{tmp_path}/mem", f"file://{tmp_path}/res", f"file://{tmp_path}/ck")
    for n, (a, b) in enumerate(((0, 3), (3, 5))):
        (tmp_path / f"in/{n}.json").write_text("\n".join(json.dumps(dict(zip(("seq", "url", "title", "content"), p))) for p in PAGES[a:b]))
        jobs.run_agent(*args).awaitTermination()
        res = lambda: rows(spark.read.parquet(f"file://{tmp_path}/res/batch={n}"), "url", "decision", "doc_id")
        before, kept = res(), rows(M.Memory(spark, args[2]).read(), "doc_id", "content")
        import shutil

        shutil.rmtree(tmp_path / f"res/batch={n}")
        (tmp_path / f"ck/commits/{n}").unlink()
        (tmp_path / f"ck/commits/.{n}.crc").unlink(missing_ok=True)
        jobs.run_agent(*args).awaitTermination()
        assert res() == before and rows(M.Memory(spark, args[2]).read(), "doc_id", "content") == kept
    assert all(r.ts is not None for r in M.Memory(spark, args[2]).read().collect())


def test_indexes_are_never_given_twice(spark, tmp_path):
    m = M.Memory(spark, f"file://{tmp_path}/m")
    m.upsert(mem(spark, ("000_A", "a"), ("007_B", "b")))
    m.delete(mem(spark, ("007_B", "b")))
    assert m.next_index() == 8 and m.version() == 1
    m.upsert(mem(spark, ("1003_C", "c")), 5)
    assert m.next_index() == 1004 and m.note()["batch"] == 5 and m.before(5).count() == 1 and m.before(6).count() == 2
    (tmp_path / "m/v=3").mkdir()  # a version that was never finished
    assert m.version() == 2 and m.count() == 2


def test_merge(spark):
    df = spark.createDataFrame([("a\nb", "b\nc"), ("", "x"), (None, "y")], "o string, n string")
    assert [r[0] for r in df.select(A.merge_lines(F.col("o"), F.col("n"))).collect()] == ["a\nb\nc", "x", "y"]


def test_stats(spark, rows):
    r = spark.createDataFrame([("1", "SAVE", "f"), ("2", "save", "f"), ("3", "ERROR", None), (None, None, None)], "url string, decision string, file_path string")
    assert rows(stats.decision_counts(r)) == [("CONSOLIDATE", 0), ("ERROR", 1), ("SAVE", 2), ("SKIP", 0)]
    assert tuple(stats.success_rate(r).first()) == (3, 1, 0.75, 0.666667)
    assert tuple(stats.success_rate(r.limit(0)).first()) == (0, 0, 0.0, 0.0)
    c = spark.createDataFrame([("s", "page_saved"), ("s", "source_finished"), ("t", "source_finished"), ("t", "page_failed"), ("u", "page_saved"), (None, "page_saved")], "source string, kind string")
    assert rows(stats.source_phase(c), "source", "phase") == [("s", "finished"), ("t", "finished_with_gaps"), ("u", "running")]


def test_audit(spark, rows):
    sha = hashlib.sha256(b"<p>x</p>").hexdigest()
    led = spark.createDataFrame([("a", "u1", "<p>x</p>", sha, 1, "x"), ("a", "u1", "<p>x</p>", "bad", 2, "y"), (None, "u2", None, None, 3, None)], "source string, url string, article_html string, article_sha256 string, page_id int, text string")
    cov = spark.createDataFrame([("a", "page_saved")] * 5, "source string, kind string")
    assert rows(audit.findings(led, cov)) == [("a", "article checksum mismatch"), ("a", "duplicate urls"), ("a", "record count differs from report")]
    from corpusloom.functions import html as H

    got = {r.page_id: (r.text, r.changed) for r in audit.rerendered(led, H.page_text(F.col("article_html"))).collect()}
    assert got == {1: ("x", False), 2: ("x", True), 3: (None, False)}


def test_ledgers(spark, tmp_path, rows):
    good, torn = {"url": "u1", "links": ["a"], "fetched_at": 1.5}, '{"url": "u3", "li'
    (tmp_path / "a.jsonl").write_text(json.dumps(good) + "\n\n" + json.dumps({"url": "u2"}) + "\n" + torn)
    (tmp_path / "b.jsonl").write_text(json.dumps(good) + "\nnot json\n" + json.dumps(good) + "\n")
    assert readers.ledger(spark, f"file://{tmp_path}/none").count() == 0
    got, bad = readers.tolerant_ledger(spark, f"file://{tmp_path}/a.jsonl")
    assert rows(got, "url") == [("u1",), ("u2",)] and bad.count() == 0
    _, bad = readers.tolerant_ledger(spark, f"file://{tmp_path}/b.jsonl")
    assert rows(bad, "line_no") == [(2,)]
    with pytest.raises(Exception):
        readers.ledger(spark, f"file://{tmp_path}/b.jsonl").collect()


def test_writers(spark, tmp_path, rows):
    d = spark.createDataFrame([("000_A", "u", "t", "body")], "doc_id string, url string, title string, content string")
    writers.write_documents(d, f"{tmp_path}/out")
    writers.write_documents(d, f"{tmp_path}/out")
    assert (tmp_path / "out/000_A.txt").read_text().endswith("\n\nbody")
    assert rows(readers.documents(spark, f"{tmp_path}/out"), "body") == [("body",)] and readers.text_files(spark, f"{tmp_path}/out").count() == 1
    with pytest.raises(ValueError):
        writers.write_documents(d.withColumn("doc_id", F.lit("../x")), f"{tmp_path}/out")
    writers.replace_snapshot(spark, f"file://{tmp_path}/s.json", {"sources": {"a": {"saved": 1, "phase": "finished"}}, "ai": {}})
    assert rows(readers.status(spark, f"file://{tmp_path}/s.json"), "source", "saved") == [("a", 1)]


def test_sitemaps_and_robots(spark, rows):
    store = spark.createDataFrame([("https://s.test/sitemap.xml", '<?xml version="1.0"?><sitemapindex xmlns="x"><sitemap><loc> https://s.test/m1.xml </loc></sitemap><sitemap><loc>https://o.test/m.xml</loc></sitemap></sitemapindex>'), ("https://s.test/m1.xml", "<urlset><url><loc>https://s.test/a?x=1&amp;y=2</loc></url></urlset>")], "url string, xml string")
    assert readers.sitemap_urls(store, ["https://s.test/sitemap.xml"], "s.test") == ["https://s.test/a?x=1&y=2"]
    rules = spark.createDataFrame([("a.test", 200, "User-agent: *\nDisallow: /no"), ("b.test", 404, ""), ("c.test", 500, "")], "host string, status int, body string")
    u = spark.createDataFrame([("https://a.test/no/x",), ("https://a.test/yes",), ("https://b.test/",), ("https://c.test/",), ("https://d.test/",)], "url string")
    assert [r[1] for r in rows(readers.robots_allowed(u, rules))] == [False, True, True, False, True]


def test_fetchers(spark, site, rows):
    f = spark.createDataFrame([("https://site.test/docs/c",), ("https://site.test/none",)], "url string")
    assert [r.html is None for r in readers.fetch(f, site).orderBy("url").collect()] == [False, True]

    def client():
        def get(u):
            if u.endswith("none"):
                raise OSError()
            return "<p>x</p>"

        return get

    assert [r.html for r in readers.fetch_with(f, client).orderBy("url").collect()] == ["<p>x</p>", None]


def test_lookup_join_salted(spark, rows):
    big = spark.createDataFrame([("k", i) for i in range(200)] + [("j", 1), (None, 2)], "k string, i int")
    small = spark.createDataFrame([("k", 9)], "k string, v int")
    for limit in (100, 0):
        assert lookup_join(big, small, ["k"], max_bytes=limit).count() == 200
        assert lookup_join(big, small, ["k"], "left", max_bytes=limit).count() == 202
        assert lookup_join(big, small.select("k"), ["k"], "left_anti", max_bytes=limit).count() == 2


def test_streams(spark, tmp_path, rows):
    (tmp_path / "in").mkdir()
    for n, (a, b) in enumerate(((0, 3), (3, 5))):
        (tmp_path / f"in/{n}.json").write_text("\n".join(json.dumps(dict(zip(("seq", "url", "title", "content"), p))) for p in PAGES[a:b]))
        args = (spark, f"file://{tmp_path}/in", f"file://{tmp_path}/mem", f"file://{tmp_path}/res", f"file://{tmp_path}/ck")
        jobs.run_agent(*args).awaitTermination()
    jobs.run_agent(*args).awaitTermination()  # nothing new
    got = rows(spark.read.parquet(f"file://{tmp_path}/res"), "url", "decision", "doc_id")
    assert [r[1] for r in got] == ["SAVE", "SKIP", "SKIP", "CONSOLIDATE", "SAVE"]
    kept = rows(M.Memory(spark, f"file://{tmp_path}/mem").read(), "doc_id", "content")
    assert [k for k, _ in kept] == ["000_One", "001_Five"] and kept[0][1].endswith("zeta")


def test_coverage_stream(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/1.json").write_text("\n".join(json.dumps({"source": "s", "time": t, "kind": "page_saved"}) for t in (0.0, 10.0, 7200.0)))
    q = jobs.coverage_counts(spark, f"file://{tmp_path}/c").writeStream.format("memory").queryName("cov").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("cov").collect()) == [1, 2]
