"""Problems 3, 4, 5 and 7 against brute force, with edge cases."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import history, near_copies, site_lines, split
from corpusloom.llm import shingles as S

WORDS = [f"w{i}" for i in range(400)]
DOC = "doc_id string, content string, batch int, cls string, w int, id string, text string"


def shingles(text, k=3):
    w = re.findall("[a-z0-9]+", (text or "").lower())
    return None if len(w) < 20 else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def corpus(n=60, seed=5):
    g = random.Random(seed)
    out = []
    for i in range(n):
        base = [g.choice(WORDS) for _ in range(g.randint(20, 120))]
        out.append((f"d{i}", " ".join(base), g.randint(0, 3)))
        for _ in range(g.randint(0, 3)):
            v = base.copy()
            for _ in range(g.randint(0, max(1, len(v) // 12))):
                at = g.randrange(len(v))
                v[at : at + g.randint(0, 1)] = [g.choice(WORDS)] * g.randint(0, 2)
            sep = g.choice([" ", "\n", ", "])
            out.append((g.choice([f"d{i}", f"e{g.randint(0, 99)}"]), sep.join(v).upper() if g.random() < 0.3 else sep.join(v), g.randint(0, 3)))
    out += [("null", None, 1), ("empty", "", 1), ("short", "a b c", 2), (None, out[0][1], 3), ("d0", out[0][1], 0), ("d0", out[0][1], 0), ("long", " ".join(g.choice(WORDS) for _ in range(60_000)), 0), ("nobatch", out[0][1], None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(a, b, c, "x", 1, "y", "z") for a, b, c in corpus()], DOC)


def brute_pairs(rows):
    s = [(i, x) for i, t, _ in rows if i is not None and (x := shingles(t))]
    return {(min(a, b), max(a, b)) for n, (a, x) in enumerate(s) for b, y in s[:n] if a != b and jaccard(x, y) >= 0.7}


def brute_repeats(rows):
    s = [(i, b, x) for i, t, b in rows if b is not None and (x := shingles(t))]
    return {(i, b) for i, b, x in s if any(c < b and jaccard(x, y) >= 0.7 for _, c, y in s)}


@pytest.mark.parametrize("hot", [2_000, 1])
def test_near_copies(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    members, texts, links = near_copies.near_copies(docs, k=3, threshold=0.7)
    assert {tuple(r) for r in near_copies.id_pairs(members, links).collect()} == brute_pairs(corpus())
    star = {tuple(r) for r in near_copies.id_pairs(members, links, copies=1).collect()}
    assert star <= brute_pairs(corpus())


def test_groups(spark, docs):
    members, _, links = near_copies.near_copies(docs, k=3, threshold=0.7)
    g = near_copies.groups(members, links).collect()
    where = {(r.id, r.cls): r.group_id for r in g}
    for r in links.collect():
        a, b = r.a.hex(), r.b.hex()
        assert {v for (_, c), v in where.items() if c in (a, b)}.__len__() == 1
    assert len(where) == len(g)


def test_components(spark):
    g = random.Random(2)
    edges = [(g.randint(0, 80), g.randint(0, 80)) for _ in range(50)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in near_copies.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in linked}


def test_near_copies_of_nothing(spark, docs):
    members, texts, links = near_copies.near_copies(docs.limit(0), k=3, threshold=0.7)
    assert near_copies.id_pairs(members, links).count() == 0 and near_copies.groups(members, links).count() == 0


@pytest.mark.parametrize("hot", [2_000, 1])
def test_repeats(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    got = history.repeats(docs, "content", ["doc_id"], "batch", k=3, threshold=0.7)
    assert {tuple(r) for r in got.collect()} == brute_repeats(corpus())


def test_repeats_of_nothing(spark, docs):
    assert history.repeats(docs.limit(0), "content", ["doc_id"], "batch").count() == 0
    assert history.repeats(docs.filter("batch = 0"), "content", ["doc_id"], "batch").count() == 0


def test_history_is_taken_up_again(spark, docs, tmp_path):
    """A folder filled in one go and one filled by three openings, the last by another process, say the same."""
    import subprocess
    import sys

    path, rows = str(tmp_path / "history"), corpus()
    got = set()
    for b in (0, 1, 2):
        got |= {tuple(r) for r in history.repeats(docs.filter(F.col("batch") == b), "content", ["doc_id"], "batch", history=path, k=3, threshold=0.7).collect()}
    docs.filter("batch = 3").select("doc_id", "content", "batch").write.parquet(str(tmp_path / "late"))
    code = f"""
from corpusloom.llm import history
from corpusloom.session import get_session
s = get_session("other", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": {str(tmp_path / 'wh')!r}}})
h = history.History.open(s, {path!r})
b = h.prepare(s.read.parquet({str(tmp_path / 'late')!r}), "content", ["doc_id", "batch"])
n = h._read("texts").count()
h.check(b).join(b.rows, "cls").select("doc_id", "batch", "kind", "coverage").distinct().write.json({str(tmp_path / 'out')!r})
h.append(b); m = h._read("texts").count(); h.append(b)
assert n < m == h._read("texts").count()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300)
    out = spark.read.json(str(tmp_path / "out")).collect()
    assert got | {(r.doc_id, r.batch) for r in out} == brute_repeats(rows)
    assert all(0 < r.coverage <= 1 and (r.kind != "copy" or r.coverage == 1) for r in out)
    with pytest.raises(ValueError):
        history.History.create(spark, path)


def test_spread_edits_are_found(spark):
    """Edits as evenly spread as the similarity allows: none of the pairs is lost."""
    g, rows = random.Random(6), []
    for i in range(150):
        base = [g.choice(WORDS) + str(i) for _ in range(g.randint(60, 200))]
        step, kind = g.randint(10, 24), i % 3
        late = [x for n, w in enumerate(base) for x in (([f"x{n}"] if kind == 0 else [w, f"x{n}"] if kind == 1 else []) if n % step == step - 1 else [w])]
        rows += [(f"a{i}", " ".join(base), 0), (f"b{i}", " ".join(late), 1)]
    df = spark.createDataFrame(rows, "doc_id string, content string, batch int")
    want = brute_repeats(rows)
    assert len(want) > 60 and {tuple(r) for r in history.repeats(df, "content", ["doc_id"], "batch", k=3, threshold=0.7).collect()} == want


def test_passages_are_shared():
    import numpy as np

    g = np.random.default_rng(1)
    run = history.PASSAGE + history.WINDOW - 1
    for _ in range(200):
        a, b = g.integers(0, 2**62, 60), g.integers(0, 2**62, 60)
        at, to = g.integers(0, 60 - run), g.integers(0, 60 - run)
        b[to : to + run] = a[at : at + run]
        assert set(history.passages(a)) & set(history.passages(b))


def test_sketch_bound():
    import numpy as np

    g = np.random.default_rng(7)
    a, b = S.samplers(128)
    limit, over = S.most_bits(0.7, 128), 0
    for _ in range(200):
        x = g.integers(0, 2**63, 85, dtype=np.uint64)
        y = np.concatenate([x[:70], g.integers(0, 2**63, 15, dtype=np.uint64)])
        p, q = (S.parity_sketch(S.min_samples(v, a, b)) for v in (x, y))
        over += sum(int(v).bit_count() for v in (p ^ q).view(np.uint64)) > limit
    assert over <= 1


# ---------------------------------------------------------------- splitting


def parts(spark, text, size, overlap):
    df = spark.createDataFrame([(1, text, "p")], "id int, t string, piece_no string")
    return [(r.start, r.text) for r in split.split_long(df.select("id", "t"), "t", ["id"], size, overlap).orderBy("piece_no").collect()]


@given(st.text(alphabet="ab \n.!é\u0301😀。", max_size=400), st.integers(8, 60), st.integers(0, 2))
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_split_round_trip(spark, text, size, overlap):
    p = parts(spark, text, size, overlap)
    assert all(len(t) <= size for _, t in p)
    assert all(text[s : s + len(t)] == t for s, t in p)
    whole = "".join(t[(overlap if n else 0) :] for n, (_, t) in enumerate(p))
    assert whole == text
    assert len(p) == (0 if not text else 1) or len(text) > size


def test_split_boundaries(spark):
    cut = lambda t, n: [x for _, x in parts(spark, t, n, 0)]
    assert cut("aaaa aaaa\n\nbbbb. cc\nddd", 14) == ["aaaa aaaa\n\n", "bbbb. cc\nddd"]
    assert cut("aaaa aaaa. bbbb bbbb bbbb", 14) == ["aaaa aaaa. ", "bbbb bbbb bbbb"]
    assert cut("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert parts(spark, None, 10, 2) == [] and parts(spark, "", 10, 2) == []
    with pytest.raises(ValueError):
        split.pieces(F.col("t"), 10, 10)


@pytest.mark.parametrize("size, overlap", [(2, 1), (10, 5), (10, 9), (30, 20), (64, 63)])
def test_split_with_any_overlap(spark, size, overlap):
    text = "Ab cd. Éf gh!\n\nij 😀 kl mn\nop " * 9
    p = parts(spark, text, size, overlap)
    assert all(len(t) <= size and text[s : s + len(t)] == t for s, t in p)
    ends = [s + len(t) for s, t in p]
    assert p[0][0] == 0 and ends[-1] == len(text) and all(s == max(0, e - overlap) for (s, _), e in zip(p[1:], ends))


# ---------------------------------------------------------------- lines of a site


def test_repeated_lines(spark):
    g = random.Random(4)
    rows = []
    for i in range(60):
        u = f"https://{'BIG.test:80' if i % 2 else f's{i % 4}.test'}/p{i}?q#f"
        body = [f"Title {i}", "Log in", "LOG-IN!" if i % 5 else "log in", f"Updated {i} May 20{i:02d}", " ".join(g.choices(WORDS, k=8)) + " Qx" + "abcdefgh"[i % 8] * 3, "", "42"]
        rows.append((i, u, "\n".join(body), i, "c"))
    rows += [(100, None, "Log in\nx", 0, "c"), (101, "https://big.test/n", None, 0, "c"), (102, "https://big.test/e", "", 0, "c"), (103, rows[1][1], rows[1][2], 0, "c")]
    df = spark.createDataFrame(rows, "fetch_id bigint, url string, content string, line_no int, site string")
    got = site_lines.repeated_lines(df, "content", "fetch_id", "url")
    exact = {(r.doc_id, r.line_no) for r in got.collect() if r.same_docs >= 5 and r.same_docs * 10 >= r.site_docs}
    key = lambda s: "".join(c for c in s.lower() if c.isalpha())
    host = lambda u: re.sub(r"^https?://([^/:?#]*).*$", r"\1", (u or "").lower())
    sites, seen = {}, {}
    for i, u, c, *_ in rows:
        sites[host(u)] = sites.get(host(u), 0) + 1
        for k in {key(x) for x in (c or "").split("\n")} - {""}:
            seen[(host(u), k)] = seen.get((host(u), k), 0) + 1
    want = {(i, n) for i, u, c, *_ in rows for n, x in enumerate((c or "").split("\n"), 1) if (k := key(x)) and seen[(host(u), k)] >= 5 and seen[(host(u), k)] * 10 >= sites[host(u)]}
    assert exact == want and want
    near = {(r.doc_id, r.line_no) for r in got.collect()}
    assert exact <= near
    clean = {r.doc_id: (r.text, r.n_removed) for r in site_lines.without_lines(df, "content", "fetch_id", got).collect()}
    assert clean[101] == (None, 0) and "Log in" not in clean[1][0] and clean[102] == ("", 0)
    assert site_lines.repeated_lines(df.limit(0), "content", "fetch_id", "url").count() == 0
