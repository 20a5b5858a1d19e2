"""Pages and vectors: brute force, planted templates, and odd rows."""

import duckdb
import numpy as np
import pytest

from tests.llm import brute
from tessera.llm import ann, urls
from tessera.llm.queries import oracle_sql, queries

SF = brute.SF
Q = queries()


def rows_of(df, *names):
    return sorted((tuple(r) for r in (df.select(*names) if names else df).collect()), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql(f"create view pages as from '{SF}/pages.parquet'")
    return c


def test_urls(spark, duck):
    got = Q["op3_url_filter"](spark, SF)
    assert rows_of(got, "page_id", "host", "path", "rule", "verdict") == sorted(duck.sql(oracle_sql()["op3_url_filter"]).fetchall(), key=repr)


LINKED = [
    (1, "http://a.example.com/en/1", '<link rel="canonical" href="http://x.net/p">'),  # alias of a blocked address
    (2, "http://b.example.com/en/1", "<LINK href='//a.example.com/en/1' REL='canonical'>"),  # alias of an alias
    (3, "http://c.example.net/en/9", '<link rel=canonical href="http://x.net/p">'),  # explicitly allowed, and so its component
    (4, "http://d.example.com/q", '<meta http-equiv="refresh" content="0; url=/de/7">'),  # redirect to a blocked path
    (5, "HTTP://D.Example.COM/de/7?x=1", ""),
    (6, "http://e.example.com/z", '<link rel="stylesheet" href="http://y.net/p">'),
    (7, "http://f.org/fr/1#u", None), (8, None, "<link rel=canonical href=http://z.net/>"), (9, "mailto:x", ""), (10, "http://q.net", ""), (11, "http://q.net/", ""),
    (11, "http://q.net/", ""), (12, "http://deep.sub.example.com/de/a/b?c=/d", ""), (13, "http://g.example.com/en/1", '<link rel="canonical" href="http://h.net/p">'), (14, "x\ny://UP.net/Ab", ""),
]


def test_urls_linked(spark):
    pages = spark.createDataFrame([(*r, "clash") for r in LINKED], "page_id long, url string, html string, host string")
    got = urls.filtered(pages)
    verdict = {r.page_id: (r.rule, r.verdict) for r in got.collect()}
    assert verdict[1] == verdict[2] == (None, "allow") and verdict[3] == ("example.net/en/", "allow")
    assert verdict[4] == (None, "block") and verdict[5] == ("example.com/de/", "block") and verdict[13] == (None, "block")
    assert verdict[6] == verdict[8] == verdict[9] == verdict[10] == (None, "allow")
    assert verdict[7] == ("org/fr/", "allow") and verdict[11] == ("net/", "block") and verdict[12] == ("example.com/de/", "block")
    assert verdict[14] == ("net/", "block")
    c = duckdb.connect()
    c.sql("create table pages (page_id bigint, url varchar, html varchar)")
    c.executemany("insert into pages values (?, ?, ?)", LINKED)
    assert rows_of(got, "page_id", "host", "path", "rule", "verdict") == sorted(c.sql(oracle_sql()["op3_url_filter"]).fetchall(), key=repr)
    assert urls.filtered(pages.where("false")).collect() == []


MORE = [
    (1, "http://a1.example.com/en/x", '<link rel=canonical href="http://a1.example.com/en/y"><LINK class=k rel="alternate CANONICAL" href="http://bad.net/p">'),  # the second link counts
    (2, "http://a2.example.com/dir/page?x=1", "<meta content='0; url=next.html' http-equiv='Refresh'>"), (3, "http://a2.example.com/dir/next.html", '<link rel="canonical" href="../de/7">'),  # relative to the page
    (4, "http://a3.example.com/b", '<meta http-equiv=refresh content="5;URL=&quot;?p=2&quot;">'), (5, "http://a3.example.com/b?p=2", '<link rel=canonical href="&#x2f;&#x2f;worse.net&#47;z">'),
    (6, "HTTP://C2.org/p", '<link rel=canonical href="http://w.net/">'), (7, "http://c2.ORG/p#part", ""),  # one node, whatever the case and fragment
    (8, "http://a4.example.com/x", '<link rel=canonical data-href="http://w.net/">'), (9, "http://a5.example.com/x", '<link title=" rel=canonical href=http://w.net/ " rel=icon href=/i>'),
    (10, "http://a6.example.com/x", "<!-- <link rel=canonical href=http://w.net/> --><script>'<link rel=canonical href=http://w.net/>'</script>"),
    (11, "http://a7.example.com/x", '<link rel=canonical href="/r?to=http://w.net/">'), (12, "http://a7.example.com", '<link rel="canonical" href="./de/../de/./q">'),
    (13, "http://a8.example.com/x", '<link rel=canonical href="mailto:a@w.net"><link rel=canonical href="#top"><link rel=canonical href=""><link rel=canonical>'),
    (14, "http://long.example.com/" + "x" * 50000, "y" * 300000 + "<link rel=canonical " + "k=v " * 20000 + "href=http://w.net/q>"),
    (15, "http://a9.example.com/a/b/c/..", '<link rel=canonical href="../../../de/">'), (16, "http://b1.example.com/a", '<link rel=canonical href="http://hub.example.com/">'),
    *((100 + k, f"http://s{k}.example.com/", '<link rel=canonical href="http://HUB.example.com">') for k in range(400)), (17, "http://hub.example.com/", '<meta http-equiv="refresh" content="0;http://z.net/">'),
]


def test_urls_all_links(spark):
    """Several links, relative ones, references, case, long addresses and pages, a hub; as the SQL has it."""
    pages = spark.createDataFrame(MORE, "page_id long, url string, html string")
    got = urls.filtered(pages)
    blocked = {r.page_id for r in got.collect() if r.verdict == "block"}
    assert blocked == {1, 2, 3, 4, 5, 6, 7, 12, 14, 15, 16, 17, *range(100, 500)}
    c = duckdb.connect()
    c.sql("create table pages (page_id bigint, url varchar, html varchar)")
    c.executemany("insert into pages values (?, ?, ?)", MORE)
    assert rows_of(got, "page_id", "host", "path", "rule", "verdict") == sorted(c.sql(oracle_sql()["op3_url_filter"]).fetchall(), key=repr)


def neighbours(rows, every=20, k=20):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            s = (x * q).sum(1)
            order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def recall(spark, got, rows):
    truth, found = neighbours(rows), {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for q, best in truth.items():
        own = sorted(found[q], key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(best) + 1))
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len({r.vec_id for r in own} & {i for i, _ in best})
        total += len(best)
    return hits / total


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_ann(spark, sf):
    rows = duckdb.sql(f"select vec_id, embedding from '/root/testdata/{sf}/embeddings.parquet'").fetchall()
    found = ann.searched(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet"))
    assert found.leaves >= 16 and recall(spark, found.rows.collect(), rows) >= 0.94
    if sf == "sf0.01":
        assert rows_of(Q["op10_ann"](spark, SF)) == rows_of(found.rows)


def clustered(rng, n, groups, size=12):
    centre = rng.normal(size=(groups, size)) * 4
    return [(i, (centre[i % groups] + rng.normal(size=size) * 0.3).tolist()) for i in range(n)]


@pytest.mark.parametrize("upper", [1024, 12])
def test_ann_tree(spark, monkeypatch, upper):
    """Far from all leaves are visited where vectors lie in clusters, also in a tree of two levels."""
    monkeypatch.setattr(ann, "UPPER", upper)
    rng = np.random.default_rng(1)
    rows = clustered(rng, 9000, 60)
    rows += [(9000 + i, rows[40][1]) for i in range(3000)]  # a hot vector
    found = ann.searched(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert found.leaves >= 90 and found.visits < found.leaves / 4
    assert recall(spark, found.rows.collect(), rows) >= 0.9


def test_ann_long_vectors(spark):
    rng = np.random.default_rng(2)
    rows = clustered(rng, 300, 6, 3000)
    assert recall(spark, ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), rows) >= 0.9


def test_ann_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (20, [1.0, 1.0, 1.0]), (6, [2.0, 0.0]), (40, [0.0, -1.0]), (40, [0.0, -1.0]), (7, [float("inf"), 0.0])]
    docs = spark.createDataFrame([(*r, 1, 0.5) for r in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = [tuple(r) for r in ann.neighbours(docs).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 6, 2.0), (0, 2, 1, 1.0), (0, 3, 40, 0.0), (40, 1, 0, 0.0), (40, 2, 1, 0.0), (40, 3, 6, 0.0)]
    assert ann.neighbours(docs.where("false")).collect() == []
