"""Main texts against the generated pages, plain tree matching, planted templates, and odd rows."""

import html as entities
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tessera.llm import html
from tessera.llm.queries import queries

SF = brute.SF
Q = queries()


def article(page):
    """The generated pages keep their text in <article>."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
    parts = re.split(r"<p>|</p>|</h1>", m[1] if m else "")
    texts = [" ".join(entities.unescape(re.sub(r"<[a-z/][^>]*(?:>|\Z)", " ", x)).split()) for x in parts]
    return "\n\n".join(x for x in texts if x)


def test_articles(spark):
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in Q["op6_html"](spark, SF).collect()}
    for i, url, page in duckdb.sql(f"select page_id, url, html from '{SF}/pages.parquet'").fetchall():
        assert got[i] == (url, article(page), len(article(page)))


def test_templates(spark):
    body = "<html><head><title>T</title></head><body><div id=top>Site name</div><div class=x><h2>{0}</h2><p>{0} one.</p><div>Read more of this site</div><p>{0} two &amp; three</p></div><div>Made by us</div></body></html>"
    rows = [(k, f"http://host.example/{k}", body.format(f"Word{k}")) for k in range(8)]
    rows += [(100 + k, f"http://same.example/{k}", "<body><p>always this</p></body>") for k in range(4)] + [(200, "http://one.example/", body.format("Only")), (300, None, None), (301, "http://host.example/9", ""), (302, "x", "plain < text &am &copy")]
    pages = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, template int")
    got = {r.page_id: r.text for r in html.articles(pages).collect()}
    for k in range(8):
        assert got[k] == f"Word{k}\n\nWord{k} one.\n\nWord{k} two & three"
    assert got[100] == got[103] == "always this" and "Site name" in got[200] and "Only two" in got[200]
    assert got[300] == got[301] == "" and got[302] == "plain < text &am ©"
    assert html.articles(pages.where("false")).collect() == []


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><nav>a</nav><article><header><h1>H</h1></header>b<br>c<p>d <i>e</i>f</p><aside>g</aside><div class='post-comments'>h</div></article><footer>i</footer></body>", "H\n\nb c\n\nd ef"),
        ("<main><p>a<p>b<form>c</form><ul><li>d<li>e</ul></main><div>z</div>", "a\n\nb\n\nd\n\ne"),
        ("<div class='cookie-notice'>x</div><div>y<!-- no --><script>var a='</p>'</script> z</div>", "y z"),
        ("<p title='a>b'>c</p><p>d</p", "c\n\nd"),
        ("<table><tr><td>a<td>b<tr><td>c</table><select><option>d</select>", "a\n\nb\n\nc"),
        ("<p>a <span class=ad>b</span> c", "a c"),
        ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
        ("<p>" + "word " * 40000, ("word " * 40000).strip()),
    ],
)
def test_extracted(page, text):
    assert html.extracted(page) == text


def test_regions_without_article(spark, monkeypatch):
    """With the article element renamed and no names of classes, templates alone find the articles."""
    monkeypatch.setattr(html, "OUTSIDE", frozenset())
    monkeypatch.setattr(html, "BESIDE", frozenset())
    html.described.cache_clear()
    rows = duckdb.sql(f"select page_id, regexp_extract(url, '://([^/?#]*)', 1) as h, html from '{SF}/pages.parquet'").fetchall()
    by = {}
    for i, h, page in rows:
        by.setdefault(h, []).append((i, page))
    hosts = right = total = 0
    for own in by.values():
        if len({p for _, p in own}) < html.LEAST_PAGES:
            continue
        bare = [p.replace("<article>", "<div class=k1>").replace("</article>", "</div>").replace("<nav>", "<div class=k2>").replace("</nav>", "</div>").replace("<footer>", "<div class=k3>").replace("</footer>", "</div>") for _, p in own]
        nodes, told = induced(bare)
        assert nodes[told["region"]].label == "div.k1"
        hosts += 1
        for (_, page), p in zip(own, bare, strict=True):
            right += html.extracted(p, (nodes, told)) == article(page)
            total += 1
    html.described.cache_clear()
    assert hosts > 20 and right == total


def induced(pages):
    """Reference and template of pages, as the operator makes them."""
    nodes = html.read_tree(html.written_tree(html.reference(sorted(set(pages))[: html.REFERENCE])))
    counts = {}
    for page in pages:
        for k, found in html.placed(html.parsed(page), nodes).items():
            x = html.own_text(found)
            n, low, high, chars = counts.get(k, (0, html.digest(x), html.digest(x), 0))
            counts[k] = n + 1, min(low, html.digest(x)), max(high, html.digest(x)), chars + len(x)
    return nodes, html.template(nodes, counts, counts[0][0])


def test_references_of_all_pages(spark):
    """Parts that stand on a few of many pages only, whatever their hash, are in the host's reference."""
    body = "<body><div class=top>Site</div><div class=text><p>Words {0}.</p></div>{1}</body>"
    rows = [("h", body.format(k, f"<div class=rare{k}>Rare {k}</div>" if k % 10 == 0 else "")) for k in range(400)] + [("g", body.format(k, "")) for k in range(2)] + [("h", body.format(3, ""))]
    pages = spark.createDataFrame(rows, "__host string, html string")
    got = {r["__of"]: r for r in html.references(pages).collect()}
    labels = [x.label for x in html.read_tree(got["h"].tree)]
    assert set(got) == {"h"} and got["h"].pages == 400
    assert {x for x in labels if "rare" in x} == {f"div.rare{k}" for k in range(0, 400, 10)} and len(labels) == len(set(labels))
    again = html.references(pages.orderBy(F.rand(3)).repartition(7)).collect()
    assert [tuple(r) for r in again] == [tuple(got["h"])]


def test_names_do_not_decide():
    kept = ["social-history", "side-effects", "related-work", "with-sidebar", "no-sidebar", "ad-free", "article-header"]
    page = "<article>" + "".join(f"<section class='{k}'><p>Text of {k}.</p></section>" for k in kept) + "<section id='legal-basis'>Basis.</section></article>"
    assert html.extracted(page) == "\n\n".join([*(f"Text of {k}." for k in kept), "Basis."])
    assert html.extracted("<body><div class='sidebar'><p>" + "All of the page is here. " * 5 + "</p></div><div>x</div></body>").startswith("All of the page")
    assert html.extracted("<body><div class=sidebar>links</div><div>" + "The text itself. " * 5 + "</div></body>") == ("The text itself. " * 5).strip()


def test_comments_and_related(spark):
    """Varying boxes beside a larger text go by their place; a line that only some pages share stays."""
    random.seed(2)
    word = lambda n: " ".join("".join(random.choices("abcdefgh", k=5)) for _ in range(n))
    rows, want = [], {}
    for k in range(12):
        title, first, second = word(4), word(60), word(40)
        license = "All rights are reserved by those who wrote this." if k % 3 else word(8)
        page = f"<body><div class=q7>{word(3)}</div><div class=z9><h1>{title}</h1><p>{first}<p>{second}<p>{license}</div><div class=z4><a href=x>{word(5)}</a></div><div>By us</div></body>"
        rows.append((k, f"http://host.example/{k}", page))
        want[k] = "\n\n".join([title, first, second, license])
    got = {r.page_id: r.text for r in html.articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def plain_matches(a, b):
    if a[0] != b[0]:
        return 0
    x, y = a[1], b[1]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain_matches(x[i], y[j]))
    return 1 + best[-1][-1]


def test_tree_matching():
    random.seed(9)

    def grown(depth):
        return random.choice("ab"), [grown(depth - 1) for _ in range(random.randint(0, 4))] if depth else []

    tree = lambda x: html.Tree(x[0], [tree(c) for c in x[1]])
    for _ in range(300):
        a, b = grown(3), grown(3)
        m, x, y = html.Matching(), tree(a), tree(b)
        assert m.matches(m.number(x), m.number(y)) == plain_matches(a, b)
        if x.label == y.label:
            pairs = m.aligned(x.children, y.children)
            assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
            assert sum(plain_matches(a[1][i], b[1][j]) for i, j in pairs) == plain_matches(a, b) - 1
            assert html.written_tree(html.read_tree(html.written_tree(x))[0]) == html.written_tree(x)


def test_wide_and_deep():
    deep = lambda odd: "".join(f"<div class=c{k % 3}><p>x{odd}</p><ul class=u{odd if k % 2 else 0}></ul>" for k in range(1500))
    pages = [deep(k) for k in range(4)]
    nodes, told = induced(pages)
    assert told is not None and html.extracted(pages[0], (nodes, told)) == "\n\n".join(["x0"] * 1500)
    wide = ["".join(f"<div class=k{k}-{n}>t{k}</div><div class=all>w{n}{k}</div>" for n in range(900)) for k in range(5)]
    nodes, told = induced(wide)
    assert html.extracted(wide[1], (nodes, told)).startswith("t1\n\nw01\n\nt1\n\nw11")
