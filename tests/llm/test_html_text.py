"""HTML extraction on the given pages, on templates without named articles, and on broken markup."""

import html
import re

from tessera.llm import html_text, queries


def simple_truth(page):
    m = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)
    text = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h\d|br)\b[^>]*>", " ", m[1]))
    return " ".join(html.unescape(text).split())


def test_given_pages(spark):
    df = queries.table(spark, "/root/testdata/sf0.01", "pages")
    want = {r.page_id: simple_truth(r.html) for r in df.collect()}
    rows = html_text.extract_main_text(df).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)


PAGE = """<!doctype html><html><head><title>T{i}</title><script>if (a<b) document.write("<p>no</p>")</script></head><body>
<header class="site"><h1>Site name</h1></header><div id="menu-{i}"><a href="/">Home</a><a href="/x">About us</a></div>
<div class="wrap"><div class="col"><h2>Head {i}</h2><p>First &amp; par {i} <b>bo</b>ld<p>Second&nbsp;one {i} 1 < 2<br>line {text}
<div class="share-buttons">Share me</div><form><input name=q>Find</form></div>
<div class="sidebar"><p>Popular things</p></div></div>
<section id="comments"><p>Nice post {i}, I agree very much with everything that was said here</p></section>
<aside>Ads</aside><div role="contentinfo">Foot {i}</div></body></html>"""


def test_template_without_named_article(spark):
    rows = [(i, f"http://User@Host.Example:80/p/{i}", PAGE.format(i=i, text="word " * (20 + i)), "x", 1, "r") for i in range(6)]
    # one page lacks the slot: it falls back on its own
    rows += [(6, "http://host.example/p", "<html><body><nav>Menu</nav><div><p>Only this</p></div></body></html>", "x", 1, "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, n_chars int, role string")
    slots = {r.host: r.role for r in html_text.template_slots(df.selectExpr("lower('Host.Example') as host", "cast(html as binary) as raw")).collect()}
    assert slots == {"host.example": "/html/body/div.wrap/div.col"}
    got = {r.page_id: r.text for r in html_text.extract_main_text(df).collect()}
    for i in range(6):
        assert got[i] == f"Head {i} First & par {i} bold Second one {i} 1 < 2 line " + " ".join(["word"] * (20 + i))
    assert got[6] == "Only this"


def test_odd_pages(spark):
    cases = {
        1: (None, None, ""),
        2: ("http://a.example/", "", ""),
        3: (None, "plain text &lt;b&gt;", "plain text <b>"),
        4: ("notaurl", "<article><header><h1>Title</h1><p>By line</p></header><p>Body</article><p>after", "Title Body"),
        5: ("http://b.example/", "<body><main><p>a<!-- x > y --><i>b</i></p><ul><li>c<li>d</ul><style>p{}</style></main><footer>f</footer>", "ab c d"),
        6: ("http://c.example/", "<article><p title=it's>x <span hidden>no</span><div style='display: none'>no</div>y</article>", "x y"),
        7: ("http://d.example/", "<div class=article-body><p>t<script>var s='</p>'", "t"),
        8: ("http://e.example/", "<nav>only menu</nav>", ""),
        9: ("http://f.example/", "<article>a</article><p>mid</p><article>b &#x41;&amp;amp;</article>" + "<i>" * 2000, "a b A&amp;"),
    }
    df = spark.createDataFrame([(k, u, h) for k, (u, h, _) in cases.items()] + [(1, None, None), (None, "http://g.example/", "<p>n")], "page_id long, url string, html string")
    rows = html_text.extract_main_text(df).collect()
    assert len(rows) == len(cases) + 2
    for r in rows:
        assert r.text == (cases[r.page_id][2] if r.page_id else "n"), r
    assert html_text.extract_main_text(df.limit(0)).count() == 0
