"""Layouts without article or main, with text beside them, and with wrappers named by boilerplate words."""

from tessera.llm import html_text


def test_title_and_blocks_beside_the_slot(spark):
    body = "word " * 40
    cases = {
        "<div class=post><h1>Title</h1><div class=intro>" + "in " * 20 + "</div><div class=body>" + body + "</div></div><div class=footer>no</div>": "Title " + "in " * 20 + body,
        "<main><h1>Title</h1><p>Stand first<article>" + body + "</article></main><p>after": "Title Stand first " + body,
    }
    rows = [(k, "http://h%d.example/" % (i if k % 2 else 9), page) for i, page in enumerate(cases) for k in (2 * i, 2 * i + 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html_text.extract_main_text(df).collect():
        assert r.text == " ".join(list(cases.values())[r.page_id // 2].split())


def test_layout_words_do_not_empty_a_page():
    text = "word " * 40
    for page in (
        f"<div class='layout has-sidebar'><article>{text}</article><div class=sidebar>no</div></div>",
        f"<div id='page-with-ads'><main>{text}</main><div class=ads>no</div></div>",
        f"<html class='no-widget'><body><div class=post>{text}</div><div class=widget>no</div></body></html>",
        f"<div class='layout has-sidebar'><h2>{text}</h2><div class=sidebar>no</div></div>",
        f"<div class=has-comments><article><header><h1>{text}</h1>by</header></article></div>",
        f"<article>{text}</article><div class=comments-area><article>{'no ' * 200}</article></div>",
    ):
        assert html_text.main_text(page, None) == text.strip(), page
    assert html_text.main_text("<div class=comments>" + "no " * 99 + "</div><p>a", None) == "a"
