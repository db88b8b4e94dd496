"""Template deduction on hosts without telling names, against classes of exact occurrence vectors made by hand."""

import random
from collections import Counter, defaultdict

import pytest

from tessera.llm import html_text

SCHEMA = "page_id long, url string, html string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(n))


def neutral_host(seed, pages, host):
    """Pages whose only difference between article and the rest is that the rest repeats; (row, article)."""
    rng = random.Random(seed)
    fixed = {k: words(rng, 12) for k in ("top", "links", "offer", "below", "rare")}
    out = []
    for i in range(pages):
        title, body = words(rng, 5), [words(rng, 30) for _ in range(rng.randrange(2, 6))]
        extra = f"<div class=q9><p>{fixed['rare']}</p></div>" if i % 20 else ""  # on 95 pages of 100
        html = f"""<html><body><div class=q1><p>{fixed["top"]}</p><ul><li>{fixed["links"]}</li><li>Home</li></ul></div>
        <div class=q2><h2>{title}</h2><p>{body[0]}</p><div class=q3><p>{fixed["offer"]}</p></div>{"".join(f"<p>{x}</p>" for x in body[1:])}</div>
        {extra}<div class=q4><p>{fixed["below"]} <b>2024</b></p></div></body></html>"""
        out.append(((i, f"http://{host}/p{i}", html), " ".join([title, *body])))
    return out


def test_repeated_text_goes_without_word_lists(spark, monkeypatch):
    for name in ("BOILER_WORDS", "MAIN_WORDS", "BOILER_TAGS", "MAIN_TAGS"):
        monkeypatch.setattr(html_text, name, frozenset())
    html_text.nature.cache_clear()
    pages = neutral_host(1, 60, "neutral.example")
    df = spark.createDataFrame([r for r, _ in pages], SCHEMA)
    got = {r.page_id: r.text for r in html_text.extract_main_text(df).collect()}
    html_text.nature.cache_clear()
    assert got == {r[0]: want for r, want in pages}


def test_without_vectors_the_template_is_lost(spark, monkeypatch):
    """With a number of its own for each token there are no classes, and the repeated text stays."""
    pages = neutral_host(2, 30, "neutral.example")
    df = spark.createDataFrame([r for r, _ in pages], SCHEMA)
    got = html_text.template_slots(df.selectExpr("'h' as host", "cast(html as binary) as raw")).first()
    vectors = Counter(t["class"] for t in got.template)
    assert min(vectors.values()) >= html_text.LEAST_TOKENS and len(vectors) == 2  # on all pages, and on 95 of 100
    one = pages[3]
    assert html_text.main_text(one[0][2], got.role, [t.asDict() for t in got.template]) == one[1]
    alone = [t.asDict() | {"class": i, "place": -t.place} for i, t in enumerate(got.template)]
    assert html_text.main_text(one[0][2], got.role, [t.asDict() | {"place": -t.place} for t in got.template]) != one[1]  # not in order
    assert len(html_text.main_text(one[0][2], got.role)) > len(one[1]) and alone


def plain_template(pages):
    """Tokens of the classes, from whole occurrence vectors."""
    on = defaultdict(set)
    for i, html in enumerate(pages):
        for token, _, _, block in html_text.page_tokens(html_text.segments(html)):
            on[token].add((i, block >= 0))
    vectors = defaultdict(list)
    for token, where in on.items():
        vectors[frozenset(i for i, _ in where)].append((token, any(t for _, t in where)))
    return {t for v, ts in vectors.items() for t, _ in ts if len(v) >= 0.9 * len(pages) and len(ts) >= 2 and any(x for _, x in ts)}


@pytest.mark.parametrize("seed", [3, 4])
def test_classes_equal_exact_vectors(spark, seed):
    pages = [r for r, _ in neutral_host(seed, 25, "a.example")]
    copies = [pages[0]] * 40  # a page's copies count once
    rows = pages + [(100 + i, u, h) for i, (_, u, h) in enumerate(copies)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("page_id", "'h' as host", "cast(html as binary) as raw")
    got = html_text.template_slots(html_text._distinct_pages(df)).first()
    assert {t.token for t in got.template} == plain_template([h for _, _, h in pages])


def test_copies_and_near_copies_keep_their_text(spark):
    """Pages that differ in a word share nearly all their tokens; they are no template of each other."""
    rng = random.Random(5)
    body = [words(rng, 40) for _ in range(6)]
    near = [(i, "http://b.example/", "<div class=z>" + "".join(f"<p>{x}</p>" for x in [*body[:-1], body[-1] + f" n{i}"]) + "</div>") for i in range(12)]
    same = [(50 + i, "http://c.example/", "<div class=z><p>" + body[0] + "</p><p>" + body[1] + "</p></div>") for i in range(9)]
    got = {r.page_id: r.text for r in html_text.extract_main_text(spark.createDataFrame(near + same, SCHEMA)).collect()}
    assert all(got[i] == " ".join(body) + f" n{i}" for i in range(12))
    assert all(got[50 + i] == body[0] + " " + body[1] for i in range(9))


def test_a_very_long_page(spark):
    rng = random.Random(6)
    pages = neutral_host(7, 8, "long.example")
    big = " ".join(f"<p>{words(rng, 400)}</p>" for _ in range(400))
    rows = [r for r, _ in pages] + [(99, "http://long.example/big", f"<html><body><div class=q2><h2>Big</h2>{big}</div></body></html>")]
    got = {r.page_id: r for r in html_text.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[99].text == "Big " + " ".join(big.replace("<p>", "").replace("</p>", "").split()) and got[99].n_chars > 900_000
