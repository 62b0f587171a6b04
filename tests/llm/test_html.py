"""HTML extraction: pages with known article text."""

from __future__ import annotations

import html
import random
import re

import pytest

from tessella.llm import html_extract as H
from tessella.session import table

PAGE = "page_id long, url string, html string"


def texts(spark, rows, **options):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], PAGE)
    return {r["page_id"]: r for r in H.extract(df, **options).collect()}


def test_table_pages_have_their_article(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    got = {r["page_id"]: r for r in H.extract(pages).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        want = "\n".join(x for x in parts if x)
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want)
    assert all(r["matched"] for r in got.values())


def template(rng: random.Random, i: int) -> tuple[str, str]:
    body = [" ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(3, 20))) for _ in range(rng.randrange(1, 5))]
    ad = '<div class="ad-box"><p>Buy it</p></div>' if rng.random() < 0.5 else ""
    notes = "".join(f'<div class="comment"><p>c{rng.randrange(99)}</p></div>' for _ in range(rng.randrange(3)))
    page = (
        "<!doctype html><html><head><title>x</title><style>p{}</style></head><body><header><a href=/>Site</a></header>"
        "<ul class=menu><li><a href=1>Home</a><li><a href=2>News</a></ul><div id='cookie-notice'>We use cookies &amp; more</div>"
        f"<div class=story><h2>Title {i} &lt;b&gt;</h2>{ad}" + "".join(f"<p>{x.replace('w1', '<i>w1</i>')}\n &eacute;</p>" for x in body)
        + f"</div><div class='sidebar'><p>Side {i}</p></div><form><p>Mail?</p></form>{notes}"
        "<script>if (a < b) document.write('<p>no</p>')</script><p>All rights kept</p><footer>foot</footer></body></html>")
    return page, "\n".join([f"Title {i} <b>", *(x + " é" for x in body)])


def test_wrapper_of_a_host_without_article_element(spark):
    rng = random.Random(2)
    made = [template(rng, i) for i in range(20)]
    got = texts(spark, [(f"https://News.example.com/{i}", p) for i, (p, _) in enumerate(made)])
    assert [got[i]["text"] for i in range(20)] == [t for _, t in made]
    far = texts(spark, [(f"https://News.example.com/{i}", p) for i, (p, _) in enumerate(made)], broadcast_bytes=0)
    assert [far[i]["text"] for i in range(20)] == [t for _, t in made]


def test_odd_pages(spark):
    rows = [(None, None), ("", ""), ("not a url", "just text &amp; more"), ("http://a/", "<p>one<p>two\n  three<br>four"),
            ("http://a/", "<p>one<p>two\n  three<br>four"), ("http://b/", "<article><p>x &am &amp y &copy; &#233;&nbsp;z"),
            ("http://c/", "<main><p>" + "long " * 50_000 + "</p></main>"), ("http://d/", "<div class=ad>buy<article><h1>T</h1><p>a<b>b</b>c</p>"),
            ("http://e/", "<article><!-- <p>no --><p>k</p><section class=comments><p>no</p></section><aside>no</aside></article><p>no</p>")]
    got = texts(spark, rows)
    want = ["", "", "just text & more", "one\ntwo three four", "one\ntwo three four", "x &am & y © é z", "long " * 49_999 + "long",
            "T\nabc", "k"]
    assert [got[i]["text"] for i in range(len(rows))] == want
    assert texts(spark, []) == {}


@pytest.mark.parametrize("seed", range(12))
def test_a_wrapper_matches_all_pages_that_made_it(seed):
    rng = random.Random(seed)
    pages = [H.Page(template(rng, i)[0]) for i in range(12)]
    w = H.Wrapper()
    for p in pages:
        w.add(p)
    assert w.pages == 12 and all(len(w.read(p.tokens)) == p.places for p in pages)
    a, b = H.Wrapper(), H.Wrapper()
    for i, p in enumerate(pages):
        (a if i % 2 else b).add(p)
    both = H.Wrapper.loads(a.merge(H.Wrapper.loads(b.dumps())).dumps())
    assert both.pages == 12 and all(both.read(p.tokens) is not None for p in pages)


def rich(rng: random.Random, depth: int = 0) -> str:
    out = []
    for _ in range(rng.randrange(1, 6)):
        t = rng.choice(["p", "div", "ul", "li", "h2", "section"])
        out.append(f"<{t}>{rich(rng, depth + 1) if depth < 3 and rng.random() < 0.5 else 'x'}</{t}>")
    return "".join(out)


def test_pages_with_nothing_in_common_make_a_wrapper_of_bounded_size():
    pages = [H.Page("".join(rich(random.Random(i * 50 + k)) for k in range(20))) for i in range(41)]
    w = H.Wrapper()
    for p in pages:
        w.add(p)
    assert len(list(H._tokens(w.items))) <= H.SIZE and all(w.read(p.tokens) is not None for p in pages)


def test_very_long_and_very_deep_pages():
    for source in ("<font>x" * 200_000, "<div>x" * 100_000, "<div class=ad>x" * 100_000, "<p>a<ul><li>b" * 50_000, "</b></div>" * 100_000,
                   "".join(rich(random.Random(i)) for i in range(4_000))):
        page = H.Page(source)
        w = H.Wrapper()
        w.add(page)
        assert len(w.dumps()) < 100_000 and w.read(page.tokens) is not None
        text = H.text_of(H.article(page, None, frozenset(), frozenset()))
        assert bool(text) == (not source.startswith(("</b>", "<div class=ad>")))


def test_texts_are_told_apart_by_their_place_in_the_expression(spark, monkeypatch):
    rng = random.Random(7)
    rows, want, label = [], [], []
    for i in range(6):
        a, b = (" ".join(f"w{rng.randrange(999)}" for _ in range(9)) for _ in range(2))
        rows.append(("http://divs/", f'<div id="top">Daily Gazette</div><div id="c"><h1>{a}</h1><p>{b}</p></div><div id="bottom">Copyright Gazette Ltd</div>'))
        rows.append(("http://paragraphs/", f"<p>Home | News | Sport</p><p>{a}</p><p>Terms of use</p>"))
        rows.append(("http://lines/", f"<div>Follow us</div><div>{a}</div><h2>{b}</h2><div>All rights reserved</div>"))
        # the same path on every page, and on some pages a place of its own
        also = "<div>Breaking</div>" if i % 3 else ""
        rows.append(("http://label/", f"<div>{a}</div><h2>{b}</h2>{also}"))
        want += [f"{a}\n{b}", a, f"{a}\n{b}", f"{a}\n{b}"]
        label.append(f"{a}\n{b}\nBreaking" if also else f"{a}\n{b}")
    got = texts(spark, rows)
    assert [got[i]["text"] for i in range(len(rows))] == want and all(r["matched"] for r in got.values())
    # without the expression the label stays
    for i in range(3, len(rows), 4):
        page = H.Page(rows[i][1])
        assert H.text_of(H.article(page, None, frozenset(), frozenset())) == label[i // 4]
    off = [H.text_of(H.article(H.Page(h), None, frozenset(), frozenset())) for _, h in rows]
    assert sum(x != y for x, y in zip(off, want, strict=True)) >= 20
    # two pages are judged like many
    got = texts(spark, rows[:8])
    assert [got[i]["text"] for i in range(8) if i % 4 != 3] == [w for i, w in enumerate(want[:8]) if i % 4 != 3]


def test_copies_and_near_copies_keep_their_article(spark):
    rng = random.Random(8)
    body = "".join(f"<p>{' '.join(f'w{rng.randrange(999)}' for _ in range(30))}</p>" for _ in range(5))
    near = [("http://copy/", f"<div><h1>One</h1>{body}<p>Read {i} times</p></div>") for i in range(4)]
    got = texts(spark, near)
    assert all(got[i]["text"].count("\n") == 6 for i in range(4))


def test_pages_without_a_host_are_judged_by_their_own_shape(spark):
    rows, want = [], []
    for i in range(60):
        # unrelated pages: each shape on its own, some shapes twice with another text
        shape = "".join(f"<{t}>" for t in random.Random(i // 2).choices(["div", "section", "center", "blockquote"], k=8))
        rows.append((None, f"<body>{shape}<p>Story {i} of someone</p></body>"))
        want.append(f"Story {i} of someone")
    got = texts(spark, rows)
    assert [got[i]["text"] for i in range(len(rows))] == want


def test_alignment_makes_repeats_and_options():
    assert H.fold(["<ul>", *["<li>", "#", "</li>"] * 3, "</ul>"]) == ("<ul>", ("+", ("<li>", "#", "</li>")), "</ul>")
    got = H.merge(("<h1>", "#", "</h1>", "<p>", "#", "</p>"), ("<p>", "#", "</p>"))
    assert got == (("?", ("<h1>", "#", "</h1>")), "<p>", "#", "</p>")
    got = H.merge(H.fold(["<p>", "#", "</p>"] * 2), ("<p>", "<b>", "#", "</p>"))
    assert H.Wrapper(got, 1).read(["<p>", "#", "</p>", "<p>", "<b>", "#", "</p>"]) is not None


def test_pages_with_and_without_article_element_on_one_host(spark):
    rng = random.Random(3)
    rows, want = [], []
    for i in range(12):
        body, foot = " ".join(f"w{rng.randrange(999)}" for _ in range(9)), "<p>All rights kept</p>"
        page = (f"<div class=story><h1>Title {i}</h1><div><p>{body}</p></div></div>" if i % 3 else f"<article><h1>Title {i}</h1><p>{body}</p></article>")
        for url in ("http://mixed/" + str(i), None, "odd url"):
            rows.append((url, f"<html><body>{page}{foot}</body></html>"))
            want.append(f"Title {i}\n{body}")
    # one page of its own shape among null URLs, and copies of another
    rows += [(None, "<html><body><section><h2>Alone</h2><p>only here</p></section></body></html>")]
    rows += [(None, "<html><body><table><tr><td>copied text</td></tr></table></body></html>")] * 4
    want += ["Alone\nonly here", *["copied text"] * 4]
    for options in ({}, {"broadcast_bytes": 0}):
        got = texts(spark, rows, **options)
        assert [got[i]["text"] for i in range(len(rows))] == want


def test_linked_words_and_formulas_stay_in_the_article(spark):
    rng = random.Random(4)
    menu = "<ul><li><a href=1>Home</a> | <li><a href=2>News</a></ul>"
    rows, want = [], []
    for i in range(6):
        w = f"w{rng.randrange(999)}"
        rows.append(("http://lists/", f"<body>{menu}<div class=story><p>Text {i} {w}</p><ul><li>See <a>the report {i}</a> for more</li>"
                     f"<li><a>Alone {i}</a></li></ul></div>{menu}</body>"))
        want.append(f"Text {i} {w}\nSee the report {i} for more\nAlone {i}")
        body = (f"<p>Here <math><msup><mi>x</mi><mn>{i}</mn></msup><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math> holds</p>"
                f"<object data=f><p>Film {w}</p></object><noscript><p>Table {i}</p></noscript>"
                f"<p>Plot <svg><title>no</title><text x=1>axis <tspan>{w}</tspan></text></svg> end</p>")
        rows.append(("http://formulas/", f"<body><noscript>no</noscript><article>{body}</article></body>"))
        want.append(f"Here x{i}= 1 2 holds\nFilm {w}\nTable {i}\nPlot axis {w} end")
    got = texts(spark, rows)
    assert [got[i]["text"] for i in range(len(rows))] == want


def test_marking_words_that_are_not_the_blocks_own_role(spark):
    rng = random.Random(5)
    rows, want = [], []
    for i in range(8):
        a, b, c = (" ".join(f"w{rng.randrange(999)}" for _ in range(12)) for _ in range(3))
        side = f"<div class='left-sidebar'><p>Side {i}</p></div><div class='ad-box'>Buy {i}</div><div id='cookie-notice'>Eat {i}</div>"
        rows.append(("http://with/", f"<body class=no-menu><div class='content with-sidebar'><p>{a}</p></div>{side}</body>"))
        want.append(a)
        rows.append(("http://ids/", f"<body><article><h2 id='search'>Search {i}</h2><p>{a}</p><h2 id='related-work'>Related {i}</h2><p>{b}</p>"
                     f"<h3><span id=comments>Said {i}</span></h3><p class='notice-period'>{c}</p>{side}</article></body>"))
        want.append(f"Search {i}\n{a}\nRelated {i}\n{b}\nSaid {i}\n{c}")
        # a block with a mark of its own that holds most of what differs
        rows.append(("http://most/", f"<body><div class=widget><p>{a}</p><p>{b}</p></div><p>By {i}</p>{side}</body>"))
        want.append(f"{a}\n{b}\nBy {i}")
        rows.append(("http://readers/", f"<body><div class=story><p>{a}</p></div><div class=comments><p>{b}</p><p>{c}</p></div></body>"))
        want.append(a)
    got = texts(spark, rows)
    assert [got[i]["text"] for i in range(len(rows))] == want
