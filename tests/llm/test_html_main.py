"""Main text of hand-made pages, and of the table's pages against its template."""

from __future__ import annotations

import html
import re
from collections import Counter

from tracewright.llm import html_main
from tracewright.session import table

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body class="home">
<header class="site-header"><a href="/">Home</a><p>Welcome to this site, a header of some length for all to see.</p></header>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, and this notice is a long one that says so in many words.</p></div>
<div id="wrap" class="layout no-sidebar"><article class="post post-{n}"><header><h1>Title &amp; more</h1><p class=by>By somebody</p></header>
<!-- <p>comment</p> --><p>First   paragraph with <b>bold</b>,<br>a break &lt;and&gt; caf&eacute;&#33; It has enough text to tell.
<p>Second paragraph, left open, with enough text to tell as well <i>x
<div class="advert"><p>Buy this thing now, an advert that should never show up in the text.</p></div>
<ul><li>item one<li>item two</ul><table><tr><td>cell a<td>cell b</tr></table>
<form><label>Name</label><input name=q><button>Send</button></form>
<div class="share-bar">Share this</div></article>
<section id="comments"><article class="comment"><p>A reader's comment that is rather long and goes on for quite some time.</p></article></section>
<aside class="sidebar"><p>Related things that stand in a sidebar and are long enough to count.</p></aside></div>
<footer>&copy; nobody</footer></body></html>"""
TEXT = ["Title & more", "First paragraph with bold, a break <and> café! It has enough text to tell.", "Second paragraph, left open, with enough text to tell as well x", "item one", "item two", "cell a", "cell b"]


def texts(df):
    return {r.page_id: r.text for r in html_main.extract(df).collect()}


def test_template(spark):
    rows = [(i, f"http://Host.example/{i}", PAGE.replace("{n}", str(i)), "x") for i in range(4)]
    rows += [(10, "http://host.example/x", "<div class=other><p>A page of another kind, without the winning path but with some text.</p></div>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, paths string")
    got = texts(df)
    assert all(got[i].split("\n\n") == TEXT for i in range(4))
    assert got[10] == "A page of another kind, without the winning path but with some text."
    assert {tuple(r.paths) for r in html_main.consensus(html_main.read_pages(df)).collect()} == {(">div.other", ">html>body.home>div.layout.no-sidebar>article.post.post-")}


def test_edge_cases(spark):
    rows = [(1, None, None), (2, "not a url", ""), (3, "http://a/", "<"), (4, "http://a/", "just < text &am"), (5, "http://a/", "<p"), (6, "http://a/", "<script>never closed <p>x</p>"), (None, "http://a/", "<p>text without an id, long enough to count</p>"), (7, "http://a/", "<p>" + "word " * 100_000), (8, "http://a/", "<div " * 20_000), (9, "http://a/", '<p a="<b>never closed'), (10, "http://a/", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string")
    out = html_main.extract(df).collect()
    assert len(out) == len(rows) + 1
    got = {r.page_id: r for r in out}
    assert got[1].text == got[2].text == "" and got[1].n_chars == 0
    assert got[None].text == "text without an id, long enough to count"
    assert got[3].text == "<" and got[4].text == "just < text &am" and got[6].text == "" and got[10].text == "deep"
    assert got[7].text == ("word " * 100_000).strip()
    assert html_main.extract(df.limit(0)).count() == 0


def test_whole_table(spark, sf):
    pages = table(spark, sf, "pages")
    got = texts(pages)

    def want(page):
        body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", body)
        parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>|<!--.*?-->", "", x))).split()) for x in parts]
        return "\n\n".join(x for x in parts if x)

    for r in pages.collect():
        assert got[r.page_id] == want(r.html)


def words(n, seed):
    return " ".join(f"word{seed}x{i}" for i in range(n))


def brute(rows):
    """Votes counted and blocks chosen in plain Python, from what single pages are read into."""
    read = [(d, u.split("/")[2], html_main.read_page(h or "")) for d, u, h in rows]
    out = {}
    for d, host, (_, _, found) in read:
        own = [x[2] for x in read if x[1] == host]
        votes, doubts = Counter(v for v, _, _ in own if v is not None), Counter(x for _, ds, _ in own for x in ds)
        paths = [p for p, n in votes.items() if n >= html_main.LEAST_SHARE * sum(votes.values())]
        stale = {p for p, n in doubts.items() if n >= max(html_main.LEAST_PAGES, html_main.LEAST_SHARE * len(own))}
        kept = [b for b in found if b["doubt"] not in stale]
        won = [any(b["path"] == p or b["path"].startswith(p + ">") for p in paths) for b in kept]
        size = lambda of: sum(len(b["text"]) for b, x in zip(kept, of, strict=True) if x)
        few = size(won) < html_main.HELD * size([b["own"] for b in kept])
        out[d] = "\n\n".join(b["text"] for b, w in zip(kept, won, strict=True) if w or (few and b["own"]))
    return out


def layouts():
    p = lambda n, s: f"<p>{words(n, s)}</p>"
    nav = "<div class='menu'>" + "".join(f"<a href='/{i}'>Item {i}</a> " for i in range(9)) + "</div>"
    end = "<div class='footer'>All rights kept by somebody who says so at length</div>"
    rows = []
    for i in range(12):  # plain div layout; on some pages the article goes on in a section, on some it is all there is
        inner = p(30, i) + (f"<div class='section'>{p(80, 100 + i)}</div>" if i % 3 == 0 else p(40, 200 + i))
        rows.append((i, f"http://a.example/{i}", f"<body>{nav}<div class='content'>{inner}</div><div class='comments-list'>{p(60, 'c')}</div>{end}</body>"))
    for i in range(12):  # an article in two containers side by side, the larger now one, now the other
        rows.append((100 + i, f"http://b.example/{i}", f"<body>{nav}<div class='lead'>{p(20 + 30 * (i % 2), i)}</div><div class='rest'>{p(35, 300 + i)}</div>{end}</body>"))
    for i in range(10):  # one page has little where the others have their text
        text = f"<div class='story'>{p(50, i)}</div>" if i else f"<div class='story'>T</div><div class='long-read'>{p(90, 'z')}</div>"
        rows.append((200 + i, f"http://c.example/{i}", f"<body>{nav}{text}{end}</body>"))
    for i in range(10):  # words of furniture in classes: once, as part of the article; on all pages, as furniture
        odd = f"<div class='warning-signs'>{p(12, 'w')}</div><div class='form-of-government'>{p(12, 'g')}</div>" if i == 4 else ""
        rows.append((300 + i, f"http://d.example/{i}", f"<body>{nav}<div class='text'>{p(40, i)}{odd}<div class='share-story-now'>{p(8, 's')}</div>{p(9, 400 + i)}</div>{end}</body>"))
    return rows


def test_layouts(spark):
    rows = layouts()
    got = texts(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got == brute(rows)
    for i in range(12):
        assert got[i] == words(30, i) + "\n\n" + (words(80, 100 + i) if i % 3 == 0 else words(40, 200 + i))
        assert got[100 + i] == words(20 + 30 * (i % 2), i) + "\n\n" + words(35, 300 + i)
    assert got[200] == "T\n\n" + words(90, "z") and got[203] == words(50, 3)
    assert got[304] == "\n\n".join([words(40, 4), words(12, "w"), words(12, "g"), words(9, 404)])
    assert got[305] == "\n\n".join([words(40, 5), words(9, 405)])


def test_tied_votes_and_deep_pages(spark):
    two = [(i, "http://t.example/", f"<div class={'xy'[i % 2]}><p>{words(20, i)}</p></div>", "v", 1) for i in range(4)]
    deep = "<div>" * 2000 + f"<p>{words(9, 'd')}" + "</div><p>x" * 100
    math = f"<article><p>{words(20, 'm')} <math><mi>x</mi>=<mn>1</mn></math></p></article>"
    rows = [*two, (8, "http://u.example/", deep, "v", 1), (9, "http://v.example/", math, "v", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, vote string, blocks int")
    got = texts(df)
    assert got == brute([r[:3] for r in rows])
    assert all(got[i] == words(20, i) for i in range(4))
    assert got[8].startswith(words(9, "d")) and got[8].count("x") >= 100 and got[9] == words(20, "m") + " x=1"
