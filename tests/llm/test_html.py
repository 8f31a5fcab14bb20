"""Main text of varied pages against gold texts, ablations of the method, and odd inputs."""

from __future__ import annotations

import numpy as np
import pytest

from exprflow.llm import html

P = [f"Paragraph number {w} tells of rivers and towns, of the people there and of what they did in those years." for w in ("one", "two", "three", "four")]
PS = "".join(f"<p>{x}</p>" for x in P)
NAV = "<nav><ul>" + "".join(f"<li><a href=/{x}>{x} and more of it</a>" for x in "abcdef") + "</ul></nav>"
FOOT = "<footer>&copy; 2020 Some Publisher &middot; All rights reserved, for all of the world and for all time to come.</footer>"
AD = "<div class='ad'>Buy our fine shoes now, they are cheap and good and we have many of them in all sizes.</div>"
COMMENT = "<p>I read this and I think that the author is wrong about the rivers, as I have been there myself and saw none.</p>"
GOLD = {
    "article": (f"{NAV}{AD}<article><h1>Head</h1>{PS}</article>{FOOT}", ["Head", *P]),
    "no article": (f"{NAV}{AD}<div id=content><h1>Head</h1>{PS}</div>{FOOT}", ["Head", *P]),
    "main": (f"<header>My site</header>{NAV}<main><h1>Head</h1>{PS}</main><aside>{COMMENT}</aside>{FOOT}", ["Head", *P]),
    "bare paragraphs": (f"{NAV}{PS}{FOOT}", P),
    "short paragraphs between": (f"{NAV}<article><h1>H</h1><p>{P[0]}<p>Yes.<p>{P[1]}<p>No.</article>{AD}", ["H", P[0], "Yes.", P[1], "No."]),
    "related-work": (f"<article><h1>Head</h1><p>{P[0]}</p><section id=related-work><h2>Related work</h2><p>{P[1]}</p></section></article>{FOOT}", ["Head", P[0], "Related work", P[1]]),
    "share-price": (f"<article><p>{P[0]}</p><div class=share-price><p>{P[1]}</p></div><p>{P[2]}</p></article>", P[:3]),
    "comments inside": (f"<article>{PS}<div class=comments><h3>Comments</h3>{COMMENT * 3}</div></article>{FOOT}", P),
    "nested comments": (f"<article>{PS}</article><section id=comments><article class=comment>{COMMENT}<article class=comment>{COMMENT}</article></article></section>", P),
    "replies": (f"<div class=post>{PS}</div><div class='comment-replies'>{COMMENT * 2}</div>", P),
    "cookie notice": (f"<div class=cookie-notice><p>We and our partners use cookies to make this page better for you. Please agree to it.</p></div><article>{PS}</article>", P),
    "notice in article": (f"<article><p>{P[0]}<div class=notice>This page needs a newer browser, please get one from its maker.</div><p>{P[1]}</article>", P[:2]),
    "sidebar": (f"<div class=has-sidebar><div class=post><h1>Head</h1>{PS}</div><div class=sidebar>{COMMENT}</div></div>", ["Head", *P]),
    "links in text": (f"{NAV}<article><p>{P[0]}<p><a href=x>A link that is a paragraph</a><p>{P[1]}</article>", [P[0], "A link that is a paragraph", P[1]]),
    "link list after": (f"<article>{PS}</article><div><a href=x>Another story of rivers</a> <a href=y>One more story of towns</a></div>", P),
    "list": (f"<article><p>{P[0]}<ul><li>salt</li><li>oil<li>bread</ul><p>{P[1]}</article>{FOOT}", [P[0], "salt", "oil", "bread", P[1]]),
    "table": (f"<article><p>{P[0]}<table><tr><td>a field of grass</td><td>two fields of corn</td></tr></table><p>{P[1]}</article>", [P[0], "a field of grass", "two fields of corn", P[1]]),
    "form around all": (f"<form action=/>{NAV}<div>{PS}</div>{FOOT}</form>", P),
    "form inside": (f"<article><p>{P[0]}<form>Your mail address, so that we can write to you <input></form><p>{P[1]}</article>", P[:2]),
    "references": ("<article><p>Caf&eacute; &amp; bar &lt;b&gt; &#8364;5 &#x1F600; and enough words after it to be a line of text.</article>", ["Café & bar <b> €5 😀 and enough words after it to be a line of text."]),
    "scripts": (f"<script>var a='<p>no</p>';</script><style>p{{}}</style><div><p>{P[0]}<script>x()</script></p><noscript>Turn it on</noscript><p>{P[1]}</div>", P[:2]),
    "hidden": (f"<article><p>{P[0]}<div hidden><p>{P[1]}</div><div style='display: none'>{P[2]}</div></article>", P[:1]),
    "text in small divs": ("<body>" + NAV + "".join(f"<div><div>{x}</div></div>" for x in P) + FOOT, P),
    "broken markup": (f"<div><p>{P[0]}<p>{P[1]}<b><div class=ad>Buy this now, it is cheap and it is good for you.</div></i></span><p>{P[2]}", P[:3]),
    "long footer": (f"<article><h1>Tion.</h1><p>Short text.</article>{FOOT}", ["Tion.", "Short text."]),
}


@pytest.mark.parametrize("name", GOLD)
def test_gold_pages(name):
    page, want = GOLD[name]
    assert html.main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body>{page}</body></html>").split("\n\n") == want
    assert html.main_text(page).split("\n\n") == want


def changed(monkeypatch, name, value):
    before = {k: html.main_text(p) for k, (p, _) in GOLD.items()}
    monkeypatch.setattr(html, name, value)
    return sum(html.main_text(p) != before[k] for k, (p, _) in GOLD.items())


def test_without_clusters_pages_change(monkeypatch):
    monkeypatch.setattr(html, "LOW", -np.inf)
    monkeypatch.setattr(html, "HIGH", np.inf)
    assert changed(monkeypatch, "two_clusters", lambda x: float(x.min())) > len(GOLD) / 2


def test_without_smoothing_pages_change(monkeypatch):
    assert changed(monkeypatch, "smooth", lambda x, at: x) >= 3


def test_names_alone_do_not_decide(monkeypatch):
    """Without any evidence of ratios, names and kinds don't give the texts."""
    assert changed(monkeypatch, "smooth", lambda x, at: np.full(len(x), 10.0)) >= 2


def test_smoothing_and_clusters_by_definition():
    rng = np.random.default_rng(2)
    x, at = rng.random(30), np.cumsum(rng.integers(1, 4, 30)).astype(float)
    for i, got in enumerate(html.smooth(x, at)):
        near = [j for j in range(30) if abs(i - j) <= 3]
        w = [np.exp(-0.5 * (at[i] - at[j]) ** 2) for j in near]
        assert got == pytest.approx(np.dot(w, x[near]) / sum(w))
    y = np.concatenate((rng.normal(0, 1, 40), rng.normal(9, 1, 20)))
    t = html.two_clusters(y)
    assert t == pytest.approx((y[y < t].mean() + y[y >= t].mean()) / 2)


def test_odd_pages(spark):
    deep = "<div>" * 400 + "<p>deep text of some length in here</p>"
    long = "<article>" + f"<p>{P[0]}</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "v", "<p>", "x"), (4, "w", deep, "x"), (5, "w", long, "x"), (5, "w", long, "x"), (6, "u", "Hi", "x"), (7, "u", "<nav><a>x</a></nav>", "x")]
    out = html.extract_text(pytest.importorskip("pyspark") and spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r.text for r in out}
    assert (got[1], got[2], got[None], got[4], got[6], got[7]) == ("", "", "", "deep text of some length in here", "Hi", "")
    assert [len(r.text) for r in out if r.page_id == 5] == [20_000 * (len(P[0]) + 2) - 2] * 2 and all(r.n_chars == len(r.text) for r in out)
    assert html.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_of_the_tables_keep_their_articles(spark):
    """Every page there has one article whose blocks are its text."""
    import re

    from exprflow.session import read_table

    for r in html.extract_text(read_table(spark, "/root/testdata/sf0.001", "pages")).join(read_table(spark, "/root/testdata/sf0.001", "pages").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)
        if body:
            blocks = [html.main_text(f"<article><p>{x}</p></article>") for x in re.split(r"</?(?:p|h1)>", body[1])]
            assert r.text == "\n\n".join(b for b in blocks if b)


FIRST, SECOND, THIRD = (f"The {n} paragraph of the article stands here, and it is long enough to be read as text." for n in ("first", "second", "third"))


def test_unclosed_short_elements_lose_nothing_behind_them():
    want = "\n\n".join((FIRST, SECOND, THIRD))
    for between in ("<select><option>a<option>b</select>", "<select><option selected>a</select>", "<button>Go", "<label>Name", "<label>Name<option>x", "<svg><g><title>t</svg>", "<textarea>x</textarea>", "<select><optgroup><option>a</select>"):
        assert html.main_text(f"<article><p>{FIRST}</p>{between}<p>{SECOND}</p><p>{THIRD}</p></article>") == want, between
    # the end of an element without text closes what is open in it, but not across a table's cell
    assert html.main_text(f"<article><p>{FIRST}</p><object><table><tr><td></object>x</td></tr></table></object><p>{SECOND}</p><p>{THIRD}</p></article>") == want


def test_time_grows_with_the_page_whatever_is_open():
    import time

    pages = ["<b>x " * 100_000, "<div>x " * 100_000, "<p><font>some words " * 50_000, ("<i><p>" + "<b>" * 50_000) + "</i>x" * 50_000, "<aside>x " * 20_000, "<li>x" * 50_000]
    began = time.perf_counter()
    for page in pages:
        html.main_text(page)
    assert time.perf_counter() - began < 60
