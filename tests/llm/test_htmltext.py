"""Main texts of planted pages, and densities against their definition."""

import math
import random
import re
import time
from html import unescape

import pytest

from tallyrank.llm import htmltext
from tallyrank.llm.htmltext import main_text

LONG = "Words of an article that go on for a good while. " * 6
NEXT = "The story then turns to another matter altogether. " * 5


def lines(*parts):
    return "\n".join(" ".join(p.split()) for p in parts)


JUNK = f"""<header class="site-header"><h1>Site</h1><p>{LONG}</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice"><p>{NEXT}</p></div><aside><p>{LONG}</p></aside><div class="ad">{NEXT}</div>
<form action="/s"><label>Mail</label><input name="q"><p>Join us</p></form><div id="sidebar-left"><p>{NEXT}</p></div>
<section id="comments"><article class="comment"><p>{LONG}</p></article></section>
<script>document.write("<p>no</p>")</script><style>p > b {{}}</style><!-- <p>no</p> --><footer>&copy; us</footer>"""
BODY = f"<h1>A title</h1><p>{LONG}</p><p>Be.</p><p>{NEXT}</p><ul><li>one</li><li>two</li></ul><p>End &amp; done.</p>"
WANT = lines("A title", LONG, "Be.", NEXT, "one", "two", "End & done.")


@pytest.mark.parametrize("page", [
    f"<html><body>{JUNK}<article>{BODY}</article>{JUNK}</body></html>",
    f"<body>{JUNK}<main><div class='x'>{BODY}</div></main>{JUNK}",
    f"<body class='has-sidebar'>{JUNK}<div id=wrap><div class='content with-sidebar'>{BODY}</div></div>{JUNK}",
    f"<body>{JUNK}<div role='main'>{BODY}<div class='share-buttons'><a href=1>a</a></div></div>",
    f"<body>{JUNK}<h1>A title</h1><div class=text>{BODY.partition('</h1>')[2]}</div>{JUNK}",
    f"<body>{JUNK}{BODY}{JUNK}",
    f"<form id=aspnet><div>{JUNK}<div>{BODY}</div></div></form>",
    f"<article>{BODY}<nav><a href=1>next</a></nav><div><a href=1>More of it</a> <a href=2>Yet more</a></div></article>",
    f"<article><header><h1>A title</h1><span>by someone</span></header>{BODY.partition('</h1>')[2]}</article>",
    f"<article>{BODY.replace('</p>', '').replace('</li>', '')}<footer>f",
    f"<ARTICLE>{BODY.replace('<p>', '<P CLASS=x data-a="1 > 0">')}</ARTICLE>",
    f"<article>{BODY.replace('<p>', '<p><b>').replace('</p>', '<br></p>')}</article>",
    f"<table><tr><td><ul><li><a href=1>a</a><li><a href=2>b</a></ul><td>{BODY}</table>",
    f"<article><section>{BODY.partition('<ul>')[0]}</section><section><ul>{BODY.partition('<ul>')[2]}</section></article>",
])
def test_planted_pages(page):
    assert main_text(page) == WANT


def test_blocks_and_references():
    page = "<p> a  b<br>c\t<i>d</i>e &lt;p&gt; &eacute;&#233;&#x1F4A5; &amp;amp; </p>\n<p>f<div>g</div>h"
    assert main_text(page) == "a b c de <p> éé💥 &amp;\nf\ng\nh"


def test_nothing_to_find():
    for page in (None, "", " \n ", "<nav>x</nav>", "<!-- x", "<script>x", "<a", "<p", "</p>", "<!doctype html>", "<br>"):
        assert main_text(page) == ""
    assert main_text("just  text") == "just text" and main_text("1 < 2 & 3 <") == "1 < 2 & 3 <"


def test_whole_pages_in_linear_time():
    started = time.time()
    assert main_text("<div>" * 40_000 + "x" + "</div>" * 40_000) == "x"
    assert main_text("<b>" * 40_000 + "</i>" * 40_000 + "x") == "x"
    assert main_text("<ul><li>" + "<div>" * 20_000 + "<li>y" * 20_000).count("y") == 20_000
    assert main_text("<p " + 'a="b" ' * 50_000 + ">x") == "x"
    assert main_text('<p a="' * 20_000) == ""
    assert main_text(f"<article>{BODY * 3_000}</article>") == "\n".join([WANT] * 3_000)
    assert time.time() - started < 60


def plain_density(c, t, l, k, share):
    if c == 0:
        return 0.0
    t, l1, k, rest = t or 1, l or 1, k or 1, c - l or 1
    return c / t * math.log((c / l1) * (t / k) if (c / l1) * (t / k) > 1 else 1, math.log(c / rest * l1 + share * c + math.e))


def test_densities_are_as_defined():
    """Random trees, counted from the root down for every element anew."""
    rng = random.Random(4)

    def grow(depth):
        kids = [grow(depth - 1) for _ in range(rng.randrange(0, 4) if depth else 0)]
        return (rng.choice(["div", "p2", "a"]), "x" * rng.randrange(0, 30), kids)

    def html(node):
        return f"<{node[0]}>{node[1]}{''.join(map(html, node[2]))}</{node[0]}>"

    def counts(node, linked):
        linked = linked or node[0] == "a"
        below = [counts(k, linked) for k in node[2]]
        return (
            len(node[1]) + sum(b[0] for b in below), sum(1 + b[1] for b in below),
            (len(node[1]) if linked else 0) + sum(b[2] for b in below), (node[0] == "a") + sum(b[3] for b in below),
        )

    for _ in range(60):
        # no link within a link: a new one closes the one before it
        tree = ("div", "t" * 20, [(t, s, [k for k in kids if "<a>" not in html(k)] if t == "a" else kids) for t, s, kids in grow(3)[2]])
        if "<a>" in re.sub(r"<a>(?:(?!<a>).)*?</a>", "", html(tree)):
            continue
        c, t, l, k = counts(tree, False)
        share = l / c
        assert htmltext.density(c, t, l, k, share) == pytest.approx(plain_density(c, t, l, k, share))


def test_the_largest_sum_is_found():
    """Sums and their maximum against a search over all elements."""
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(1, 30)
        parents = [-1] + [rng.randrange(0, i) for i in range(1, n)]
        own = [rng.choice([0.0, 1.0, 2.0, 3.5]) for _ in range(n)]
        direct = [rng.choice([0.0, 0.5]) for _ in range(n)]
        sums = htmltext._sums(parents, ["div"] * n, own, direct)
        for i in range(n):
            kids = [j for j in range(n) if parents[j] == i]
            assert sums[i] == pytest.approx(sum(own[j] for j in kids) + direct[i] if kids else own[i])
        best = htmltext._best_below(parents, sums)
        for i in range(n):
            below, todo = [], [i]
            while todo:
                below.append(todo.pop())
                todo += [j for j in range(n) if parents[j] == below[-1]]
            assert sums[best[i]] == max(sums[j] for j in below)


def test_query_extracts_the_articles(spark, sf_dir):
    from tallyrank.llm.queries import REGISTRY

    def article(html):
        inner = re.search(r"<article>(.*?)</article>", html, re.S).group(1)
        parts = re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))
        found = (" ".join(unescape(re.sub(r"<[^>]+>", "", part)).split()) for part in parts)
        return "\n".join(p for p in found if p)

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = REGISTRY["op13_html_text"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["url"] == pages[r["page_id"]]["url"]
        assert r["text"] == article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"])


def test_awkward(awkward, none):
    got = awkward.select("doc_id", htmltext.extracted(awkward["text"]).alias("text")).collect()
    assert len(got) == 13 and all(r["text"] is not None for r in got)
    assert none.select(htmltext.extracted(none["text"])).collect() == []
