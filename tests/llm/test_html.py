"""Main text of pages, and the minimum cut by brute force."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest

from tracewright.llm import html_mincut as H

LONG = "This is a sentence of the article with enough words in it to look like running text, as it goes on."


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""), ("   ", ""), ("<p>" + LONG, LONG),
        (f"<nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{LONG}<p>{LONG}</article><footer>&copy; us</footer>", f"Title\n\n{LONG}\n\n{LONG}"),
        (f"<article><p>a &lt;b&gt; &amp; &eacute;&#233;&nbsp;c.\n\n d<br>e</p></article>", "a <b> & éé c. d e"),
        (f"<main><p>{LONG}</p><div class='comments'><p>{LONG}</p></div><aside>{LONG}</aside><form>{LONG}</form></main>", LONG),
        (f"<article><header><h1>T</h1></header><p>{LONG}</p><div id=\"cookie-notice\">We use cookies.</div></article>", f"T\n\n{LONG}"),
        (f"<header>Site</header><div class=ad>{LONG}</div><div><p>{LONG}</p></div>", LONG),
        (f"<article><script>var a='</p>';</script><style>p{{}}</style><!-- <p>x</p> --><p>{LONG}</p></article><script>un", LONG),
        (f"<article><p>{LONG}</p><ul><li>one<li>two</ul><p hidden>no</p></article>", f"{LONG}\n\none\n\ntwo"),
        (f"<article><p>{LONG}</p><table><tr><td>a<td>b</table></article><p>after", f"{LONG}\n\na\n\nb"),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
        (f"<article><div class='search results'><p>{LONG}</p></div></article>", LONG), (f"<div class='post follow-up'><p>{LONG}</p></div>", LONG),
        (f"<article><p title=\"a > b\">{LONG}</p><p class=it's>{LONG}</p></article>", f"{LONG}\n\n{LONG}"),
    ],
)
def test_main_text(page, text):
    assert H.main_text(page) == text


def test_minimum_cut_is_least():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 7))
        source, sink = rng.integers(0, 6, n).astype(float).tolist(), rng.integers(0, 6, n).astype(float).tolist()
        edges = [(a, b, float(rng.integers(1, 5))) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cost = lambda keep: sum(sink[i] if k else source[i] for i, k in enumerate(keep)) + sum(c for a, b, c in edges if keep[a] != keep[b])
        assert cost(H.minimum_cut(n, source, sink, edges)) == pytest.approx(min(map(cost, product([False, True], repeat=n))))


def test_extract(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "x"), (2, None, None, "x"), (3, "u", "", "x"), (1, "u", f"<article><p>{LONG}</p></article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.url, r.text, r.n_chars) for r in H.extract(pages).collect() if r.url)
    assert got == [(1, "u", LONG, len(LONG))] * 2 + [(3, "u", "", 0)]
    assert H.extract(pages.where("false")).count() == 0


def test_names_tell_parts_apart():
    noise = "".join(f'<div class="{c}">{LONG}</div>' for c in ("site-header", "sidebar", "subnav", "cookie-bar", "ad-slot", "user-comments", "notice"))
    body = f'<article class="post"><div class="entry-header"><h2>T</h2></div><div class="body-text"><p>{LONG}</p></div><div class="comments">{LONG}</div></article>'
    assert H.main_text(noise + body + '<div role="contentinfo">c</div>') == f"T\n\n{LONG}"
    assert H.main_text(noise + f"<div><h1>T</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>") == f"T\n\n{LONG}\n\nShort.\n\n{LONG}"


def test_whole_pages_equal_brute_force():
    """The text is that of the labelling of least cost, whatever the page and the weights."""
    rng = np.random.default_rng(8)
    parts = [f"<p>{LONG}</p>", "<p>Short</p>", "<p><a href=x>link</a></p>", "<h2>Title</h2>", "<div class=ad>Buy now.</div>", "<ul><li><a>one</a><li>two</ul>", "<div><div><p>deep, and a bit longer</p></div></div>"]
    changed = 0
    for n in range(80):
        inner = "".join(parts[i] for i in rng.integers(0, len(parts), int(rng.integers(1, 6))))
        page = f"<nav><a>Home</a></nav><article>{inner}</article><p>after</p>" if n % 2 else inner
        model = H.Model(H.PRIOR * rng.uniform(0.1, 1.2, len(H.PRIOR)), tuple(rng.uniform(0.2, 1.5, H.NEAR + 1)), float(rng.uniform(0.2, 1.5)))
        blocks = H.blocks_of(page)
        scores, edges = H.features(blocks) @ model.weights, H.smoothness(blocks, model)
        cost = lambda keep: sum(max(-x, 0) if k else max(x, 0) for x, k in zip(scores, keep)) + sum(c for a, b, c in edges if keep[a] != keep[b])  # noqa: B023, E731
        keep = H.kept(blocks, model)
        assert cost(keep) == pytest.approx(min(map(cost, product([False, True], repeat=len(blocks)))))
        assert H.main_text(page, model) == "\n\n".join(b.text for b, k in zip(blocks, keep) if k)
        changed += keep != [x > 0 for x in scores]
    assert changed > 10


def test_long_and_broken_pages_take_one_pass():
    import time

    for page in ("<a " * 300_000, "<i>" * 100_000 + "<p>" * 100_000, '<a "' * 200_000, "<ul>" + "<b>" * 100_000 + "<td>x" * 50_000, "<div>x" * 50_000, "<" * 500_000, "<!--" * 200_000):
        began = time.process_time()
        H.main_text(page)
        assert time.process_time() - began < 5


#: Names of elements that hold the article say nothing about it.
WRAPPED = [
    f"<div class='site has-sidebar'><article><p>{LONG}</p></article></div>", f"<div class='post no-sidebar'><p>{LONG}</p></div>", f"<div class='post comments-open'><p>{LONG}</p></div>",
    f"<article><div class='notice-board'><p>{LONG}</p></div></article>", f"<section class='legal'><p>{LONG}</p></section>", f"<div class='side by side'><p>{LONG}</p></div>",
    f"<div style='overflow: hidden '><p>{LONG}</p></div>", f"<form id='aspnetForm'><article><p>{LONG}</p></article></form>", f"<article><p title=\"a hidden door\">{LONG}</p></article>",
    f"<div class='sidebar-layout menu-open'><nav><a>Home</a></nav><article><p>{LONG}</p></article><div class='sidebar'>{LONG}</div></div>", f"<header class='menu'><main><p>{LONG}</p></main></header>",
]


@pytest.mark.parametrize("page", WRAPPED)
def test_wrappers_lose_nothing(page):
    assert H.main_text(page) == LONG


@pytest.mark.parametrize(
    "part", ["<div class='comments'>{}</div>", "<aside>{}</aside>", "<form>{}<input></form>", "<div class='cookie-bar'>{}</div>", "<div class='related'><article><h3>Other</h3></article>{}</div>",
             "<p hidden>{}</p>", "<p HIDDEN=''>{}</p>", "<p style='color:red; DISPLAY : none'>{}</p>", "<p aria-hidden=true>{}</p>", "<nav>{}</nav>", "<div id='disqus'><p>{}</p></div>"],
)
def test_marked_parts_go(part):
    page = f"<article><h1>T</h1><p>{LONG}</p>{part.format('Something else that was said here.')}<p>{LONG}</p></article>"
    assert H.main_text(page) == f"T\n\n{LONG}\n\n{LONG}"
    assert H.main_text(f"<main><a title='the hidden gem'>{LONG}</a><p>{LONG}</p></main>") == f"{LONG}\n\n{LONG}"


def test_fit(spark):
    """Marks teach, and without any the text is found by text, place and edges."""
    rng = np.random.default_rng(12)
    words = lambda n: " ".join(f"word{x}" for x in rng.integers(0, 99, n))

    def page(i, marks):
        tag = lambda name, inner: f"<{name}>{inner}</{name}>" if marks else f"<div>{inner}</div>"
        links = "".join(f"<li><a href=x>{words(2)}</a></li>" for _ in range(6))
        body = "".join(f"<p>{words(int(rng.integers(2, 60)))}.</p>" for _ in range(6))
        return tag("nav", f"<ul>{links}</ul>") + f"<div{' class=ad' * marks}>{words(9)}.</div>" + tag("article", f"<h1>{words(4)}</h1>{body}") + tag("footer", words(5)), body

    made = [page(i, True) for i in range(60)]
    pages = spark.createDataFrame([(i, "u", p) for i, (p, _) in enumerate(made)] + [(99, "u", None)], "page_id long, url string, html string")
    model = H.fit(pages)
    free = np.array([f not in H.MARKED for f in H.FEATURES])
    assert not np.allclose(model.weights[free], H.PRIOR[free]) and (model.weights[~free] == H.PRIOR[~free]).all()
    assert 0 < max(model.next) <= H.STRONGEST and model.next != H.DEFAULT.next
    right = 0
    for i in range(40):
        bare, body = page(i, False)
        blocks = H.blocks_of(bare)
        keep = H.kept(blocks, model)
        wanted = [b.text in body.replace("<p>", "").replace("</p>", " ") or b.heading for b in blocks]
        right += sum(k == w for k, w in zip(keep, wanted, strict=True)) / len(blocks)
    assert right / 40 > 0.98
    assert {r.page_id: r.text for r in H.extract(pages, model).collect()}[99] == ""
    assert H.fit(pages.where("html is null")) is not None and (H.fit(pages.where("html is null")).weights == H.PRIOR).all()
