"""What of a page is its article: names of elements, comments, teasers, long runs of siblings."""

import time

import pytest

from lumenlake.llm import html


def text(page):
    root = html.parse(page)
    return " ".join(filter(None, map(html.text_of, html.region(root, html.main_path(html.skeleton(root))))))


LONG = "The long story goes on and on and does not end before the page does. " * 3
SAID = LONG.strip()


@pytest.mark.parametrize(
    "page,want",
    [
        (f'<body><div class="content no-sidebar"><article><p>{LONG}</p></article></div><div class="sidebar">Links</div></body>', SAID),
        (f'<body><div class="has-sidebar"><div><p>{LONG}</p><p>{LONG}</p></div><div class="sidebar">Links</div></div></body>', f"{SAID} {SAID}"),
        (f'<body><article><h1>Shares</h1><div class="share-price">Price 5</div><p>{LONG}</p></article></body>', f"Shares Price 5 {SAID}"),
        (f'<body><div><div class="post-header"><h1>Title</h1></div><p>{LONG}</p></div></body>', f"Title {SAID}"),
        (f'<body><article><p>{LONG}</p><article class="comment"><p>I do not agree with any of it.</p></article></article></body>', SAID),
        (f'<body><div class="comments"><article class="comment">{LONG * 9}</article></div><article><p>{LONG}</p></article></body>', SAID),
        (f'<body><main><p>{LONG}</p></main><article class="teaser"><p>teaser</p></article></body>', SAID),
        (f'<body><main><div class="sidebar">Links</div><article><p>{LONG}</p></article><p>More</p></main></body>', SAID),
        (f'<body><div class="sidebar content"><main><p>{LONG}</p></main></div></body>', SAID),
        (f'<body><article><div class="ad">Buy</div><div class="social share">Share</div><p>{LONG}</p></article></body>', SAID),
        (f'<body><div class="promo">Buy now</div><div id="story"><p>{LONG}</p></div><div class="cookie-notice">We use cookies</div></body>', SAID),
    ],
)
def test_the_article_stays_and_nothing_else(page, want):
    assert text(page) == want


def test_long_runs_of_siblings_align_in_proportion():
    def page(n, extra):
        return "<body><article>" + extra + "".join(f"<h2>{i}</h2><p>text {i}</p>" for i in range(n)) + "<h3>end</h3></article></body>"

    took = []
    for n in (7_500, 15_000):
        start = time.perf_counter()
        a, b = html.skeleton(html.parse(page(n, "<p>lead</p>"))), html.skeleton(html.parse(page(n + 40, "<ul><li>x</ul><p>lead</p><p>two</p>")))
        w = html.merge(a, b)
        took.append(time.perf_counter() - start)
        assert html.main_path(w)[-1] == "article"
    assert took[1] < 60


@pytest.mark.parametrize("x,y", [("abcabc", "abxcabc"), ("", "ab"), ("ab", ""), ("aab", "ab"), ("xyz", "abc"), ("hphphp", "phphph")])
def test_alignment_keeps_order_and_tags(x, y, monkeypatch):
    for cells in (html.CELLS, 0):
        monkeypatch.setattr(html, "CELLS", cells)
        pairs = html._common(list(x), list(y))
        assert all(x[i] == y[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_partitioning_does_not_change_the_texts(spark):
    layouts = ['<body><div class="top">Site {i}</div><article><h1>T{i}</h1><p>{t}</p></article></body>', '<body><div id="page"><div id="text"><p>{t}</p><p>again {i}</p></div><ul><li>a<li>b</ul></div></body>', "<body><table><tr><td>menu</td><td><p>{t}</p></td></tr></table></body>"]
    rows = [(i, f"http://host{i % 3}.org/{i}", layouts[i % 3].format(i=i, t=LONG + str(i))) for i in range(60)]
    got = [{r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)).collect()} for n in (1, 7)]
    assert got[0] == got[1] and all(f"{SAID} {i}" in t for i, t in got[0].items())
