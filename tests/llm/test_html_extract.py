from __future__ import annotations

import random
from itertools import combinations

import pytest

from sondeframe.llm import html_extract as X

PAGE = """<!DOCTYPE html><html lang="en"><head><title>A title</title><style>p{margin:0}</style><script>var t="</p>";if(a<b)x();</script></head>
<body><nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul></nav><!-- an advert --><div class="ad">Buy this now.</div>
<div class="cookie-notice">We use cookies.</div><article><header><h1>The   heading &amp; more</h1></header>
<p>First <b>bold</b> text&nbsp;with &lt;signs&gt; and &#x41;&#66;.<br>Next line<p>Second, unclosed
<ul><li>item one<li>item two</ul><aside>See also this</aside><table><tr><td>cell a</td><td>cell b</td></tr></table></article>
<section id="comments"><h2>Comments</h2><p>I disagree with all of it, and say so at length here.</p></section>
<form><p>Your name</p><button>Send</button></form><footer>&copy; nobody</footer></body></html>"""
TEXT = "The heading & more\n\nFirst bold text with <signs> and AB. Next line\n\nSecond, unclosed\n\nitem one\n\nitem two\n\ncell a\n\ncell b"


def test_article():
    assert X.extract(PAGE) == TEXT


@pytest.mark.parametrize("page", [None, "", "   ", "<html></html>", "<script>only()</script>", "<nav>menu</nav>", "<!-- open", "<p", "<"])
def test_pages_without_text(page):
    assert X.extract(page) in ("", "<")


def test_links_and_short_blocks_at_the_ends_of_an_article():
    items = "".join(f"<li><i><a href='/{k}'>link{k}</a></i></li>" for k in range(30))
    page = f"<body><nav>menu words here</nav><article><p><a href='/'>A link first</a></p><p>text</p><ul>{items}</ul></article><article class='comment'><p>no, no, no</p></article></body>"
    assert X.extract(page) == "\n\n".join(["A link first", "text", *[f"link{k}" for k in range(30)]])


def test_unmarked_page_takes_the_best_run():
    words = " ".join(f"word{k}" for k in range(60))
    links = "".join(f'<li><a href="/{k}">link {k} with words</a></li>' for k in range(20))
    page = f"<body><ul>{links}</ul><div><p>{words}</p><p>{words}</p></div><ul>{links}</ul></body>"
    assert X.extract(page) == f"{words}\n\n{words}"


def test_best_run_against_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        scores = [rng.uniform(-2, 2) for _ in range(rng.randrange(12))]
        sums = {(a, b): sum(scores[a:b]) for a, b in combinations(range(len(scores) + 1), 2)}
        begin, end = X.best_run(scores)
        assert sum(scores[begin:end]) == pytest.approx(max([0.0, *sums.values()]))


def test_table(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (1, "u", PAGE), (None, "x", "<article><p>" + "long " * 50_000 + "</p></article>")]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    found = sorted((tuple(r) for r in X.extract_pages(df).collect()), key=str)
    want = [(1, "u", TEXT, len(TEXT))] * 2 + [(2, None, "", 0), (3, "u", "", 0), (None, "x", ("long " * 50_000).strip(), 249_999)]
    assert found == sorted(want, key=str)
    assert X.extract_pages(df.limit(0)).count() == 0


def test_fitted_weights_keep_their_signs(spark):
    weights = X.fit_weights(spark.createDataFrame([(k, PAGE) for k in range(5)], "page_id long, html string"))
    assert all(w < 0 for n, w in weights.items() if n.startswith("t:") or n.endswith(":a"))
    assert all(w > 0 for n, w in weights.items() if n.startswith("w:") and n.endswith("-"))
    assert X.extract(PAGE, weights) == TEXT


WRAPPERS = ['<div class="site has-sidebar">', '<div class="no-sidebar">', '<div id="page" class="share-enabled">', '<form action="/page.aspx">', '<div class="has-comments">']


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_a_cued_wrapper_of_the_page_hides_no_article(wrapper):
    inner = PAGE[PAGE.index("<nav>") : PAGE.index("</body>")]
    assert X.extract(f"<body>{wrapper}{inner}</{wrapper[1:5].strip()}></body>") == TEXT


@pytest.mark.parametrize("wrapper", WRAPPERS[:4])
def test_a_cued_wrapper_of_an_unmarked_page(wrapper):
    words = " ".join(f"word{k}" for k in range(60))
    tail = '<div class="sidebar"><p>beside it</p></div><div class="ad"><p>Buy this now.</p></div>'
    comments = f'<div id="comments"><p>{words} {words} {words} no</p></div>'
    page = f"<body>{wrapper}<p>{words}</p>{tail}</{wrapper[1:5].strip()}>{comments}</body>"
    assert X.extract(page) == words


def test_cued_elements_beside_the_text_stay_out():
    words = " ".join(f"word{k}" for k in range(60))
    page = f'<body><p>{words}</p><div class="related"><article><p>a teaser</p></article></div><form><p>Your name</p></form><div class="widget"><p>one two</p></div></body>'
    assert X.extract(page) == words


def bare(page):
    import re

    return re.sub(r"<(/?)(article|main)\b", r"<\1div", page)


def fitted(pages):
    from collections import Counter

    inside, outside = Counter(), Counter()
    for page in pages:
        a, b = X.count_features(page)
        inside.update(a)
        outside.update(b)
    return X.weights_of([(k, inside[k], outside[k]) for k in sorted({*inside, *outside})])


def site(rng, names):
    """A page of a site with its own class names; between the article's paragraphs stands what names[1] holds."""
    say = lambda n: " ".join(f"word{rng.randrange(300)}" for _ in range(n))
    body = [say(rng.randrange(15, 60)) for _ in range(rng.randrange(3, 7))]
    parts = "".join(f"<p>{b}</p>" for b in body[:2]) + f'<div class="{names[1]}"><p>{say(9)}</p></div>' + "".join(f"<p>{b}</p>" for b in body[2:])
    page = (f'<body><div class="{names[0]}"><p>{say(12)}</p></div><ul><li><a href="/">{say(2)}</a></li><li><a href="/">{say(2)}</a></li></ul>'
            f'<div class="{names[1]}"><p>{say(9)}</p></div><article>{parts}</article><div class="{names[0]}"><p>{say(8)}</p></div><p>{say(2)}</p></body>')
    return page, "\n\n".join(body)


def test_class_words_are_learned_from_marked_pages(rng):
    """Names that no list has; the marks are hidden when pages are read, and their weight says nothing."""
    names = ("qq-strip", "zz-box")
    marked = [site(rng, names)[0].replace(f'<div class="{names[1]}"><p>', f'<aside class="{names[1]}"><p>', 0) for _ in range(60)]
    outside_only = [p.replace(p[p.index("<article>") : p.index("</article>")], "<article><p>" + " ".join(f"word{k}" for k in range(80)) + "</p>") for p in marked]
    weights = fitted(outside_only)
    assert weights["c:qq"] < X.LEAVE and weights["c:zz"] < X.LEAVE
    tests = [site(rng, names) for _ in range(40)]
    assert sum(X.extract(bare(page), weights) == text for page, text in tests) >= 39  # the last two words stand alone
    assert sum(X.extract(bare(page)) == text for page, text in tests) == 0  # fixed weights don't know the names


def test_the_scan_leaves_stray_words_out(rng):
    """Words of an ordinary paragraph far from the text, with links between, are of another run."""
    words = " ".join(f"word{k}" for k in range(60))
    links = "".join(f'<li><a href="/{k}">link {k} of the page</a></li>' for k in range(9))
    page = f"<body><p>two words</p><ul>{links}</ul><div><p>{words}</p></div><ul>{links}</ul><p>some more words</p></body>"
    assert X.extract(page) == words


def test_the_run_is_the_best_of_all_runs(rng):
    """The whole extraction against every run of a page's tokens."""
    names = ["p", "div", "li", "a", "h2", "b", "nav", "section", "td", "form", "article"]
    for _ in range(150):
        page = ""
        for _ in range(rng.randrange(14)):
            name = rng.choice(names)
            attribute = rng.choice(["", "", ' class="ad"', ' id="comments"', ' class="body text"'])
            page += rng.choice([f"<{name}{attribute}>", f"</{name}>", " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(5)))])
        found, scores, left = X.scored(page)
        best = max((sum(scores[a:b]), -a) for a in range(len(scores) + 1) for b in range(a, len(scores) + 1))[0]
        runs = {"".join("".join(t.text for t, gone in zip(found[a:b], left[a:b], strict=True) if not gone).split())
                for a in range(len(scores) + 1) for b in range(a, len(scores) + 1) if abs(sum(scores[a:b]) - best) < 1e-9}
        assert "".join(X.extract(page).split()) in runs


@pytest.mark.parametrize("page", [
    "<body>" + "<span>" * 100_000 + "</b>" * 300_000 + "<p>end</p>", "<li><ul>" + "<span>" * 100_000 + "<li></li>" * 100_000, "<p>" + "<i>" * 100_000 + "<p>x" * 100_000,
    '<div class="ad">' * 60_000 + "<article>x</article>" * 60_000, "<b>" * 500_000,
], ids=["stray ends", "list items", "paragraphs", "nested", "open"])
def test_time_is_linear(page):
    import time

    began = time.process_time()
    X.extract(page)
    assert time.process_time() - began < 6


def test_items_and_cells_close_what_they_must():
    page = "<article><table><tr><td>a<td>b<tr><th>c<td><ul><li>d<li>e</ul></table><dl><dt>f<dd>g<dt>h</dl><p>i<div>j</div></article>"
    assert X.extract(page).split("\n\n") == list("abcdefghij")
