import html as references
import re

import numpy as np
import pytest

from rillflow.llm import layouts, pages
from rillflow.llm.labeller import Labeller, Places


@pytest.fixture(scope="module")
def model():
    return pages.production_model()


BLOG = """<!doctype html><html><head><title>T</title><script>if (a < b) { x("<p>no</p>"); }</script><style>p { color: red }</style></head><body class="home">
<header id="top"><a href="/">Site name</a><nav><ul><li><a href="/a">Home</a><li><a href="/b">About us</a></ul></nav><form action="/s"><input name="q"><button>Search</button></form></header>
<div class="cookie-notice">We use cookies to make this page better. <button>Accept</button></div>
<article class="post"><h1>On  the &amp; of
 things</h1><p>First paragraph of the text, with <b>bold</b> and a <a href="/x">link</a>.<p>Second one&nbsp;here &lt;tag&gt;.
<div class="advertisement">Buy things now. They are cheap and good.</div>
<p>Third one ends it.</p><ul><li>An item<li>Another item</ul></article>
<aside class="sidebar"><h3>Popular</h3><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></aside>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>I read this text and liked it very much.</p></div><div class="comment"><p>So did I, I have to say.</p></div></section>
<footer><p>&copy; 2024 Site name. All rights reserved.</p></footer></body></html>"""


def test_a_page_by_hand(model):
    expected = ["On the & of things", "First paragraph of the text, with bold and a link.", "Second one here <tag>.", "Third one ends it.", "An item", "Another item"]
    assert pages.label_pages(model, [BLOG]) == [expected]


def truths(seed, count):
    for page in layouts.generate(count, seed):
        reader = pages.TruthReader()
        blocks = reader.read(page)
        yield page, [b[0] for b, main in zip(blocks, reader.truth) if main], [b[0] for b, main in zip(blocks, reader.truth) if not main]


def test_pages_of_unseen_layouts(model):
    held = list(truths(99, 300))
    found = pages.label_pages(model, [h for h, _, _ in held])
    right = sum(f == main for f, (_, main, _) in zip(found, held)) / len(held)
    shared = sum(len(set(f) & set(main)) for f, (_, main, _) in zip(found, held))
    recall, precision = shared / sum(len(set(m)) for _, m, _ in held), shared / sum(len(set(f)) for f in found)
    print(f"pages exactly right {right:.3f}, recall of blocks {recall:.4f}, precision {precision:.4f}")
    assert right > 0.75 and recall > 0.98 and precision > 0.98


def between_tags(page):
    """The article of the given tables' pages, read by their own pattern."""
    article = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = (" ".join(references.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
    return "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_pages(spark, model, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("page_id", "url", "html")
    expected = {r.page_id: (r.url, between_tags(r.html)) for r in table.collect()}
    found = {r.page_id: r for r in pages.main_text(table, model).collect()}
    assert found.keys() == expected.keys()
    right = sum((found[i].url, found[i].text) == expected[i] for i in expected)
    assert right >= 0.99 * len(expected) and all(r.n_chars == len(r.text) for r in found.values())


def test_odd_pages(spark, model):
    deep, long = "<div>" * 3000 + "x" + "</div>" * 3000, "<article>" + "<p>Some words of a text stand here.</p>" * 5000 + "</article>"
    rows = [
        (1, None, None), (2, "u", ""), (3, "u", " \n "), (4, "u", "<p"), (5, "u", "<script>alert(1)"), (6, "u", "</p></div>&amp;&#0;&bogus;"), (7, "u", deep), (8, "u", long), (None, "u", long), (8, "u", long),
        (9, "u", "<table><tr><td>a<tr><td>b</table><li>c<li>d<select><option>e<option>f"), (10, "u", "<!-- <p>no</p> --><![CDATA[x]]><?php y ?>"),
    ]
    table = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id LONG, url STRING, html STRING, text STRING, n_chars LONG")
    found = pages.main_text(table, model)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = {}
    for r in found.collect():
        got.setdefault(r.page_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows) and len(got[8]) == 2 and len(got[None]) == 1
    assert all(got[i][0].text == "" and got[i][0].n_chars == 0 for i in (1, 2, 3, 4, 5, 10))
    assert got[8][0].text == "\n".join(["Some words of a text stand here."] * 5000) and got[8][0].text == got[8][1].text == got[None][0].text
    assert pages.main_text(table.limit(0), model).collect() == []


def test_blocks_of_careless_tags():
    read = lambda h: [b[0] for b in pages.BlockReader().read(h)]
    assert read("<p>a <b>b<br>c<p>d</b> e<div>f</div>g</p>h") == ["a b c", "d e", "f", "g", "h"]
    assert read("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert read("<noscript><p>x</p></noscript>a<style>b</style> c<svg><text>d</text></svg>") == ["a c"]
    tags = [b[3] for b in pages.BlockReader().read("<div><p>a</div>b<td>c<td>d</span>e")]
    assert tags == ["p", "", "td", "td"]


def test_places_do_not_depend_on_parts_or_neighbours():
    blocks = pages.BlockReader().read(next(layouts.generate(1, 3)) + BLOG + "out of all elements")
    whole = pages.block_places(blocks, 0, len(blocks))
    parts = [pages.block_places(blocks, i, min(i + 3, len(blocks))) for i in range(0, len(blocks), 3)]
    joined = Places.joined(parts)
    assert np.array_equal(whole.vectors, joined.vectors)
    assert all(np.array_equal(whole.bags[i], joined.bags[j]) for i, j in zip(whole.which, joined.which))


def some_places(r, n, width, numbers=7):
    return Places(r.normal(size=(n, width)), [np.array([1, 3]), np.array([0]), np.array([2, 3, 6])], np.arange(n) % 3)


def test_gradients_are_those_of_differences():
    r = np.random.default_rng(1)
    model, x, lengths, y = Labeller(5, 7, 3), some_places(r, 9, 5), np.array([4, 2, 3]), r.integers(0, 2, 9).astype(bool)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    model.weights["bags"] += r.normal(0, 0.3, model.weights["bags"].shape)
    loss, grads = model.gradients(x, lengths, y)
    p = model.scores(model.project(x), lengths)
    assert abs(loss + np.mean(np.log(np.where(y, p, 1 - p)))) < 1e-4
    for name, g in grads.items():
        for _ in range(8):
            at = tuple(r.integers(0, s) for s in g.shape)
            moved = []
            for step in (1e-2, -1e-2):
                model.weights[name][at] += step
                moved.append(model.gradients(x, lengths, y)[0])
                model.weights[name][at] -= step
            assert abs((moved[0] - moved[1]) / 2e-2 - g[at]) < 1e-3


def test_scores_do_not_depend_on_the_batch():
    r = np.random.default_rng(2)
    model, lengths = Labeller(6, 7, 4), np.array([1, 9, 0, 5, 20, 5])
    sent = model.project(some_places(r, 40, 6))
    one = np.concatenate([model.scores(sent[a : a + n], np.array([n])) for a, n in zip(np.cumsum(lengths) - lengths, lengths) if n])
    assert np.allclose(model.scores(sent, lengths), one, atol=1e-6)
