import time

import numpy as np
import pytest

from tidemark.llm.html_blocks import BlockLabeller, blocks_of, extract_main_text, features, padded, weak_label

SF = "/root/testdata/sf0.01/pages.parquet"


def texts(page):
    return [b.text for b in blocks_of(page)]


def test_blocks():
    assert texts("<p>a &amp;\n b<b>old</b> <a href='x>y'>l</a><p>two<br>three</p>tail") == ["a & bold l", "two three", "tail"]
    assert texts("<script>var t='</p>';<p></script><style>p{}</style><!-- <p>x</p> --><p>kept") == ["kept"]
    assert texts("1 < 2 <3<p>x <") == ["1 < 2 <3", "x <"]
    assert texts("<p>cut <a hre") == ["cut"] and texts("<p>cut &am") == ["cut &am"] and texts("<!-- open <p>x") == []
    assert texts("") == [] and texts("<p> \n </p>") == [] and texts("<ul><li>a<li>b</ul>") == ["a", "b"]
    assert blocks_of('<div class="Ad-Top x1" id=side><p>t')[0].path == ("<div", ".ad", ".top", ".x", ".side", "<p")
    assert len(texts("<p>" * 50_000 + "x")) == 1 and len(texts('<p a="' * 2000)) <= 1


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    model = BlockLabeller()
    page = [b for i in range(3) for b in blocks_of(f"<nav>x{i}</nav><p>some text {i}</p>")]
    x, mask = padded([features(page), features(page[:2])])
    labels = (rng.random(mask.shape) < 0.5).astype(np.float32)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}

    def loss():
        p = 1 / (1 + np.exp(-model.scores(x.astype(float), mask)))
        return -((labels * np.log(p) + (1 - labels) * np.log(1 - p)) * mask).sum() / mask.sum()

    grads = model._gradients(x, mask, labels)
    for name in ("fw_h", "bw_h", "fw_b", "bw_x", "out"):
        w = model.weights[name]
        # the largest gradient; states are kept in single precision, hence the wide step
        at = np.unravel_index(np.abs(grads[name]).argmax(), w.shape)
        old = w[at]
        w[at] = old + 1e-2
        up = loss()
        w[at] = old - 1e-2
        down = loss()
        w[at] = old
        assert (up - down) / 2e-2 == pytest.approx(grads[name][at], rel=0.05, abs=1e-4)


ARTICLE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>
<div class="cookie-notice">We use cookies.</div><main><article><h1>Title &lt;x&gt;</h1><p>First &amp; <b>bold</b> text.
<p>Second paragraph that is long enough.<aside class="related">See also</aside><p>Third one.</article>
<section id="comments"><div class="comment"><p>Nice!</p></div></section></main><div class="sidebar"><p>Side</p></div>
<footer>(c)</footer></body></html>"""


def test_main_text_of_pages(spark):
    pages = spark.read.parquet(SF)
    extra = spark.createDataFrame([(9001, "u", ARTICLE), (9002, None, None), (None, "v", ""), (9001, "u", ARTICLE)], pages.schema)
    rows = extract_main_text(pages.unionByName(extra)).collect()
    html = {r.page_id: r.html for r in pages.collect()}
    assert len(rows) == len(html) + 4
    for r in rows:
        assert r.n_chars == len(r.text)
        if r.page_id in html:
            assert r.text == "\n".join(b.text for b in blocks_of(html[r.page_id]) if weak_label(b))
    made = [r for r in rows if r.page_id == 9001]
    assert len(made) == 2 and made[0].text == made[1].text == (
        "Title <x>\nFirst & bold text.\nSecond paragraph that is long enough.\nThird one.")
    assert all(r.text == "" for r in rows if r.page_id in (9002, None))
    assert extract_main_text(pages.limit(0)).count() == 0


LAYOUTS = {
    "body with a sidebar class": ('<body class="with-sidebar"><article class="post has-comments"><h1>T</h1><p>One is here.</p></article>'
                                  '<div class="sidebar"><p>Side</p></div></body>', "T\nOne is here."),
    "header of the article": ("<body><header><p>Site</p></header><article><header><h1>Big Title</h1></header><p>Body text here.</p></article>"
                              "</body>", "Big Title\nBody text here."),
    "privacy notice": ('<body><main><h1>T</h1><p>Words of the text.</p></main><div class="gdpr"><p>We value your privacy. Accept all.</p></div>',
                       "T\nWords of the text."),
    "wrapper named after search": ('<div class="search-page"><h1>T</h1><p>First one.</p><p>Second one.</p></div><footer>x</footer>',
                                   "T\nFirst one.\nSecond one."),
    "wrapper around main": ('<div id="content-sidebar-wrap" class="sidebar"><main><p>Inside it.</p></main></div>', "Inside it."),
    "comments as articles": ('<main><article><h1>T</h1><p>Main words.</p></article><section id="comments"><article class="comment">'
                             "<p>Nice one!</p></article></section></main>", "T\nMain words."),
    "aside in the text": ("<article><h1>T</h1><p>Before it.</p><aside><p>Read more</p></aside><p>After it.</p></article>", "T\nBefore it.\nAfter it."),
    "navigation by role": ('<div role="navigation"><ul><li><a href=a>Home</a></ul></div><article><p>Only this.</p></article>', "Only this."),
    "lists and tables": ("<main><h1>T</h1><ul><li>a b<li>c d</ul><table><tr><td>1<td>2</table></main>", "T\na b\nc d\n1\n2"),
    "advert between": ('<article><p>Up here.</p><div class="ad-slot"><p>Buy now</p></div><p>Down here.</p></article>', "Up here.\nDown here."),
    "form at the end": ("<article><p>Text of it.</p></article><form><p>Your mail</p><button>Go</button></form>", "Text of it."),
    "no hint at all": ("<p>Plain one.<p>Plain two.", "Plain one.\nPlain two."),
}


def test_hand_made_layouts(spark):
    """Expected texts are written by hand; none may be lost."""
    pages = spark.read.parquet(SF)
    names = list(LAYOUTS)
    made = spark.createDataFrame([(10_000 + i, "u", LAYOUTS[n][0]) for i, n in enumerate(names)], pages.schema)
    rows = {r.page_id: r.text for r in extract_main_text(pages.unionByName(made)).collect()}
    assert {n: rows[10_000 + i] for i, n in enumerate(names)} == {n: LAYOUTS[n][1] for n in names}


def test_deep_pages_take_time_by_their_length():
    started = time.perf_counter()
    assert len(blocks_of("<div>x" * 20_000)) == 20_000
    assert len(blocks_of("<div>" * 20_000 + "</span></em></section>" * 20_000 + "<nav>y")) == 1
    assert time.perf_counter() - started < 5
    deep = blocks_of("<nav>" + "<div>" * 100 + "far")[0]
    assert len(deep.path) < 60 and not weak_label(deep)
