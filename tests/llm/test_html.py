"""HTML extraction: hand-made pages, templates, broken markup."""

from __future__ import annotations

import random
import time

from tideline.llm import html_extract as H
from tideline.llm.common import Scratch


def test_article_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><a href=x>Site</a></header>
    <nav><ul><li>Menu</ul></nav><div class="ad">Buy</div><div id="cookie-notice">Cookies</div><main><article><header><h1>Title &amp; more</h1></header><p><b>Bold<br><p>One&nbsp;two
    three</p><ul><li>a<li>b</ul><form><input> Send</form><script>x</script><aside>By the way</aside><p>caf&eacute; &#8364; &lt;p&gt;</article></main><section class="comments"><article class="comment"><p>First!</article></section>
    <aside>Side</aside><footer>&copy; x</footer>"""
    assert H.extract(page) == "Title & more\nBold\nOne two three\na\nb\ncafé € <p>"


def test_odd_pages():
    assert H.extract("") == "" and H.extract("plain &amp; text") == "plain & text"
    assert H.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert H.extract("<p title=\"a>b\">x</p><p title=it's>y</p><!-- <p>z</p> --><p>w") == "x\ny\nw"
    assert H.extract("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert H.extract("a < b and c <3") == "a < b and c <3"
    assert len(H.extract("<article>" + "<p>word</p>" * 50_000 + "</article>").split("\n")) == 50_000


def test_template_without_marks(spark):
    page = lambda i: f"<html><body><div><p>Daily Herald</p></div><div><h2>Story {i}</h2><p>Body of {i} is here.</p><p>More {i * 7} text.</p></div><div><p>All rights kept</p></div></body></html>"
    rows = [(i, f"http://h.example/{i}", page(i), "x") for i in range(12)] + [(50, None, None, "x"), (51, "http://h.example/e", "", "x"), (52, "no url", "<p>Alone</p>", "x"), (3, "http://h.example/3", page(3), "x")]
    rows += [(100 + i, "http://copies.example/", "<body><div><p>Same</p></div><div><h2>Copied</h2><p>All pages are one.</p></div>", "x") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, reference string")
    out = {r.page_id: r.text for r in H.extract_pages(df, Scratch(spark, "t")).collect()}
    for i in range(12):
        assert out[i] == f"Story {i}\nBody of {i} is here.\nMore {i * 7} text."
    assert out[50] == "" and out[51] == "" and out[52] == "Alone"
    assert out[100] == "Same\nCopied\nAll pages are one."  # copies of one page have no wrapper
    assert H.extract_pages(df.limit(0), Scratch(spark, "t")).count() == 0


def test_matching_keeps_order():
    a = H.compact(H.parse("<body><div class=x><p>1</p></div><ul><li>2</ul><div class=y><h1>3</h1><p>4</p></div></body>"))
    b = H.numbered(H.compact(H.parse("<body><div class=y><h1>3</h1><p>4</p></div><div class=x><p>1</p></div></body>")))
    assert {e.label for e, _ in H.align(a, b)} == {"#root", "body", "div.y", "h1", "p"}


def test_deep_pages_keep_what_lies_below_constant_text():
    page = lambda text: "<body>" + "<div>" * 30 + f"<div>Label<div><p>{text}</p></div></div><p>Foot</p>" + "</div>" * 30 + "</body>"
    a, b = H.compact(H.parse(page("one"))), H.numbered(H.compact(H.parse(page("two"))))
    met = H.align(a, b)
    assert {H.own_text(x) for x, _ in met} >= {"Label", "one", "Foot"}
    label = [n for x, n in met if H.own_text(x) == "Label"]
    foot = [n for x, n in met if H.own_text(x) == "Foot"]
    text = H.extract(page("one"), page("two"), leave=label + foot)
    assert "one" in text and "Foot" not in text
    deep = H.compact(H.parse("<div>" * 3000 + "<p>x</p>"))
    assert len(H.align(deep, H.numbered(H.compact(H.parse("<div>" * 3000 + "<p>y</p>"))))) > 3000


def test_long_pages_align_exactly(monkeypatch):
    own = lambda kinds: "<body>" + "".join(f'<div class="{k}"><div>{k}</div></div>' for k in kinds) + "</body>"
    first, second = "z" + "abc" * 90, "abc" * 90 + "z"
    a, b = H.compact(H.parse(own(first))), H.numbered(H.compact(H.parse(own(second))))
    long = len(H.align(a, b))
    monkeypatch.setattr(H, "CELLS", 10**9)
    assert long == len(H.align(a, b)) and long > 2 * 270


def words(i: int, n: int) -> str:
    return " ".join(f"w{i}x{k}" for k in range(n))


def telling(i: int) -> tuple[str, str]:
    """A page with tags and classes, and its text."""
    paragraphs = [words(1000 + i * 9 + k, 40) for k in range(2 + i % 3)]
    menu = "".join(f'<li><a href="/{k}">{words(i + 100 * k, 2)}</a></li>' for k in range(5))
    body = f"<h1>Title {i}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    page = f'<html><body><nav><ul>{menu}</ul></nav><div class="ad">Buy {words(i, 6)}</div><article>{body}</article><footer>All rights {words(i, 3)}</footer></body></html>'
    return page, "\n".join([f"Title {i}", *paragraphs])


def renamed(page: str) -> str:
    for k, tag in enumerate(("nav", "article", "footer", "ul", "li", "h1", "p")):
        page = page.replace(f"<{tag}>", f'<div class="q{"abcdefg"[k]}">').replace(f"</{tag}>", "</div>")
    return page.replace('class="ad"', 'class="qz"')


def test_slots_find_the_content_without_names(spark):
    """With tags and classes renamed the text stays the same; without the wrapper it does not."""
    made = [telling(i) for i in range(12)]
    rows = [(i, f"http://one.example/{i}", page) for i, (page, _) in enumerate(made)]
    rows += [(100 + i, f"http://two.example/{i}", renamed(page)) for i, (page, _) in enumerate(made)]
    rows += [(200 + i, f"http://three.example/{i}", renamed(made[0][0])) for i in range(9)]  # copies of one page count once
    rows += [(300 + i, f"http://one.example/b{i}", f"<html><body class=list><div>{page}</div></body></html>") for i, (page, _) in enumerate(made[:6])]  # another layout of a host
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in H.extract_pages(df.repartition(4), Scratch(spark, "t")).collect()}
    for i, (page, text) in enumerate(made):
        assert out[i] == text == H.extract(page)
        assert out[100 + i] == text != H.extract(renamed(page))
    assert out[200] == H.extract(renamed(made[0][0]))
    assert all(out[300 + i] == made[i][1] for i in range(6))


def test_several_articles_and_harmless_words():
    page = "<body><article><h2>One</h2><p class='share-price'>Up 3</p><div class='notice-of-motion'>Moved</div></article><div class='ad'>x</div><article><p>Two</p><div class='comment-list'>No</div></article></body>"
    assert H.extract(page) == "One\nUp 3\nMoved\nTwo"


def test_matching_is_the_best_there_is():
    """Against every way to match two small trees."""
    rng = random.Random(4)

    def tree(depth: int) -> str:
        kids = "".join(tree(depth - 1) for _ in range(rng.randrange(4))) if depth else ""
        return f'<div class="{rng.choice("ab")}">{kids}t</div>'

    def best(a, b) -> int:
        if a.label != b.label:
            return 0

        def lists(i: int, j: int) -> int:
            if i == len(a.kids) or j == len(b.kids):
                return 0
            return max(lists(i + 1, j), lists(i, j + 1), best(a.kids[i], b.kids[j]) + lists(i + 1, j + 1))

        return 1 + lists(0, 0)

    for _ in range(60):
        a, b = (H.numbered(H.compact(H.parse("<body>" + tree(3) + tree(2) + "</body>"))) for _ in range(2))
        assert H.matching(a, b, {}) == best(a, b) == len(H.align(a, b))


def test_long_broken_pages_take_linear_time():
    began = time.time()
    H.parse("<b>" * 40_000 + "<p>x" * 40_000)
    assert time.time() - began < 10
