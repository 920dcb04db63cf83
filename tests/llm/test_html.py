"""Main text of generated pages whose article is known, and of hostile ones."""
import random
import time
from collections import Counter

import pytest

from postern.llm import op2_html


def prose(r, n):
    return " ".join("".join(r.choice("aeioulmnrstd") for _ in range(r.randrange(2, 9))) for _ in range(n)).capitalize() + "."


BOILERPLATE = [
    "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>World news today</a></li></ul></nav>",
    '<div class="menu-bar"><a href=/x>One</a> <a href=/y>Two</a></div>',
    '<header class="site-header"><a href=/>The Site</a><p>All the news that fits on a page, every day of the year</p></header>',
    '<div id="cookieNotice"><p>We use cookies to make this site work as well as it can for all readers</p><button-group><a href=#>OK</a></button-group></div>',
    '<div class="ad-slot"><span>Buy this thing now, it is cheap and good</span></div>',
    '<aside><h3>More</h3><p>Something else that is not part of it at all</p></aside>',
    '<form action=/s><label>Search the site</label><input name=q></form>',
    '<script>var a = "<p>not text</p>";</script><style>p > a { color: red }</style>',
    '<div class="share-buttons"><a href=#>Share</a><a href=#>Post</a></div>',
    '<div class="related posts"><h3>Related</h3><a href=/r>Another story about another thing</a></div>',
    '<div hidden><p>not to be seen by anyone who reads this page</p></div>',
]
AFTER = ['<section id="comments"><h2>2 comments</h2><div class="comment-body"><p>A reader says a lot of things about it</p></div></section>', '<footer>&copy; someone <a href=/t>terms</a></footer>']


def article(r, labelled):
    """HTML and text of an article with all that articles hold."""
    markup, text = [], []

    def block(opens, words, closes):
        markup.append(opens + words + closes)
        text.append(words)

    block("<h1>", prose(r, 6), "</h1>")
    block("<p>", prose(r, 30), "</p>")
    for kind in r.sample(range(11), r.randrange(3, 9)):
        if kind == 0:
            items = [prose(r, 1) for _ in range(15)]
            markup.append("<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>")
            text += items
        elif kind == 1:
            items = [prose(r, 2) for _ in range(4)]
            markup.append("<ol>" + "".join(f"<li><a href=/l>{x}</a></li>" for x in items) + "</ol>")
            text += items
        elif kind == 2:
            markup.append('<aside class="pull"><a href=/1>x</a><a href=/2>y</a><a href=/3>z</a><a href=/4>u</a><a href=/5>v</a></aside>')
        elif kind == 3:
            words = prose(r, 5)
            markup.append(f"<figure><img src=a.png alt='a > b'><figcaption>{words}</figcaption></figure>")
            text.append(words)
        elif kind == 4:
            cells = [prose(r, 1) for _ in range(6)]
            markup.append("<table><tr><th>" + "<th>".join(cells[:3]) + "<tr><td>" + "</td><td>".join(cells[3:]) + "</table>")
            text += cells
        elif kind == 5:
            a, b = prose(r, 8), prose(r, 9)
            markup.append(f"<p>{a}<p>{b}")
            text += [a, b]
        elif kind == 6:
            markup.append('<p class="notice">Subscribers read this first')
            block("<p>", prose(r, 12), "</p>")
        elif kind == 7:
            block('<div class="lead share-price-analysis"><p>', prose(r, 14), "</p></div>")
            block('<section class="related-work">', prose(r, 12), "</section>")
        elif kind == 8:
            a, b = prose(r, 3), prose(r, 3)
            markup.append(f"<p>{a[:-1]} &amp; <em>{b[:3]}</em>{b[3:]}\n\t <my-note>&eacute;</my-note></p>")
            text.append(f"{a[:-1]} & {b} é")
        elif kind == 9:
            block("<blockquote>", prose(r, 10), "</blockquote></span></b>")
        else:
            markup.append('<nav class="toc"><a href=#1>one</a></nav><!-- <p>no</p> --><div class="ad">an advert of a few words</div>')
    block("<p>", prose(r, 40), "</p>")
    return "".join(markup), " ".join(" ".join(text).split())


def page(seed, labelled):
    r = random.Random(seed)
    markup, text = article(r, labelled)
    before = "".join(r.sample(BOILERPLATE, r.randrange(2, 7)))
    after = "".join(r.sample(BOILERPLATE, r.randrange(1, 4)) + AFTER)
    opens, closes = r.choice([("<article>", "</article>"), ("<main class='x'>", "</main>"), ("<main><article class='post has-sidebar'>", "</article></main>")]) if labelled else ("<div class='content with-sidebar'>", "</div>")
    end = r.choice(["</body></html>", ""])
    return f"<!DOCTYPE html><html><head><title>t</title><meta charset=utf-8></head><body>{before}{opens}{markup}{closes}{after}{end}", text


@pytest.fixture(scope="module")
def weights():
    counts = Counter()
    for seed in range(1000, 1100):
        counts.update(op2_html.observe(page(seed, True)[0]))
    return op2_html.weigh(counts)


@pytest.mark.parametrize("labelled", [True, False])
def test_whole_articles(weights, labelled):
    for seed in range(150):
        markup, text = page(seed, labelled)
        assert op2_html.extract(markup, weights) == text, seed
        if labelled:
            assert op2_html.extract(markup, op2_html.FIXED) == text, seed


def test_pages_without_a_label(weights):
    long = prose(random.Random(1), 60)
    for markup, text in [
        ("<p>a b c", "a b c"), (f"<form><p>{long}</form>", long), (f"<div class=sidebar>x y</div><p>{long}", long), (f"<nav><a>m</a><p>{long}", long),
        (f"<article>{long}</article><article>{long}</article>", f"{long} {long}"), ("<article></article><p>one two three", "one two three"), ("1 < 2 and <b>3</b>", "1 < 2 and 3"),
        ("<p>a&lt;b&#233;", "a<bé"), ("<custom-tag>word</custom-tag>", "word"), ("<svg><title>x</title></svg>word", "word"), ("<p>unclosed <svg>word", "unclosed word"),
    ]:
        assert op2_html.extract(markup, weights) == text, markup


@pytest.mark.parametrize("part", ["<a ", '<p "', '<p a="', '<p a=">" ', "<!--", "<button>", "<svg ", "<div>", "<ul><li>x", "<td><span>", "< ", "</p>", "<p hidden", "&", '<div class="a b c">x'])
def test_hostile_pages_are_linear(part):
    began = time.process_time()
    op2_html.extract(part * (1_000_000 // len(part)), op2_html.FIXED)
    assert time.process_time() - began < 6
