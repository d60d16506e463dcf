"""Page text against pages whose parts are known, and against a plain reader of well-formed pages."""

import html
import random
import time
from html.parser import HTMLParser

import pytest

from cairnfield.llm import html_text
from cairnfield.llm.html_text import main_texts, text_blocks, train


@pytest.fixture(scope="module")
def tree():
    return train()


class Plain(HTMLParser):
    """Text between block tags of a well-formed page."""

    def __init__(self):
        super().__init__()
        self.blocks, self.now = [], []

    def end_block(self):
        text = " ".join("".join(self.now).split())
        self.blocks += [text] if text else []
        self.now = []

    def handle_starttag(self, tag, attrs):
        self.now.append(" ") if tag == "br" else None if tag in html_text.INLINE or tag == "a" else self.end_block()

    def handle_endtag(self, tag):
        None if tag in html_text.INLINE or tag in ("a", "br") else self.end_block()

    def handle_data(self, data):
        self.now.append(data)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefé&<>\"") for _ in range(rng.randint(1, 7))) for _ in range(n))


def test_blocks_agree_with_a_plain_reader():
    rng = random.Random(1)

    def node(depth):
        kind = rng.choice(["p", "div", "ul", "b", "a", "text", "text", "br", "section", "table"] if depth < 5 else ["text", "br"])
        if kind == "text":
            return html.escape(words(rng, rng.randint(0, 4))) + rng.choice(["", " ", "\n\t", "&nbsp;", "&copy;"])
        if kind == "br":
            return "<br/>"
        body = "".join(node(depth + 1 if kind not in ("p", "b", "a") else 9) for _ in range(rng.randint(0, 4)))
        if kind == "ul":
            return f"<ul><li class='x > y'>{body}</li><li>{body}</li></ul>"
        if kind == "table":
            return f"<table><tbody><tr><td>{body}</td></tr></tbody></table>"
        return f'<{kind} href="/a?b=1&c>2">{body}</{kind}>'

    for _ in range(300):
        page = "".join(node(0) for _ in range(6))
        plain = Plain()
        plain.feed(page)
        plain.close()
        plain.end_block()
        assert [b.text for b in text_blocks(page)] == plain.blocks, page


def furniture(rng):
    w = lambda a, b: html.escape(words(rng, rng.randint(a, b)))
    links = "".join(f'<li><a href="/{k}">{w(1, 3)}</a></li>' for k in range(rng.randint(2, 8)))
    return [
        f"<nav><ul>{links}</ul></nav>", f'<div class="top-menu"><ul>{links}</ul></div>', f'<div class="ad">{w(3, 20)}</div>', f'<div id="cookie_notice"><p>{w(10, 30)}</p></div>',
        f"<aside><p>{w(5, 60)}</p></aside>", f'<div class="sidebar"><h3>{w(1, 3)}</h3><p>{w(5, 40)}</p></div>', f"<form><label>{w(1, 3)}</label><input name=q><button>{w(1, 2)}</button></form>",
        f"<script>if (a < b) document.write('<p>{rng.random()}</p>');</script>", "<style>p > b { color: red }</style>", f"<!-- <p>{w(3, 9)}</p> -->", f"<div hidden><p>{w(3, 30)}</p></div>",
        f'<section class="comments"><h2>{w(1, 2)}</h2><article><p>{w(1, 90)}</p></article><div class="comment"><p>{w(2, 40)}</p></div></section>', f"<footer><p>&copy; {w(3, 30)}</p></footer>",
    ]


def test_articles_come_out_whole_and_alone(tree):
    rng = random.Random(2)
    for k in range(200):
        blocks, body = [], []
        for _ in range(rng.randint(1, 8)):
            text = words(rng, rng.choice([1, 2, 5, 12, 40, 200]))
            blocks.append(text)
            tag = rng.choice(["p", "p", "p", "h2", "li", "blockquote"])
            escaped = html.escape(text).replace(" ", rng.choice([" ", "\n  ", " <b>", "<br>"]), 1) + rng.choice(["", "</b>"])
            body.append(f"<ul><li>{escaped}</ul>" if tag == "li" else f"<{tag}>{escaped}" + (f"</{tag}>" if tag != "p" or rng.random() < 0.5 else ""))
        shell = rng.choice(["<article>{}</article>", "<main>{}</main>", '<div class="post">{}</div>', '<div class="page sidebar-left"><article>{}</article></div>'])
        inner = list(body)
        if rng.random() < 0.5:
            inner.insert(rng.randint(0, len(inner)), f'<div class="advert">{html.escape(words(rng, 9))}</div>')
        parts = furniture(rng)
        before, after = rng.sample(parts, 3), rng.sample(parts, 3)
        page = f"<!DOCTYPE html><html><head><title>{k}</title></head><body>{''.join(before)}{shell.format(''.join(inner))}{''.join(after)}</body></html>"
        assert main_texts([page], tree)[0] == "\n\n".join(" ".join(b.split()) for b in blocks), page


def test_pages_without_an_article_are_read_by_words_and_links(tree):
    long = "word " * 60
    page = f'<div><a href="/">Home</a> <a href="/b">News</a></div><div><h1>A title here</h1><p>{long}</p><p>Short one.</p><p>{long}</p></div><div><a href="/x">One</a><a href="/y">Two</a></div>'
    assert main_texts([page], tree)[0] == "\n\n".join(["A title here", long.strip(), "Short one.", long.strip()])


def test_odd_pages(tree):
    pages = [None, "", "   ", "<", "<p", "</", "<!--", "<script>x", "&am", "plain &lt;text&gt; &#233;&nbsp;&hellip; x &unknown; &amp", "<article><p>one<p>two</article></p></b>", '<article><p title="a>b">in</p>', "<article><p>a < b and c<d</p>"]
    got = main_texts(pages, tree)
    assert got[:8] == ["", "", "", "<", "", "</", "", ""] and got[8] == "&am" and got[9] == "plain <text> é … x &unknown; &"
    assert got[10] == "one\n\ntwo" and got[11] == "in" and got[12].startswith("a < b and c")
    rng = random.Random(4)
    bits = ["<div>", "</div>", "<p>", "<li>", "<a href=x>", "</a>", "<table>", "<td>", "</table>", "word ", "<!--", "-->", "<script>", "</script>", "<b", '"', "'", "=", ">", "&#x;", "&#55296;", "\x00"]
    main_texts(["".join(rng.choice(bits) for _ in range(200)) for _ in range(500)], tree)


def test_time_follows_length(tree):
    for bit in ("<div>", "<p>x", "<a href='", "<!-", "</span>", "<li><div>", "<ul><li>", "<td", "&amp;", "<b>"):
        start = time.perf_counter()
        main_texts(["<article>" + bit * 60_000 + "</section>" * 1000], tree)
        assert time.perf_counter() - start < 10, bit
    text = "word " * 2_000_000
    assert main_texts([f"<article><p>{text}</p></article>"], tree) == [text.strip()]


def test_table(spark):
    rows = [(1, "u", "<article><p>one é</p></article>", "x", "y"), (1, "u", "<article><p>one é</p></article>", "x", "y"), (None, None, None, None, None), (2, None, "", "a", "b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, k0 string")
    got = html_text.extract(df, keep=["page_id", "url", "text", "k0"])
    assert got.columns == ["page_id", "url", "__text" if "_text" in df.columns else "_text", "k0", "text", "n_chars"]
    assert sorted((r[0] or 0, r[2] or "", r[4], r[5]) for r in got.collect()) == [(0, "", "", 0), (1, "x", "one é", 5), (1, "x", "one é", 5), (2, "a", "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0
