"""Main text of web pages: flat text blocks judged by a decision tree.

A page is read once as tags and text. Tags that are not inline end a block, so a page becomes a flat
run of text blocks. A block is described by its words and link density, by those of the blocks
before and after it, and by what encloses it: an article, page furniture named by tag, role, class
or id, a heading, a list. A decision tree, grown on the driver from the small labelled table below,
says which blocks are main text. Those are joined in page order by an empty line.

Rules: script, style and other unseen content is no block. Character references are decoded in each
run of text. White space inside a block, a line break included, becomes one space; what is empty
then is no block. Null or empty pages give an empty text. Unclosed tags end where HTML ends them, an
unclosed comment, script or quoted attribute at the end of the page.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.llm.common import bounded_batches, fresh

# Element names of HTML by how a text reader must treat them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
UNSEEN = frozenset("audio button canvas datalist math noscript object select svg template video".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An element that ends an open one of its kind, and what stops the search for that one.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}),
}
# Words of class, id and role that tell what an element is for.
MAIN_WORDS = frozenset("article articlebody content entry main post story".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus discussion replies reply respond".split())
CHROME_WORDS = frozenset(
    """ad ads adsense advert advertisement adverts alert alertdialog author-box banner breadcrumb breadcrumbs byline complementary consent contentinfo cookie cookies copyright
    dialog disclaimer footer form gdpr header legal login masthead menu menubar meta modal nav navbar navigation newsletter notice outbrain pager pagination paywall popup popular
    promo promoted promotion recommended related search share sharing sidebar signup social sponsor sponsored subscribe subscription taboola tags toolbar trending warning widget""".split()
)
CHROME_TAGS = frozenset("nav footer aside form dialog menu fieldset".split())

_TOKEN = re.compile(
    r"""<!--(?:.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|<([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)""", re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_PARTS = re.compile(r"[^a-z0-9]+")


class Place(NamedTuple):
    """What encloses a block."""

    main: bool = False
    #: Page furniture by tag or role, anywhere above.
    chrome: bool = False
    #: Page furniture by class or id: inside the article, or where there is none; and outside of it.
    hint: bool = False
    outer: bool = False
    comment: bool = False
    header: bool = False
    heading: bool = False
    item: bool = False
    para: bool = False
    unseen: bool = False


PAGE = Place()


def inside(parent: Place, tag: str, names: Sequence[str] = (), hidden: bool = False) -> Place:
    """The place inside a new element whose class, id and role words are ``names``."""
    if tag in ("html", "body"):
        return parent
    tagged = tag in ("article", "main")
    main = tagged or not MAIN_WORDS.isdisjoint(names)
    comment = parent.comment or not COMMENT_WORDS.isdisjoint(names)
    hint = not CHROME_WORDS.isdisjoint(names)
    enters = tagged and not parent.main  # a class alone does not lift what encloses it
    return Place(
        parent.main or main, parent.chrome or tag in CHROME_TAGS, hint if enters else parent.hint or hint, parent.outer or (enters and parent.hint), comment,
        parent.header or (tag == "header" and not (parent.main or main)), tag in ("h1", "h2", "h3", "h4", "h5", "h6"), tag in ("li", "td", "th", "dd", "dt") or (parent.item and tag not in ("ul", "ol", "table")),
        tag in ("p", "pre", "blockquote"),
        parent.unseen or hidden or tag in UNSEEN,
    )


def _names(attributes: str) -> tuple[list[str], bool]:
    """Words of class, id and role, and whether the element is hidden."""
    names, hidden = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role", "itemprop"):
            names += _PARTS.split(value)
        elif key == "style":
            hidden = hidden or bool(_HIDDEN.search(value))
        elif key == "aria-hidden":
            hidden = hidden or value == "true"
    return names, hidden or bool(re.search(r"(?:^|\s)hidden(?:\s|/|=|$)", re.sub(r"""=\s*(?:"[^"]*"|'[^']*')""", "", attributes.lower())))


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    place: Place


def text_blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    pieces: list[str] = []
    state = {"linked": 0}
    stack: list[tuple[str, Place]] = []
    count: dict[str, int] = {}
    place = PAGE

    def flush() -> None:
        if pieces:
            words = "".join(pieces).split()
            pieces.clear()
            if words:
                out.append(Block(" ".join(words), len(words), min(state["linked"], len(words)), place))
        state["linked"] = 0

    def pop_to(k: int) -> None:
        nonlocal place
        for name, _ in stack[k:]:
            count[name] -= 1
        del stack[k:]
        place = stack[-1][1] if stack else PAGE

    def nearest(names: set[str], stop: set[str]) -> int:
        if any(count.get(n) for n in names):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in names:
                    return k
                if stack[k][0] in stop:
                    break
        return -1

    def add(raw: str) -> None:
        if raw and not place.unseen:
            text = references.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if count.get("a"):
                state["linked"] += len(text.split())

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        add(page[at : m.start() if m else end])
        if m is None:
            break
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag in INLINE:
                continue
            if tag == "a":
                k = nearest({"a"}, set())
                if k >= 0:  # only the link ends, not what was opened inside it
                    del stack[k]
                    count["a"] -= 1
                continue
            flush()
            k = nearest({tag}, {"table"} if tag not in ("table", "html", "body") and not count.get("table") == 0 and tag in ("p", "li") else set())
            if k >= 0:
                pop_to(k)
        elif m[2]:
            tag = m[2].lower()
            if tag == "br":
                pieces.append(" ")
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = close.start() if close else end
                if tag not in INLINE and tag in ("textarea", "iframe", "xmp"):
                    flush()
                continue
            if tag in INLINE:
                continue
            attributes = m[3]
            if tag == "a":
                k = nearest({"a"}, set())
                if k >= 0:
                    del stack[k]
                    count["a"] -= 1
                if "href" in attributes.lower():
                    stack.append(("a", place))
                    count["a"] = count.get("a", 0) + 1
                continue
            flush()
            if tag in VOID:
                continue
            if tag in CLOSES_P:
                k = nearest({"p"}, {"table", "td", "th", "li", "div", "section", "article"})
                if k >= 0:
                    pop_to(k)
            if tag in SIBLINGS:
                k = nearest(*SIBLINGS[tag])
                if k >= 0:
                    pop_to(k)
            names, hidden = _names(attributes) if attributes and not attributes.isspace() else ((), False)
            if attributes.endswith("/") and tag in ("svg", "math"):
                continue
            place = inside(place, tag, names, hidden)
            stack.append((tag, place))
            count[tag] = count.get(tag, 0) + 1
    flush()
    return out


FEATURES = ("comment", "chrome", "header", "hint", "main", "has_main", "outer", "heading", "item", "para", "words", "density", "words_before", "density_before", "words_after", "density_after")


def features(words: np.ndarray, linked: np.ndarray, places: np.ndarray, page: np.ndarray) -> np.ndarray:
    """One row a block: its own figures, its neighbours' on the same page (0 words beyond the ends), and its place."""
    n = len(words)
    density = linked / np.maximum(words, 1)
    same = page[1:] == page[:-1]
    before, after = np.zeros((n, 2)), np.zeros((n, 2))
    own = np.stack([words, density], 1).astype(np.float64)
    if n > 1:
        before[1:] = own[:-1] * same[:, None]
        after[:-1] = own[1:] * same[:, None]
    main = places[:, 0]
    has_main = (np.bincount(page, main, minlength=1) > 0)[page] if n else main
    p = {name: places[:, k] for k, name in enumerate(Place._fields)}
    cols = [p["comment"], p["chrome"], p["header"], p["hint"], main, has_main, p["outer"], p["heading"], p["item"], p["para"], words, density, before[:, 0], before[:, 1], after[:, 0], after[:, 1]]
    return np.stack([np.asarray(c, np.float64) for c in cols], 1)


# The labelled table. One line a block: 1 if it is main text, its path (tag.class), words, words inside links; an empty line ends a page.
LABELLED = """
0 header/div.logo 2 2
0 nav/ul/li 1 1
0 nav/ul/li 2 2
0 nav/ul/li 1 1
0 div.ad 8 0
1 article/h1 8 0
1 article/p 60 0
1 article/p 2 0
1 article/p 12 0
1 article/p 150 4
1 article/ul/li 6 0
1 article/ul/li 11 2
1 article/blockquote/p 25 0
0 article/div.share 3 3
0 footer 9 0

0 div.cookie-notice/p 18 1
0 div.header/a 3 3
0 div.menu/a 2 2
0 div.menu/a 1 1
1 div.post/h1 7 0
1 div.post/p 35 1
1 div.post/p 3 0
0 div.post/div.ad 14 0
1 div.post/p 90 2
1 div.post/h2 4 0
1 div.post/p 5 0
0 div.related/h3 2 0
0 div.related/ul/li 6 6
0 div.related/ul/li 8 8
0 section.comments/h2 2 0
0 section.comments/article/p 30 0
0 section.comments/article/p 4 0
0 section.comments/div 65 1
0 div.footer/p 14 3

0 form/div 4 0
0 aside.sidebar/h3 2 0
0 aside.sidebar/p 40 2
0 aside.sidebar/ul/li 5 5
1 main/h1 5 0
1 main/p 45 3
1 main/table/tr/td 2 0
1 main/table/tr/td 1 0
1 main/pre 30 0
1 main/p 6 6
1 main/p 20 0
0 main/form/p 7 0
0 main/nav/a 2 2
0 main/section.comments/p 22 0
0 footer/div/p 30 0
0 footer/ul/li 2 2

0 div/a 2 2
0 div/a 1 1
0 div/ul/li 3 3
0 div/ul/li 2 2
1 div/h1 9 0
1 div/p 70 1
1 div/p 40 0
1 div/p 9 0
1 div/p 55 2
1 div/h2 3 0
1 div/p 120 6
0 div/ul/li 7 7
0 div/ul/li 6 6
0 div/p 4 2
0 div/p 3 3

0 table/tr/td 2 2
0 table/tr/td 3 3
1 table/tr/td 200 4
0 table/tr/td 5 4
0 div 6 1

0 header/h1 3 3
0 header/p 7 0
0 div.popup/p 25 0
0 div.sidebar/main/aside/p 30 1
1 div.sidebar/main/h1 6 0
1 div.sidebar/main/p 50 0
1 div.sidebar/main/p 4 0
1 div.sidebar/main/header/p 30 0
1 div.menu/article/p 8 0
0 div.menu/p 8 0
0 div.newsletter/p 16 0
0 article.comment/p 40 0
0 article.comment/p 3 0
0 div.disqus/p 75 0
0 dialog/p 24 0

1 p 30 0
1 p 12 0
1 p 50 2
1 p 80 0

1 div/p 6 0

0 div/a 2 2
0 div/a 1 1
0 div 9 0
1 div/h2 6 0
1 div/p 60 0
1 div/p 5 0
1 div/p 75 2
0 div 7 0
0 div/a 2 2
0 div/a 1 1

0 div/a 1 1
1 div/h1 4 0
1 div 85 0
1 div 66 1
1 div 110 0
0 div 8 0

0 div 10 0
0 div/p 25 0
1 article/h1 5 0
1 article/p 9 0
1 article/div 40 0
1 article/div 4 0
0 div/p 45 0
0 div 6 0
0 section/h3 3 0

1 main/h2 4 0
1 main/p 20 8
1 main/p 9 5
1 main/p 30 9
1 main/p 14 14
1 main/p 50 12
1 main/ul/li 8 3
1 main/ul/li 5 2
0 main/ul/li 2 2
0 main/ul/li 1 1
0 main/ul/li 3 3

1 body 3 0

1 body 30 0

1 div 4 0
"""


class Tree(NamedTuple):
    """Nodes of a binary tree; a leaf has feature -1 and its share of main text in ``value``."""

    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while len(rows):
            rows = rows[self.feature[at[rows]] >= 0]
            k = at[rows]
            at[rows] = np.where(x[rows, self.feature[k]] <= self.cut[k], self.low[k], self.high[k])
        return self.value[at]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 4) -> Tree:
    """CART by Gini impurity, ``least`` rows a leaf; of equal splits the first feature and the least cut."""
    nodes: list[list[float]] = []

    def node(rows: np.ndarray, left: int) -> int:
        k = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(y[rows].mean()) if len(rows) else 0.0])
        if not left or y[rows].min() == y[rows].max():
            return k
        best = None
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            edge = np.flatnonzero(v[1:] > v[:-1])
            edge = edge[(edge + 1 >= least) & (edge + 1 <= len(order) - least)]
            if not len(edge):
                continue
            n, total = len(order), ones[-1]
            a, p = edge + 1.0, ones[edge]
            impurity = p * (a - p) / a + (total - p) * (n - a - total + p) / (n - a)
            j = int(np.argmin(impurity))
            if best is None or impurity[j] < best[0] - 1e-9:
                best = (impurity[j], f, (v[edge[j]] + v[edge[j] + 1]) / 2)
        if best is not None:
            _, f, at = best
            low = x[rows, f] <= at
            nodes[k][:4] = [f, at, node(rows[low], left - 1), node(rows[~low], left - 1)]
        return k

    node(np.arange(len(y)), depth)
    f, c, low, high, value = zip(*nodes, strict=True)
    return Tree(np.array(f, int), np.array(c), np.array(low, int), np.array(high, int), np.array(value))


def place_of(path: str) -> Place:
    """The place at the end of a path like ``div.post/ul/li``."""
    place = PAGE
    for step in path.split("/"):
        tag, *names = step.split(".")
        place = inside(place, tag, [w for n in names for w in _PARTS.split(n)])
    return place


def labelled(table: str = LABELLED, scales: Sequence[float] = (0.2, 1, 5)) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a labelled table. Every page is taken short, as it stands and long, as the length of a text says little about its place."""
    xs, ys = [], []
    pages = [[line.split() for line in page.splitlines() if line] for page in table.strip().split("\n\n")]
    for scale in scales:
        rows = [(k, *row) for k, page in enumerate(pages) for row in page]
        size = lambda n: max(1, round(float(n) * scale)) if n != "0" else 0  # noqa: B023, E731
        words = np.array([size(r[3]) for r in rows])
        linked = np.minimum(words, np.array([size(r[4]) for r in rows]))
        # A chain of links stays one whatever its length.
        linked = np.where(np.array([r[3] == r[4] for r in rows]), words, linked)
        xs.append(features(words, linked, np.array([place_of(r[2]) for r in rows], float), np.array([r[0] for r in rows])))
        ys.append(np.array([int(r[1]) for r in rows], float))
    return np.concatenate(xs), np.concatenate(ys)


def train(table: str = LABELLED) -> Tree:
    return grow(*labelled(table))


def main_texts(pages: Sequence[str | None], tree: Tree) -> list[str]:
    """The main text of each page."""
    found = [text_blocks(p) if p else [] for p in pages]
    flat = [b for blocks in found for b in blocks]
    if not flat:
        return [""] * len(found)
    page = np.repeat(np.arange(len(found)), [len(b) for b in found])
    x = features(np.array([b.words for b in flat]), np.array([b.linked for b in flat]), np.array([b.place for b in flat], float), page)
    keep = tree.predict(x) >= 0.5
    out, at = [], 0
    for blocks in found:
        out.append("\n\n".join(b.text for b, k in zip(blocks, keep[at : at + len(blocks)], strict=True) if k))
        at += len(blocks)
    return out


def extract(df: DataFrame, html: str = "html", keep: Sequence[str] = ("page_id", "url"), tree: Tree | None = None) -> DataFrame:
    """The ``keep`` columns with text and n_chars (code points of text), one row a page.

    Rows never meet, so repeated pages are judged alike and nothing is shuffled. A kept column that
    is called text or n_chars gets a leading underscore.
    """
    bounded_batches(df.sparkSession)
    tree = tree or train()
    hidden = [f"k{i}" for i in range(len(keep))]
    rows = df.select(*(F.col(f"`{c}`").alias(h) for c, h in zip(keep, hidden, strict=True)), F.col(f"`{html}`").cast("string").alias("html"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = pa.array(main_texts(part.column("html").to_pylist(), tree), pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(h) for h in hidden), texts, pc.utf8_length(texts).cast(pa.int64())], names=[*hidden, "text", "n_chars"])

    named = [c if c.lower() not in ("text", "n_chars") else fresh(df, "_" + c)[0] for c in keep]
    return rows.mapInArrow(run, schema).select(*(F.col(h).alias(c) for h, c in zip(hidden, named, strict=True)), "text", "n_chars")
