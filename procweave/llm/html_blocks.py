"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks at block-level tags. A block has its number of
words and link density, those of the blocks before and behind it, whether it is
a heading or a list item, and its context: whether an element around it names itself
part of the article, and whether the page's furniture is around it for sure
(element names such as ``nav``, words such as sidebar or comments in ``role``, ``class``
and ``id``) or perhaps (words that may as well name a topic or a kind of page: menu,
search, legal). A name counts as perhaps furniture unless it ends in a content
word (search-results-article); of an article's mark and a perhaps, the nearer one
holds. A furniture word only modifies behind has, no, with or without
(has-ads-banner), in the title block of an article (entry-header; any header inside
an article), or, on an element that is or names itself an article, in a tag or
category (tag-privacy) or before a side (sidebar-left). ``main`` is never furniture
by its names. A small decision tree (CART, Gini impurity) trained on
:data:`LABELLED` decides which blocks are article text; there, long text without
links overrules a perhaps. Scripts, styles, markup, comments and form controls
never become text.

Text of a kept block: character references decoded, white space turned into
single spaces, trimmed; blocks are joined in page order by two line breaks. A
``<br>`` is white space inside its block.

Defined results: null or empty html, and a page without article blocks, give an
empty text; repeated rows are extracted one by one; unclosed elements end with
the element around them; a tag cut off by the end of the page is markup; pages
of any length are read whole, in time proportional to their length however deeply
elements are nested.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

#: Fixed names: elements without text of the article, block-level elements, words of furniture and of content.
HIDDEN = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "head", "title",
          "select", "textarea", "button", "option", "datalist", "audio", "video", "map")
BLOCKS = frozenset((
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th",
    "thead", "tr", "ul"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CONTAINERS = frozenset((
    "article", "aside", "body", "center", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "header",
    "main", "menu", "nav", "ol", "section", "span", "table", "td", "ul"))
FURNITURE_TAGS = frozenset(("nav", "footer", "aside", "form", "menu", "dialog"))
FURNITURE_WORDS = frozenset((
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "byline",
    "comment", "comments", "commentlist", "consent", "contentinfo", "cookie", "cookies", "copyright", "disclaimer", "discussion",
    "disqus", "dropdown", "feedback", "foot", "footer", "gdpr", "header", "legal", "links", "login", "masthead", "menu", "meta",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pager", "pagination", "paywall", "popup",
    "popular", "privacy", "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "responses", "search",
    "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "tags",
    "teaser", "toolbar", "topbar", "trending", "widget", "widgets", "complementary", "alert", "dialog", "sponsors", "toc"))
CONTENT_WORDS = frozenset((
    "article", "articlebody", "blogpost", "content", "entry", "main", "maincontent", "post", "story", "text"))

#: Furniture words that may also name a topic, a kind of page or a part of a text.
PERHAPS_WORDS = frozenset((
    "alert", "banner", "copyright", "discussion", "feedback", "header", "legal", "links", "masthead", "menu", "meta", "notice",
    "popular", "privacy", "disclaimer", "promotion", "responses", "search", "tags", "trending", "toc"))
#: Words that make furniture words behind them a layout's mark, first words of a post's own tags, sides of a layout's mark.
LAYOUT_WORDS = frozenset(("has", "no", "with", "without"))
TOPIC_WORDS = frozenset(("tag", "category", "cat", "topic"))
SIDE_WORDS = frozenset(("left", "right", "both", "none", "off"))
#: Content words whose header is the title block of an article, wherever it stands.
TITLED_WORDS = frozenset(("article", "blogpost", "content", "entry", "post", "story"))

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(" + "|".join(HIDDEN) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*+[^>]*+>|(?=<body[\s>])|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|</?\Z|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

N_FEATURES = 10


#: Kinds of elements: sure furniture, perhaps furniture, neither, part of the article.
SURE, PERHAPS, PLAIN, CONTENT = -2, -1, 0, 1


def _name_kind(name: str, in_article: bool) -> tuple[int, bool]:
    """(kind, whether an element of the article overrules it) of one name of ``class``, ``id`` or ``role``."""
    rows = [x.lower() for x in _PARTS.findall(name)], [x for x in re.split(r"[_-]+", name.lower()) if x]
    found = {x for row in rows for x in row}
    bad = found & FURNITURE_WORDS
    for row in rows:
        layout = next((i for i, word in enumerate(row) if word in LAYOUT_WORDS), len(row))
        bad -= set(row[layout + 1:])
    if in_article or found & TITLED_WORDS:
        bad.discard("header")
    if bad - PERHAPS_WORDS or (bad and rows[0] and rows[0][-1] in bad) or (bad and rows[1] and rows[1][-1] in bad):
        kind = SURE
    elif bad and not any(row and row[-1] in CONTENT_WORDS for row in rows):
        kind = PERHAPS
    else:
        # a mark of the layout (has-content, no-header) says nothing of the element itself
        return (CONTENT if found & CONTENT_WORDS and not found & LAYOUT_WORDS else PLAIN), False
    return kind, any(len(row) > 1 and (row[0] in TOPIC_WORDS or row[-1] in SIDE_WORDS) for row in rows)


def _kind(tag: str, attributes: str, in_article: bool) -> int:
    """Kind of an element by its name and the words of its attributes."""
    kinds: list[tuple[int, bool]] = []
    if attributes:
        for m in _NAMED.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                return SURE
            kinds += [_name_kind(x, in_article) for x in value.split()]
    content = tag in ("article", "main") or tag not in ("body", "span") and any(k == CONTENT for k, _ in kinds)
    if tag in FURNITURE_TAGS or (tag == "header" and not in_article and not content):
        return SURE
    worst = min((k for k, overruled in kinds if k < 0 and not (content and overruled)), default=PLAIN)
    if worst < 0 and tag not in ("body", "main"):
        return worst if worst == SURE or not content else CONTENT
    return CONTENT if content else PLAIN


def blocks(html: str) -> list[tuple]:
    """Flat blocks of a page: (text, words, link density, heading, list item, in article, furniture).

    ``furniture`` is 2 inside sure furniture, 1 if the nearest mark around the block is a perhaps, else 0.
    """
    out: list[tuple] = []
    stack: list[tuple[str, tuple]] = []  # open containers with the context outside them
    open_names: dict[str, int] = {}
    context = (False, False, False)  # in article, perhaps, sure
    parts: list[str] = []
    links: list[str] = []
    in_link, leaf = False, ""

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                n = text.count(" ") + 1
                linked = len(unescape(" ".join(links)).split())
                article, perhaps, sure = context
                out.append((text, n, min(1.0, linked / n), leaf in HEADINGS, leaf in ("li", "dt", "dd", "td", "th"),
                            article, 2 if sure else int(perhaps)))
            parts.clear()
            links.clear()

    def said(text: str) -> None:
        parts.append(text)
        if in_link:
            links.append(text)

    def push(tag: str, kind: int) -> tuple:
        stack.append((tag, context))
        open_names[tag] = open_names.get(tag, 0) + 1
        article, perhaps, sure = context
        return article or kind == CONTENT, kind == PERHAPS or perhaps and kind != CONTENT, sure or kind == SURE

    def pop() -> tuple[str, tuple]:
        name, outside = stack.pop()
        open_names[name] -= 1
        return name, outside

    last = 0
    for m in _TAG.finditer(html):
        if m.start() > last:
            said(html[last:m.start()])
        last = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, closing = tag.lower(), bool(m[2] or m[5])
        if tag == "a":
            in_link = not closing
            continue
        if tag == "br":
            parts.append(" ")
            continue
        block = tag in BLOCKS
        if block:
            flush()
            in_link = False
            if not closing and tag != "p" and stack and stack[-1][0] == "p":  # a block ends an open paragraph
                _, context = pop()
        if tag in CONTAINERS or tag in ("p", "li"):
            if closing:
                if open_names.get(tag):
                    name = ""
                    while name != tag:  # elements inside it end with it
                        name, outside = pop()
                    if outside != context:  # what stands in a marked inline element is a block of its own
                        flush()
                        context = outside
            elif tag not in ("p", "li"):
                kind = _kind(tag, m[4] or m[7] or "", context[0])
                if kind < 0 and not block and parts:
                    flush()
                context = push(tag, kind)
            elif m[4] and (kind := _kind(tag, m[4], context[0])) < 0:  # a marked paragraph or item holds its own text only
                context = push(tag, kind)
            elif stack and stack[-1][0] == tag:  # the marked paragraph before was not closed
                _, context = pop()
        if block:
            leaf = "" if closing else tag
    if last < len(html):
        said(html[last:])
    flush()
    return out


def features(found: list[tuple]) -> np.ndarray:
    """A row for each block: words and link density of it and its neighbours, heading, list item, context."""
    x = np.zeros((len(found), N_FEATURES))
    for i, (_, n, density, heading, item, article, furniture) in enumerate(found):
        x[i, :2] = n, density
        x[i, 6:10] = heading, item, article, furniture
    x[1:, 2:4], x[:-1, 4:6] = x[:-1, :2], x[1:, :2]
    return x


def train(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple | int:
    """CART by Gini impurity: nested (feature, threshold, low branch, high branch), leaves 0 / 1."""
    share = y.mean() if len(y) else 0.0
    if depth == 0 or share in (0.0, 1.0):
        return int(share >= 0.5)
    best = None
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for t in (values[:-1] + values[1:]) / 2:
            low = x[:, k] <= t
            cost = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, k, float(t), low)
    if best is None:
        return int(share >= 0.5)
    _, k, t, low = best
    return k, t, train(x[low], y[low], depth - 1), train(x[~low], y[~low], depth - 1)


def decide(tree: tuple | int, row) -> int:
    while not isinstance(tree, int):
        k, t, low, high = tree
        tree = low if row[k] <= t else high
    return tree


def _w(n: int) -> str:
    return " ".join(["word"] * n)


#: The labelled table (names of furniture around real text too): small pages whose blocks open with + (article) or - (not). ``{n}`` stands for n words.
LABELLED = (
    "<body><nav><ul><li><a>-{1}</a></li><li><a>-{1}</a></li><li><a>-{2}</a></li></ul></nav><div class=ad>-{8}</div><article><h1>+{9}</h1><p>+{30}</p><p>+{1}</p><p>+{2}</p><p>+{60}</p></article><footer>-{6}</footer></body>",
    "<body><header><a>-{2}</a><p>-{12}</p></header><main><h1>+{4}</h1><p>+{45}</p><ul><li>+{6}</li><li>+{2}</li></ul><h2>+{1}</h2><p>+{80}</p></main><aside><p>-{25}</p><a>-{4}</a></aside><footer><p>-{30}</p></footer></body>",
    "<body><div id=menu><a>-{1}</a> <a>{1}</a></div><div class=content><p>+{3}</p><p>+{70}</p><p><a>+{4}</a></p><p>+{20}</p></div><div class=comments><p>-{15}</p><p>-{40}</p></div><div id=footer>-{9}</div></body>",
    "<body><div><a>-{1}</a> <a>{1}</a> <a>{1}</a></div><div><a>-{2}</a></div><h1>+{7}</h1><div>+{50}</div><div>+{90}</div><div>+{25}</div><div><a>-{2}</a> <a>{2}</a></div><div>-{4}</div></body>",
    "<body><table><tr><td><a>-{1}</a></td><td><a>-{2}</a></td></tr></table><p>+{35}</p><p>+{12}</p><p>+{64}</p><p><a>-{1}</a> <a>{3}</a></p><p>-{3}</p></body>",
    "<body><article><h1>+{6}</h1><p>+{22}</p><ul><li>+{5}</li><li>+{7}</li></ul><p>+{1}</p><section class=comments><h3>-{2}</h3><p>-{33}</p><p>-{4}</p></section></article></body>",
    "<body><article><p>+{48}</p><p>+{14}</p><ul><li><a>-{5}</a></li><li><a>-{6}</a></li><li><a>-{4}</a></li><li><a>-{7}</a></li></ul></article><form><p>-{11}</p></form></body>",
    "<body><div class=cookie-notice><p>-{28}</p></div><div class=post><h2>+{3}</h2><p>+{1}</p><p>+{100}</p></div><div class=sidebar><h3>-{2}</h3><p>-{18}</p></div></body>",
    "<body><p><a>-{2}</a></p><h1>+{5}</h1><p>+{18}</p><p>+{40}</p><p>+{2}</p><p>+{33}</p><hr><p>-{2}</p></body>",
    "<body><article><h1>+{1}</h1></article><footer>-{20}</footer></body>",
    "<body><article><p>+{1}</p></article></body>",
    "<body><main><blockquote>+{16}</blockquote><p><a>+{9}</a></p><table><tr><td>+{1}</td><td>+{2}</td></tr></table></main></body>",
    "<body><p>+{26}</p></body>",
    "<body><p>+{1}</p></body>",
    "<body><div>+{4}</div></body>",
    "<body><div class=menu-page><nav><a>-{1}</a></nav><article><h1>+{3}</h1><p>+{20}</p><p>+{2}</p></article></div></body>",
    "<body><div class=legal-section><h1>+{8}</h1><p>+{44}</p><p>+{31}</p></div></body>",
    "<body><div class=privacy-box><p>+{60}</p></div></body>",
    "<body><article><p>+{3}</p><section class=comments><div class=content><p>-{90}</p><p>-{200}</p></div></section></article><footer><p>-{120}</p></footer></body>",
    "<body><p>+{60}</p><p>+{14}</p></body>",
    "<body><article><p>+{90}</p><p>+{3}</p></article></body>",
    "<body><div class=content><p>+{55}</p><p>+{80}</p><p>+{6}</p></div></body>",
    "<body><h1>+{3}</h1><p>+{70}</p><p>+{33}</p><p>+{12}</p></body>",
    "<body><article><p>+{40}</p><p>+{120}</p><p>+{1}</p></article><div>-{3}</div></body>",
    "<body><aside><p>-{150}</p></aside><p>+{150}</p><aside><p>-{44}</p></aside></body>",
    "<body><div class=sidebar>-{60}</div></body>",
    "<body><div class=menu-box><p>-{4}</p></div><p>+{40}</p><p>+{11}</p><div class=meta-box>-{3}</div></body>",
    "<body><div class=search-form-box><p>-{3}</p><p><a>-{2}</a></p></div><p>+{50}</p><div class=tags-list><p>-{5}</p></div></body>",
    "<body><section id=search-results-article><p>+{3}</p><p>+{17}</p></section></body>",
    "<body><article><p>+{28}</p><div class=legal-text><p>+{9}</p></div><div class=notice-box><p>-{4}</p></div></article></body>",
    "<body><div class='has-ads-banner post'><h1>+{2}</h1><p>+{12}</p></div></body>",
    "<body><article><h1>+{4}</h1><p>+{30}</p><p>+{2}</p></article></body>",
    "<body><article><h1>+{2}</h1><p>+{75}</p><p>+{7}</p><p>+{4}</p></article></body>",
    "<body><article><h1>+{3}</h1><p>+{12}</p><p><a>+{3}</a></p><p>+{9}</p><p><a>+{5}</a></p><p>+{90}</p><p><a>+{2}</a></p></article></body>",
    "<body><article><p>+{8}</p><p><a>+{6}</a></p><p><a>+{4}</a></p><h2><a>+{3}</a></h2><p>+{40}</p><ul><li><a>+{2}</a> {8}</li><li>+{1}</li></ul><p>+{5}</p></article></body>",
    "<body><article><h2>+{5}</h2><p>+{20}</p><ul><li><a>-{3}</a></li><li><a>-{2}</a></li><li><a>-{8}</a></li></ul></article><div>-{3}</div></body>",
    "<body><h1>+{6}</h1><p>+{44}</p><p>+{8}</p><div><a>-{2}</a></div><div>-{4}</div></body>",
    "<body><div>+{150}</div><div>-{2}</div></body>",
    "<body><ul><li><a>-{2}</a></li><li><a>-{3}</a></li></ul><p>+{15}</p><p>+{11}</p></body>",
    "<body class=has-sidebar><header class=site-header><a>-{2}</a></header><div class='content has-sidebar'><h1>+{6}</h1><p>+{55}</p><p>+{3}</p><p>+{21}</p></div><div class=sidebar><p>-{22}</p></div></body>",
    "<body><article class='post tag-privacy category-legal'><header class=entry-header><h1>+{5}</h1></header><div class=entry-content><p>+{40}</p><p>+{2}</p></div><div class=entry-meta>-{6}</div></article></body>",
    "<body><main class='main-content no-sidebar'><div class=article-header><h1>+{4}</h1><p>+{14}</p></div><p>+{65}</p><div class=share><a>-{1}</a></div></main></body>",
)


def labelled_tree() -> tuple | int:
    """The tree trained on :data:`LABELLED`."""
    xs, ys = [], []
    for page in LABELLED:
        found = blocks(re.sub(r"\{(\d+)\}", lambda m: _w(int(m[1])), page))
        xs.append(features([(b[0], *b[1:]) for b in found]))
        ys += [int(b[0].startswith("+")) for b in found]
    return train(np.concatenate(xs), np.array(ys))


def main_text(html: str, tree: tuple | int) -> str:
    found = blocks(html)
    return "\n\n".join(b[0] for b, row in zip(found, features(found).tolist()) if decide(tree, row))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per input row: key, url, text, n_chars. A map without any shuffle."""
    data = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).cast("string").alias("_html"))
    kinds = [f.dataType.simpleString() for f in data.schema.fields]
    tree = labelled_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_html", 4 << 20):
            texts = [main_text(t.as_py() or "", tree) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["_key", "_url", "text", "n_chars"])

    out = data.mapInArrow(run, f"_key {kinds[0]}, _url {kinds[1]}, text string, n_chars long")
    return out.withColumnsRenamed({"_key": key, "_url": url})
