"""Main text of web pages by a site style tree.

Pages of one host are merged: an element's place is the path of (tag, class, id) from the body. For
every place of a host the style tree keeps how often each presentation (the sequence of child
elements) and each content (the text below) occurs. Their entropies, relative to the number of
pages, give a place's importance: what looks and reads alike on page after page carries little.

What HTML says goes into the tree as a prior weight of a place between 0 and 1: menus, headers,
footers, asides, forms and what class, id or role call adverts, notices, sidebars or comments weigh
little, as does what lies outside the article or main element of a page that has one; words that may
as well name a topic weigh a half. A branch that holds the page's article, or on a page without one
most of its text, weighs 1 whatever its name. A place has the weight that it has on most of its pages.

A place is removed from every page of the host if weight times importance, relative to the most
varied place of the host, is below ``threshold``. Entropies tell nothing, and count as 1, for places
that hold half of the page's text or more on half of their pages, for those seen on fewer than
``least_pages`` pages, and on hosts whose pages all read alike; there the prior decides alone.
Scripts, styles, form controls and hidden elements are no text at all.

The tree is made of counts alone, which are added up before they are shuffled, so that a host with
a third of all pages costs no more than its distinct contents. Only the verdicts on places that
recur go back to the pages: broadcast up to a size that is measured, else by a join.

Defined results: a null or empty page has the empty text; broken markup is read as far as it goes;
a page without an address belongs to the host ""; repeated rows repeat and count once each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import cut, joined_to

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
DIGITS = re.compile(r"\d+")

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}

#: Elements that hold no text of the page.
SILENT = frozenset("head script style noscript template iframe button select option input textarea dialog svg canvas object audio video map title datalist legend".split())
#: Elements that seldom hold main text.
ASIDE = frozenset("nav footer aside form menu search".split())
#: Words in a class, id or role that name such parts.
NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adbox|adslot|banner|bottom-?bar|breadcrumbs?|comments?|commentlist|consent|cookies?|copyright|dialog|disclaimer|disqus|footer|gdpr|masthead|menu|menubar|modal|nav|navbar|navigation|newsletter|notices?|notification|overlay|pager|pagination|paywall|popup|promo|promoted|promotion|reactions?|replies|reply|respond|share|sharing|side-?bar|signup|site-?header|skip|sponsor|sponsored|subscribe|tags?|toolbar|top-?bar|widget|contentinfo|complementary)(?:$|[\s_-])", re.I)
#: Words that name such parts or what an article is about.
MAYBE = re.compile(r"(?:^|[\s_-])(?:alert|discussion|feedback|recommended|related|search|social|teaser)(?:$|[\s_-])", re.I)
#: Prior weights of a place: nothing speaks against it, a word that may, an element or word that does.
WEIGHTS = (1.0, 0.5, 0.2)
#: Words that tell a state or a topic of what an element holds, not what it is.
STATE = re.compile(r"(?<!\S)(?:(?:has|no|with|without)[-_]\S*|tags?[-_](?!(?:lists?|clouds?|links?)(?!\S))\S*|\S*[-_](?:open|closed))(?!\S)", re.I)
HEADERS = frozenset("header site-header page-header top-header global-header main-header hdr masthead page-head site-head".split())
MAIN = frozenset({"article", "main"})


class Node:
    __slots__ = ("children", "frame", "hint", "out", "parent", "parts", "place", "tag", "weight", "within")

    def __init__(self, tag: str, hint: int, parent: Node | None, place: int, within: bool):
        self.tag, self.hint, self.parent, self.place, self.within = tag, hint, parent, place, within
        self.out, self.weight, self.frame = False, 0, False
        self.children: list[Node] = []
        self.parts: list = []  # texts, nodes and line breaks in page order


def _opened(tag: str, attributes: str, parent: Node) -> Node:
    named, hidden = "", False
    if attributes:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        named = " ".join(found[k] for k in ("class", "id", "role") if found.get(k))
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    hint = 0
    if tag not in MAIN and tag not in ("body", "html"):
        words = STATE.sub(" ", named) if named else ""
        if tag in ASIDE or words and NAMED.search(words):
            hint = 2
        elif words and MAYBE.search(words):
            hint = 1
    if not parent.within and (tag == "header" or tag in ("div", "section", "table") and HEADERS.intersection(named.lower().split())):
        hint = 2  # a header inside an article holds its title
    style = f"{tag}|{DIGITS.sub('0', named)}"
    place = xxhash.xxh3_64_intdigest(style, parent.place & 0xFFFFFFFFFFFFFFFF)
    node = Node(tag, hint, parent, place, parent.within or tag in MAIN)
    node.out = tag in SILENT or hidden and tag not in MAIN and tag not in ("body", "html")
    return node


def _weigh(root: Node) -> None:
    """Set every element's weight, as an index of WEIGHTS, from the hints and where the page's article lies."""
    mains, hinted, stack = [], False, [(root, 0)]
    while stack:
        x, depth = stack.pop()
        if x.out:
            continue
        hinted |= x.hint > 0
        depth += x.hint > 0
        if x.tag in MAIN:
            mains.append((depth, x))
        stack += [(c, depth) for c in x.children]
    size = lambda x: len("".join(raw_text(x).split()))
    mains = [(depth, x) for depth, x in mains if size(x)]
    least = min((depth for depth, _ in mains), default=0)  # an article in a comment lies deeper than the page's own
    own = {x for depth, x in mains if depth == least}
    holds = set()
    for x in own:
        while x is not None and x not in holds:
            holds.add(x)
            x = x.parent
    whole = size(root) if hinted and not own else 0
    stack = [(root, 0, False)]
    while stack:
        x, above, inside = stack.pop()
        inside = inside or x in own
        if x in holds:
            weight = 0
        elif own and not inside:
            weight = 2
        else:
            weight = x.hint if x.hint and (own or 2 * size(x) <= whole) else 0
        x.weight, x.frame = max(above, weight), x in holds and not inside
        stack += [(c, x.weight, inside) for c in x.children if not c.out]


def parsed(html: str) -> Node:
    """The page's element tree, with HTML's implied ends of elements."""
    root = node = Node("", 0, None, 0, False)
    at, end = 0, len(html)

    def text(piece: str) -> None:
        if piece:
            node.parts.append(unescape(piece) if "&" in piece else piece)

    while at < end:
        m = TOKEN.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                node = up.parent
            elif tag in ("p", "br"):
                node.parts.append(None)
            continue
        if tag == "br" or tag == "hr":
            node.parts.append(None)
            continue
        if tag in CLOSES_P:
            up = node
            while up is not root and up.tag in INLINE:
                up = up.parent
            if up.tag == "p":
                node = up.parent
        if tag in SIBLING:
            up = node
            while up is not root and up.tag not in SIBLING[tag] and up.tag not in SCOPE.get(tag, {"table"}):
                up = up.parent
            if up.tag in SIBLING[tag]:
                node = up.parent
        own = _opened(tag, m[3], node)
        node.children.append(own)
        node.parts.append(own)
        if tag in VOID or m[3].endswith("/") and tag not in INLINE and tag not in CLOSES_P:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = close.end() if close else end
            continue
        node = own
    _weigh(root)
    return root


def blocks(root: Node, removed: frozenset[int] | set[int] = frozenset(), kept: frozenset[int] | set[int] = frozenset(), threshold: float = 0.25) -> list[str]:
    """Texts of the blocks below ``root`` in page order, without branches whose place is ``removed`` or whose weight says so and isn't overruled by ``kept``."""
    out: list[str] = []
    line: list[str] = []

    def close() -> None:
        if line:
            if joined := " ".join("".join(line).split()):
                out.append(joined)
            line.clear()

    stack: list = [root]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            line.append(x)
        elif not (x.out or x.place in removed or WEIGHTS[x.weight] < threshold and x.place not in kept):
            parts = [c for c in x.parts if not isinstance(c, str)] if x.frame else x.parts  # what lies beside the article
            if x.tag in INLINE:
                stack += reversed(parts)
            else:
                close()
                stack.append(None)
                stack += reversed(parts)
    close()
    return out


def raw_text(root: Node) -> str:
    """All text below ``root`` that isn't out, white space as it is."""
    out: list[str] = []
    stack: list = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is not None and not x.out:
            stack += reversed(x.parts)
    return "".join(out)


def main_text(root: Node, removed: set[int] | frozenset = frozenset(), kept: set[int] | frozenset = frozenset(), threshold: float = 0.25) -> str:
    """The page's main text, blocks joined by line feeds."""
    return "\n".join(blocks(root, removed, kept, threshold))


def style_rows(root: Node) -> list[tuple[int, int, int, int, int]]:
    """(place, presentation, content, weight, large) of each place of the page that has text.

    Elements at one place count together. Inline elements belong to their block's presentation.
    A place is large if it holds half as much text as the place that holds most, or more.
    """
    at: dict[int, list] = {}
    stack = [root]
    while stack:
        x = stack.pop()
        if x.out or x.tag in INLINE:
            continue
        if x.tag not in ("", "html", "body"):
            at.setdefault(x.place, []).append(x)
        stack += reversed(x.children)
    texts = {p: "".join(map(raw_text, xs)) for p, xs in at.items()}
    whole = max(map(len, texts.values()), default=0)
    digest = xxhash.xxh3_64_intdigest
    return [(p, digest(" ".join(c.tag for x in at[p] for c in x.children)), digest(t), min(x.weight for x in at[p]), int(2 * len(t) >= whole)) for p, t in texts.items() if t and not t.isspace()]


def _host(url_col: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, place, pages, weight, weightless, large, presentation, content): the site style trees.

    ``weight`` is an index of WEIGHTS, ``weightless`` tells whether the place weighs least on any page,
    ``large`` whether it is on half of its pages, and the entropies lie between 0 and 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple, int] = {}
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                for row in style_rows(parsed(html.as_py() or "")):
                    counts[(host, *row)] = counts.get((host, *row), 0) + 1
            columns = list(zip(*counts, strict=True)) or [()] * 6
            longs = [pa.array(np.asarray(v, "u8").view("i8")) for v in columns[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *longs, pa.array(list(counts.values()), pa.int64())], names=["host", "place", "look", "content", "weight", "large", "n"])

    found = pages.select(_host(url_col).alias("host"), F.col(html_col).alias("html")).mapInArrow(run, "host string, place long, look long, content long, weight long, large long, n long")
    kinds = found.select("host", "place", "weight", "large", "n", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("look").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("content").alias("value")))).alias("x"))
    counted = kinds.groupBy("host", "place", "x.kind", "x.value").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("large")).alias("large"), *[F.sum(F.when(F.col("weight") >= k, F.col("n")).otherwise(0)).alias(f"at_least_{k}") for k in (1, 2)]
    )
    of = lambda k, v: F.sum(F.when(F.col("kind") == k, v))
    total = counted.groupBy("host", "place").agg(
        of(1, F.col("n")).alias("pages"), *[of(1, F.col(c)).alias(c) for c in ("large", "at_least_1", "at_least_2")], of(0, F.col("n") * F.log2("n")).alias("look_log"), of(1, F.col("n") * F.log2("n")).alias("content_log")
    )
    entropy = lambda c: F.when(F.col("pages") > 1, (F.log2("pages") - F.col(c) / F.col("pages")) / F.log2("pages")).otherwise(1.0)
    most = lambda c: 2 * F.col(c) > F.col("pages")
    weight = F.when(most("at_least_2"), 2).when(most("at_least_1"), 1).otherwise(0)
    return total.select("host", "place", "pages", weight.alias("weight"), (F.col("at_least_2") > 0).alias("weightless"), (2 * F.col("large") >= F.col("pages")).alias("large"), entropy("look_log").alias("presentation"), entropy("content_log").alias("content"))


def judged(tree: DataFrame, threshold: float = 0.25, least_pages: int = 4, gamma: float = 0.9) -> DataFrame:
    """(host, removed, kept): the places of low importance, and those that a page's own weights would drop but the tree keeps."""
    rows = tree.filter(F.col("pages") >= least_pages)
    varied = rows.groupBy("host").agg(F.max("content").alias("best"))
    own = ((1 - gamma) * F.col("presentation") + gamma * F.col("content")) / F.col("best")
    importance = F.when(F.col("large") | (F.col("best") <= 0.3), 1.0).otherwise(own)
    prior = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("weight") + 1)
    decided = rows.join(varied, "host").withColumn("low", prior * importance < threshold).filter(F.col("low") | F.col("weightless"))
    places = lambda x: F.collect_list(F.when(x, F.col("place")))
    return decided.groupBy("host").agg(places(F.col("low")).alias("removed"), places(~F.col("low")).alias("kept"))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.25) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    verdicts = cut(judged(style_tree(pages, url_col, html_col), threshold))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), _host(url_col).alias("host"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = lambda x: {p % (1 << 64) for p in x.as_py() or ()}
        for batch in batches:
            texts = [main_text(parsed(html.as_py() or ""), places(removed), places(kept), threshold) for html, removed, kept in zip(batch.column("html"), batch.column("removed"), batch.column("kept"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    met = joined_to(rows, verdicts, ["host"], "left").select("page_id", "url", "html", "removed", "kept")
    return met.mapInArrow(run, "page_id long, url string, text string, n_chars long")
