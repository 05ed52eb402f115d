"""Main text of web pages, by scoring the tree of elements.

Paragraphs give points for their length and commas to their ancestors, less with distance; an element's points are
discounted by its link density. The best container and those of its siblings that hold text and few links are kept (beside an article only
further articles and paragraphs), without the parts that are never content: menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .queries import Query
from .words import chunks

#: How elements of a page behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title svg select".split())
BLOCKS = frozenset(("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul").split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
          "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
PARAGRAPH_ENDS = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "summary", "figcaption"}

#: Elements, roles and words in class or id of parts that are never content.
DROPPED = frozenset("head nav footer aside form button menu dialog label input".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
DROPPED_WORDS = frozenset((
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations pagination pager toolbar widget").split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
CONTENT_WORDS = frozenset("article content main body post entry text story page hentry blog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Every "<" with a letter behind it and a ">" somewhere after it is a tag: up to a ">" outside of quotes, or else to the first one.
_TAG = re.compile(r"<!--|<!\[CDATA\[|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)(?:((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|([^>]*)>)")
#: One attribute after the other, so that what stands in a value is never taken for a name.
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?|["'=]""")
_LOOKED_AT = frozenset("class id role hidden style aria-hidden".split())
_CUT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")

#: Elements that are paragraphs, and others whose own text counts as one.
PARAGRAPHS = frozenset("p pre blockquote td li dd".split())
HOLDERS = frozenset("div section article main body".split())
#: Points of a paragraph need so many characters; one point, one more for each comma and for each hundred characters up to three.
LEAST_CHARS = 25


class Node:
    __slots__ = ("tag", "attributes", "parent", "children", "depth", "points", "chars", "link_chars", "said", "commas", "dropped")

    def __init__(self, tag: str, attributes: str, parent: "Node | None"):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []
        self.depth = 0 if parent is None else parent.depth + 1
        self.points, self.chars, self.link_chars, self.said, self.commas, self.dropped = 0.0, 0, 0, 0, 0, False


def parse(page: str) -> Node:
    """A tree of the page. Tags that are not closed are closed by what follows; what is cut off at the end is kept.

    Only a script or style that is never closed runs to the end; of other elements without content the tag alone goes.
    """
    root = here = Node("#page", "", None)
    path, opened = [root], defaultdict(list)  # open elements from the outside in, all and by their tag
    unclosed: set[str] = set()
    at, n = 0, len(page)
    last, last_cdata = page.rfind(">") + 1, page.rfind("]]>")

    def add_text(text: str) -> None:
        here.children.append(html.unescape(text) if "&" in text else text)

    def leave(depth: int) -> Node:
        """Close all elements from this depth on."""
        while len(path) > depth:
            opened[path.pop().tag].pop()
        return path[-1]

    def leave_outermost(tags: tuple[str, ...], until: tuple[str, ...]) -> Node:
        """Close the outermost open element of ``tags`` below the nearest of ``until``."""
        floor = max((opened[t][-1].depth for t in until if opened[t]), default=0)
        inside = [x[i].depth for x in (opened[t] for t in tags) if (i := bisect_right(x, floor, key=lambda e: e.depth)) < len(x)]
        return leave(min(inside)) if inside else path[-1]

    while at < n:
        m = _TAG.search(page, at, last) if at < last else None
        if not m:
            # What is cut off inside a comment goes, as does a comment without an end.
            cut = page.find("<!--", at)
            add_text(page[at: cut if cut >= 0 else n])
            break
        if m.start() > at:
            add_text(page[at: m.start()])
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = end + 3 if end >= 0 else n
            continue
        if m[0] == "<![CDATA[":
            if at <= last_cdata:
                end = page.find("]]>", at)
                here.children.append(page[at:end])
                at = end + 3
            else:
                at = page.find(">", at) + 1 or n
            continue
        closing, name, attributes = m[1], m[2], m[3] or m[4] or ""
        if not name:
            continue
        tag = name.lower()
        if closing:
            if opened[tag]:
                here = leave(opened[tag][-1].depth)
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/") and tag not in unclosed:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at, last)
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = n
                else:
                    unclosed.add(tag)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                here.children.append(" ")
            continue
        if tag in PARAGRAPH_ENDS:
            leave_outermost(("p",), ("td", "th", "li", "div", "article", "section", "main", "body", "blockquote"))
        if tag in CLOSES:
            which, until = CLOSES[tag]
            leave_outermost(tuple(which.split()), until)
        node = Node(tag, attributes, path[-1])
        path[-1].children.append(node)
        path.append(node)
        opened[tag].append(node)
        here = node
    return root


def _words(node: Node) -> tuple[set[str], str, bool]:
    """Words of class and id, the role, and whether the element is hidden."""
    words: set[str] = set()
    role, hidden = "", False
    if node.attributes:
        for key, value in _ATTRIBUTE.findall(node.attributes):
            key = key.lower()
            if key not in _LOOKED_AT:
                continue
            value = html.unescape(value[1:-1] if value[:1] in ("'", '"') else value)
            if key in ("class", "id"):
                words.update(x for x in _CUT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()) if x)
            elif key == "role":
                role = value.strip().lower()
            elif key == "style":
                hidden |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
            elif key == "hidden":
                hidden = True
            else:
                hidden |= value.lower() == "true"
    return words, role, hidden


def _is_dropped(node: Node, words: set[str], role: str, hidden: bool, in_article: bool) -> bool:
    if node.tag in ("html", "body", "main", "#page"):
        return False
    if hidden or words & COMMENT_WORDS:
        return True
    if node.tag == "article":
        return bool(words & DROPPED_WORDS) and not words & CONTENT_WORDS
    if node.tag in DROPPED or role in DROPPED_ROLES or (node.tag == "header" and not in_article):
        return True
    if node.tag == "p" or node.tag in HEADINGS:
        return bool(words & {"ad", "ads", "advert", "advertisement", "sponsored", "promo", "notice", "cookie"})
    return bool(words & DROPPED_WORDS) and not words & CONTENT_WORDS or bool(words & {"header"} and not words & CONTENT_WORDS and not in_article)


def _score(root: Node) -> list[Node]:
    """Mark what is dropped, measure text and links, and give out points. Returns the kept elements in page order."""
    order: list[Node] = []
    stack = [(root, False, False)]
    while stack:
        node, in_article, in_link = stack.pop()
        words, role, hidden = _words(node)
        node.dropped = _is_dropped(node, words, role, hidden, in_article)
        if node.dropped:
            continue
        if node.tag in ("article", "main"):
            node.points += 25
        if words & CONTENT_WORDS:
            node.points += 10
        order.append(node)
        in_article |= node.tag in ("article", "main")
        in_link |= node.tag == "a"
        own = 0
        for child in node.children:
            if isinstance(child, str):
                own += len(child.strip())
                node.commas += child.count(",")
        node.chars = node.said = own
        node.link_chars = own if in_link else 0
        stack.extend((child, in_article, in_link) for child in reversed(node.children) if isinstance(child, Node))
    for node in reversed(order):
        # Text of elements that hold no paragraph of their own counts for the one around them.
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
            if node.tag not in PARAGRAPHS and node.tag not in HOLDERS:
                node.parent.said += node.said
                node.parent.commas += node.commas
    for node in order:
        if (node.tag in PARAGRAPHS or node.tag in HOLDERS) and node.said >= LEAST_CHARS:
            points = (1 + node.commas + min(node.said // 100, 3)) * (1 - node.link_chars / max(1, node.chars))
            up, share = node.parent if node.tag in PARAGRAPHS else node, 1.0
            far = 1
            while up is not None and far <= 4:
                up.points += points * share
                far += 1
                share = 1 / far if far == 2 else 1 / (far * 2)
                up = up.parent
    for node in order:
        node.points *= 1 - node.link_chars / max(1, node.chars)
    return order


def _text(nodes: list[Node]) -> str:
    out: list[str] = []
    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.dropped:
            if x.tag in BLOCKS:
                out.append(" ")
                stack.append(" ")
            stack.extend(reversed(x.children))
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    if not page:
        return ""
    order = _score(parse(page))
    holders = [x for x in order if x.points > 0 and x.tag in BLOCKS and x.tag not in ("p", "html") and x.tag not in HEADINGS]
    if not holders:
        body = next((x for x in order if x.tag == "body"), order[0] if order else None)
        return _text([body]) if body is not None and body.link_chars * 2 <= max(1, body.chars) else ""
    best = max(holders, key=lambda x: x.points)
    # A part of an article stands for the article.
    up = best
    while up is not None and up.tag not in ("article", "main", "body", "#page"):
        up = up.parent
    if up is not None and up.tag in ("article", "main"):
        best = up
    elif best.tag in ("li", "ul", "ol", "td", "tr", "tbody", "blockquote", "dd", "dl"):
        while best.parent is not None and best.tag in ("li", "ul", "ol", "td", "tr", "tbody", "table", "blockquote", "dd", "dl") and not best.parent.dropped:
            best = best.parent
    if best.parent is None:
        return _text([best])
    article = best.tag in ("article", "main")
    return _text([x for x in best.parent.children if x is best or isinstance(x, Node) and _stays(x, article)])


def _stays(x: Node, beside_article: bool) -> bool:
    """Whether a sibling of the best container is kept. It does not depend on how long either of them is."""
    if x.dropped or not x.chars:
        return False
    dense = x.link_chars / x.chars
    if beside_article:
        return x.tag == "article" and dense < 0.5 or x.tag == "p" and dense < 0.25
    return x.tag in HEADINGS or x.tag in BLOCKS and dense < 0.25


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Null or empty html, and a page without any text of its own, give an empty text. Rows are independent: repeated rows and
    null ids give their own rows, other columns are not read, an empty table gives none.
    """
    rows = pages.select("page_id", "url", pages["html"].cast("string").alias("html"))
    kinds = dict(rows.dtypes)

    def work(batches):
        for batch in (part for whole in batches for part in chunks(whole, "html")):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op10_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op10_extraction": Query(op10_extraction)}
