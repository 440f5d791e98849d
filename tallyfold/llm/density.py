"""Main text of web pages by composite text density.

A page is read into a tree. Each node's density is the characters of its text per tag below it, adjusted by the share of linked
characters; the sum of the densities of a node's children tells where text is gathered. The node with the greatest sum is the
main subtree; the least density on its path from the body is the threshold below which other subtrees count as boilerplate.
Parts whose tag, role, class or id names them as menus, notices, adverts, forms or comments are left out before.

Pages are independent rows, so a task holds one batch of them and one tree at a time.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg".split())
UNSEEN = RAW | frozenset("head object canvas audio video select option datalist button input".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold an article, and elements inside one that are text whatever they are called.
ARTICLE = frozenset("article main".split())
TEXTUAL = HEADINGS | frozenset("p blockquote pre figure figcaption table tr td th dl dt dd li a em strong b i span code q cite time small sup sub label".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html dd dt li tbody td tfoot th thead tr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|side|aside|widget|ads?|adverts?|advertisement|"
    r"banner|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|"
    r"search|form|share|sharing|social|related|recommended|comments?|comment-?list|disqus|replies|respond|pagination|pager|toolbar|skip|copyright|legal)"
    r"(?:$|[\s_-])"
)
COMMENTS = re.compile(r"comment|disqus|repl|respond")
#: Inside an article a part is something else only if a whole name says so, alone or with a word for a box.
_PARTS = "box|bar|block|banner|links?|buttons?|list|posts?|items?|stories|articles|section|widget|container|form|wrapper|wrap|area|unit|slot|inner|thread|prompt|message"
WHOLLY = re.compile(
    r"(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|widget|ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|notice|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|comments?|disqus|replies|respond|pagination|pager|toolbar|skip|copyright)"
    rf"(?:[-_](?:{_PARTS}|ads?|cookies?|comments?|share|notice|promo|signup|consent))*"
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+>?|</([a-zA-Z][^\s/>]*+)[^>]*+>?|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^>]*+)>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|$)|'([^']*)(?:'|$)|([^\s>]+)))?")
_BLANK = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parts", "up", "marked", "chars", "tags", "linked", "linked_tags", "density", "total")

    def __init__(self, tag: str, up: Node | None, marked: int = 0) -> None:
        self.tag, self.up, self.marked, self.parts = tag, up, marked, []

    def children(self) -> Iterator[Node]:
        return (p for p in self.parts if isinstance(p, Node))


def _marked(tag: str, attributes: str, inside: bool = False) -> int:
    """Whether an element is named as something other than the article: 0 no, 1 by a name that may also stand around the article, 2 for sure.
    Inside an article, headings and other textual elements go by no name, and boxes by whole names only."""
    if tag in BOILERPLATE:
        if inside and (tag == "header" or tag == "aside" and "quote" in attributes.lower()):
            return 0
        return 1 if tag in ("form", "aside", "header") and not inside else 2
    if not attributes or tag in ("html", "body", "article", "main"):
        return 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id"):
            if inside:
                if tag not in TEXTUAL and any(WHOLLY.fullmatch(word) for word in value.split()):
                    return 2
            elif tag not in HEADINGS and (found := MARKED.search(value)):
                return 2 if COMMENTS.search(found[0]) else 1
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return 2
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return 2
    return 0


def parse(page: str) -> Node:
    """The tree of a page. Elements that are left open end where HTML says or with their parent; unseen content is skipped. What is open is counted, so
    that stray end tags cost nothing, and after the last ``>`` there are no tags."""
    root = Node("html", None)
    here, at, size, last = root, 0, len(page), page.rfind(">")
    open_tags: Counter[str] = Counter()

    def leave(upto: Node) -> Node:
        """Ends all elements from ``here`` up to and with ``upto``."""
        node = here
        while True:
            open_tags[node.tag] -= 1
            if node is upto:
                return node.up
            node = node.up

    while at < size:
        cut = page.find("<", at)
        if cut < 0 or cut > last:
            cut = size
        if cut > at:
            here.parts.append(html.unescape(page[at:cut]))
        if cut == size:
            break
        found = _TOKEN.match(page, cut)
        if not found:
            here.parts.append("<")
            at = cut + 1
            continue
        at = found.end()
        if found[1]:
            tag, open_ = found[1].lower(), here
            if open_tags[tag] > 0:
                while open_.tag != tag:
                    open_ = open_.up
                here = leave(open_)
        elif found[2]:
            tag = found[2].lower()
            if tag in RAW and not found[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*+>?", re.I).search(page, at)
                at = end.end() if end else size
                continue
            if tag in ("html", "body"):
                if tag == "body" and not any(n.tag == "body" for n in root.children()):
                    open_tags.clear()
                    here = Node("body", root)
                    root.parts.append(here)
                continue
            ended = _ended(here, tag, open_tags)
            if ended is not None:
                here = leave(ended)
            inside = any(open_tags[t] > 0 for t in ARTICLE)
            node = Node(tag, here, _marked(tag, found[3], inside))
            here.parts.append(node)
            if tag not in VOID and not found[3].endswith("/"):
                open_tags[tag] += 1
                here = node
    return root


def _ended(here: Node, tag: str, open_tags: Counter[str]) -> Node | None:
    """The open element that a new one ends: some end the one before them of their kind."""
    if tag in CLOSES_P:
        open_ = here
        while open_tags["p"] > 0 and open_.up is not None and open_.tag not in BLOCK:
            open_ = open_.up
        return open_ if open_.tag == "p" else None
    for group, stop in ((("li",), ("ul", "ol", "menu")), (("dt", "dd"), ("dl",)), (("td", "th"), ("tr", "table")), (("tr",), ("table",)), (("option",), ("select",))):
        if tag in group and any(open_tags[t] > 0 for t in group):
            open_ = here
            while open_.up is not None and open_.tag not in stop:
                if open_.tag in group:
                    return open_
                open_ = open_.up
    return None


def _order(root: Node) -> list[Node]:
    """Every node after its parent."""
    nodes = [root]
    for node in nodes:
        nodes.extend(node.children())
    return nodes


def measure(root: Node) -> list[Node]:
    """Fills in characters, tags, densities and density sums from the leaves up. Left-out parts count as nothing."""
    nodes = _order(root)
    for node in reversed(nodes):
        own = sum(len(_BLANK.sub(" ", p).strip()) for p in node.parts if isinstance(p, str))
        kids = [k for k in node.children() if not k.marked and k.tag not in UNSEEN]
        node.chars = own + sum(k.chars for k in kids)
        # A formula is one element, however many its signs are.
        node.tags = 0 if node.tag == "math" else sum(k.tags + 1 for k in kids)
        link = node.tag == "a"
        node.linked = node.chars if link else sum(k.linked for k in kids)
        node.linked_tags = node.tags if link else sum(k.linked_tags + (k.tag == "a") for k in kids)
    body = root
    ratio = body.linked / body.chars if body.chars else 0.0
    for node in reversed(nodes):
        if not node.chars:
            node.density = 0.0
        else:
            tags, plain = max(node.tags, 1), max(node.chars - node.linked, 1)
            linked, linked_tags = max(node.linked, 1), max(node.linked_tags, 1)
            base = math.log(node.chars * node.linked / plain + ratio * node.chars + math.e)
            node.density = max(node.chars / tags * math.log(max(node.chars * tags / (linked * linked_tags), 1.0), max(base, math.e)), 0.0)
        node.total = sum(k.density for k in node.children() if not k.marked and k.tag not in UNSEEN)
    return nodes


def _wanted(root: Node) -> list[Node]:
    """The main subtree and the others that reach the threshold of its path from the body, in page order.

    If the subtree lies in an article or main element, that is taken whole: its headings and short blocks belong to it. Elsewhere headings
    beside the subtree are taken with it."""
    body = next((n for n in root.children() if n.tag == "body"), root)
    body.marked = False
    _trusted(root, body)
    nodes = [n for n in measure(root) if n.chars]
    shown = {id(body)}
    for n in nodes:
        if n.up is not None and id(n.up) in shown and not n.marked and n.tag not in UNSEEN:
            shown.add(id(n))
    nodes = [n for n in nodes if id(n) in shown]
    if not nodes:
        return []
    best = max(nodes, key=lambda n: n.total)
    while best is not body and best.tag not in BLOCK:
        best = best.up
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].up)
    threshold = min(n.density for n in path)
    for n in path:
        if n.tag in ARTICLE:
            best = n
    wanted = [best]
    for parent in path[path.index(best) + 1 :]:
        before = True
        for n in parent.children():
            if n in path:
                before = False
            elif id(n) in shown and n.chars:
                heading = before and n.tag in HEADINGS
                if heading or n.density >= threshold and n.linked * 3 < n.chars and n.tag in BLOCK:
                    wanted.append(n)
    place = {id(n): i for i, n in enumerate(_reading(body))}
    return sorted(wanted, key=lambda n: place[id(n)])


def _reading(top: Node) -> Iterator[Node]:
    stack = [top]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(reversed(list(node.children())))


def _trusted(root: Node, body: Node) -> None:
    """A part that is named as something else but holds most of the text is the article after all (a form around the whole
    page, ``class="content with-sidebar"``), unless it holds comments."""
    nodes = _order(root)
    sizes: dict[int, int] = {}
    for node in reversed(nodes):
        own = sum(len(p) for p in node.parts if isinstance(p, str) and not p.isspace())
        sizes[id(node)] = own + sum(sizes[id(k)] for k in node.children() if k.tag not in UNSEEN)
    for node in nodes:
        if node.marked == 1 and 2 * sizes[id(node)] > sizes[id(body)]:
            node.marked = 0


def blocks(node: Node) -> list[str]:
    """Texts of the blocks of a subtree in page order, white space made one space."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = _BLANK.sub(" ", "".join(run)).strip()
        if text:
            out.append(text)
        run.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        item = stack.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            run.append(item)
        elif item.marked or item.tag in UNSEEN:
            if item.tag in BLOCK:
                close()
        elif item.tag == "br":
            run.append(" ")
        else:
            if item.tag in BLOCK:
                close()
                stack.append(None)
            stack.extend(reversed(item.parts))
    close()
    return out


def main_text(page: str | None) -> str:
    """The article of a page; a null or empty page has none."""
    if not page:
        return ""
    return "\n".join(b for n in _wanted(parse(page)) for b in blocks(n))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page, from its whole html. Null html is empty; null ids and urls, repeated rows and
    other columns do not matter."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [main_text(x.as_py()) for x in part.column("html")]
                yield pa.record_batch(
                    {
                        "page_id": part.column("page_id"),
                        "url": part.column("url"),
                        "text": pa.array(texts, pa.string()),
                        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                    }
                )

    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )
