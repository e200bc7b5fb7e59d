"""Main text of web pages by composite text density.

A page becomes a tree.  For every node with C characters, T tags, LC link
characters and LT link tags, the composite density is

    C/T * log_b(C/LC * T/LT),   b = ln(C/(C - LC) * LC + LCb/Cb * C + e)

(zeros in denominators count as 1; LCb and Cb are the body's).  The node with the
largest sum of its children's densities is the core (among blocks, as inline elements
are their block's text; a block without blocks inside has its own density) and is kept
whole; the smallest
density on the path from the core to the body is the threshold, and what hangs off
that path stays if it is at least as dense.

Parts that element, role or class name mark as furniture (menus, page headers and
footers, sidebars, notices, adverts, forms, reader comments) take part in this: all
their characters and tags count as link characters and tags, and in a part's own
density its characters count twice so.  Its density is then below zero, that of
anything else is not: the core is sought only in what is not below zero, and only
that stays, inside the core too.  Nothing else is done about them.

Two rules keep an article whole where its densest part alone is the core: headings
on the path below the body stay, and so does, in an ancestor at least half as dense
as the core, everything that has no link.

Defined results for odd input: a null, empty or text-less page gives an empty
text.  Unclosed and stray tags are taken as browsers do in the common cases
(paragraphs and list items close one another; stray ends are ignored), and cut
character references stay as they are.  Repeated rows give equal texts.  Extra
columns stay; columns named like the results are replaced.  An empty table gives
no rows.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField

from .storage import add_columns

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<|[^<]+""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr caption ul".split()
)
#: Elements that are never shown as text.
UNSEEN = frozenset("head script style title noscript template iframe object embed svg canvas audio video datalist".split())
#: Elements that are furniture.
FURNITURE = frozenset("nav aside footer form button select textarea input label option menu dialog search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Class and id words of parts that are not article text; the second tuple holds starts of words.
WORDS = frozenset("ad ads adv adbox adslot adunit nav navbar navigation menu aside share sharing widget popup modal overlay gdpr toolbar pagination pager".split())
STARTS = ("advert", "adsense", "adsbygoogle", "sponsor", "promo", "sidebar", "cookie", "consent", "notice", "notification", "newsletter", "subscri", "signup", "login", "social", "comment", "disqus", "breadcrumb", "related", "banner", "outbrain", "taboola")
#: Such words outside an article only: an article's own header and footer blocks are named alike.
PAGE_WORDS = frozenset("header footer masthead topbar copyright".split())
#: A start tag on the left closes the nearest open element on the right, up to the stop elements.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
_P_STOPS = frozenset("table td th button object caption body html article section div main".split())


class Node:
    __slots__ = ("tag", "parent", "kids", "furniture", "chars", "tags", "link_chars", "link_tags", "density")

    def __init__(self, tag: str, parent: Node | None, furniture: bool = False):
        self.tag, self.parent, self.kids, self.furniture = tag, parent, [], furniture
        self.density = 0.0


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), unescape((m[2] or "").strip("\"'")))
    return out


def _kind(tag: str, raw: str, in_article: bool) -> str:
    """Whether an element is "unseen", "furniture" or neither ("")."""
    if tag in UNSEEN:
        return "unseen"
    marked = tag in FURNITURE or (tag == "header" and not in_article)
    if "=" not in raw and "hidden" not in raw:
        return "furniture" if marked else ""
    at = _attributes(raw)
    if "hidden" in at or at.get("aria-hidden") == "true":
        return "unseen"
    if marked or at.get("role", "").lower() in ROLES:
        return "furniture"
    if tag in ("body", "html", "article", "main"):
        return ""
    names = _NAME.findall(f"{at.get('class', '')} {at.get('id', '')}".lower())
    return "furniture" if any(n in WORDS or n.startswith(STARTS) or (not in_article and n in PAGE_WORDS) for n in names) else ""


def parse(html: str) -> Node:
    """The page's tree without what is never shown; text is a kid of type str."""
    root = node = Node("#root", None)
    skip = ""
    articles = 0
    for m in _TOKEN.finditer(html):
        name = m[2]
        if skip:
            if name and m[1] and name.lower() == skip:
                skip = ""
            continue
        if name is None:
            text = m[0]
            if not text.startswith(("<!", "<?")):
                node.kids.append(text)
            continue
        tag = name.lower()
        if m[1]:
            at = node
            while at is not root and at.tag != tag:
                at = at.parent
            if at is not root:
                while node is not at.parent:
                    articles -= node.tag == "article"
                    node = node.parent
            elif tag == "p":
                node.kids.append(Node("p", node))
            continue
        closing, stops = CLOSES.get(tag, ((), ()))
        if tag in BLOCK:
            closing, stops = (closing, stops) if closing else (("p",), _P_STOPS)
        if closing:
            at = node
            while at is not root and at.tag not in closing and at.tag not in stops:
                at = at.parent
            if at is not root and at.tag in closing:
                while node is not at.parent:
                    articles -= node.tag == "article"
                    node = node.parent
        if tag in RAW:
            skip = "" if m[3].endswith("/") else tag
            continue
        kind = _kind(tag, m[3], articles > 0)
        new = Node(tag, node, kind == "furniture")
        if kind != "unseen":
            node.kids.append(new)
        if tag not in VOID and not m[3].endswith("/"):
            node = new
            articles += tag == "article"
    return root


def _measure(root: Node) -> list[Node]:
    """Sets the counts of every node; returns the nodes, parents first."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [k for k in n.kids if type(k) is Node]
    for n in reversed(order):
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        for k in n.kids:
            if type(k) is str:
                n.chars += _length(k)
            else:
                n.chars += k.chars
                n.tags += 1 + k.tags
                n.link_chars += k.link_chars
                n.link_tags += k.link_tags + (k.tag == "a" or k.furniture)
        if n.tag == "a" or n.furniture:
            n.link_chars = n.chars
        if n.furniture:
            n.link_tags = n.tags
    return order


def _length(text: str) -> int:
    return len(text) if " " not in text and "\n" not in text else len("".join(text.split()))


def _density(n: Node, body: Node) -> float:
    if not n.chars:
        return 0.0
    c, t = n.chars, max(1, n.tags)
    lc, lt = max(1, n.link_chars * (2 if n.furniture else 1)), max(1, n.link_tags)
    base = math.log(c / max(1, c - n.link_chars) * n.link_chars + body.link_chars / max(1, body.chars) * c + math.e)
    inside = math.log(c / lc * t / lt)
    return c / t * inside / math.log(base) if base > 1 else c / t * inside


class _Text:
    """Collects blocks."""

    def __init__(self):
        self.blocks, self.now = [], []

    def cut(self) -> None:
        if self.now:
            text = " ".join("".join(self.now).split())
            if text:
                self.blocks.append(text)
            self.now = []

    def add(self, root: Node, wanted) -> None:
        """Appends the wanted kids of ``root`` and below; ``wanted`` is asked for texts too."""
        stack: list = [(root, None)]
        while stack:
            n, parent = stack.pop()
            if n is None:
                self.cut()
            elif parent is not None and not wanted(n, parent):
                continue
            elif type(n) is str:
                self.now.append(unescape(n))
            elif n.tag == "br":
                self.now.append(" ")
            else:
                if n.tag in BLOCK:
                    self.cut()
                    stack.append((None, None))
                kids = n.kids
                if n.tag == "header":  # of an article: its headings
                    kids = [k for k in kids if type(k) is Node and k.tag in HEADINGS]
                stack += [(k, n) for k in reversed(kids)]


def select(order: list[Node], body: Node) -> tuple[Node | None, list[Node], float]:
    """The core, the path from it to the body, and the threshold."""
    for n in order:
        n.density = _density(n, body)
    core, most, below = None, 0.0, set()
    for n in order:
        if n.parent in below or n.density < 0:
            below.add(n)
        elif n.chars and n.tag in BLOCK:
            total = sum(max(0.0, k.density) for k in n.kids if type(k) is Node and k.tag in BLOCK) or n.density
            if core is None or total > most:
                core, most = n, total
    if core is None and order[0].chars and not any(n.tag in BLOCK for n in order):
        core = order[0]
    path = [core] if core is not None else []
    while path and path[-1].parent is not None and path[-1] is not body:
        path.append(path[-1].parent)
    return core, path, min((n.density for n in path), default=0.0)


def extract(html: str | None) -> str:
    """The main text, one block a line."""
    if not html:
        return ""
    root = parse(html)
    order = _measure(root)
    body = next((n for n in order if n.tag == "body"), root)
    core, path, threshold = select(order, body)
    if core is None:
        return ""
    on_path = set(path) - {core}
    dense = {n for n in on_path - {path[-1]} if 2 * n.density >= core.density}

    def wanted(n: Node | str, parent: Node) -> bool:
        if parent not in on_path:  # inside the core or a part that stays
            return type(n) is str or n.density >= 0
        if n is core or n in on_path:
            return True
        if type(n) is str:
            return parent in dense or _length(n) >= max(1.0, threshold)
        if n.density < 0 or not n.chars:
            return False
        return n.density >= max(threshold, 1e-9) or (n.tag in HEADINGS and parent is not path[-1]) or (parent in dense and not n.link_chars)

    out = _Text()
    out.add(path[-1], wanted)
    out.cut()
    return "\n".join(out.blocks)


def extract_text(df: DataFrame, html: str = "html", drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds text and n_chars (code points)."""

    def make(column: pa.Array) -> list[pa.Array]:
        texts = [extract(h) for h in column.to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return add_columns(df, html, [StructField("text", StringType()), StructField("n_chars", LongType())], make, drop)


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages, drop=("html",)).select("page_id", "url", "text", "n_chars")
