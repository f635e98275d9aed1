"""Main text of web pages by composite text density.

Every DOM node gets its characters per tag, adjusted for links; a node's density
sum adds up its children's.  The subtree of the largest sum is the text.  The least
density on the path from it to the body is the threshold: what stands beside that
path joins the text where it is as dense, and a container whose class or id only may
name boilerplate leaves it where it is not."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements by how they are parsed.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
SAID = frozenset("h1 h2 h3 p".split())
CLOSES_P = BLOCK - frozenset("body html caption dd dt li option optgroup tbody td tfoot th thead tr legend".split())
# An element that ends an open one of its family, unless one of the family's holders comes between.
FAMILIES = {"li": ("li", "ul ol menu dir"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tr": ("tr", "table"), "option": ("option", "select")}
_SAME = {k: frozenset(same.split()) for k, (same, _) in FAMILIES.items()}
_WATCHED = {k: frozenset(f"{same} {holders}".split()) for k, (same, holders) in FAMILIES.items()}
_IN_FAMILY = frozenset().union(*_WATCHED.values())
_THROUGH_CELLS = frozenset("tr table tbody body html".split())  # end tags that may end a cell
# Elements and roles that are never main text.
DROPPED = frozenset(
    "nav footer aside form script style noscript template iframe button select textarea input svg canvas object head menu "
    "dialog audio video map".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Classes and ids of containers: adverts, comments and page furniture, and words that an
# article may use too, which density decides on.  A name counts by its last word
# (site-footer), adverts and comments by any.
CONTAINERS = frozenset("div section ul ol dl table span article center header".split())
NEVER = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsored|cookies?|gdpr|comments?|commentlist|disqus)(?=$|[\s_-])|"
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|pagination|side-?bar|footer|masthead)(?=$|\s)",
    re.I,
)
PERHAPS = re.compile(
    r"(?:^|[\s_-])(?:banners?|promos?|promotions?|consent|notices?|alerts?|pop-?ups?|modals?|overlays?|menus|pager|side-?bars|widgets?|footers|"
    r"header|top-?bar|replies|responses|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|toolbar|skip-?link)(?=$|\s)",
    re.I,
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/](?![a-zA-Z])[^>]*>|<![^>]*>|</?[a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^>])*+>", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "up", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "drop", "doubt", "block", "family")

    def __init__(self, tag: str, up: Node | None, drop: bool = False, doubt: bool = False):
        self.tag, self.up, self.drop, self.doubt = tag, up, drop, doubt
        self.parts: list[Node | str] = []  # children and text, in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        # the nearest block, and the nearest member or holder of each family, itself included
        self.block: Node = self if up is None or tag in BLOCK else up.block
        self.family: dict[str, Node] = {} if up is None else up.family
        if tag in _IN_FAMILY:
            self.family = self.family | {k: self for k, watched in _WATCHED.items() if tag in watched}


def _verdict(name: str, token: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is never main text, and whether its names put it in doubt."""
    if name in DROPPED or (name == "header" and not inside):
        return True, False
    if "=" not in token and "hidden" not in token:
        return False, False
    doubt = False
    for key, a, b, c in _ATTRIBUTE.findall(token):
        key, value = key.lower(), a or b or c
        if key == "role" and value.lower() in DROPPED_ROLES:
            return True, False
        if key in ("class", "id") and name in CONTAINERS:
            if NEVER.search(value):
                return True, False
            doubt = doubt or PERHAPS.search(value) is not None
        if (key == "hidden" and not value) or (key == "aria-hidden" and value.lower() == "true"):
            return True, False
        if key == "style" and _HIDDEN_STYLE.search(value):
            return True, False
    return False, doubt


def parse(html: str) -> Node:
    """The DOM of a whole page, forgiving of unclosed and stray tags.  Each element is
    left once and no end tag looks for one that is not open, so time follows the
    page's length."""
    root = Node("#root", None)
    here = root
    opened: dict[str, int] = {}  # open elements by name, and those within the innermost cell
    cells: list[dict[str, int]] = [{}]

    def leave(until: Node) -> None:
        nonlocal here
        while here is not until:
            opened[here.tag] -= 1
            if here.tag in ("td", "th"):
                cells.pop()
            else:
                cells[-1][here.tag] -= 1
            here = here.up

    at, end = 0, html.rfind(">") + 1
    while m := _TOKEN.search(html, at, end):
        if m.start() > at:
            here.parts.append(html[at : m.start()])
        token, at = m.group(), m.end()
        if token.startswith("<!--"):
            at = at if token.endswith("-->") else len(html)
            continue
        if token.startswith("<![CDATA["):
            here.parts.append(token[9:-3] if token.endswith("]]>") else token[9:])
            continue
        if not (n := _NAME.match(token)):
            continue
        name = n.group(1).lower()
        if token[1] == "/":
            if name in ("td", "th"):
                if (cell := here.family.get("td")) is not None and cell.tag == name:
                    leave(cell.up)
            elif (opened if name in _THROUGH_CELLS else cells[-1]).get(name, 0):
                up = here
                while up.tag != name:
                    up = up.up
                leave(up.up)
            elif name == "br":
                here.parts.append(" ")
            continue
        if (name in CLOSES_P or name == "p") and here.block.tag == "p":
            leave(here.block.up)
        if name in FAMILIES and (last := here.family.get(name)) is not None and last.tag in _SAME[name]:
            leave(last.up)
        if name == "br" or name == "wbr":
            here.parts.append(" " if name == "br" else "")
            continue
        drop, doubt = (True, False) if here.drop else _verdict(name, token, bool(opened.get("article") or opened.get("main")))
        node = Node(name, here, drop, doubt)
        here.parts.append(node)
        if name in VOID or token.endswith("/>"):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
            at = close.end() if close else len(html)
            continue
        opened[name] = opened.get(name, 0) + 1
        if name in ("td", "th"):
            cells.append({})
        else:
            cells[-1][name] = cells[-1].get(name, 0) + 1
        here = node
    if at < len(html):
        here.parts.append(html[at:])
    return root


def _measure(root: Node) -> list[Node]:
    """Counts and densities of all nodes; returns them, parents first."""
    order = [root]
    for node in order:  # grows while it is walked
        order.extend(x for x in node.parts if isinstance(x, Node))
    for node in reversed(order):
        for x in node.parts:
            if isinstance(x, Node):
                node.link_chars += x.chars if x.tag == "a" else x.link_chars
                node.link_tags += (x.tag == "a") + x.link_tags
                if not x.drop:
                    node.tags += 1 + x.tags
                    node.chars += x.chars
            else:
                node.chars += len(" ".join(unescape(x).split()))
    share = root.link_chars / max(root.chars + root.link_chars, 1)
    for node in order:
        if node.chars and not node.drop:
            own = min(node.link_chars, node.chars)
            base = log(node.chars / max(node.chars - own, 1) * own + share * node.chars + e)
            scale = node.chars / max(own, 1) * max(node.tags, 1) / max(node.link_tags, 1)
            node.density = node.chars / max(node.tags, 1) * log(max(scale, 1.0)) / max(log(base), 0.1)
    for node in order:
        node.total = sum(x.density for x in node.parts if isinstance(x, Node))
    return order


def _blocks(node: Node, threshold: float) -> list[str]:
    """The texts of a subtree's blocks, in page order, without containers in doubt
    that are less dense than the threshold."""
    out: list[str] = []
    now: list[str] = []

    def close() -> None:
        if text := " ".join(unescape("".join(now)).split()):
            out.append(text)
        now.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            now.append(x)
        elif not x.drop and (not x.doubt or x.density >= threshold or x is node):
            if x.tag in BLOCK:
                close()
                stack.append(None)
            stack.extend(reversed(x.parts))
    close()
    return out


def _choose(root: Node) -> tuple[Node, Node, float]:
    """The body, the subtree of the largest density sum and the body-path threshold.

    Subtrees in doubt take no part; where an article or main element holds text, only
    such elements and what is in them do.  Of equals the outermost is taken."""
    body, live, spoken = root, [], []
    order: list[tuple[Node, bool]] = [(root, False)]
    for n, inside in order:  # grows while it is walked
        if n.drop or n.doubt or not n.chars:
            continue
        if n.tag == "body" and body is root:
            body = n
        inside = inside or n.tag in ("article", "main")
        live.append(n)
        if inside:
            spoken.append(n)
        order.extend((x, inside) for x in n.parts if isinstance(x, Node))
    best = max(spoken or live, key=lambda n: n.total, default=body)
    if best.total <= 0 and not spoken:
        best = body
    threshold, n = best.density, best
    while n.up is not None and n is not body:
        n = n.up
        threshold = min(threshold, n.density)
    return body, best, threshold


def main_text(html: str | None) -> str:
    """The main text of a whole page: blocks joined by one newline, white space
    inside a block turned into one space.  Null, empty and textless pages: ''."""
    if not html:
        return ""
    root = parse(html)
    _measure(root)
    body, best, threshold = _choose(root)
    path, n = {id(best)}, best
    while n.up is not None:
        n = n.up
        path.add(id(n))
    out: list[str] = []
    stack: list[tuple[Node | str, bool]] = [(body if id(body) in path else root, False)]
    while stack:
        x, inside = stack.pop()
        if isinstance(x, str):
            if text := " ".join(unescape(x).split()):
                out.append(text)
        elif x is best:
            out.extend(_blocks(x, threshold))
        elif id(x) in path:
            inside = inside or x.tag in ("article", "main")
            stack.extend((y, inside) for y in reversed(x.parts))
        elif not x.drop and (x.density >= threshold or (not x.doubt and (x.tag in SAID or (inside and 2 * x.link_chars < x.chars)))):
            out.extend(_blocks(x, threshold))
    return "\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per row of ``pages``, in one pass
    without a shuffle.  A null page counts as empty and has an empty text, as has
    a page without main text.  Repeated rows stay; further columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"]
                )

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    ).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
