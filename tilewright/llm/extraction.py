"""Main text of web pages by tree scoring.

A page becomes a tree of elements.  Scripts, styles, forms, menus and other elements that are never part of an article go, by their
tag, role or name.  Every paragraph then has points for its length and commas and passes them to its ancestors, half as many
with each step up; a container's score is its points less the share of its text that lies in links.  The best container is
kept with those of its siblings that look like text, and so on upwards while the siblings do.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, functions as F

from tilewright.llm.stages import over_batches

VOID = frozenset("area base basefont bgsound br col command embed frame hr img input keygen link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
 h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold no text of an article.
DROPPED = frozenset("""applet aside audio button canvas datalist dialog embed footer frameset head iframe input label map math menu menuitem meter nav noframes noscript
 object optgroup option output progress script search select style svg template textarea title video""".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Beginnings of words in class and id that name what surrounds an article ...
AROUND = ("advert", "adsbygoogle", "banner", "breadcrumb", "comment", "consent", "contentinfo", "cookie", "copyright", "disclaimer", "disqus", "footer", "gdpr",
          "login", "masthead", "modal", "navbar", "navigation", "newsletter", "notice", "notification", "outbrain", "overlay", "pagination", "popup", "promo",
          "recommend", "related", "replies", "respond", "shar", "sidebar", "signup", "skip", "social", "sponsor", "subscri", "taboola", "toolbar", "widget")
COMMENTS = ("comment", "discussion", "disqus", "replies", "respond")
#: ... and whole words that do.
AROUND_WORDS = frozenset("ad ads alert aside discussion header hidden legal menu nav pager sharing teaser tags tool tools topbar".split())
KEPT = frozenset("html body article main".split())
_CLOSES_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: An opening tag ends an open element of these names, looked for up to one of those.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
         "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
         "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"tbody"}, {"table"})}
_SCOPES = frozenset("td th table caption button object html".split())
_NAME = re.compile("[a-z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_COMMAS = re.compile("[,،、，﹐]")
LINKED = 0.8   # of the text of a list or box with three links or more: a menu
WHOLE = 0.5    # of the page's paragraph text: an element that holds so much is not taken for a surrounding part by its name


class Node:
    __slots__ = ("tag", "parent", "children", "around", "flag", "chars", "linked", "links", "paragraphs", "points", "main", "titled")

    def __init__(self, tag: str, parent, around: int = 0):
        self.tag, self.parent, self.children = tag, parent, []
        self.around = around                       # named like a surrounding part: 1, like readers' comments: 2
        self.flag = False                          # taken out
        self.chars = self.linked = self.links = self.paragraphs = 0
        self.points, self.main, self.titled = 0.0, False, False  # main: holds an article; titled: holds an h1


def _named_around(tag: str, attrs) -> int:
    """Whether role, style, class or id say that an element surrounds an article or is not shown (1), or holds readers' comments (2)."""
    if not attrs:
        return 0
    names = dict(attrs)
    if "hidden" in names or (names.get("aria-hidden") or "").lower() == "true" or _UNSEEN.search((names.get("style") or "").lower()):
        return 1
    if (names.get("role") or "").strip().lower() in ROLES:
        return 1
    if tag in KEPT:
        return 0
    raw = " ".join(names.get(k) or "" for k in ("class", "id"))
    words = _NAME.findall(f"{raw} {re.sub('(?<=[a-z])(?=[A-Z])', ' ', raw)}".lower())
    return max((2 if w.startswith(COMMENTS) else 1 for w in words if w in AROUND_WORDS or w.startswith(AROUND)), default=0)


class _Tree(HTMLParser):
    """Builds the tree; unclosed and wrongly nested elements end where a browser would end them, roughly."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("html", None)
        self.nodes = [self.root]
        self.open: dict[str, int] = {}

    def _leave(self, node):
        """`node` and all that is open in it ends."""
        while self.now is not node.parent:
            self.open[self.now.tag] -= 1
            self.now = self.now.parent

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        if tag in _CLOSES_P:
            self._end({"p"}, _SCOPES)
            if tag in HEADINGS and self.now.tag in HEADINGS:
                self._leave(self.now)
        if self.now.tag == "head" and tag in BLOCKS:
            self._leave(self.now)  # a head ends where the body's first block begins
        if tag in _ENDS:
            self._end(*_ENDS[tag])
        node = Node(tag, self.now, _named_around(tag, attrs))
        self.now.children.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.now = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash of <div/> means nothing

    def handle_endtag(self, tag):
        if tag == "br":
            self.now.children.append(" ")
        elif tag in BLOCKS:
            self._end({tag}, {"table", "html"} if tag != "table" and tag not in _ENDS else {"html"})
        elif tag not in VOID:
            self._end({tag}, BLOCKS if tag not in DROPPED else {"html"})

    def _end(self, names, stops):
        if not any(self.open.get(x) for x in names):
            return
        node = self.now
        while node.tag not in names:
            if node is self.root or node.tag in stops:
                return
            node = node.parent
        self._leave(node)

    def handle_data(self, data):
        self.now.children.append(data)


def _tree(html: str) -> list[Node]:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.nodes


def _measured(nodes: list[Node]) -> None:
    """Text, linked text and links below every element that is not taken out; children follow their parents in `nodes`."""
    for node in nodes:
        node.chars = sum([len(x.strip()) for x in node.children if x.__class__ is str])
        node.linked = node.links = node.paragraphs = 0
    for node in reversed(nodes):
        if node.tag == "a":
            node.linked, node.links = node.chars, node.links + 1
        if node.tag in ("p", "pre", "blockquote", "h1"):
            node.paragraphs = node.chars
        above = node.parent
        if above is not None and not node.flag:
            above.chars += node.chars
            above.linked += node.linked
            above.links += node.links
            above.paragraphs += node.paragraphs
            above.main |= node.main or node.tag in ("article", "main")
            above.titled |= node.titled or node.tag == "h1"


def _take_out(nodes: list[Node]) -> None:
    """Flags elements that surround an article, by tag or name, unless they hold the article's title or most of the page's paragraphs."""
    for node in nodes:
        node.flag = node.tag in DROPPED
    _measured(nodes)
    whole = max(nodes[0].paragraphs, 1)
    inside = set()
    for node in nodes[1:]:
        if node.tag in ("article", "main") or id(node.parent) in inside:
            inside.add(id(node))
        most = node.paragraphs > WHOLE * whole
        if node.around:
            own = node.tag not in ("form", "article") and id(node) in inside and any(getattr(c, "tag", None) == "h1" for c in node.children)
            node.flag = node.flag or not (own or most and (node.around == 1 or node.titled))
        elif node.tag == "form" or node.tag == "header" and id(node) not in inside:  # an article has a head of its own
            node.flag = not (most or node.main)
    _measured(nodes)
    for node in nodes[1:]:
        if node.tag in ("ul", "ol", "dl", "div", "table", "section") and node.links >= 3 and node.linked >= LINKED * node.chars:
            node.flag = True
    _measured(nodes)


def _score(nodes: list[Node]) -> Node:
    """The container of highest score.  A paragraph is a p, pre, blockquote or td, or any box or body with text of its own."""
    shown = set()
    for node in nodes:
        node.points = 0.0
        if not node.flag and (node.parent is None or id(node.parent) in shown):
            shown.add(id(node))
    for node in nodes:
        if id(node) not in shown or node.tag not in BLOCKS or node.tag in HEADINGS:
            continue
        own = " ".join("".join(_inline(node)).split())
        if not own:
            continue
        points = 1 + len(_COMMAS.findall(own)) + min(len(own) / 100, 3)
        above = node.parent if node.tag in ("p", "pre", "blockquote", "td", "li", "dd", "dt", "figcaption") and node.parent else node
        while above is not None and points > 1e-6:
            if above.tag not in ("p", "tr", "tbody", "ul", "ol"):
                above.points += points
                points /= 2
            above = above.parent
    best = nodes[0]
    for node in nodes:
        if id(node) in shown and _density(node, node.points) > _density(best, best.points):
            best = node
    return best


def _density(node: Node, points: float) -> float:
    return points * (1 - node.linked / node.chars) if node.chars else 0.0


def _inline(node: Node):
    """Text of an element outside the blocks in it."""
    stack = [iter(node.children)]
    while stack:
        for child in stack[-1]:
            if isinstance(child, str):
                yield child
            elif child.flag or child.tag in BLOCKS:
                yield " "
            elif child.tag in ("br", "wbr"):
                yield " " if child.tag == "br" else ""
            else:
                stack.append(iter(child.children))
                break
        else:
            stack.pop()


def _kept(best: Node) -> list[Node]:
    """The best container with the siblings that are text, from the page's root or the outermost article downwards."""
    top, node = best, best
    while node is not None:  # an article is never cut: the best container may be one section of it
        if node.tag in ("article", "main"):
            top = node
        node = node.parent
    if top.tag == "main" or top.tag == "article":
        return [top]
    parts = [top]
    while top.parent is not None:
        around = [c for c in top.parent.children if isinstance(c, Node)]
        found = [c for c in around if c is top or _is_text(c, best)]
        parts = parts if len(found) == 1 else [x for c in found for x in (parts if c is top else [c])]
        top = top.parent
    return parts


def _is_text(node: Node, best: Node) -> bool:
    if node.flag or not node.chars:
        return False
    loose = 1 - node.linked / node.chars
    if node.tag in HEADINGS or node.tag in ("p", "pre", "blockquote", "table", "ul", "ol", "dl", "figure"):
        return loose > 0.5
    return loose > 0.7 and (node.paragraphs > 0 or node.points >= 0.2 * best.points)


def _blocks(parts: list[Node]) -> list[str]:
    """Text of all blocks of the given elements in page order, white space turned into single spaces."""
    out, held = [], []

    def end():
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append(text)
    for part in parts:
        stack = [(part, iter(part.children))]
        end()
        while stack:
            node, rest = stack[-1]
            for child in rest:
                if isinstance(child, str):
                    held.append(child)
                elif child.flag:
                    held.append(" " if child.tag not in BLOCKS else "")
                elif child.tag in VOID:
                    held.append(" " if child.tag == "br" else "")
                    if child.tag == "hr":
                        end()
                else:
                    if child.tag in BLOCKS:
                        end()
                    stack.append((child, iter(child.children)))
                    break
            else:
                if node.tag in BLOCKS:
                    end()
                stack.pop()
        end()
    return out


def main_text(html: str | None) -> str:
    """Blocks of a page's article joined by two line ends; empty if it has none."""
    if not html:
        return ""
    nodes = _tree(html)
    _take_out(nodes)
    return "\n\n".join(_blocks(_kept(_score(nodes))))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages` (page_id, url, html; others are not read).

    text is the page's main text: headings, paragraphs, lists and tables of the article in page order, character references
    decoded, white space inside a block (line breaks included) as one space, blocks joined by two line ends; n_chars is its
    number of code points.  Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments of readers go.

    Null and empty html, and pages with nothing but surrounding parts, have an empty text; html without tags is one block.  Unclosed and
    wrongly nested elements end where the next block says so; a page cut off in the middle keeps what came.  Pages of any length and
    depth are read whole, by loops without recursion.  Null ids and urls stay null, repeated rows give repeated results, and an
    empty table gives an empty one.  Each page is worked on alone, so nothing is shuffled.
    """
    def work(batches):
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column(2)]
            yield [batch.column(0), batch.column(1), texts, [len(t) for t in texts]]
    return over_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string")),
                        "page_id long, url string, text string, n_chars long", work)
