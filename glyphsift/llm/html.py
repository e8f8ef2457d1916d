"""Main text of web pages by tree scoring."""

from __future__ import annotations

import functools
import html as entities
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Fixed values of HTML: elements whose content is no markup, that have none, that are no part of a line, and
#: those that end an open element of the kinds named.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd dt figcaption".split()) | HEADINGS
#: Elements that never have article text, and those and the roles that speak against it.
NEVER = frozenset("button select input head script style template object canvas svg".split()) | RAW
AGAINST = frozenset("nav header footer aside form label fieldset dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Words of names that speak against an element, if all of the name's other words are mere fillers.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsors sponsored promo promotion promotions banner banners cookie cookies consent gdpr notice notices notification notifications popup modal overlay newsletter subscribe subscription sidebar sidenav rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments disqus respond reply replies share sharing social related recommended pagination pager login signin signup search skip".split()
)
FILLERS = frozenset("area articles article bar block blocks body bottom box button buttons col column container entry footer form global group head holder icons id inner item items js left link links list main outer page panel post posts primary reader readers right row secondary section site slot stories text thread title top unit user users wrap wrapper zone".split())
#: What is no part of an article however long it is: elements, and words of names.
ALWAYS = frozenset("nav footer aside dialog menu".split())
ALWAYS_WORDS = frozenset("comment comments disqus respond reply replies cookie cookies consent gdpr newsletter popup modal related recommended".split())

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>=]++|=)*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")

#: How far an element's kind and names speak against it: not at all, some of them, all of them, so much that its
#: length is no excuse, or it is never shown.
OWN, DOUBTFUL, FOREIGN, EVER, UNSEEN = range(5)
#: What points count for that come through such an element.
WEIGHTS = (1.0, 0.5, 0.2, 0.1)


class Node:
    __slots__ = ("children", "kind", "links", "parent", "score", "shown", "size", "tag", "titled")

    def __init__(self, tag: str, parent: Node | None, kind: int = OWN) -> None:
        self.tag, self.parent, self.kind, self.children = tag, parent, kind, []
        self.shown, self.titled, self.score, self.size, self.links = kind != UNSEEN and (parent is None or parent.shown), False, 0.0, 0, 0


@functools.lru_cache(maxsize=10_000)
def _named(name: str) -> int:
    """What one name from a class or id says."""
    words = {p.lower() for p in PART.findall(name)}
    if not words & WORDS or words - WORDS - FILLERS:
        return OWN
    return EVER if words & ALWAYS_WORDS else FOREIGN


def _kind(tag: str, attributes: str, within: bool) -> int:
    """A header within an article is its own, whatever its name. Of several names of a paragraph one that says
    nothing leaves a doubt."""
    if tag in NEVER:
        return UNSEEN
    exempt = tag in ("html", "body", "article", "main") or tag == "header" and within
    kind = OWN if exempt or tag not in AGAINST else EVER if tag in ALWAYS else FOREIGN
    if not attributes.strip() or tag in ("html", "body"):
        return kind
    names = []
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return UNSEEN
        if name == "role" and value.lower() in ROLES and not exempt:
            kind = max(kind, FOREIGN)
        if name in ("class", "id") and not exempt:
            names += [_named(x) for x in value.split()]
    said = max(names, default=OWN)
    return max(kind, DOUBTFUL if said and tag in PARAGRAPHS and OWN in names else said)


@functools.lru_cache(maxsize=32)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.I)


def parse(page: str) -> Node:
    """The page's tree. Elements that are left open end with their parents or where HTML ends them; end tags
    without a start, comments, declarations, and tags cut off by the page's end are dropped. The open elements'
    places are kept by kind, so that no tag is looked for in the stack and time grows with the page's length."""
    root = Node("#root", None)
    at, stack, blocks, places = 0, [root], [0], {}

    def close(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().tag].pop()
            if blocks[-1] == len(stack):
                blocks.pop()

    def text(chunk: str) -> None:
        if chunk and stack[-1].shown:
            stack[-1].children.append(entities.unescape(chunk))

    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or not m[4]:
            continue
        if m[1]:
            # An end tag of a part of a line doesn't reach over a block that is open in it.
            if places.get(tag) and (tag in BLOCK or places[tag][-1] > blocks[-1]):
                close(places[tag][-1])
            continue
        if tag in BLOCK and stack[blocks[-1]].tag == "p":
            close(blocks[-1])
        while stack[blocks[-1]].tag in ENDS.get(tag, ()):
            close(blocks[-1])
        node = Node(tag, stack[-1], _kind(tag, m[3], bool(places.get("article") or places.get("main"))))
        if node.shown:
            stack[-1].children.append(node)
        if tag in RAW:
            end = _raw_end(tag).search(page, at)
            at = page.find(">", end.end()) + 1 if end else 0
            if not at:
                return root
        elif tag not in VOID and not (m[3].endswith("/") and tag not in BLOCK):
            if tag in BLOCK:
                blocks.append(len(stack))
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    text(page[at:])
    return root


def _inner(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node)]


def _own(node: Node) -> str:
    return " ".join(" ".join(c.split()) for c in node.children if isinstance(c, str)).strip()


def _walk(root: Node) -> list[Node]:
    """Every node, each after its parent."""
    found = [root]
    for node in found:
        found += _inner(node)
    return found


def density(node: Node) -> float:
    return node.links / node.size if node.size else 0.0


def measure(root: Node) -> list[Node]:
    """Every node, with the sizes of the texts and of the links' texts below it, and its points.

    A paragraph, or what has text of its own, passes 1, 1 for each comma and 1 for each hundred characters, less the
    share of links in it, to its parent, half as many to that one's, then a third and so on for five levels. They
    count for less by the kind of what the paragraph is in. What a node has got is lessened by its own share of links.
    """
    nodes = _walk(root)
    for node in reversed(nodes):
        node.size += sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        node.titled |= node.tag in ("h1", "h2")
        if node.tag == "a":
            node.links = node.size
        if node.parent:
            node.parent.size += node.size
            node.parent.links += node.links
            node.parent.titled |= node.titled
    weight = {root: 1.0}
    for node in nodes[1:]:
        weight[node] = weight[node.parent] * WEIGHTS[node.kind]
    for node in nodes:
        own = _own(node) if node.size and (node.tag in PARAGRAPHS or node.tag in BLOCK) else ""
        if not node.size or not (node.tag in PARAGRAPHS or own):
            continue
        # A block with text between its inner blocks is its own container.
        level, up, length = 1, node.parent if node.tag in PARAGRAPHS else node, node.size if node.tag in PARAGRAPHS else len(own)
        points = (1 + own.count(",") + length / 100) * (1 - density(node)) * weight[node]
        while up is not None and level < 6:
            up.score += points / level
            up, level = up.parent, level + 1
    for node in nodes:
        node.score *= 1 - density(node)
    return nodes


def _container(nodes: list[Node]) -> Node | None:
    """The node with most points, or the article or main element about it; none if no node has any. Where articles
    stand that no foreign element is about, it is one of those or in one."""
    inside, plain = {}, {}
    for node in nodes:
        plain[node] = node.kind < FOREIGN and (node.parent is None or plain[node.parent])
        inside[node] = plain[node] and (node.tag in ("article", "main") or node.parent is not None and inside[node.parent])
    best = max([n for n in nodes if inside[n] and n.score > 0] or nodes, key=lambda n: n.score)
    if best.score <= 0:
        return next((n for n in nodes if inside[n] and n.size), None)
    about = best
    while about is not None and about.tag not in ("article", "main"):
        about = about.parent
    return about or best


def _belongs(node: Node, best: Node) -> bool:
    """Whether an element in the container is the article's, as its length or its links say: one that only its name or kind
    speaks against stays if it has most of the text, or a title and few links."""
    if node.kind == OWN or not node.size:
        return True
    linked = density(node) >= 0.5
    if node.kind == FOREIGN:
        return not linked and (2 * (node.size - node.links) > best.size - best.links or node.titled and best.tag in ("article", "main"))
    return node.kind == DOUBTFUL and not linked


def _blocks(node: Node, shows=lambda _: True) -> list[str]:
    """Texts of the lines below a node: what stands between the starts and ends of its block elements."""
    lines, line = [], []

    def end() -> None:
        found = " ".join("".join(line).split())
        if found:
            lines.append(found)
        line.clear()

    work: list[tuple[Node | str, bool]] = [(node, False)]
    while work:
        x, done = work.pop()
        if isinstance(x, str):
            line.append(x)
        elif done:
            end()
        elif x is node or shows(x):
            if x.tag == "br":
                line.append(" ")
            if x.tag in BLOCK or x.tag == "#root":
                end()
                work.append((x, True))
            work += [(c, False) for c in reversed(x.children)]
    end()
    return lines


def _beside(x: Node, best: Node) -> bool:
    """Whether a sibling of the container is part of the article."""
    if x.kind >= FOREIGN or not x.size or density(x) >= 0.25:
        return False
    return x.tag in PARAGRAPHS and x.tag != "li" or x.score >= best.score / 5 or x.tag in ("div", "section") and any(c.tag == "p" and c.size for c in _inner(x))


def main_text(page: str | None) -> str:
    """The article's blocks in page order, one to a line, white space within each turned into single spaces.

    The best container is the node with most points, or the article or main element about it. In it, only what is
    foreign by its kind or name, and by its length or links as well, is left out; comments and menus are however long
    they are. Its siblings stay if they aren't foreign, have few links, and are headings, paragraphs or have some, or a fifth
    of its points. Where nothing has points, all but foreign elements is kept; where nothing is left, those are
    kept too. Null and empty pages give the empty text. Time grows with the page's length, whatever its markup.
    """
    if not page:
        return ""
    root = parse(page)
    best = _container(measure(root))
    if best is None:
        return "\n".join(_blocks(root, lambda x: x.kind < FOREIGN) or _blocks(root))
    shows = lambda x: _belongs(x, best)
    if best.parent is None or best.tag in ("body", "html"):
        return "\n".join(_blocks(best, shows) or _blocks(best))
    kept = []
    for x in best.parent.children:
        if x is best or isinstance(x, Node) and _beside(x, best):
            kept += _blocks(x, shows)
    return "\n".join(kept or _blocks(root))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row. Rows are independent: repeated ones give equal rows, null and
    empty pages the empty text, an empty table no rows; very long pages are taken whole, and other columns, whatever their
    names, play no part."""

    def make():
        def run(ids, urls, pages):
            texts = [main_text(p) for p in pages]
            return ids, urls, texts, [len(t) for t in texts]

        return run

    return map_rows(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html"), ["page_id", "url", "html"], "page_id bigint, url string, text string, n_chars bigint", make, 64)
