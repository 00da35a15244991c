"""Main text of HTML pages by composite text density.

A tolerant tokenizer builds the element tree. Every element gets its characters
for each tag, adjusted by the share that stands in links: dense prose scores
high, link lists low. Each element is then rated by the sum of its children's
densities, and the article is the element with the largest sum among those whose
own density reaches the threshold, which is the smallest density on the path from
the page's body to its densest element.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from acreledger.llm.common import fields, map_column

# Element names of HTML by what they mean to a reader.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
SKIPPED = frozenset("head script style noscript template iframe object embed svg math canvas audio video form button select option textarea input label nav header footer aside menu dialog map title noembed noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"body", "caption", "html", "legend", "td", "th", "tr", "tbody", "thead", "tfoot"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
INLINE_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u span mark sub sup cite abbr q".split())
# Words of class, id and role names that mark what is not the article.
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion promoted nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar sidebars footer masthead topbar toolbar notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments disqus respond replies reply discussion share sharing social related recommended recommendations pagination pager widget complementary contentinfo search hidden".split())
# Words that take a class name's meaning back, and those that say nothing but layout.
NEGATED = frozenset("no not non has have with without".split())
LAYOUT = frozenset("area bar block box button buttons column container inner item items left link links list outer panel post posts right row section slot unit widget widgets wrap wrapper".split())

#: The share of the body's unlinked text with which a form or an element named as no article holds the article.
MOST = 0.5
#: The share of a parent's text that makes the parent the article as well.
WIDEN = 0.7

TOKEN = re.compile(r"""<!--.*?(?:--!?>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[a-z]+")


@dataclass(eq=False)
class Node:
    name: str
    skipped: bool = False
    why: str = ""
    items: list = field(default_factory=list)  # texts and child nodes in page order
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    total: float = 0.0


def names_other(token: str) -> bool:
    """Whether a class, id or role names what is no article: its last word does, or its first before words of layout."""
    parts = WORD.findall(token)
    if not parts or not NEGATED.isdisjoint(parts):
        return False
    if parts[-1] == "hidden":
        return len(parts) == 1 or parts[:-1] in (["is"], ["visually"])
    return parts[-1] in NOT_ARTICLE or parts[0] in NOT_ARTICLE and LAYOUT.issuperset(parts[1:])


def not_article(name: str, attributes: str, inside: bool) -> str:
    """Why an element is none of the article: ``cut`` by its name, hidden or style, ``named`` by class, id or role, ``form``; else empty."""
    if name in SKIPPED and name != "form" and not (name == "header" and inside):
        return "cut"
    why = "form" if name == "form" else ""
    if not attributes or name in ("html", "body", "article", "main"):
        return why
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return "cut"
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "cut"
        if key in ("class", "id", "role") and any(map(names_other, value.split())):
            why = why or "named"
    return why


def keep_holders(root: Node) -> None:
    """Take back the cut of forms and named elements that hold most of the body's unlinked text.

    A named element stays cut where an article, a main element or a first heading
    stands outside all that is cut: long comments, say.
    """
    plain: dict[Node, int] = {}
    order, stack = [], [(root, False)]
    while stack:
        node, link = stack.pop()
        order.append((node, link))
        stack += [(c, link or c.name == "a") for c in node.items if isinstance(c, Node) and c.why != "cut"]
    if not any(n.why for n, _ in order):
        return
    for node, link in reversed(order):
        own = 0 if link else sum(len(" ".join(c.split())) for c in node.items if isinstance(c, str))
        plain[node] = own + sum(plain[c] for c in node.items if isinstance(c, Node) and c.why != "cut")
    found = True
    while found:
        found, marked, large, stack = False, False, [], [root]
        while stack:
            node = stack.pop()
            marked = marked or node.name in ("article", "main", "h1")
            for c in node.items:
                if isinstance(c, Node):
                    if not c.skipped:
                        stack.append(c)
                    elif c.why != "cut" and plain[c] > MOST * plain[root]:
                        large.append(c)
        for c in large:
            if c.why == "form" or not marked:
                c.skipped, found = False, True


def parse(page: str) -> Node:
    """The element tree; tags left open end with their parent, an unfinished tag at the end is dropped."""
    root = Node("#root")
    open_ = [root]
    at = 0
    end = len(page)
    while at < end:
        found = TOKEN.search(page, at)
        if found is None:
            rest = page[at:]
            cut = re.search(r"<[a-zA-Z/!?]", rest)
            open_[-1].items.append(rest[: cut.start()] if cut else rest)
            break
        if found.start() > at:
            open_[-1].items.append(page[at : found.start()])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        attributes = found[3] or found[6] or ""
        if found[1] or found[4]:
            if any(n.name == name for n in open_[1:]):
                while open_.pop().name != name:
                    pass
            continue
        if name in CLOSES_P and any(n.name == "p" for n in open_):
            # a block ends an open paragraph, with whatever was left open in it
            depth = max(i for i, n in enumerate(open_) if n.name == "p")
            if all(n.name == "p" or n.name in INLINE_FORMATTING for n in open_[depth:]):
                del open_[depth:]
        if name in ("li", "dd", "dt", "tr", "td", "th", "option"):
            close_alike(open_, name)
        inside = any(n.name in ("article", "main") for n in open_)
        why = not_article(name, attributes, inside)
        node = Node(name, bool(why), why)
        open_[-1].items.append(node)
        if name in VOID or attributes.endswith("/"):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
            continue
        open_.append(node)
    keep_holders(root)
    return root


def close_alike(open_: list[Node], name: str) -> None:
    """A list item or table cell ends the one before it in the same list or row."""
    alike = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
    for i in range(len(open_) - 1, 0, -1):
        if open_[i].name in alike:
            del open_[i:]
            return
        if open_[i].name in ("ul", "ol", "dl", "table", "select", "article", "body"):
            return


def measure(root: Node) -> tuple[int, int]:
    """Characters, tags and those in links of every element, bottom up; what is no article counts as nothing."""
    order, stack = [], [(root, False)]
    while stack:
        node, link = stack.pop()
        order.append((node, link))
        stack += [(c, link or c.name == "a") for c in node.items if isinstance(c, Node) and not c.skipped]
    for node, link in reversed(order):
        for c in node.items:
            if isinstance(c, str):
                n = len(c.split()) and len(" ".join(c.split()))
                node.chars += n
                node.link_chars += n if link else 0
            elif not c.skipped:
                node.chars += c.chars
                node.link_chars += c.link_chars
                node.tags += c.tags + 1
                node.link_tags += c.link_tags + (c.name == "a")
    return root.chars, root.link_chars


def rate(root: Node) -> list[Node]:
    """Composite density of every element and the sum over its children."""
    chars, links = measure(root)
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack += [c for c in node.items if isinstance(c, Node) and not c.skipped]
    for node in nodes:
        if node.chars:
            c, tags, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
            plain = max(1, node.chars - node.link_chars)
            base = math.log(c / plain * lc + links / max(1, chars) * c + math.e)
            node.density = c / tags * max(0.0, math.log(c / lc * tags / lt + 1e-9)) / math.log(max(base, 1.0 + 1e-9)) if base > 1 else 0.0
    for node in nodes:
        node.total = sum(c.density for c in node.items if isinstance(c, Node) and not c.skipped)
    return nodes


def main_element(root: Node) -> Node:
    """The element with the largest sum of child densities among those that reach the threshold of the body's path.

    It is widened to the article or main element that holds it, to parents that
    have little text beside it (headings, say), and to any parent up to the body
    in which siblings reach the threshold as well or a headline stands before it;
    there other blocks before and after these are cut, and link lists.
    """
    nodes = rate(root)
    body = next((n for n in nodes if n.name == "body"), root)
    parents = {c: n for n in nodes for c in n.items if isinstance(c, Node)}
    inside, stack = [], [body]
    while stack:
        node = stack.pop()
        inside.append(node)
        stack += [c for c in node.items if isinstance(c, Node) and not c.skipped]
    densest = max(inside, key=lambda n: n.density)
    path = [densest]
    while path[-1] is not body:
        path.append(parents[path[-1]])
    threshold = min(n.density for n in path)
    dense = [n for n in inside if n.density >= threshold and n.chars and n.name in BLOCKS] or [body]
    best = max(dense, key=lambda n: (n.total, n.chars))
    holders = [best]
    while holders[-1] is not body and holders[-1] in parents:
        holders.append(parents[holders[-1]])
    marked = next((n for n in holders if n.name in ("article", "main")), None)
    if marked is not None:
        return marked
    spare: list[Node] = []  # what is cut if a higher parent becomes the article
    own = best
    for parent in holders[1:]:
        if parent.name not in ("#root", "html", "body") and not spare and own is best and best.chars >= WIDEN * parent.chars:
            own = best = parent
            continue
        beside, joined = others(parent, own, threshold)
        spare += beside
        own = parent
        if joined:
            best = parent
            for node in spare:
                node.skipped = True
            spare = []
    return best


def others(parent: Node, own: Node, threshold: float) -> tuple[list[Node], bool]:
    """The parent's children that don't belong with the article part ``own`` of it, and whether any beside it do.

    Dense blocks do, what stands between them unless it is half links, and headings
    before the first. A headline further up does, alone or in a block with a lead,
    with all from it to the article, if the article has none itself and no
    block of links stands between.
    """
    children = [c for c in parent.items if isinstance(c, Node) and not c.skipped and c.chars]
    unlinked = {c for c in children if c is own or 2 * c.link_chars < c.chars}
    dense = [i for i, c in enumerate(children) if c is own or c in unlinked and c.name in BLOCKS and c.density >= threshold and c.density > 0 and c.name not in HEADINGS]
    first, last = dense[0], dense[-1]
    while first and children[first - 1].name in HEADINGS:
        first -= 1
    if not any(holds_headline(c) for c in children[first : last + 1]):
        at = first
        while at and children[at - 1] in unlinked:
            at -= 1
            if holds_headline(children[at]):
                first = at
                break
    return [c for i, c in enumerate(children) if not (first <= i <= last and c in unlinked)], len(dense) > 1 or first < dense[0]


def holds_headline(element: Node) -> bool:
    """Whether a first heading with text stands in the element, or is it."""
    stack = [element]
    while stack:
        node = stack.pop()
        if node.name == "h1" and node.chars:
            return True
        stack += [c for c in node.items if isinstance(c, Node) and not c.skipped]
    return False


def blocks(element: Node) -> list[str]:
    """The text of each block in page order, references decoded, white space made one space; none is empty."""
    out: list[str] = []
    parts: list[str] = []

    def end() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(text)
        parts.clear()

    stack: list = [element]
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            parts.append(item)
        elif not item.skipped:
            block = item.name in BLOCKS
            if block:
                end()
                stack.append(None)
            elif item.name == "br":
                parts.append(" ")
            stack += reversed(item.items)
    end()
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line ends; empty for a null or empty page or one without an article."""
    return "\n".join(blocks(main_element(parse(page)))) if page else ""


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """Append text and n_chars (its code points), read from the whole page.

    Null and empty pages, and pages of markup alone, have an empty text. Input
    columns named like a result are replaced; repeated rows stay.
    """
    return map_column(pages, column, fields("text string, n_chars long"), lambda: lambda values: [(t, len(t)) for t in map(main_text, values)])
