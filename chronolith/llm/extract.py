"""Main text of web pages by scoring the containers of paragraphs."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Element and name lists.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset(
    "aside audio button canvas datalist dialog embed footer frame frameset head header iframe input label map menu meter nav noframes noscript object "
    "option progress script select style svg template textarea title video".split()
)
CONTROLS = frozenset("button label meter progress".split())
PENALISED = frozenset("fieldset form".split())
SKIPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising alert banner comment comments consent cookie cookies disqus footer gdpr header hidden "
    "login masthead menu modal nav navbar navigation newsletter notice notices overlay popup promo promotion replies "
    "respond sidebar signup sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
LINK_LIST_NAMES = frozenset("breadcrumb breadcrumbs pager pagination promoted recommended related share sharing social".split())
SKIPPED_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
GOOD_NAMES = frozenset("article body content entry main post story text".split())
KEPT_WHOLE = frozenset("html body article main".split())
PARAGRAPH = frozenset("blockquote dd dt figcaption li p pre td th h1 h2 h3 h4 h5 h6".split())
SENTENCES = frozenset("blockquote dd figcaption p h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "tr": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
SCOPES = frozenset("ul ol dl table article section div body html".split())
ITEMS = frozenset().union(*CLOSED_BY.values())
CELLS = frozenset("td th table".split())
TABLE_PARTS = frozenset("td th tr tbody thead tfoot table body html".split())

TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
QUOTED_END = re.compile(r"(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>")
NAMES = re.compile(r"(?:^|[\s\"'])(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
ROLE = re.compile(r"(?:^|\s)role\s*=\s*[\"']?([a-zA-Z]+)", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Points reach this many ancestors.
ANCESTORS = 5
#: What a name of boilerplate leaves of the points within its element.
NAME_SHARE = 0.2
#: Lists of links by name are boilerplate if links are this share of their text, or if it is shorter than this.
LINK_SHARE, SHORT_CHARS = 0.2, 100


class Node:
    """An element. ``block`` is the nearest block around its text, ``part`` the nearest element that text counts for, ``paragraph`` the p that a
    new block would close, ``item`` the nearest list item or table part in scope, ``open`` the tags open since the last table cell."""

    __slots__ = ("tag", "parent", "skipped", "named", "good", "block", "part", "paragraph", "item", "open", "score", "chars", "linked", "bad", "share", "place")

    def __init__(self, tag: str, parent: Node | None, skipped: bool, named: str, good: bool):
        self.tag, self.parent, self.skipped, self.named, self.good = tag, parent, skipped, named, good
        self.score, self.chars, self.linked, self.bad = 0.0, 0, 0, False
        self.block = self if tag in BLOCK or parent is None else parent.block
        self.part = self if named or self.block is self else parent.part
        self.paragraph = self if tag == "p" else None if tag in SCOPES or parent is None else parent.paragraph
        self.item = self if tag in ITEMS else None if tag in SCOPES or parent is None else parent.item
        self.open = Counter() if parent is None or tag in CELLS else parent.open


def _named(attributes: str) -> tuple[str, bool]:
    """(``bad``, ``list`` or empty for boilerplate by name, role or hiding, list of links by name, neither; whether a name speaks for content)."""
    if not attributes or attributes.isspace():
        return "", False
    words = {w.lower() for m in NAMES.finditer(attributes) for w in WORDS.findall(m[1] or m[2] or m[3] or "")}
    role = ROLE.search(attributes)
    bad = bool(words & SKIPPED_NAMES) or bool(role and role[1].lower() in SKIPPED_ROLES) or bool(HIDDEN.search(attributes))
    return "bad" if bad else "list" if words & LINK_LIST_NAMES else "", bool(words & GOOD_NAMES)


def _tokens(page: str) -> Iterator[tuple[str, str, str, int, int]]:
    """(kind, name, attributes, start, end) of texts, opening and closing tags and character data, in one pass from left to right.

    A tag ends at the first ``>`` outside quotes. Where quotes never close, they hide no ``>`` from there on; where no ``>`` follows, the rest is text.
    A consumer that skips ahead sends the place to go on from.
    """
    at, last, quotes = 0, page.rfind(">"), True
    text_from = 0
    while True:
        start = page.find("<", at)
        if start < 0 or (start > last and not page.startswith("<!--", start)):
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            kind, name, attributes, end = "none", "", "", len(page) if end < 0 else end + 3
        elif page.startswith("<![CDATA[", start) and (end := page.find("]]>", start)) >= 0:
            kind, name, attributes, end = "data", "", page[start + 9:end], end + 3
        elif page.startswith(("<!", "<?"), start):
            kind, name, attributes, end = "none", "", "", page.find(">", start) + 1
        else:
            m = TAG_NAME.match(page, start + 1)
            if m is None:
                at = start + 1
                continue
            whole = QUOTED_END.match(page, m.end()) if quotes else None
            if whole is None:
                quotes = False
            end = whole.end() if whole else page.find(">", m.end()) + 1
            kind, name, attributes = "close" if m[1] else "open", m[2].lower(), page[m.end():end - 1]
        if start > text_from:
            yield "text", "", "", text_from, start
        onward = yield kind, name, attributes, start, end
        at = text_from = end if onward is None else onward
    if text_from < len(page):
        yield "text", "", "", text_from, len(page)


def _blocks(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """All elements, parents first, and (element, text, link characters) of every block outside skipped elements, in page order."""
    root = Node("html", None, False, "", False)
    nodes, node, link = [root], root, 0
    blocks: list[tuple[Node, str, int]] = []
    buffer: list[str] = []
    linked = 0
    owner = root
    opened: Counter = Counter()

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                blocks.append((owner, text, min(linked, len(text))))
            buffer.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked, owner
        if node.skipped or not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if not buffer:
            if text.isspace():
                return
            owner = node.part
        buffer.append(text)
        if link:
            linked += len(text)

    def enter(name: str, skipped: bool, named: str, good: bool) -> None:
        nonlocal node, link
        node = Node(name, node, skipped, named, good)
        nodes.append(node)
        node.parent.open[name] += 1
        opened[name] += 1
        link += name == "a"

    def close_to(target: Node) -> None:
        """Leaves every open element up to and including ``target``."""
        nonlocal node, link
        while True:
            last = node
            if last.part is last:
                flush()
            if last.parent is None:
                return
            if last.tag == "a":
                link = max(0, link - 1)
            node = last.parent
            node.open[last.tag] -= 1
            opened[last.tag] -= 1
            if last is target:
                return

    def nearest(tags: frozenset[str]) -> Node | None:
        p = node.item
        while p is not None and p.tag not in tags:
            p = p.parent.item
        return p

    tokens = _tokens(page)
    onward = None
    while True:
        try:
            kind, name, attributes, start, end = tokens.send(onward)
        except StopIteration:
            break
        onward = None
        if kind == "text":
            add(page[start:end])
        elif kind == "data":
            add(html.escape(attributes))
        elif kind == "close":
            target = None
            if opened[name] if name in TABLE_PARTS else node.open[name]:
                target = node
                while target.parent is not None and target.tag != name:
                    target = None if target.tag in CELLS and name not in TABLE_PARTS else target.parent
                    if target is None:
                        break
            if target is not None and target.parent is not None:
                close_to(target)
            elif name in BLOCK:
                flush()
        elif kind == "open":
            if name == "br":
                if buffer:
                    buffer.append(" ")
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                continue
            if name in BLOCK and node.paragraph is not None:
                close_to(node.paragraph)
            if name in CLOSED_BY and (p := nearest(CLOSED_BY[name])) is not None:
                close_to(p)
            named, good = _named(attributes)
            named = "" if name in KEPT_WHOLE else "bad" if name in PENALISED else named
            skipped = node.skipped or (name in SKIPPED and not (name in CONTROLS and node.block.tag in SENTENCES))
            if named and name not in BLOCK and (buffer or named == "list" or node.block.tag in SENTENCES):
                # within a sentence: boilerplate goes in place, the words around it stay one block
                skipped, named = skipped or named == "bad", ""
            if name in BLOCK or named:
                flush()
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, end)
                if name == "xmp" and not skipped:
                    add(html.escape(page[end:close.start() if close else len(page)]))
                onward = close.end() if close else len(page)
                continue
            if name in ("html", "body") and node is root:
                if name == "body":
                    enter("body", False, "", good)
                continue
            if not attributes.rstrip().endswith("/") or name in BLOCK:
                enter(name, skipped, named, good)
    flush()
    return nodes, blocks


def main_text(page: str | None) -> str:
    """The blocks of the best container and its siblings, joined by empty lines; empty if the page has no text outside boilerplate.

    Every paragraph gives points for its length and commas to its ancestors, fewer to farther ones; a container's points are
    discounted by the share of its characters that are links, and shrink within elements whose names or roles speak of boilerplate and within
    forms. The best container (of equal ones the first) stands for the article or main element around it. Elements named as boilerplate are
    left out unless they hold the best container; lists of links by name (related, share) only if they are mostly links or short.
    Siblings with a fifth of its points are kept. Without an article or main element everything beside it stays that is not mostly links
    (under a quarter of its characters: headings, lists, short paragraphs, plain divs and text), and the h1 and h2 beside its ancestors.
    Time grows in proportion to the page, whatever its tags; an empty or null page has no text.
    """
    nodes, blocks = _blocks(page or "")
    if not blocks:
        return ""
    for owner, text, linked in blocks:
        owner.chars += len(text)
        owner.linked += linked
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.linked += n.linked
    for n in nodes:
        n.bad = n.named == "bad" or n.named == "list" and (n.chars < SHORT_CHARS or n.linked >= LINK_SHARE * n.chars)
        n.share = (n.parent.share if n.parent is not None else 1.0) * (NAME_SHARE if n.bad else 1.0)
    scored: dict[int, Node] = {}
    for owner, text, linked in blocks:
        points = 1 + text.count(",") + min(len(text) / 100, 3) if len(text) >= 25 else 0.0
        target = owner.parent if owner.tag in PARAGRAPH and owner.parent is not None else owner
        points *= owner.share
        for level in range(ANCESTORS):
            if target is None:
                break
            if id(target) not in scored:
                scored[id(target)] = target
                target.score += ((5 if target.tag in ("article", "main") else 0) + (5 if target.good else 0)) * target.share
            target.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            target = target.parent
    worth = lambda n: n.score * (1 - n.linked / max(1, n.chars))
    best = max(scored.values(), key=worth)
    around = best
    while around is not None and around.tag not in ("article", "main"):
        around = around.parent
    if around is not None:
        best = around
        others = {id(n) for n in scored.values() if n.parent is best.parent and n.tag == best.tag and worth(n) >= 0.2 * worth(best)}
    else:
        others = {id(n) for n in scored.values() if n.parent is best.parent and worth(n) >= 0.2 * worth(best)}
    parent = best.parent if around is None else None
    holders, up = set(), best
    while up is not None:
        holders.add(id(up))
        up = up.parent
    above = holders - {id(best), id(parent)}
    # place: out (boilerplate), in (best container or a kept sibling), beside, or neither
    for n in nodes:
        over = n.parent.place if n.parent is not None else ""
        if over == "out" or n.bad and id(n) not in holders:
            n.place = "out"
        elif over or n is best or id(n) in others:
            n.place = over or "in"
        else:
            n.place = ("beside" if n.linked < 0.25 * n.chars else "out") if parent is not None and n.parent is parent else ""
    kept = []
    for owner, text, linked in blocks:
        near = owner.place == "" and parent is not None and (owner is parent or owner.tag in ("h1", "h2") and id(owner.parent) in above)
        if owner.place in ("in", "beside") or near and linked < 0.25 * len(text):
            kept.append(text)
    return "\n\n".join(kept)


def extracted(page: Column) -> Column:
    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return extract(page)
