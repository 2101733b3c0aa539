"""Tolerant page trees: block elements and the runs of text between them, with the features of each node."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Elements of the HTML standard by how they lay out text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template title svg math iframe object audio video canvas datalist".split())
#: Hidden elements whose content is read as markup, not as text up to an end tag.
MARKUP_INSIDE = frozenset({"svg", "math", "noscript"})
#: What a head may hold; anything else that opens in it starts the body.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td textarea tfoot th thead tr ul button".split()
)
#: An opening tag ends an open element of these names, up to the nearest of the containers.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Elements that an end tag of another name does not reach through.
WALLS = frozenset("article aside body div footer form header html main nav section table td th li ul ol blockquote".split())

TAGS = [
    {"nav", "menu", "dir"},
    {"header", "hgroup"},
    {"footer"},
    {"aside", "dialog"},
    {"article"},
    {"main"},
    {"section"},
    {"div", "center"},
    {"p"},
    {"h1", "h2", "h3", "h4", "h5", "h6"},
    {"ul", "ol", "dl"},
    {"li", "dt", "dd"},
    {"form", "fieldset", "select", "textarea", "button", "option", "legend", "search", "optgroup"},
    {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"},
    {"blockquote", "pre", "figure", "figcaption", "address", "details", "summary"},
    {"html", "body", "#page"},
    {"#text"},
]
TAG_NUMBER = {name: i for i, names in enumerate(TAGS) for name in names}

# Words of class, id and role names, by what they usually mark.
NAME_GROUPS = [
    set("nav navbar navigation menu menubar breadcrumb breadcrumbs topbar toolbar tabs pager pagination sitemap".split()),
    set("header masthead banner branding logo hero top".split()),
    set("footer copyright legal colophon bottom contentinfo imprint".split()),
    set("sidebar aside rail side widget widgets complementary related recommended trending more".split()),
    set("ad ads adv advert adverts advertisement sponsor sponsored promo promotion promoted adsense".split()),
    set("cookie cookies consent notice notices gdpr alert popup modal overlay paywall disclaimer warning message".split()),
    set("form login signin signup subscribe newsletter search register contact".split()),
    set("comment comments commentlist reply replies disqus discussion respond reactions feedback".split()),
    set("share sharing social follow tags meta byline author tools".split()),
    set("article content main post entry story body text prose page copy articlebody maincontent".split()),
]
NAME_NUMBER = {word: i for i, words in enumerate(NAME_GROUPS) for word in words}

LENGTHS = [1, 20, 60, 150, 400]
LINKED = [0.05, 0.3, 0.7]
#: tags here and above, names here and above, length steps, link steps, few features of a run, constant
N_FEATURES = 2 * len(TAGS) + 2 * len(NAME_GROUPS) + len(LENGTHS) + len(LINKED) + 5

_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_STOPS = re.compile(r"[.!?…]")


class PageTree(HTMLParser):
    """Nodes in page order: ``parent``, ``tag``, ``names`` (groups of class, id and role), text and link lengths."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.names, self.label = [-1], ["#page"], [frozenset()], [None]
        self.text: list[list[str] | None] = [None]
        self.linked = [0]
        self.open: list[tuple[str, int]] = [("#page", 0)]  # name, block node it belongs to
        self.hidden: list[str] = []  # open hidden elements, outermost first
        self.run = -1
        self.links = 0  # open links

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers are not needed."""
        return j

    def set_cdata_mode(self, elem: str, **options) -> None:
        """Content of graphics, formulas and noscript is markup, whatever the element: their end tags end it."""
        if not MARKUP_INSIDE.intersection(self.hidden):
            super().set_cdata_mode(elem, **options)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.hidden == ["head"] and tag not in IN_HEAD or "head" in self.hidden and tag == "body":  # an unended head
            self.hidden.clear()
        if tag in HIDDEN and tag not in VOID:
            self.hidden.append(tag)
        if self.hidden:
            return
        if tag == "br":
            self._add(" ", False)
            return
        if tag in BLOCK:
            self.run = -1
            if tag in ("html", "body") and any(name == tag for name, _ in self.open):
                return
            ended, until = CLOSES.get(tag, ((), ()))
            self._end({"p"} if tag not in CLOSES else {"p", *ended}, until or WALLS, all_of=True)
            if tag in VOID:
                return
            self.parent.append(self.open[-1][1])
            self.tag.append(tag)
            self.names.append(_groups(attrs))
            self.label.append(next((v for k, v in attrs if k == "data-label"), None))
            self.text.append(None)
            self.linked.append(0)
            self.open.append((tag, len(self.tag) - 1))
        elif tag not in VOID:
            self.open.append((tag, self.open[-1][1]))
            self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in HIDDEN:
            self.handle_starttag(tag, attrs)
        elif self.hidden == ["head"] and tag not in IN_HEAD:
            self.hidden.clear()

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            # Ends its own element and what is open inside; other end tags end nothing hidden.
            if tag in self.hidden:
                del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
            return
        if tag in BLOCK:
            self.run = -1
        self._end({tag}, WALLS - {tag}, all_of=False)

    def _end(self, names: set[str], walls, all_of: bool) -> None:
        """Ends the nearest open element of these names, or all of them, with all inside it, but not through walls."""
        cut = None
        for at in range(len(self.open) - 1, 0, -1):
            name = self.open[at][0]
            if name in names:
                cut = at
                if not all_of:
                    break
            elif name in walls:
                break
        if cut is not None:
            if self.links:
                self.links -= sum(name == "a" for name, _ in self.open[cut:])
            del self.open[cut:]

    def handle_data(self, data: str) -> None:
        if self.hidden == ["head"] and data.strip():
            self.hidden.clear()
        if not self.hidden:
            self._add(data, self.links > 0)

    def _add(self, data: str, link: bool) -> None:
        if self.run < 0:
            if not data.strip():
                return
            block = self.open[-1][1]
            self.parent.append(block)
            self.tag.append("#text")
            self.names.append(frozenset())
            self.label.append(self.label[block])
            self.text.append([])
            self.linked.append(0)
            self.run = len(self.tag) - 1
        self.text[self.run].append(data)
        if link:
            self.linked[self.run] += len(data)

    def blocks(self) -> list[str | None]:
        """Text of each run with white space as one space, None for elements."""
        return [None if t is None else " ".join("".join(t).split()) for t in self.text]


def _groups(attrs: list[tuple[str, str | None]]) -> frozenset[int]:
    found = set()
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for part in _PARTS.findall(value):
                group = NAME_NUMBER.get(part.lower())
                if group is not None:
                    found.add(group)
    return frozenset(found)


def parsed(html: str | None) -> PageTree:
    tree = PageTree()
    if html:
        tree.feed(html)
        tree.close()
    return tree


def features(tree: PageTree, texts: list[str | None]) -> tuple[list[int], list[int], list[int]]:
    """Sparse binary features: node and feature numbers; and the depth of each node."""
    n = len(tree.tag)
    size, linked, depth = [0] * n, list(tree.linked), [0] * n
    above: list[frozenset[int]] = [frozenset()] * n
    over: list[frozenset[int]] = [frozenset()] * n
    for i in range(1, n):
        p = tree.parent[i]
        depth[i] = depth[p] + 1
        above[i] = above[p] | tree.names[p] if tree.names[p] else above[p]
        tag = TAG_NUMBER.get(tree.tag[p], TAG_NUMBER["div"])
        over[i] = over[p] if tag in over[p] else over[p] | {tag}
        if texts[i] is not None:
            size[i] = len(texts[i])
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        size[p] += size[i]
        linked[p] += linked[i]
    nodes, numbers = [], []
    at_names = len(TAGS)
    at_above = at_names + len(NAME_GROUPS)
    at_size = at_above + len(NAME_GROUPS)
    at_link = at_size + len(LENGTHS)
    at_rest = at_link + len(LINKED)
    at_tags = at_rest + 5
    for i in range(n):
        own = [TAG_NUMBER.get(tree.tag[i], TAG_NUMBER["div"]), at_rest + 4]
        own += [at_names + g for g in tree.names[i]]
        own += [at_above + g for g in above[i]]
        own += [at_tags + t for t in over[i]]
        own += [at_size + k for k, least in enumerate(LENGTHS) if size[i] >= least]
        share = linked[i] / size[i] if size[i] else 0.0
        own += [at_link + k for k, least in enumerate(LINKED) if share > least]
        text = texts[i]
        if text is not None:
            if _STOPS.search(text[-3:]):
                own.append(at_rest)
            if text[:1] in "©" or "©" in text:
                own.append(at_rest + 1)
            if tree.tag[tree.parent[i]] == "p":
                own.append(at_rest + 2)
            if len(_STOPS.findall(text)) >= 2:
                own.append(at_rest + 3)
        nodes += [i] * len(own)
        numbers += own
    return nodes, numbers, depth
