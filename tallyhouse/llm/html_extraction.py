"""Main text of web pages by a tree-structured graphical model.

Each node of a page, element or run of text, is content or not. Potentials are linear in the node's features and, between
parent and child, a table by kind of child. Sum-product messages pass up the tree and down again and give each node's
marginal. Weights are trained by the likelihood of labelled pages, whose gradient needs the same marginals.
"""

from __future__ import annotations

import html as escaping
import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, projected
from .html_tree import N_FEATURES, features, parsed

#: Labelled pages that the model is trained on: the bound of the sample.
LABELLED_PAGES = 300
SEED = 7
STEPS = 150
RATE = 0.2
RIDGE = 1e-5
#: Pages whose nodes are inferred together.
TOGETHER = 64


@dataclass
class Forest:
    """Nodes of several pages as arrays; ``order`` lists the nodes of each depth."""

    parent: np.ndarray
    kind: np.ndarray  # 1 for runs of text
    node: np.ndarray
    feature: np.ndarray
    levels: list[np.ndarray]


def forest(pages: list) -> tuple[Forest, list[list[str | None]], list[int]]:
    """``pages``: parsed trees. Gives the forest, the texts of each page's nodes and the first node of each page."""
    parent, kind, node, feature, depth, texts, firsts = [], [], [], [], [], [], []
    for tree in pages:
        base = len(parent)
        firsts.append(base)
        own = tree.blocks()
        nodes, numbers, levels = features(tree, own)
        parent += [p + base if p >= 0 else -1 for p in tree.parent]
        kind += [t is not None for t in own]
        node += [i + base for i in nodes]
        feature += numbers
        depth += levels
        texts.append(own)
    depth_of = np.array(depth, dtype=np.int64)
    order = np.argsort(depth_of, kind="stable")
    cuts = np.flatnonzero(np.diff(depth_of[order])) + 1
    return (
        Forest(
            np.array(parent, dtype=np.int64),
            np.array(kind, dtype=np.int64),
            np.array(node, dtype=np.int64),
            np.array(feature, dtype=np.int64),
            np.split(order, cuts),
        ),
        texts,
        firsts,
    )


@dataclass
class Model:
    """``unary``: weight of each feature for content. ``pair[kind, parent, child]``: log potentials."""

    unary: np.ndarray
    pair: np.ndarray

    def marginals(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """``P(node, state)`` by upward and downward sum-product, and ``P(node, parent state, state)``; roots have zeros."""
        n = len(f.parent)
        inside = np.zeros((n, 2))
        inside[:, 1] = np.bincount(f.node, weights=self.unary[f.feature], minlength=n)
        up = np.zeros((n, 2))
        for level in reversed(f.levels[1:]):
            joint = self.pair[f.kind[level]] + inside[level][:, None, :]
            up[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
            np.add.at(inside, f.parent[level], up[level])
        belief, pairs = inside.copy(), np.zeros((n, 2, 2))
        for level in f.levels[1:]:
            # What the parent knows without this child.
            outside = belief[f.parent[level]] - up[level]
            joint = self.pair[f.kind[level]] + outside[:, :, None]
            belief[level] = inside[level] + np.logaddexp(joint[:, 0, :], joint[:, 1, :])
            both = joint + inside[level][:, None, :]
            both -= both.max(axis=(1, 2), keepdims=True)
            pairs[level] = np.exp(both) / np.exp(both).sum(axis=(1, 2), keepdims=True)
        belief -= belief.max(axis=1, keepdims=True)
        states = np.exp(belief)
        return states / states.sum(axis=1, keepdims=True), pairs


def fitted(f: Forest, labels: np.ndarray, steps: int = STEPS) -> Model:
    """Maximum likelihood with a ridge, by gradient steps with adaptive rates: observed minus expected counts."""
    model = Model(np.zeros(N_FEATURES), np.zeros((2, 2, 2)))
    inner = np.flatnonzero(f.parent >= 0)
    seen_unary = np.bincount(f.feature, weights=labels[f.node], minlength=N_FEATURES)
    seen_pair = np.zeros((2, 2, 2))
    np.add.at(seen_pair, (f.kind[inner], labels[f.parent[inner]], labels[inner]), 1)
    mean = [np.zeros_like(model.unary), np.zeros_like(model.pair)]
    square = [np.zeros_like(model.unary), np.zeros_like(model.pair)]
    for step in range(1, steps + 1):
        states, pairs = model.marginals(f)
        expected = np.bincount(f.feature, weights=states[f.node, 1], minlength=N_FEATURES)
        expected_pair = np.stack([pairs[inner][f.kind[inner] == k].sum(axis=0) for k in (0, 1)])
        for i, (weights, seen, told) in enumerate(
            ((model.unary, seen_unary, expected), (model.pair, seen_pair, expected_pair))
        ):
            gradient = (seen - told) / len(labels) - RIDGE * weights
            mean[i] = 0.9 * mean[i] + 0.1 * gradient
            square[i] = 0.99 * square[i] + 0.01 * gradient**2
            scaled = mean[i] / (1 - 0.9**step) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)
            weights += RATE * scaled
    return model


def training_forest(pages: list[str]) -> tuple[Forest, np.ndarray]:
    """Forest and node labels of pages whose elements carry ``data-label``; others take their parent's, the root none."""
    trees = [parsed(p) for p in pages]
    labels = []
    for tree in trees:
        own: list[int] = []
        for label, parent in zip(tree.label, tree.parent):
            own.append(int(label) if label is not None else own[parent] if parent >= 0 else 0)
        labels += own
    return forest(trees)[0], np.array(labels, dtype=np.int64)


@lru_cache(maxsize=4)
def trained(pages: int = LABELLED_PAGES, seed: int = SEED) -> Model:
    """The model of this process: always the same for the same number of labelled pages and seed."""
    return fitted(*training_forest([labelled_page(random.Random(seed * 100_003 + i)) for i in range(pages)]))


def extracted(
    pages: DataFrame,
    model: Model | None = None,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks`` of every page.

    The text has the runs whose marginal for content is one half or more, in page order, one to a line; white space is
    one space, character references are decoded. Null, empty and broken pages are parsed as far as they go; a page without
    content has an empty text. Pages are independent rows: no shuffle, nothing is cut off. Repeated rows are all returned;
    other columns are ignored; an empty table gives no rows.
    """
    model = model or trained()
    kinds = dict(pages.dtypes)

    def rows(given: Iterator[tuple]) -> Iterator[tuple]:
        while part := list(islice(given, TOGETHER)):
            trees = [parsed(html) for _, _, html in part]
            whole, texts, firsts = forest(trees)
            content = model.marginals(whole)[0][:, 1] >= 0.5
            for (page_id, url, _), own, first in zip(part, texts, firsts):
                kept = [t for i, t in enumerate(own) if t and content[first + i]]
                text = "\n".join(kept)
                yield page_id, url, text, len(text), len(kept)

    return map_rows(
        projected(pages, page_id=id_column, url=url_column, html=html_column),
        rows,
        f"page_id {kinds[id_column]}, url {kinds[url_column]}, text string, n_chars bigint, n_blocks bigint",
    )


def labelled_page(r: random.Random) -> str:
    """A page of a random layout whose elements carry ``data-label`` 1 for content, 0 for the rest.

    Layouts vary what sites vary: element or class names for the same part, unknown names, order, nesting, unended
    paragraphs, and parts of no content inside the article.
    """
    syllables = ["ka", "lo", "mi", "ren", "tos", "vel", "un", "dar", "eis", "pho", "gra", "ti", "ne", "sou", "ber"]

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def sentence(low: int = 4, high: int = 18) -> str:
        words = [word() for _ in range(r.randint(low, high))]
        return words[0].capitalize() + " " + " ".join(words[1:]) + r.choice([".", ".", ".", "!", "?"])

    def prose(low: int = 1, high: int = 6) -> str:
        text = escaping.escape(" ".join(sentence() for _ in range(r.randint(low, high))))
        if r.random() < 0.25:
            text = text.replace(" ", f' <a href="/{word()}">{word()}</a> ', 1)
        if r.random() < 0.2:
            text = f"<{(t := r.choice(['b', 'i', 'em', 'strong', 'span']))}>{text}</{t}>"
        return text

    def unknown() -> str:
        return r.choice(["", "", f' class="{word()}"', f' class="c{r.randint(1, 99)}"', f' id="{word()}"', ' class="box"', ' class="row"'])

    def part(label: int, names: list[str], elements: list[str], body: str) -> str:
        """One part under an element of its own or a plain one with a telling name; seldom without."""
        tag = r.choice(elements)
        if tag in ("div", "section", "ul") and r.random() < 0.9:
            attr = f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"'
            if r.random() < 0.2:
                attr = attr[:-1] + f"{r.choice(['-', ' ', '_'])}{word()}\""
        else:
            attr = unknown()
        return f'<{tag}{attr} data-label="{label}">{body}</{tag}>'

    def links(low: int = 3, high: int = 9) -> str:
        items = [f'<a href="/{word()}">{word().capitalize()}</a>' for _ in range(r.randint(low, high))]
        if r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return r.choice([" ", " | ", "<br>"]).join(items)

    def menu() -> str:
        return part(0, ["nav", "menu", "navbar", "main-menu", "navigation", "breadcrumb", "topbar"], ["nav", "nav", "div", "ul"], links())

    def head() -> str:
        inner = r.choice([f"<h1>{word()}</h1>", f"<h2>{sentence(1, 4)}</h2>", f"<p>{sentence(2, 8)}</p>", word()])
        return part(0, ["header", "masthead", "banner", "top", "site-header"], ["header", "header", "div"], inner + (links() if r.random() < 0.5 else ""))

    def foot() -> str:
        inner = r.choice([f"&copy; {word()} &middot; {sentence()}", f"<p>&copy; {word()}.example {sentence(1, 8)}</p>", links(), f"<p>{sentence()}</p>"])
        return part(0, ["footer", "copyright", "legal", "bottom", "site-footer"], ["footer", "footer", "div"], inner)

    def side() -> str:
        inner = r.choice([f"<h3>{sentence(1, 4)}</h3>" + links(), f"<p>{prose(1, 3)}</p>", links(), f"<h4>{word()}</h4><p>{prose(1, 2)}</p>"])
        return part(0, ["sidebar", "side", "rail", "widget", "related", "more-stories", "recommended"], ["aside", "aside", "div", "section"], inner)

    def advert() -> str:
        inner = r.choice([prose(1, 4), f"<p>{prose(1, 3)}</p>", f'<a href="/{word()}">{sentence()}</a>', f"<h3>{sentence(2, 5)}</h3><p>{prose(1, 2)}</p>"])
        return part(0, ["ad", "ads", "advert", "sponsored", "promo", "ad-slot", "advertisement"], ["div", "div", "section", "aside"], inner)

    def notice() -> str:
        inner = r.choice([f"<p>{prose(1, 3)}</p>", prose(1, 3)]) + (f"<button>{word()}</button>" if r.random() < 0.5 else "")
        return part(0, ["cookie", "notice", "consent", "alert", "popup", "cookie-banner", "gdpr", "modal"], ["div", "div", "section", "aside"], inner)

    def form() -> str:
        inner = f"<label>{sentence(1, 4)}</label><input type=text><p>{prose(1, 2)}</p><button>{word()}</button>"
        inner = r.choice([inner, f"<form>{inner}</form>" if r.random() < 0.5 else inner])
        return part(0, ["form", "newsletter", "subscribe", "search", "login"], ["form", "form", "div"], inner)

    def comments() -> str:
        def one() -> str:
            text = r.choice([f"<p>{prose(1, 5)}</p>", prose(1, 4)])
            return r.choice([f"<li>{text}</li>", f"<div{unknown()}>{text}</div>", f'<div class="comment">{text}</div>', f"<article>{text}</article>"])

        inner = (f"<h3>{sentence(1, 3)}</h3>" if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 5)))
        return part(0, ["comments", "comment-list", "discussion", "replies", "respond", "comment"], ["section", "div", "div"], inner)

    def share() -> str:
        return part(0, ["share", "social", "tools", "tags"], ["div", "div", "ul"], links(2, 5))

    def paragraph() -> str:
        kind = r.random()
        if kind < 0.62:
            # Some pages do not end paragraphs, or leave inline elements open.
            return f"<p>{prose(1, 8)}" + r.choice(["</p>", "</p>", "</p>", "", "<br>"])
        if kind < 0.70:
            return f"<p><b>{prose(1, 5)}<br>"
        if kind < 0.78:
            level = r.randint(2, 4)
            return f"<h{level}>{escaping.escape(sentence(1, 7))}</h{level}>"
        if kind < 0.85:
            return f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{prose(1, 2)}</li>" for _ in range(r.randint(1, 5))) + f"</{t}>"
        if kind < 0.91:
            return f"<blockquote>{r.choice([prose(1, 3), f'<p>{prose(1, 3)}</p>'])}</blockquote>"
        if kind < 0.94:
            return f"<pre>{word()} = {word()}\n{word()}</pre>"
        if kind < 0.97:
            return f"<table><tr><th>{word()}<td>{word()}<tr><td>{word()}</td><td>{sentence(1, 5)}</td></tr></table>"
        return f"<figure><img src=x><figcaption>{prose(1, 1)}</figcaption></figure>"

    def article() -> str:
        parts = [f"<h1>{escaping.escape(sentence(1, 10))}</h1>"] if r.random() < 0.85 else []
        body = [paragraph() for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14]))]
        for extra in (advert, side, share, form, notice):
            if r.random() < 0.12:
                body.insert(r.randint(0, len(body)), extra())
        if r.random() < 0.1:
            body.append(comments())
        inner = "".join(parts + body)
        if r.random() < 0.25:
            inner = f"<div{unknown()}>{inner}</div>"
        names = ["content", "main", "article", "post", "entry", "story", "post-body", "article-content", "page-content"]
        found = part(1, names, ["article", "article", "main", "div", "section"], inner)
        return f'<main data-label="1">{found}</main>' if r.random() < 0.2 else found

    above = [f() for f in (head, menu, notice, advert, menu) if r.random() < 0.5]
    below = [f() for f in (comments, side, advert, form, share, foot) if r.random() < 0.5]
    r.shuffle(above)
    columns = [*above, article(), *below]
    body = "".join(columns)
    if r.random() < 0.3:
        body = f"<div{unknown()}>{body}</div>"
    title = escaping.escape(sentence(1, 8))
    end = r.choice(["</body></html>", ""])
    return f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a="<p>";</script></head><body data-label="0">{body}{end}'
