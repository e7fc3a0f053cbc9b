"""HTML extraction with a tree-structured graphical model.

Every block element of a page is a node with a label, article or not. A node
potential scores the element's own features; a potential on each edge from
parent to child scores how labels follow each other, by the kind of child.
Sum-product messages go from the leaves up and from the root down, and give
each node's exact marginal; text of nodes that are rather article is kept.
Both potentials are trained on the labelled pages of ``html_training``.

Messages of all pages of a batch run together, level by level of the tree.

Defined results: null or empty html gives an empty text; broken markup is
read as browsers do in the main (open elements are closed by what cannot
stand in them, at the end of their parent or of the page), in time linear in
its length; pages without
elements are one block of text; repeated rows give repeated results; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, in_small_batches
from .html_training import labelled_pages

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*"|'[^']*'|[^'">])*+)>""")
OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""\b(class|id|role|data-y)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
NAME = re.compile(r"[a-z]+")

#: Elements whose content is never text of the page.
HIDDEN = frozenset("script style noscript template svg iframe select textarea button title datalist option".split())
#: Of these, those whose content is not markup.
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i kbd label map mark math mfrac mi mn mo mroot mrow ms msqrt msub msubsup msup mtext object q rp rt ruby s samp small span strike strong sub sup time tt u var video".split()
)
#: What an opening element closes: elements that are open and may not hold it.
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "tbody": "tr td th thead tbody", "option": "option"}
CLOSES = {k: frozenset(v.split()) for k, v in CLOSES.items()}
#: Where the search for such elements ends.
SCOPE = frozenset("ul ol dl table html body div section article aside main nav header footer form td th blockquote".split())

TAGS = "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside form fieldset table thead tbody tr td th blockquote pre figure figcaption address details summary ins center head".split()
TAG_AT = {t: i for i, t in enumerate(TAGS)}
#: Beginnings of the parts of class, id and role names, by what they tell.
GROUPS = {
    "nav": "nav menu breadcrumb pagination pager toc skip", "header": "header masthead topbar brand logo", "footer": "foot bottom copyright colophon legal",
    "side": "sidebar side aside widget related recommend trending popular more teaser", "notice": "cookie notice consent gdpr alert popup modal warning disclaim privacy overlay",
    "ad": "ad ads adsby advert advertis sponsor promo adbox banner adsense outbrain taboola", "form": "newsletter subscri signup search login contact form",
    "comments": "comment repl respon discussion disqus reader user", "share": "share social tag tags toolbar follow",
    "article": "article content post entry story main text body",
}
GROUP_AT = {g: i for i, g in enumerate(GROUPS)}
WHOLE = {"ad", "ads", "nav", "side", "tag", "tags", "more", "user", "text", "body", "main", "form", "skip", "post", "foot"}
PREFIXES = [(p, g) for g, names in GROUPS.items() for p in names.split()]
#: Numbers of each node, besides: own letters, links, sentences; those of the subtree; place; depth.
N_NUMBERS = 12
#: Kinds of child for the edge potentials.
KINDS = {t: k for k, names in enumerate(("p pre blockquote ul ol li dl dt dd table thead tbody tr td th figure figcaption", "h1 h2 h3 h4 h5 h6", "nav header footer aside form", "article main"), 1) for t in names.split()}
N_KINDS = 5
#: Nodes whose features are held at once.
SLICE = 1 << 15


@lru_cache(maxsize=1 << 14)
def groups_of(names: str) -> tuple[int, ...]:
    found = set()
    for part in NAME.findall(names.lower()):
        found |= {GROUP_AT[g] for p, g in PREFIXES if (part == p if p in WHOLE else part.startswith(p))}
    return tuple(sorted(found))


def label_of(attributes: dict[str, str]) -> int:
    return {"0": 0, "1": 1}.get(attributes.get("data-y", ""), -1)


#: Tags with unpaired quotes after which quotes mean nothing; levels of a tree, deeper elements become siblings (as in browsers).
QUOTE_FAULTS, MAX_DEPTH = 8, 512


@dataclass
class Tree:
    """Nodes in page order; node 0 is the page. Text: pieces of (node, words of one block)."""

    tags: list[str]
    parents: list[int]
    names: list[str]
    labels: list[int]
    pieces: list[tuple[int, str]]
    linked: list[int]


def tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """kind (text, open or close), name or text, attributes, and where the token ends.

    A tag ends at the first ``>`` outside quotes. Where quotes hide every
    ``>`` it ends at the first one; after QUOTE_FAULTS such tags quotes mean
    nothing in the rest of the page. A tag, comment or declaration that never
    ends is text, a comment without end hides the rest. So each letter is
    read a bounded number of times. ``send`` moves on to a later place.
    """
    at, size, faults, ends = 0, len(page), 0, True

    def shut(start: int) -> int:
        nonlocal ends
        found = page.find(">", start) if ends else -1
        ends = found >= 0
        return found + 1

    while at < size:
        start = page.find("<", at)
        if start != at:
            stop = size if start < 0 else start
            moved = yield "text", page[at:stop], "", stop
            at = moved or stop
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at)
            at = size if end < 0 else end + 3
            continue
        if page[at + 1 : at + 2] in ("!", "?") or page.startswith("</", at) and not page[at + 2 : at + 3].isalpha():
            if end := shut(at):
                at = end
                continue
        elif ends and (head := OPEN.match(page, at)):
            found = TAG.match(page, at) if faults < QUOTE_FAULTS else None
            if found or (end := shut(at)):
                if found:
                    end, rest = found.end(), found[3]
                else:
                    faults += 1
                    rest = page[head.end() : end - 1]
                moved = yield "close" if head[1] else "open", head[2].lower(), rest, end
                at = moved or end
                continue
        moved = yield "text", "<", "", at + 1
        at = moved or at + 1


class Stack:
    """Open elements and their nodes, with what is needed to find one without a search."""

    def __init__(self):
        self.items: list[tuple[str, int]] = []
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.scopes: list[int] = []
        self.links = self.hidden = 0

    def push(self, tag: str, node: int) -> None:
        at = len(self.items)
        self.items.append((tag, node))
        self.where.setdefault(tag, []).append(at)
        if tag not in INLINE:
            self.blocks.append(at)
        if tag in SCOPE:
            self.scopes.append(at)
        self.links += tag == "a"
        self.hidden += tag in HIDDEN

    def cut(self, at: int) -> None:
        """Closes all from place ``at`` on."""
        while len(self.items) > at:
            tag, _ = self.items.pop()
            self.where[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
            if tag in SCOPE:
                self.scopes.pop()
            self.links -= tag == "a"
            self.hidden -= tag in HIDDEN

    def last(self, tag: str) -> int:
        """The place of the innermost open ``tag``; -1 if there is none."""
        found = self.where.get(tag)
        return found[-1] if found else -1

    def closed_by(self, tag: str) -> int:
        """The place of the outermost element that an opening ``tag`` closes; 0 if there is none."""
        if shuts := CLOSES.get(tag):
            at = max(map(self.last, shuts))
            if at < 1 or at < self.scopes[-1]:
                return 0
            while at > 1 and self.items[at - 1][0] in shuts:
                at -= 1
            return at
        at = self.blocks[-1]  # a block closes an open paragraph or heading
        return at if self.items[at][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") else 0


def parse(page: str) -> Tree:
    tags, parents, names, labels, pieces, linked, depths = ["html"], [-1], [""], [-1], [], [0], [0]
    stack = Stack()
    stack.push("html", 0)
    text: list[str] = []
    here, lower = 0, None

    def flush() -> None:
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            if words:
                pieces.append((here, words))
            text.clear()

    stream, moved = tokens(page), None
    while True:
        try:
            kind, tag, rest, end = stream.send(moved)
        except StopIteration:
            break
        moved = None
        if kind == "text":
            if not stack.hidden:
                text.append(tag)
                if stack.links:
                    linked[here] += len(tag)
            continue
        if kind == "close":
            at = stack.last(tag)
            if tag in INLINE and at < max(stack.blocks[-1], len(stack.items) - 8):
                continue  # an inline element ends in its own block alone
            if at > 0:
                if tag not in INLINE:
                    flush()
                stack.cut(at)
                here = stack.items[-1][1]
            continue
        if tag in VOID:
            if tag in ("br", "hr", "wbr") and not stack.hidden:
                text.append("" if tag == "wbr" else " ")
            continue
        if tag in RAW:
            lower = lower or page.lower()
            if len(lower) == len(page):
                stop = lower.find("</" + tag, end)
            else:
                found = re.compile("</" + tag, re.I).search(page, end)
                stop = found.start() if found else -1
            shut = page.find(">", stop) if stop >= 0 else -1
            moved = len(page) if shut < 0 else shut + 1
            continue
        if rest.endswith("/") and tag not in INLINE and tag not in TAG_AT:
            continue
        if tag in HIDDEN or tag in INLINE:
            stack.push(tag, here)
            continue
        flush()
        if tag in ("html", "body", "head"):
            y = label_of({k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(rest)})
            if tag == "html" and y >= 0:
                labels[0] = y
            if tag != "body":
                continue
            if stack.last("body") > 0:
                stack.cut(stack.last("body") + 1)
                continue
            stack.cut(1)
        elif shut := stack.closed_by(tag):
            stack.cut(shut)
        y, name = -1, ""
        if rest and not rest.isspace():
            found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(rest)}
            if found:
                name = " ".join(v for k, v in found.items() if k != "data-y")
                y = label_of(found)
        parent = stack.items[-1][1]
        if depths[parent] >= MAX_DEPTH:
            parent = parents[parent]
        parents.append(parent)
        depths.append(depths[parent] + 1)
        here = len(tags)
        tags.append(tag)
        names.append(name)
        labels.append(y)
        linked.append(0)
        stack.push(tag, here)
    flush()
    return Tree(tags, parents, names, labels, pieces, linked)


@dataclass
class Forest:
    """The nodes of many trees in a row."""

    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    tag: np.ndarray
    groups: np.ndarray
    inherited: np.ndarray
    numbers: np.ndarray
    first: np.ndarray

    def features(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """A row of each node from ``start`` to ``stop``."""
        rows = np.arange(start, len(self.tag) if stop is None else min(stop, len(self.tag)))
        root = self.parent[rows] < 0
        own, up = np.zeros((len(rows), len(TAGS) + 1)), np.zeros((len(rows), len(TAGS) + 1))
        own[np.arange(len(rows)), self.tag[rows]] = 1.0
        up[np.arange(len(rows)), self.tag[np.where(root, 0, self.parent[rows])]] = ~root
        return np.concatenate((np.ones((len(rows), 1)), own, up, self.groups[rows], self.inherited[rows], self.numbers[rows]), axis=1)


def forest(trees: list[Tree]) -> Forest:
    sizes = np.array([len(t.tags) for t in trees], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    n = int(first[-1])
    parent = np.array([p for t in trees for p in t.parents], np.int64)
    base = np.repeat(first[:-1], sizes)
    root = parent < 0
    parent = np.where(root, -1, parent + base)
    depth = np.zeros(n, np.int64)
    depth_list, parent_list = depth.tolist(), parent.tolist()
    for i, p in enumerate(parent_list):
        if p >= 0:
            depth_list[i] = depth_list[p] + 1
    depth = np.array(depth_list, np.int64)
    tag = np.array([TAG_AT.get(x, len(TAGS)) for t in trees for x in t.tags], np.int64)
    kind = np.array([KINDS.get(x, 0) for t in trees for x in t.tags], np.int64)
    own = np.zeros((n, 4))  # letters, letters of links, pieces, sentence ends
    at = np.array([first[k] + i for k, t in enumerate(trees) for i, _ in t.pieces], np.int64)
    if len(at):
        np.add.at(own[:, 0], at, np.array([len(x) for t in trees for _, x in t.pieces], float))
        np.add.at(own[:, 2], at, 1.0)
        np.add.at(own[:, 3], at, np.array([x.count(". ") + x.count(", ") + x.endswith(".") for t in trees for _, x in t.pieces], float))
    own[:, 1] = np.minimum([x for t in trees for x in t.linked], own[:, 0])
    sub = own.copy()
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts):
        inner = level[parent[level] >= 0]
        np.add.at(sub, parent[inner], sub[inner])
    page = np.repeat(sub[first[:-1]], sizes, axis=0) if n else sub
    groups = np.zeros((n, len(GROUPS)), bool)
    k = 0
    for t in trees:
        for name in t.names:
            if name:
                groups[k, list(groups_of(name))] = True
            k += 1
    inherited = groups.copy()
    for level in np.split(order[::-1], np.flatnonzero(np.diff(depth[order[::-1]])) + 1):
        inner = level[parent[level] >= 0]
        inherited[inner] |= inherited[parent[inner]]
    place = (np.arange(n) - base) / np.maximum(np.repeat(sizes, sizes), 1)
    numbers = np.stack(
        [
            np.log1p(own[:, 0]), own[:, 1] / np.maximum(own[:, 0], 1), np.log1p(own[:, 3]), (own[:, 0] > 0).astype(float),
            np.log1p(sub[:, 0]), sub[:, 1] / np.maximum(sub[:, 0], 1), np.log1p(sub[:, 3]), sub[:, 0] / np.maximum(page[:, 0], 1),
            place, np.minimum(depth, 12) / 12, sub[:, 3] / np.maximum(sub[:, 2], 1), (sub[:, 0] == 0).astype(float),
        ],
        axis=1,
    )
    return Forest(parent, depth, kind, tag, groups, inherited, numbers, first)


@dataclass
class Model:
    weights: np.ndarray
    edges: np.ndarray  # by kind of child: label of the parent, of the child


def _fit_nodes(x: np.ndarray, y: np.ndarray, steps: int = 25, ridge: float = 2.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(pages: list[str] | None = None) -> Model:
    """Piecewise: a logistic node potential, and edge potentials from the labels of parents and children."""
    trees = [parse(p) for p in (pages if pages is not None else labelled_pages())]
    y = []
    for t in trees:
        own: list[int] = []
        for given, p in zip(t.labels, t.parents):
            own.append(given if given >= 0 else own[p] if p >= 0 else 0)
        y += own
    f, y = forest(trees), np.array(y)
    weights = _fit_nodes(f.features(), y.astype(float))
    child = np.flatnonzero(f.parent >= 0)
    seen = np.full((N_KINDS, 2, 2), 1.0)
    np.add.at(seen, (f.kind[child], y[f.parent[child]], y[child]), 1.0)
    share = seen / seen.sum(axis=2, keepdims=True)
    base = seen.sum(axis=1, keepdims=True) / seen.sum(axis=(1, 2), keepdims=True)
    return Model(weights, np.log(share) - np.log(base))


def _soft(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(model: Model, f: Forest) -> np.ndarray:
    """The probability of label 1 of each node, by messages up and down the trees."""
    parts = [f.features(a, a + SLICE) @ model.weights for a in range(0, len(f.tag), SLICE)]
    score = np.clip(np.concatenate(parts) if parts else np.zeros(0), -30, 30)
    node = np.stack((np.zeros_like(score), score), axis=1)
    n = len(score)
    below, message = node.copy(), np.zeros((n, 2))
    order = np.argsort(f.depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(f.depth[order])) + 1) if n else []
    for level in levels[:0:-1]:
        joint = below[level][:, None, :] + model.edges[f.kind[level]]
        message[level] = _soft(joint[:, :, 0], joint[:, :, 1])
        np.add.at(below, f.parent[level], message[level])
    whole = below.copy()
    for level in levels[1:]:
        rest = whole[f.parent[level]] - message[level]
        joint = rest[:, :, None] + model.edges[f.kind[level]]
        whole[level] = below[level] + _soft(joint[:, 0, :], joint[:, 1, :])
    return 1 / (1 + np.exp(np.clip(whole[:, 0] - whole[:, 1], -60, 60)))


def extract(model: Model, pages: list[str]) -> list[str]:
    trees = [parse(p) for p in pages]
    f = forest(trees)
    content = marginals(model, f) >= 0.5
    content[f.first[:-1][np.diff(f.first) == 1]] = True  # no element at all
    return [" ".join(words for i, words in t.pieces if content[a + i]) for t, a in zip(trees, f.first.tolist())]


#: Pages, and letters of pages, whose messages run together.
BATCH, LETTERS = 256, 2_000_000


def groups_of_pages(pages: list[str]) -> Iterator[list[str]]:
    some, size = [], 0
    for page in pages:
        if some and (len(some) >= BATCH or size + len(page) > LETTERS):
            yield some
            some, size = [], 0
        some.append(page)
        size += len(page)
    if some:
        yield some


def main_texts(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            source = [x if isinstance(x, str) else "" for x in batch["html"]]
            texts = [t for some in groups_of_pages(source) for t in extract(shared.value, some)]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return in_small_batches(pages).select(as_text("page_id"), "url", "html").mapInPandas(run, "page_id string, url string, text string, n_chars long").withColumn("page_id", F.col("page_id").cast("long"))
