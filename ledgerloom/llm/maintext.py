"""Main text of web pages by a tree-structured graphical model over the page's block elements.

Every block element is a node that is content or not. Its own look (element, class and id words, words, links, sentence ends of its own text
and of everything below it) gives a unary potential; a node and its parent share a pairwise potential, by what both names
say (nothing, furniture of a page, or a text body). Messages go up from the leaves and down from the root once (sum-product in
the log domain, all pages of a chunk level by level), which gives each node's exact marginal. Text is kept where its node's marginal is 0.5 or more.

The weights maximise the conditional likelihood of labelled pages; the gradient is observed minus expected counts, from the same
marginals. Labelled pages are (a) at most PAGES pages of the table that mark their text with one ``article`` or ``main`` element, and (b) pages composed of those
pages' texts (COMPOSED for each), with other containers, furniture and readers' comments at known places; (b) is why names that the table
doesn't show have been seen. The sample is the only bound; every page is extracted whole.

Blocks are the text between two borders of block elements, in page order; ``br`` is white space inside a block. Open elements that HTML closes by itself
(p, li, td, head ...) are closed so.

Defined edge cases: null, empty and tag-only pages have the text ""; pages without a labelled page in the table are extracted with weights from composed
pages alone; an unclosed noscript or template hides nothing; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textbatch import map_texts

#: Labelled pages that are taken from the table, their largest size in bytes, and the pages composed from each of them.
PAGES, PAGE_BYTES, COMPOSED = 150, 200_000, 3
ROUNDS, RATE, PENALTY = 120, 0.3, 1e-3

# Elements of HTML.
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
HIDDEN = frozenset(["head", "script", "style", "noscript", "template", "iframe", "object", "svg", "math", "select", "option", "textarea", "button", "canvas", "audio", "video", "title"])
IN_HEAD = frozenset(["html", "head", "base", "link", "meta", "title", "style", "script", "noscript", "template"])
BLOCK_TAGS = [
    "html", "body", "address", "article", "aside", "blockquote", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
]
BLOCKS = frozenset(BLOCK_TAGS)
#: An open element of the values ends where the key begins, unless one of LIMITS lies between.
CLOSED_BY = {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"], "tbody": ["tr", "td", "th", "thead", "tbody"], "tfoot": ["tr", "td", "th", "tbody"]}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}}
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])

# What elements, classes, ids and roles are called.
FURNITURE = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip tabs toolbar",
    "head": "header masthead topbar banner logo branding",
    "foot": "footer colophon copyright legal imprint bottom",
    "side": "aside sidebar side widget related recommended popular trending complementary rail teaser",
    "advert": "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay toast announcement newsletter subscribe subscription paywall",
    "form": "form login signup search searchbox fieldset register contact contactform",
    "comment": "comment comments commentlist reply replies respond discussion disqus feedback responses reader readers",
    "share": "share sharing social follow tags meta byline",
}
BODY = "article main content post entry story body text articlebody"
_GROUP = {w: g for g, words in FURNITURE.items() for w in words.split()} | dict.fromkeys(BODY.split(), "body")
GROUPS = [*FURNITURE, "body"]
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ENDS = (".", "!", "?", "…", "。", ":", '"', "”", "»", ")")


@dataclass
class Page:
    """Block elements in page order (parents first), and the page's text blocks with the node that holds each."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    groups: list[frozenset[str]] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # node, text, words in links


def name_groups(tag: str, attrs: list[tuple[str, str | None]]) -> frozenset[str]:
    words = {tag}
    for key, value in attrs:
        if value and key in ("class", "id", "role", "itemprop"):
            words |= {w.lower() for w in _WORD.findall(value)} | set(re.split(r"[^a-z]+", value.lower()))
    return frozenset(_GROUP[w] for w in words if w in _GROUP)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.hidden: list[bool] = []  # of nodes
        self.stack: list[tuple[str, int]] = []  # open elements: tag and node (-1: no block)
        self.open: Counter = Counter()
        self.held: list[str] = []
        self.linked = 0
        self.shown: set[int] = set()
        self.at = self._node("html", -1, frozenset(), False)

    def _node(self, tag, parent, groups, hidden):
        self.page.parent.append(parent)
        self.page.tag.append(tag)
        self.page.groups.append(groups)
        self.hidden.append(hidden)
        return len(self.hidden) - 1

    def _flush(self):
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                self.page.blocks.append((self.at, text, self.linked))
            self.held, self.linked = [], 0

    def _pop(self):
        tag, node = self.stack.pop()
        self.open[tag] -= 1
        if node >= 0:
            self._flush()
            self.at = self.page.parent[node]
        return tag

    def _unclosed(self, k):
        """An open noscript or template from place k of the stack on ends without an end tag."""
        self.shown |= {node for tag, node in self.stack[k:] if tag in ("noscript", "template")}

    def _close(self, tags, limits=frozenset()):
        """End the innermost open element of ``tags`` unless a limit is open inside it."""
        if not any(self.open[t] for t in tags):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name in tags:
                self._unclosed(k + 1)
                while len(self.stack) > k:
                    self._pop()
                return
            if name in limits:
                return

    def _leave_head(self):
        if self.open["head"]:
            self._close(("head",))

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            self._leave_head()
            return
        if self.open["head"] and tag not in IN_HEAD:
            self._leave_head()
        if tag == "br":
            self.held.append(" ")
            return
        block = tag in BLOCKS
        if block or tag == "hr":
            if self.open["p"]:
                self._close(("p",), {"table", "td", "th", "button"})
            if tag in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
                self._pop()
            if tag in CLOSED_BY:
                self._close(CLOSED_BY[tag], LIMITS[tag])
            self._flush()
        if tag == "a" and self.open["a"]:
            self._close(("a",), BLOCKS)
        if tag in VOID:
            return
        node = -1
        if block or tag in HIDDEN:
            self._flush()
            node = self.at = self._node(tag, self.at, name_groups(tag, attrs), tag in HIDDEN)
        self.stack.append((tag, node))
        self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in BLOCKS and tag not in VOID and self.stack and self.stack[-1][0] == tag:
            self._pop()  # an svg path, say; HTML ignores the slash of block elements

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.held.append(" ")
        if not self.open[tag]:
            return
        if tag in BLOCKS or tag in HIDDEN:
            self._close((tag,), {"td", "th", "table"} - {tag} if tag not in ("tr", "tbody", "thead", "tfoot", "table") else frozenset())
        else:
            self._close((tag,), BLOCKS)

    def handle_data(self, data):
        if self.open["head"] and not self.open["title"] and not (self.stack and self.stack[-1][0] in HIDDEN and self.stack[-1][0] != "head") and data.strip():
            self._leave_head()
        self.held.append(data)
        if self.open["a"]:
            self.linked += len(data.split())

    def done(self) -> Page:
        self.close()
        self._unclosed(0)
        while self.stack:
            self._pop()
        self._flush()
        parent = self.page.parent
        for node in sorted(self.shown):
            # as if it weren't there: what it holds belongs to its parent
            self.hidden[node] = False
            parent[node + 1 :] = [parent[node] if up == node else up for up in parent[node + 1 :]]
            self.page.blocks = [(parent[node] if at == node else at, text, linked) for at, text, linked in self.page.blocks]
        for i in range(1, len(parent)):
            self.hidden[i] = self.hidden[i] or self.hidden[parent[i]]
        self.page.blocks = [b for b in self.page.blocks if not self.hidden[b[0]]]
        return self.page


def parse(html: str) -> Page:
    builder = _Builder()
    builder.feed(html)
    return builder.done()


_STEPS = np.array([0.5, 2.5, 7.5, 20.5])  # words: none, 1-2, 3-7, 8-20, more
_SHARES = np.array([0.05, 0.35, 0.7])  # words in links
_TAG = {t: k for k, t in enumerate([*BLOCK_TAGS, "other"])}
N_FEATURES = 1 + len(_TAG) + 2 * len(GROUPS) + 5 + 4 + 2 + 5 + 4 + 2
N_KINDS = 9


@dataclass
class Trees:
    """The nodes of many pages, with nodes by depth."""

    parent: np.ndarray  # -1: a page's root
    features: np.ndarray  # nodes x N_FEATURES, 0 or 1
    kind: np.ndarray  # of the edge to the parent: what both names say
    levels: list[np.ndarray]
    first: np.ndarray  # a page's first node


def trees(pages: list[Page]) -> Trees:
    first = np.concatenate(([0], np.cumsum([len(p.parent) for p in pages]))).astype(np.int64)
    n = int(first[-1])
    parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + f) for p, f in zip(pages, first, strict=False)]) if pages else np.zeros(0, np.int64)
    depth = np.zeros(n, np.int32)
    for i, up in enumerate(parent.tolist()):
        if up >= 0:
            depth[i] = depth[up] + 1
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if n else []
    words, links, ends = np.zeros(n), np.zeros(n), np.zeros(n, bool)
    for p, f in zip(pages, first.tolist(), strict=False):
        for node, text, linked in p.blocks:
            words[f + node] += text.count(" ") + 1
            links[f + node] += linked
            ends[f + node] |= text.endswith(_ENDS)
    below, below_links = words.copy(), links.copy()
    for at in reversed(levels[1:]):
        np.add.at(below, parent[at], below[at])
        np.add.at(below_links, parent[at], below_links[at])
    x = np.zeros((n, N_FEATURES), np.float32)
    every = np.arange(n)
    x[:, 0] = 1
    x[every, 1 + np.array([_TAG.get(t, len(_TAG) - 1) for p in pages for t in p.tag], np.int64)] = 1
    at = 1 + len(_TAG)
    named = np.zeros(n, np.int8)
    i = 0
    for p in pages:
        for groups in p.groups:
            for g in groups:
                x[i, at + GROUPS.index(g)] = 1
            named[i] = 2 if groups == {"body"} else 1 if groups else 0
            i += 1
    # furniture of any kind, and a body that is nothing else: what unseen names of a group share
    x[:, at + len(GROUPS)] = named == 1
    x[:, at + len(GROUPS) + 1] = named == 2
    at += 2 * len(GROUPS)
    for w, l in ((words, links), (below, below_links)):
        x[every, at + np.searchsorted(_STEPS, w)] = 1
        at += 5
        share = np.divide(l, w, out=np.zeros(n), where=w > 0)
        x[every, at + np.searchsorted(_SHARES, share)] = w > 0
        at += 4
        if w is words:
            x[:, at], x[:, at + 1] = ends, (words > 0) & ~ends
            at += 2
        else:
            x[:, at], x[:, at + 1] = below >= 100, below >= 400
            at += 2
    kind = np.where(parent >= 0, 3 * named[parent] + named, 0)
    return Trees(parent, x, kind, levels, first)


@dataclass
class Model:
    unary: np.ndarray  # N_FEATURES: the score of being content
    pair: np.ndarray  # N_KINDS x parent x child


def _either(x: np.ndarray) -> np.ndarray:
    """log of the sum over the last axis, which has two entries."""
    return np.logaddexp(x[..., 0], x[..., 1])


def sum_product(t: Trees, model: Model) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of the nodes (n x 2) and of the edges to their parents (n x 2 x 2; zero at roots), and the log of the partition function."""
    n = len(t.parent)
    own = np.zeros((n, 2))
    own[:, 1] = t.features @ model.unary
    edge = model.pair[t.kind]  # parent, child
    inside, up = own.copy(), np.zeros((n, 2))
    for at in reversed(t.levels[1:]):
        up[at] = _either(edge[at] + inside[at][:, None, :])
        np.add.at(inside, t.parent[at], up[at])
    outside = np.zeros((n, 2))
    joint = np.zeros((n, 2, 2))
    total = float(_either(inside[t.levels[0]]).sum()) if n else 0.0
    belief = inside.copy()
    for at in t.levels[1:]:
        above = t.parent[at]
        rest = belief[above] - up[at]  # the parent without this child
        pairs = edge[at] + rest[:, :, None]
        outside[at] = np.logaddexp(pairs[:, 0, :], pairs[:, 1, :])
        belief[at] = inside[at] + outside[at]
        whole = pairs + inside[at][:, None, :]
        joint[at] = np.exp(whole - _either(_either(whole))[:, None, None])
    return np.exp(belief - _either(belief)[:, None]), joint, total


def fit(pages: list[Page], labels: list[np.ndarray], rounds: int = ROUNDS) -> Model:
    """Weights of greatest penalised conditional likelihood, by gradient steps scaled by the gradients so far (Adam)."""
    t = trees(pages)
    y = np.concatenate(labels).astype(np.int64)
    model = Model(np.zeros(N_FEATURES), np.zeros((N_KINDS, 2, 2)))
    inner = np.flatnonzero(t.parent >= 0)
    seen = np.zeros((N_KINDS, 2, 2))
    np.add.at(seen, (t.kind[inner], y[t.parent[inner]], y[inner]), 1)
    weights = np.zeros(N_FEATURES + 4 * N_KINDS)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for k in range(1, rounds + 1):
        model = Model(weights[:N_FEATURES], weights[N_FEATURES:].reshape(N_KINDS, 2, 2))
        node, joint, _ = sum_product(t, model)
        expected = np.zeros((N_KINDS, 2, 2))
        np.add.at(expected, t.kind[inner], joint[inner])
        gradient = np.concatenate((t.features.T @ (y - node[:, 1]), (seen - expected).ravel())) / len(pages) - PENALTY * weights
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        weights = weights + RATE * (1 - k / (rounds + 1)) * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return Model(weights[:N_FEATURES], weights[N_FEATURES:].reshape(N_KINDS, 2, 2))


def marked_labels(page: Page) -> np.ndarray | None:
    """Labels of a page that marks its text with exactly one article, or else main, element; names of furniture in it aren't content."""
    for tag in ("article", "main"):
        at = [i for i, t in enumerate(page.tag) if t == tag]
        if len(at) == 1:
            y = np.zeros(len(page.tag), np.int8)
            for i, up in enumerate(page.parent):
                y[i] = i == at[0] or (up >= 0 and y[up] and not page.groups[i] - {"body"})
            return y
    return None


# Containers and furniture of composed pages, as start tags; their texts come from the sampled pages.
_CONTAINERS = ["article", "main", 'div class="content"', 'div id="main-content"', 'div class="post-body"', 'section class="entry"', 'div class="articleBody"', "div", "section"]
_WRAPPERS = ["div", 'div class="wrapper"', 'div id="page"', 'div class="container"', "section", 'div class="main"', "main"]
_LINKS = ["nav", 'div class="menu"', 'ul class="breadcrumbs"', 'div id="navbar"', 'div class="related"', 'div class="share"', 'div class="pagination"', 'aside class="sidebar"', 'div class="sidebar"', 'header class="masthead"', "header", "footer"]
_TEXTS = ["footer", "header", "aside", 'div class="ad"', 'div class="sidebar"', 'div class="cookie-notice"', 'div id="consent"', 'div class="widget"', 'div class="promo"', 'p class="notice"', 'div class="banner"', 'div class="newsletter"', 'div id="footer"', 'div id="header"', 'div role="alert"', 'div class="advertisement"']
_FORMS = ["form", 'form id="login"', 'form class="search"', 'div class="signup"']
_COMMENTS = ['section class="comments"', 'div id="comments"', 'div class="reader-comments"', 'ol class="commentlist"', 'div class="discussion"']
_INVENTED = [" ".join(f"{a}{b}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "to", "su")) + "."]


def _composed(rng: random.Random, body: list[str], other: list[str]) -> tuple[Page, np.ndarray]:
    """A page whose nodes are labelled by construction: ``body`` as its text, ``other`` texts as furniture and comments."""
    page, labels = Page(), []

    def node(parent: int, opening: str, label: int, text: str | None = None, linked: bool = False) -> int:
        tag, _, rest = opening.partition(" ")
        page.parent.append(parent)
        page.tag.append(tag)
        page.groups.append(name_groups(tag, re.findall(r'(\w+)="([^"]*)"', rest)))
        labels.append(label)
        if text:
            page.blocks.append((len(labels) - 1, text, text.count(" ") + 1 if linked else 0))
        return len(labels) - 1

    def piece(low: int, high: int) -> str:
        words = rng.choice(other).split()
        k = rng.randrange(max(1, len(words) - high))
        return " ".join(words[k : k + rng.randint(low, high)])

    def furniture(parent: int) -> None:
        kind = rng.random()
        if kind < 0.35:
            top = node(parent, rng.choice(_LINKS), 0)
            holder = node(top, "ul", 0) if rng.random() < 0.7 else top
            for _ in range(rng.randint(2, 7)):
                node(holder, "li" if page.tag[holder] == "ul" else "div", 0, piece(1, 3), True)
        elif kind < 0.7:
            opening = rng.choice(_TEXTS)
            if rng.random() < 0.5 or opening.startswith("p "):
                node(parent, opening, 0, piece(3, 25))
            else:
                top = node(parent, opening, 0)
                for _ in range(rng.randint(1, 3)):
                    node(top, rng.choice(["p", "h3", "div"]), 0, piece(2, 30))
        elif kind < 0.82:
            top = node(parent, rng.choice(_FORMS), 0)
            for _ in range(rng.randint(1, 3)):
                node(top, rng.choice(["p", "div", "fieldset"]), 0, piece(1, 12))
        else:
            top = node(parent, rng.choice(_COMMENTS), 0)
            for _ in range(rng.randint(1, 4)):
                one = node(top, rng.choice(["div", 'div class="comment"', "li", "article"]), 0)
                node(one, "p", 0, rng.choice(other))

    at = node(-1, "html", 0)
    most = 0 if rng.random() < 0.08 else 3  # some pages have no furniture
    for _ in range(rng.randint(0, 2)):
        at = node(at, rng.choice(_WRAPPERS), 0)
        while most and rng.random() < 0.3:
            furniture(at)
    for _ in range(rng.randint(min(1, most), most)):
        furniture(at)
    if rng.random() < 0.15:
        text, labels[at] = at, 1  # no container of its own
    else:
        text = node(at, rng.choice(_CONTAINERS), 1)
    if rng.random() < 0.6:
        node(text, rng.choice(["h1", "h2"]), 1, " ".join(body[0].split()[:10]))
    inner = node(text, rng.choice(["div", "section", 'div class="text"']), 1) if rng.random() < 0.3 else text
    for part in body:
        kind = rng.random()
        if rng.random() < 0.15:
            part = " ".join(part.split()[: rng.randint(1, 7)])
        if kind < 0.15:
            page.blocks.append((inner, part, 0))  # text of the container itself
        elif kind < 0.72:
            node(inner, "p", 1, part)
        elif kind < 0.8:
            node(node(inner, "blockquote", 1), "p", 1, part)
        elif kind < 0.88:
            holder = node(inner, rng.choice(["ul", "ol"]), 1)
            for k in range(0, len(words := part.split()), 8):
                node(holder, "li", 1, " ".join(words[k : k + 8]))
        elif kind < 0.94:
            node(inner, rng.choice(["h2", "h3"]), 1, " ".join(part.split()[:6]))
            node(inner, "p", 1, part)
        else:
            node(node(node(inner, "table", 1), "tr", 1), "td", 1, part)
        if most and rng.random() < 0.08:
            furniture(inner)
    while most and rng.random() < 0.4:
        furniture(text)
    for _ in range(rng.randint(min(1, most), most)):
        furniture(at)
    return page, np.array(labels, np.int8)


def labelled_pages(htmls: list[str], composed: int = COMPOSED, seed: int = 5) -> tuple[list[Page], list[np.ndarray]]:
    """Pages that mark their text, and ``composed`` pages made of the texts of each."""
    pages, labels, bodies, other = [], [], [], []
    for html in htmls:
        page = parse(html)
        y = marked_labels(page)
        if y is not None and y.any():
            pages.append(page)
            labels.append(y)
            bodies.append([t for i, t, _ in page.blocks if y[i]])
            other += [t for i, t, _ in page.blocks if y[i] or t.count(" ")][-4:]
    bodies = [b[:30] for b in bodies if b] or [_INVENTED * 3] * 50
    rng = random.Random(seed)
    for body in bodies:
        for _ in range(composed):
            k = rng.randrange(len(body))
            page, y = _composed(rng, body[k : k + rng.randint(1, 8)], other or _INVENTED)
            pages.append(page)
            labels.append(y)
    return pages, labels


def fit_extractor(pages: DataFrame, html: str = "html", sample: int = PAGES) -> Model:
    """A model of about ``sample`` pages that mark their text, of at most PAGE_BYTES each, chosen by a hash of the page at a rate that follows their number."""
    marked = pages.where((F.octet_length(html) <= PAGE_BYTES) & F.col(html).rlike("(?i)<(article|main)[ >]"))
    place = F.pmod(F.xxhash64(html, F.lit(12)), F.lit(1 << 40))
    rate = min(1.0, sample / max(1, marked.count()))
    rows = marked.where(place < int(rate * (1 << 40))).select(html).distinct().collect()
    return fit(*labelled_pages(sorted(r[0] for r in rows)))


def main_blocks(pages: list[Page], model: Model) -> list[list[str]]:
    """The kept blocks of each page."""
    t = trees(pages)
    content = sum_product(t, model)[0][:, 1] >= 0.5 if len(t.parent) else []
    return [[text for node, text, _ in p.blocks if content[f + node]] for p, f in zip(pages, t.first.tolist(), strict=False)]


#: Bytes of pages whose nodes are in memory at once (a page is never cut).
SLICE_BYTES = 1 << 20


def extract(pages: DataFrame, model: Model, html: str = "html") -> DataFrame:
    """page_id, url, blocks, text (blocks joined by an empty line) and n_chars of each page."""

    def per_chunk(kept: list[pa.Array], texts: list[bytes]) -> pa.RecordBatch:
        blocks: list[list[str]] = []
        held, size = [], 0
        for raw in texts:
            held.append(parse(raw.decode("utf-8", "replace")))
            size += len(raw)
            if size >= SLICE_BYTES:
                blocks += main_blocks(held, model)
                held, size = [], 0
        blocks += main_blocks(held, model)
        joined = ["\n\n".join(b) for b in blocks]
        return pa.RecordBatch.from_arrays(
            [kept[0].cast(pa.int64()), kept[1].cast(pa.string()), pa.array(blocks, pa.list_(pa.string())), pa.array(joined, pa.string()), pa.array([len(x) for x in joined], pa.int64())], ["page_id", "url", "blocks", "text", "n_chars"]
        )

    return map_texts(pages, per_chunk, "page_id long, url string, blocks array<string>, text string, n_chars long", ("page_id", "url"), html)
