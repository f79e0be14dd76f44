"""Main text of web pages by gradient-boosted trees over DOM nodes, with hierarchical decoding.

A page is parsed into block nodes: elements that make blocks, and runs of text between them (inline elements belong to
their block). Every node has features of its subtree (words, words in links, words for each tag), of its attributes'
tokens, its depth and its siblings. Boosted regression trees give the log odds that a node is part of the main text.
Decoding labels all nodes at once: a dropped node drops all below it and a kept one keeps all above it, so ancestor and
descendant can't contradict each other; among such labellings the one of greatest total log odds is found by one pass
from the leaves up.

No labelled pages come with the data, so the trees are fitted to pages that `specimen` makes from a seed: articles among
menus, headers, notices, adverts, sidebars, forms, comments and footers in many markups, with labels known.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docbasin.llm.common import arrow, pieces, read

#: Pages made for fitting; rounds, depth and learning rate of the trees; bins of a feature.
SPECIMENS, ROUNDS, DEPTH, RATE, BINS = 400, 80, 4, 0.25, 32
# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
SILENT = set("script style noscript template iframe svg canvas head title textarea select object audio video map datalist".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS_OPEN = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
TAGS = [{"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"article", "main"}, {"div", "section", "center"}, {"ul", "ol", "li", "dl", "dt", "dd"}, {"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "button", "dialog"}, {"table", "tr", "td", "th", "tbody", "thead"}, {"pre", "blockquote", "figure", "figcaption"}, {"#text"}]
TOKENS = [
    set("article content post entry main story body text page single".split()),
    set("nav navbar navigation menu breadcrumb breadcrumbs crumbs toc pager pagination tabs".split()),
    set("header masthead banner topbar logo branding site".split()),
    set("footer foot copyright legal bottom contentinfo colophon".split()),
    set("sidebar side aside related widget rail complementary recommended popular trending teaser more".split()),
    set("ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion doubleclick banner".split()),
    set("cookie cookies notice consent gdpr alert popup modal overlay newsletter subscribe paywall notification warning".split()),
    set("comment comments reply replies respond disqus discussion reader thread".split()),
    set("form login search share social sharing signup register contact buttons tools".split()),
]
WORD = re.compile(r"\S+")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    __slots__ = ("depth", "flags", "kept", "kids", "label", "link", "logit", "parent", "place", "tag", "tags", "text", "words")

    def __init__(self, tag: str, parent: Node | None, flags: int = 0):
        self.tag, self.parent, self.flags, self.depth = tag, parent, flags, parent.depth + 1 if parent else 0
        self.kids, self.text, self.words, self.link, self.tags, self.label, self.kept, self.logit, self.place = [], [], 0, 0, 1, None, False, 0.0, 0
        if parent:
            self.place = len(parent.kids)
            parent.kids.append(self)


def attribute_flags(attrs: list[tuple[str, str | None]]) -> int:
    out = 0
    for name, value in attrs:
        if name in ("class", "id", "role", "itemprop", "aria-label") and value:
            found = {p.lower() for p in PART.findall(value)}
            for i, group in enumerate(TOKENS):
                if found & group:
                    out |= 1 << i
    return out


class Dom(HTMLParser):
    """Block nodes of a page. Unclosed and misnested tags are put right as browsers do, roughly."""

    def __init__(self, heard: frozenset[str] = frozenset()):
        """heard: elements without a visible text of their own that are read nevertheless, as they are never closed."""
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None)
        self.silent, self.in_link, self.run = [], 0, []
        self.heard, self.unclosed = heard, set()
        #: By tag, the open nodes from the root down: an end tag finds its element, or that there is none, at once.
        self.open: dict[str, list[Node]] = {}

    def rise(self, to: Node) -> None:
        """Closes all open nodes below `to`."""
        while self.at is not to:
            self.open[self.at.tag].pop()
            self.at = self.at.parent

    def deepest(self, tags: Iterable[str]) -> Node | None:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), key=lambda n: n.depth, default=None)

    def speak(self) -> None:
        """Ends a silence that its own end tag did not end."""
        self.unclosed.update(self.silent[:1])
        self.silent = []

    def updatepos(self, i: int, j: int) -> int:
        """Lines and columns aren't needed."""
        return j

    def flush(self) -> None:
        """A run of text ends: it becomes a node if it has any words."""
        if self.run:
            text = " ".join(WORD.findall("".join(t for t, _ in self.run)))
            if text:
                leaf = Node("#text", self.at)
                leaf.text.append(text)
                leaf.words = text.count(" ") + 1
                leaf.link = min(leaf.words, sum(len(WORD.findall(t)) for t, linked in self.run if linked))
            self.run = []

    def handle_starttag(self, tag, attrs):
        if self.silent:
            if tag in SILENT and tag not in VOID and tag == self.silent[-1]:
                self.silent.append(tag)
            return
        if tag in SILENT and tag not in self.heard:
            if tag == "head" or tag not in VOID:
                self.silent.append(tag)
            return
        if tag == "br" or tag == "hr":
            self.flush()
            return
        if tag in INLINE:
            if tag == "a":
                self.in_link = 1
            return
        if tag in VOID:
            return
        self.flush()
        self.in_link = 0
        if tag not in ("tbody", "thead", "html", "body"):
            self.close_before(tag)
        label = next((v for k, v in attrs if k == "data-label"), None)
        node = Node(tag, self.at, attribute_flags(attrs))
        node.label = label
        self.open.setdefault(tag, []).append(node)
        self.at = node

    def close_before(self, tag: str) -> None:
        if tag in CLOSES:
            before, fence = self.deepest(CLOSES[tag]), self.deepest(KEEPS_OPEN.get(tag, ()))
            if before and (fence is None or before.depth > fence.depth):
                self.rise(before.parent)
        else:
            node = self.at
            while node.parent and node.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                node = node.parent
            self.rise(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.pop()
            elif tag in ("head", "body", "html"):
                self.speak()
            return
        if tag in INLINE:
            if tag == "a":
                self.in_link = 0
            return
        if tag in VOID:
            self.flush()
            return
        if self.open.get(tag):
            self.flush()
            self.in_link = 0
            self.rise(self.open[tag][-1].parent)

    def handle_data(self, data):
        if not self.silent:
            self.run.append((data, self.in_link))


class Bodyward(Dom):
    """A head that is never closed ends where a body begins."""

    def handle_starttag(self, tag, attrs):
        if tag == "body" and self.silent == ["head"]:
            self.silent = []
        super().handle_starttag(tag, attrs)


def closed(html: str) -> str:
    """`html` with what follows its last > as text, but for its first tag: a parser reads to the end for each tag that isn't closed."""
    end = html.rfind(">") + 1
    first = html.find("<", end) + 1
    return html if not first else html[:first] + html[first:].replace("<", "&lt;")


def _read(html: str, heard: frozenset[str]) -> Dom:
    html, dom = closed(html), Bodyward(heard)
    try:
        dom.feed(html)
        dom.close()
    except AssertionError:  # a marked section that the parser refuses: as text
        dom = Bodyward(heard)
        dom.feed(html.replace("<![", "&lt;!["))
        dom.close()
    dom.speak()
    dom.flush()
    return dom


def parse(html: str) -> list[Node]:
    """Nodes of a page in page order, the root first, with their subtrees' sums.

    Where a silent element other than the head is never closed, it would silence the rest of the page; the page is then
    read again with such elements as blocks, at most once for each kind of them.
    """
    heard: frozenset[str] = frozenset()
    while (unclosed := (dom := _read(html, heard)).unclosed - {"head", "script", "style"} - heard):
        heard |= unclosed
    out, todo = [], [dom.root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.kids))
    for node in reversed(out):
        if node.parent:
            node.parent.words += node.words
            node.parent.link += node.link
            node.parent.tags += node.tags
    return out


N_FEATURES = len(TAGS) * 2 + len(TOKENS) * 2 + 15


GROUP_OF = {tag: g for g, tags in enumerate(TAGS) for tag in tags}


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node but the root: tag groups and attribute tokens of the node and of its ancestors, then sizes."""
    whole, size = max(nodes[0].words, 1), len(nodes)
    above: dict[int, tuple[int, int]] = {id(nodes[0]): (0, 0)}  # of each node: flags and tag groups from the root to it
    bits, sizes = [], []
    for i, n in enumerate(nodes[1:], 1):
        p, words = n.parent, n.words
        up_flags, up_tags = above[id(p)]
        group = GROUP_OF.get(n.tag)
        own = 0 if group is None else 1 << group
        above[id(n)] = (up_flags | n.flags, up_tags | own)
        bits.append((own, up_tags, n.flags, up_flags))
        siblings, place = p.kids, n.place
        before = siblings[place - 1].words if place else 0
        after = siblings[place + 1].words if place + 1 < len(siblings) else 0
        sizes.append((n.depth, words, n.link / (words or 1), words / n.tags, len(n.kids), words / whole, place, len(siblings), p.words / len(siblings), before, after, p.link / (p.words or 1), words / (p.words or 1), i / size, p.words / whole))
    if not bits:
        return np.zeros((0, N_FEATURES), np.float32)
    b = np.array(bits)
    tags, tokens = np.arange(len(TAGS)), np.arange(len(TOKENS))
    return np.concatenate([b[:, :1] >> tags & 1, b[:, 1:2] >> tags & 1, b[:, 2:3] >> tokens & 1, b[:, 3:4] >> tokens & 1, np.array(sizes)], 1).astype(np.float32)


class Trees:
    """Boosted regression trees of fixed depth on binned features, for log odds."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self._bin(x)
        self.base = float(np.log((weight * y).sum() / (weight * (1 - y)).sum()))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        score = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, weight * (y - p), weight * p * (1 - p))
            self.trees.append(tree)
            score += self._leaf(binned, tree)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1).astype(np.int64)

    @staticmethod
    def _grow(binned: np.ndarray, g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = (1 << DEPTH) - 1
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64), np.zeros(len(g), np.int64)
        for level in range(DEPTH):
            first, count = (1 << level) - 1, 1 << level
            best = np.full(count, 1e-6)
            local = at - first
            for f in range(binned.shape[1]):
                slot = local * BINS + binned[:, f]
                gs, hs = (np.bincount(slot, v, count * BINS).reshape(count, BINS).cumsum(1) for v in (g, h))
                gain = gs**2 / (hs + ridge) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + ridge)
                gain[:, -1] = 0
                gain[(hs < 1) | (hs[:, -1:] - hs < 1)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(count), top] > best
                best[better] = gain[np.arange(count), top][better]
                feature[first : first + count][better], cut[first : first + count][better] = f, top[better]
            at = 2 * at + 1 + (binned[np.arange(len(g)), feature[at]] > cut[at])
        at -= inner
        return feature, cut, RATE * np.bincount(at, g, 1 << DEPTH) / (np.bincount(at, h, 1 << DEPTH) + ridge)

    @staticmethod
    def _leaf(binned: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, value = tree
        at, every = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(DEPTH):
            at = 2 * at + 1 + (binned[every, feature[at]] > cut[at])
        return value[at - len(feature)]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        binned = self._bin(x)
        return self.base + sum(self._leaf(binned, t) for t in self.trees)


def specimen(rng: np.random.Generator) -> str:
    """A made page; data-label says 1 on what is main text and 0 on what is not (for all below, unless it says otherwise)."""
    def pick(*options):
        return options[rng.integers(len(options))]

    def prose(lo: int, hi: int) -> str:
        return " ".join("w" * int(k) for k in rng.integers(2, 9, rng.integers(lo, hi + 1))) + "."

    def links(lo: int, hi: int) -> str:
        items = [f'<a href="/x">{prose(1, 3)}</a>' for _ in range(rng.integers(lo, hi + 1))]
        return pick("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", " ".join(items), "".join(f"<p>{i}</p>" for i in items))

    def references() -> str:
        """A list of links that is part of an article."""
        tag = pick("ul", "ol")
        return f"<{tag}>" + "".join(f'<li>{pick("", "", prose(1, 6))}<a href="/r">{prose(1, 5)}</a>{pick("", prose(1, 8))}</li>' for _ in range(rng.integers(1, 7))) + f"</{tag}>"

    def named(group: int) -> str:
        token = pick(*sorted(TOKENS[group]))
        return pick(f' class="{token}"', f' id="{token}"', f' class="x-{token} b{rng.integers(9)}"', f' class="{token}-box"')

    def drop(tag: str, attrs: str, inside: str) -> str:
        return f'<{tag}{attrs} data-label="0">{inside}</{tag}>'

    def block(tag_own: str, group: int, inside: str) -> str:
        return drop(tag_own, pick("", named(group)), inside) if rng.random() < 0.5 else drop(pick("div", "section"), named(group), inside)

    extras = {
        "nav": lambda: block("nav", 1, links(3, 9)),
        "header": lambda: block("header", 2, pick(f"<h1>{prose(1, 4)}</h1>", f"<h2>{prose(1, 4)}</h2><p>{prose(2, 8)}</p>", prose(1, 5)) + pick("", links(2, 5))),
        "ad": lambda: drop(pick("div", "div", "aside", "p"), named(5), pick(prose(3, 25), f"<p>{prose(3, 40)}</p>", f'<a href="/a">{prose(2, 9)}</a>')),
        "notice": lambda: drop(pick("div", "div", "section", "p"), named(6), f"<p>{prose(5, 40)}</p>" + pick("", "<button>ok</button>")),
        "side": lambda: block("aside", 4, pick("", f"<h3>{prose(1, 3)}</h3>") + pick(links(3, 9), f"<p>{prose(5, 60)}</p>" * int(rng.integers(1, 3)))),
        "form": lambda: drop("form", pick("", named(8)), f"<label>{prose(1, 3)}</label><input><p>{prose(2, 15)}</p><button>{prose(1, 2)}</button>"),
        "share": lambda: drop(pick("div", "ul", "p"), named(8), links(2, 5)),
        "comments": lambda: block("section", 7, f"<h3>{prose(1, 3)}</h3>" + "".join(pick(f"<div{named(7)}><p>{prose(3, 60)}</p></div>", f"<article{named(7)}><p>{prose(3, 60)}</p></article>", f"<li><p>{prose(3, 40)}</p></li>", f"<p>{prose(3, 40)}</p>") for _ in range(rng.integers(1, 6)))) if rng.random() < 0.3 else drop(pick("div", "section", "ol"), named(7), "".join(f"<div{named(7)}><p>{prose(3, 60)}</p></div>" for _ in range(rng.integers(1, 6)))),
        "footer": lambda: block("footer", 3, pick(f"&copy; {prose(2, 20)}", f"<p>{prose(3, 20)}</p>", links(2, 6) + prose(2, 12))),
    }

    def article() -> str:
        body = [f"<h1>{prose(2, 14)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(int(rng.integers(1, 4) if rng.random() < 0.4 else rng.integers(2, 30))):
            body.append(pick(*[f"<p>{prose(2, 120)}</p>"] * 8, f"<p>{prose(1, 6)}</p>", f"<p><b>{prose(2, 12)}<br>", f"<h2>{prose(1, 8)}</h2>", "<ul>" + "".join(f"<li>{prose(2, 25)}</li>" for _ in range(rng.integers(2, 6))) + "</ul>", f"<blockquote><p>{prose(5, 40)}</p></blockquote>", f"<pre>{prose(3, 30)}</pre>", f'<p>{prose(3, 30)} <a href="/y">{prose(1, 4)}</a> {prose(3, 30)}</p>', f"<table><tr><td>{prose(1, 5)}</td><td>{prose(1, 5)}</td></tr></table>", f"{prose(5, 60)}", references()))
        for kind in ("ad", "share", "notice", "side", "form"):
            if rng.random() < 0.15:
                body.insert(int(rng.integers(len(body) + 1)), extras[kind]())
        inside = "".join(body)
        tag = pick("article", "article", "article", "main", "div", "div", "section")
        inside = f'<{tag}{pick("", named(0)) if tag in ("article", "main") else pick(named(0), named(0), "")} data-label="1">{inside}</{tag}>'
        for _ in range(rng.integers(0, 3)):
            around = pick("", "", extras["side"](), extras["ad"]())
            inside = f'<{pick("div", "main", "section")}{pick("", "", named(0), " class=wrap")} data-label="1">{pick(inside + around, around + inside)}</div>'
        return inside

    above = [extras[k]() for k in ("header", "nav", "notice", "ad", "side", "form") if rng.random() < 0.5]
    below = [extras[k]() for k in ("share", "ad", "side", "comments", "form", "nav", "notice", "footer") if rng.random() < 0.4]
    rng.shuffle(above)
    return f'<!DOCTYPE html><html><head><title>{prose(2, 9)}</title><script>var a;</script></head><body>{"".join(above)}{article()}{"".join(below)}</body></html>'


@lru_cache(maxsize=1)
def model(seed: int = 5) -> Trees:
    rng, xs, ys, ws = np.random.default_rng(seed), [], [], []
    for _ in range(SPECIMENS):
        nodes = parse(specimen(rng))
        for n in nodes[1:]:
            if n.tag in ("html", "body"):
                n.label = "1"
            elif n.label is None or n.parent.label == "0":
                n.label = n.parent.label or "0"
        rows = features(nodes)
        xs.append(rows)
        ys += [float(n.label == "1") for n in nodes[1:]]
        ws += [1.0 + np.log1p(n.words) for n in nodes[1:]]
    return Trees(np.concatenate(xs), np.array(ys), np.array(ws))


def decode(nodes: list[Node]) -> list[str]:
    """The texts of kept leaves, in page order, under the best labelling in which a dropped node drops all below it."""
    drop: dict[int, float] = {}
    best: dict[int, float] = {}
    for n in reversed(nodes):
        own = n.logit * (1 + np.log1p(n.words) if n.tag == "#text" else 1)
        drop[id(n)] = -own + sum(drop[id(k)] for k in n.kids)
        keep = own + sum(best[id(k)] for k in n.kids)
        n.kept = keep > drop[id(n)] or n.parent is None
        best[id(n)] = max(keep, drop[id(n)])
    out, todo = [], [nodes[0]]
    while todo:
        n = todo.pop()
        if n.kept:
            out += n.text
            todo.extend(reversed(n.kids))
    return out


def extract(pages: DataFrame) -> DataFrame:
    """`pages` (page_id, url, html) -> page_id, url, text, n_chars.

    Null and empty pages, and pages without main text, have an empty text. Each page stands by itself; repeated pages
    get repeated results; other columns are ignored. One pass, no shuffle.
    """
    trees = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "html"):
            parsed = [parse(h or "") for h in piece["html"].to_pylist()]
            rows = [features(nodes) for nodes in parsed]
            odds, at, texts = trees.log_odds(np.concatenate(rows)), 0, []
            for nodes in parsed:
                for n, v in zip(nodes[1:], odds[at : at + len(nodes) - 1].tolist(), strict=True):
                    n.logit = v
                at += len(nodes) - 1
                texts.append(" ".join(decode(nodes)))
            yield pa.RecordBatch.from_arrays([piece["page_id"].cast(pa.int64()), piece["url"].cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return arrow(pages.select("page_id", "url", "html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_mainhtml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
