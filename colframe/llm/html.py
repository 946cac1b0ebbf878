"""Main text of web pages by boosted trees over DOM-node features (operator 9).

A page becomes a tree of containers and text blocks. Gradient-boosted trees, trained here on generated pages whose parts
are known, give each node a probability that it holds main text, from its own and its ancestors' tags and attribute
tokens, the density of text, links and elements in its subtree, its depth, and its siblings. Decoding goes over
the tree as a whole: a node can only be kept with all its ancestors, so the choice that makes the labels most likely
never contradicts itself.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import limit_batches

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
#: Their contents are not markup, and never text of the page.
RAW = ("script", "style", "template", "textarea", "title", "iframe", "svg", "xmp", "noembed", "noframes")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr object noscript math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mstyle mover munder semantics".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the key ends an open element of the values, up to one of BARRIERS.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
BARRIERS = frozenset("table ul ol dl select body html article section main".split())
FORM = frozenset("form input select textarea button fieldset label option".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|aria-label|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPLIT = re.compile(r"[^a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Node:
    tag: str
    parent: Node | None
    tokens: tuple[str, ...] = ()
    children: list = field(default_factory=list)
    text: list | None = None  # pieces of a text block
    links: int = 0  # characters of its links
    forms: int = 0
    elements: int = 0
    inline: int = 0
    truth: bool = False


def attribute_tokens(attrs: str) -> tuple[str, ...]:
    out = []
    for name, *values in ATTRIBUTE.findall(attrs):
        value = next((v for v in values if v), "")
        name = name.lower()
        if name == "style":
            if "display:none" in value.replace(" ", "").lower():
                out.append("hidden")
        elif name in ("hidden", "aria-hidden"):
            if value.lower() != "false":
                out.append("hidden")
        else:
            out += [t for t in SPLIT.split(CAMEL.sub("-", value).lower()) if len(t) > 1]
    return tuple(out)


def parse(page: str) -> Node:
    """Tree of containers and text blocks. Tags that are never closed, or closed twice, are put up with, as browsers do."""
    root = Node("html", None)
    here, block, inline = root, None, []  # inline: open inline elements, with whether they are links

    def text(raw: str, here: Node, block: Node | None) -> Node | None:
        if block is None:
            if not raw.strip():
                return None
            block = Node("#text", here, text=[])
            here.children.append(block)
        block.text.append(raw)
        if any(t == "a" for t in inline):
            block.links += len(raw)
        return block

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            block = text(page[at:], here, block)
            break
        if lt > at:
            block = text(page[at:lt], here, block)
        m = TOKEN.match(page, lt)
        if not m:
            # a lone "<", or a tag that the page's end cuts off
            if re.match(r"</?[a-zA-Z]", page[lt : lt + 3]) and page.find(">", lt) < 0:
                break
            block = text("<", here, block)
            at = lt + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        closing, tag = bool(m[1]), m[2].lower()
        if not closing and tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            if block is not None and tag in ("textarea", "object", "iframe"):
                block.inline += 1
            continue
        if tag == "br":
            if block is not None:
                block.text.append(" ")
            continue
        if tag in INLINE:
            if closing:
                if tag in inline:
                    del inline[len(inline) - 1 - inline[::-1].index(tag) :]
            elif not m[3].endswith("/") and tag not in VOID:
                inline.append(tag)
                if block is not None:
                    block.inline += 1
            if tag in FORM and not closing:
                here.forms += 1
            continue
        if tag in FORM and tag != "form":
            here.forms += not closing
            if tag in ("button", "option", "select") and not closing:
                pass
        if tag in VOID:
            if tag == "hr":
                block = None
            here.elements += 1
            continue
        if closing:
            x = here
            while x is not root and x.tag != tag:
                x = x.parent
            if x is not root:
                here = x.parent
            elif tag != "p":  # it closes nothing
                continue
            block = None
            inline.clear()
            continue
        block = None
        if tag in ("html", "body"):
            if tag == "body":
                root.tokens += attribute_tokens(m[3])
            continue
        # what this element ends by starting
        if tag != "p" or here.tag == "p":
            x = here
            while x is not root and x.tag != "p" and x.tag not in BARRIERS and x.tag not in ("td", "th", "button", "li", "div"):
                x = x.parent
            if x.tag == "p":
                here = x.parent
        ended = ENDS.get(tag)
        if ended:
            x, last = here, None
            while x is not root and x.tag not in BARRIERS:
                if x.tag in ended:
                    last = x
                x = x.parent
            if last is not None:
                here = last.parent
        inline.clear()
        node = Node(tag, here, attribute_tokens(m[3]))
        here.children.append(node)
        here = node
    return root


# ---- features

FLAGS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "ul", "li", "table", "p", "div", "#text", "blockquote", "pre", "heading", "figure", "dl", "button")
NUMBERS = 24


def features(root: Node, vocabulary: dict[str, int]) -> tuple[list[Node], np.ndarray]:
    """Nodes in page order, parents first, and a row of features for each."""
    nodes: list[Node] = []
    stats: dict[int, tuple] = {}
    stack = [root]
    while stack:
        x = stack.pop()
        nodes.append(x)
        stack.extend(reversed(x.children))
    for x in reversed(nodes):
        if x.text is not None:
            s = " ".join("".join(x.text).split())
            stats[id(x)] = (len(s), min(x.links, len(s)), 1, 0, s.count(" ") + 1, sum(map(s.count, ".,;:!?")), x.inline, 0, 1)
        else:
            parts = [stats[id(c)] for c in x.children]
            total = [sum(p[k] for p in parts) for k in range(9)] if parts else [0] * 9
            total[3] += x.elements + 1
            total[7] += x.forms + (x.tag == "form")
            stats[id(x)] = tuple(total)
    whole = max(1, stats[id(root)][0])
    width = NUMBERS + 3 * len(FLAGS) + 2 * len(vocabulary)
    out = np.zeros((len(nodes), width), np.float32)
    depth, path_flags, path_tokens, before = {id(root): 0}, {}, {}, 0
    alike = {id(x): Counter(c.tag for c in x.children) for x in nodes if x.children}
    flag = {t: i for i, t in enumerate(FLAGS)}
    for i, x in enumerate(nodes):
        chars, links, blocks, elements, words, marks, inline, forms, _ = stats[id(x)]
        p = x.parent
        d = depth[id(x)] = depth[id(p)] + 1 if p is not None else 0
        ps = stats[id(p)] if p is not None else stats[id(x)]
        siblings = p.children if p is not None else [x]
        k = x_index = 0
        if p is not None:
            k = p.__dict__.setdefault("_seen", 0)
            p.__dict__["_seen"] = k + 1
            x_index = k
        tag = "heading" if x.tag in HEADINGS else x.tag
        f = out[i]
        f[:NUMBERS] = (
            d, chars, links / max(1, chars), chars / max(1, elements), chars / max(1, blocks), words, marks / max(1, words),
            inline, forms, blocks, elements, x_index, len(siblings), x_index / len(siblings), chars / max(1, ps[0]),
            before / whole, chars / whole, ps[1] / max(1, ps[0]), ps[0] / max(1, ps[3]), ps[2], stats[id(siblings[x_index - 1])][0] if x_index else -1,
            stats[id(siblings[x_index + 1])][0] if x_index + 1 < len(siblings) else -1, alike[id(p)][x.tag] if p is not None else 1, x.text is None,
        )
        if x.text is not None:
            before += chars
        own = flag.get(tag)
        above = path_flags[id(p)] if p is not None else np.zeros(len(FLAGS), np.float32)
        if own is not None:
            f[NUMBERS + own] = 1
        if p is not None and (q := flag.get("heading" if p.tag in HEADINGS else p.tag)) is not None:
            f[NUMBERS + len(FLAGS) + q] = 1
        here = above
        if own is not None and not above[own]:
            here = above.copy()
            here[own] = 1
        path_flags[id(x)] = here
        f[NUMBERS + 2 * len(FLAGS) : NUMBERS + 3 * len(FLAGS)] = here
        base = NUMBERS + 3 * len(FLAGS)
        tokens = [vocabulary[t] for t in x.tokens if t in vocabulary]
        known = path_tokens[id(p)] if p is not None else frozenset()
        if tokens:
            f[[base + t for t in tokens]] = 1
            known = known | frozenset(tokens)
        path_tokens[id(x)] = known
        if known:
            f[[base + len(vocabulary) + t for t in known]] = 1
    return nodes, out


# ---- boosted trees


class Boosted:
    """Gradient-boosted trees for two classes, by histograms of binned features."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._binned(x)
        used = [k for k, e in enumerate(self.edges) if binned[:, k].max() > binned[:, k].min()]
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(len(y), self.base)
        columns = np.ascontiguousarray(binned[:, used].T).astype(np.int64)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            feature, cut = np.full((1 << self.depth) - 1, -1), np.zeros((1 << self.depth) - 1, np.int64)
            at = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                n, base = 1 << level, (1 << level) - 1
                local = at - base
                best = np.full(n, 1e-6)
                size = n * (self.bins + 1)
                for f, column in zip(used, columns, strict=True):
                    slot = local * (self.bins + 1) + column
                    gs = np.bincount(slot, g, size).reshape(n, -1).cumsum(1)
                    hs = np.bincount(slot, h, size).reshape(n, -1).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < self.least) | (ht - hs < self.least)] = -1
                    k = gain.argmax(1)
                    top = gain[np.arange(n), k]
                    better = top > best
                    best[better], feature[base : base + n][better], cut[base : base + n][better] = top[better], f, k[better]
                f = feature[at]
                right = (f >= 0) & (binned[np.arange(len(y)), np.maximum(f, 0)] > cut[at])
                at = 2 * at + 1 + right
            leaf = at - ((1 << self.depth) - 1)
            n = 1 << self.depth
            value = -self.rate * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + 1)
            score += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], 1).astype(np.uint8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        used = sorted({int(f) for feature, _, _ in self.trees for f in feature if f >= 0})
        place = {f: k for k, f in enumerate(used)}
        binned = np.stack([np.searchsorted(self.edges[f], x[:, f], "left") for f in used], 1).astype(np.int64) if used else np.zeros((len(x), 1), np.int64)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            local = np.array([place.get(int(f), 0) for f in feature])
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + ((feature[at] >= 0) & (binned[rows, local[at]] > cut[at]))
            out += value[at - len(feature)]
        return out


def decode(nodes: list[Node], logits: np.ndarray) -> set[int]:
    """The most likely labels of a tree in which a node is kept only with its parent: ids of the kept nodes."""
    gain: dict[int, float] = {}
    for x, z in zip(reversed(nodes), reversed(logits.tolist()), strict=True):
        gain[id(x)] = z + sum(max(0.0, gain[id(c)]) for c in x.children)
    kept: set[int] = set()
    for x in nodes:
        if x.parent is None or (id(x.parent) in kept and gain[id(x)] > 0):
            kept.add(id(x))
    return kept


# ---- generated pages to learn from

SYLLABLES = "ka to mi re sun vel dor an ish ble qua per lo ti ra men sta und che ver ü é ño ge".split()
#: Usual names of a page's parts, as class or id tokens.
NAMES = {
    "nav": "nav navbar menu topnav navigation main-menu mobile-menu breadcrumb breadcrumbs pagination pager tabs toc".split(),
    "header": "header masthead site-header top-bar banner branding logo page-header".split(),
    "footer": "footer site-footer page-footer copyright colophon legal bottom credits".split(),
    "aside": "sidebar side aside widget widgets related recommended trending popular more-stories tags categories archive author-box bio".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsbygoogle banner-ad ad-slot ad-container".split(),
    "notice": "cookie cookies cookie-notice consent gdpr notice alert popup modal newsletter-popup overlay paywall".split(),
    "comments": "comments comment comment-list comment-body reply discussion responses disqus user-comment".split(),
    "form": "form search search-form newsletter subscribe signup login contact-form".split(),
    "share": "share social social-share sharing toolbar follow".split(),
    "main": "content post entry article article-body post-content entry-content main-content story body-text text markdown prose page-content".split(),
    "plain": "row col container wrapper inner box grid layout block group site page wrap outer section".split(),
}


class Writer:
    """Makes pages and marks their main text: its blocks begin with the character MARK."""

    MARK = ""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        r = self.r
        out = [("".join(r.choices(SYLLABLES, k=r.randint(1, 4)))) for _ in range(max(1, n))]
        for i in range(len(out)):
            if r.random() < 0.12 and i + 1 < len(out):
                out[i] += r.choice(".,.,;:")
        return (" ".join(out)).capitalize() + r.choice([".", ".", "", "!", "?"])

    def attrs(self, kind: str, chance: float = 0.85) -> str:
        r = self.r
        if r.random() > chance:
            return ""
        names = r.sample(NAMES[kind], min(len(NAMES[kind]), r.choice([1, 1, 1, 2])))
        if r.random() < 0.2:
            names.append(r.choice(NAMES["plain"]))
        if r.random() < 0.15:
            names[0] += f"-{r.randint(1, 99)}"
        return f' {r.choice(["class", "class", "class", "id"])}="{" ".join(names)}"'

    def links(self, n: int, tag: str = "li") -> str:
        items = [f'<a href="/{i}">{self.words(self.r.randint(1, 5))}</a>' for i in range(n)]
        if tag == "li":
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice([" | ", " ", " &middot; "]).join(items)

    def paragraph(self, mark: str, long: bool = True) -> str:
        r = self.r
        n = r.choice([1, 1, 2, 4, 8]) if r.random() < 0.3 else r.randint(8, 90 if long else 25)
        text = self.words(n)
        if r.random() < 0.25:
            parts = text.split(" ")
            k = r.randrange(len(parts))
            parts[k] = r.choice([f'<a href="#">{parts[k]}</a>', f"<b>{parts[k]}</b>", f"<em>{parts[k]}</em>", f"<b>{parts[k]}"])
            text = " ".join(parts)
        return f"<p>{mark}{text}{r.choice(['</p>', '</p>', '</p>', '', '<br>', '<br></p>'])}"

    def article(self) -> str:
        r, m = self.r, self.MARK
        out = [f"<h1>{m}{self.words(r.randint(2, 10))}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
            kind = r.random()
            if kind < 0.74:
                out.append(self.paragraph(m))
            elif kind < 0.8:
                out.append(f"<h{r.randint(2, 4)}>{m}{self.words(r.randint(1, 7))}</h2>".replace("</h2>", f"</h{out and 2 or 2}>"))
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{m}{self.words(r.randint(1, 15))}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote>{self.paragraph(m)}</blockquote>")
            elif kind < 0.93:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{m}{self.words(r.randint(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif kind < 0.96:
                out.append(f"<div>{m}{self.words(r.randint(5, 60))}</div>")
            else:
                out.append(f"<pre>{m}{self.words(r.randint(4, 30))}</pre>")
            if r.random() < 0.08:
                out.append(self.part(r.choice(["ad", "share", "aside", "form", "notice"])))
        return "".join(out)

    def part(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            body = self.links(r.randint(2, 12), r.choice(["li", "li", "flat"]))
            return f"<nav{self.attrs('nav', 0.4)}>{body}</nav>" if r.random() < 0.6 else f"<div{self.attrs('nav', 0.95)}>{body}</div>"
        if kind == "header":
            body = r.choice(["", f"<h1>{self.words(2)}</h1>", f"<p>{self.words(r.randint(2, 8))}</p>", f'<a href="/">{self.words(2)}</a>']) + (self.part("nav") if r.random() < 0.5 else self.words(3))
            return f"<header{self.attrs('header', 0.4)}>{body}</header>" if r.random() < 0.6 else f"<div{self.attrs('header', 0.95)}>{body}</div>"
        if kind == "footer":
            body = r.choice([f"&copy; {self.words(r.randint(2, 25))}", f"<p>{self.words(r.randint(2, 25))}</p>", self.links(r.randint(2, 8), r.choice(["li", "flat"])) + f"<p>&copy; {self.words(4)}</p>", f"site.example &middot; {self.words(r.randint(3, 12))}<br>{self.words(3)}"])
            return f"<footer{self.attrs('footer', 0.4)}>{body}</footer>" if r.random() < 0.65 else f"<div{self.attrs('footer', 0.95)}>{body}</div>"
        if kind == "aside":
            body = f"<h3>{self.words(2)}</h3>" * (r.random() < 0.6) + r.choice([self.links(r.randint(2, 8)), f"<p>{self.words(r.randint(4, 40))}</p>", "".join(f'<div><a href="#">{self.words(6)}</a><p>{self.words(r.randint(4, 20))}</p></div>' for _ in range(3))])
            return f"<aside{self.attrs('aside', 0.5)}>{body}</aside>" if r.random() < 0.5 else f"<{(t := r.choice(['div', 'section']))}{self.attrs('aside', 0.95)}>{body}</{t}>"
        if kind == "comments":
            items = "".join(f"<{(t := r.choice(['div', 'li']))}{self.attrs('comments', 0.7)}>" + r.choice(["", f"<b>{self.words(1)}</b>", f'<a href="#">{self.words(1)}</a>']) + f"<p>{self.words(r.randint(2, 60))}</p>" * r.randint(1, 2) + f"</{t}>" for _ in range(r.randint(1, 6)))
            return f"<{(s := r.choice(['div', 'section', 'ul']))}{self.attrs('comments', 1)}>" + f"<h2>{self.words(2)}</h2>" * (r.random() < 0.5) + items + (self.part("form") if r.random() < 0.4 else "") + f"</{s}>"
        if kind == "form":
            return f"<form{self.attrs('form', 0.5)}>" + f"<p>{self.words(r.randint(2, 20))}</p>" * (r.random() < 0.5) + f'<label>{self.words(2)}</label><input type="text"><button>{self.words(1)}</button></form>'
        if kind == "share":
            return f"<div{self.attrs('share', 1)}>" + self.links(r.randint(2, 5), r.choice(["li", "flat"])) + "</div>"
        # advertisements and notices
        body = r.choice([self.words(r.randint(2, 40)), f"<p>{self.words(r.randint(2, 40))}</p>", f'<a href="#">{self.words(r.randint(2, 12))}</a>', f"<p>{self.words(12)}</p><button>{self.words(1)}</button>"])
        tag = r.choice(["div", "div", "aside", "section", "ins"] if kind == "ad" else ["div", "div", "section"])
        return f"<{tag}{self.attrs(kind, 1)}>{body}</{tag}>"

    def page(self) -> str:
        r = self.r
        article = self.article()
        if r.random() < 0.12:
            article += self.part("comments")
        style = r.random()
        if style < 0.45:
            article = f"<article{self.attrs('main', 0.3)}>{article}</article>"
        elif style < 0.6:
            article = f"<main{self.attrs('main', 0.3)}>{article}</main>"
        elif style < 0.92:
            article = f"<{(t := r.choice(['div', 'div', 'section']))}{self.attrs('main', 1)}>{article}</{t}>"
        else:
            article = f"<div{self.attrs('plain', 0.6)}>{article}</div>"
        before = [self.part(k) for k in ("header", "nav", "notice", "ad", "form", "share") if r.random() < 0.35]
        after = [self.part(k) for k in ("aside", "ad", "comments", "share", "form", "nav", "notice") if r.random() < 0.3]
        r.shuffle(before)
        r.shuffle(after)
        middle = "".join([*before[len(before) // 2 :], article, *after])
        for _ in range(r.choice([0, 0, 1, 2])):
            middle = f"<{(t := r.choice(['div', 'div', 'main', 'section']))}{self.attrs('plain', 0.7)}>{middle}</{t}>"
        foot = self.part("footer") if r.random() < 0.9 else ""
        return "<html><body>" + "".join(before[: len(before) // 2]) + middle + foot + "</body></html>"


@dataclass
class Model:
    trees: Boosted
    vocabulary: dict[str, int]


def _marked(root: Node) -> None:
    """Labels of a generated page: a block that begins with the mark, and all that holds one."""
    stack = [root]
    while stack:
        x = stack.pop()
        stack.extend(x.children)
        if x.text is not None and Writer.MARK in (joined := "".join(x.text)):
            x.text = [joined.replace(Writer.MARK, "")]
            while x is not None and not x.truth:
                x.truth, x = True, x.parent


@lru_cache(maxsize=2)
def trained(pages: int = 500, seed: int = 9) -> Model:
    """Learned from ``pages`` generated pages; the same for the same arguments. Takes some seconds, on the driver."""
    writer = Writer(seed)
    roots = [parse(writer.page()) for _ in range(pages)]
    vocabulary: dict[str, int] = {}
    for root in roots:
        _marked(root)
        stack = [root]
        while stack:
            x = stack.pop()
            stack.extend(x.children)
            for t in x.tokens:
                vocabulary.setdefault(t, len(vocabulary))
    xs, ys = [], []
    for root in roots:
        nodes, x = features(root, vocabulary)
        xs.append(x)
        ys.append(np.array([n.truth for n in nodes], float))
    return Model(Boosted().fit(np.concatenate(xs), np.concatenate(ys)), vocabulary)


def block_text(node: Node) -> str:
    """A block's text: references decoded, white space inside it one space, none at its ends."""
    return " ".join(html.unescape("".join(node.text)).split())


def main_texts(pages: list[str], model: Model) -> list[str]:
    parsed = [features(parse(p), model.vocabulary) for p in pages]
    logits = model.trees.logits(np.concatenate([x for _, x in parsed])) if parsed else np.zeros(0)
    out, at = [], 0
    for nodes, x in parsed:
        kept = decode(nodes, logits[at : at + len(x)])
        at += len(x)
        out.append("\n".join(t for n in nodes if n.text is not None and id(n) in kept and (t := block_text(n))))
    return out


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars`` for each row: the main text of the whole page, its blocks in page order, one to
    a line. A null or empty page, or one without main text, has an empty text. Rows are independent."""
    spark = df.sparkSession
    limit_batches(spark)
    shared = spark.sparkContext.broadcast(trained())
    source = df.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("page"))
    schema = source.select(id_col, url_col).schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for batch in batches:
            pages = [p or "" for p in batch.column(2).to_pylist()]
            texts = [t for at in range(0, len(pages), 64) for t in main_texts(pages[at : at + 64], shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return source.mapInArrow(run, schema)
