"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A page is parsed into block elements (inline elements belong to the block around them), in time linear in its length. A node's
features are its tag, the tokens of its class, id and role and those of its ancestors, its depth, the density of text, links and
punctuation in its subtree, its share of its parent and of the page, and its place among its siblings and the long texts among
them. Attribute tokens are hashed: a token counts by the character n-grams that it has in one of `BUCKETS` buckets, each with a
weight learned from the layouts, so names like those seen count as well. The trees learn from each half of the layouts with the
weights of the other, and give each node the log odds of holding main text. Decoding chooses keep or drop for all nodes at once so that
the summed log odds are greatest and nothing is kept below a dropped node.

Weights and trees are fitted to pages of known structure: a bounded sample of `FIT_PAGES` pages, chosen by a hash of url and
html, lends its paragraphs and phrases, and these are set into `TRAIN_PAGES` layouts drawn by a seeded generator
(menus, headers, notices, adverts, sidebars, forms, share bars, comments and footers, nested in many ways,
around and inside the article). Names come from `NAMES`, in several languages, or say nothing. Labels follow from the layout.

Text of kept nodes: character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined by an empty line in page order. Nothing is dropped for its length.

Edge cases: null or empty html gives the empty text, and so does a page without kept text. Html without any
element is one block of text. Unclosed and misnested elements are closed where the next block demands it;
head ends at body or the first thing that can't be in it, and a button, select, object or the like without an end tag hides
nothing. A tag without an end is markup up to the end of the page. Very long pages are parsed whole. Repeated rows get equal
results. An empty table gives an empty result. Without any page to lend text, the layouts use the words of TAG_WORDS. Columns of
the input pass through; text and n_chars replace input columns of that name.
"""

from __future__ import annotations

import html as _html
import random
import re
import zlib
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

FIT_PAGES = 300
TRAIN_PAGES = 1500
TREES, DEPTH, RATE, BINS = 80, 4, 0.2, 32
SEED = 1234

# Elements of HTML by their role in parsing.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("script style textarea title xmp iframe noembed noframes head template noscript select button svg canvas object audio video map datalist".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
IN_HEAD = frozenset("title style script noscript template noframes".split())
TAGS = ["html", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "figure", "figcaption", "pre"]
# Names that sites give to the parts of a page, for the layouts of the fit.
NAMES = {
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner adsense dfp werbung anzeige publicite pub publicidad anuncio reclame",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog privacy hinweis datenschutz avis aviso bandeau",
    "menu": "nav navigation navbar menu breadcrumb pagination pager toc links tabs menue navi hauptmenue sommaire menú navegacion",
    "header": "header masthead top topbar logo branding kopf kopfzeile entete cabecera",
    "footer": "footer foot bottom copyright legal colophon credits fuss fusszeile impressum pied mentions pie",
    "side": "sidebar side aside rail widget related recommended popular trending more teaser seitenleiste rechts aehnlich colonne lateral relacionados",
    "comment": "comment comments commentlist disqus reply replies discussion respond thread kommentar kommentare commentaires comentarios opiniones forum",
    "form": "form search newsletter subscribe signup login register contact suche anmeldung recherche buscar kontakt",
    "share": "share sharing social follow tweet facebook tools print teilen partager compartir",
    "content": "article content main post entry story body text page prose copy artikel inhalt beitrag contenu texte contenido articulo noticia",
}
TAG_WORDS = ["page", "site", "more", "news", "read", "home", "about", "contact", "today", "report", "people", "work", "year", "world", "story", "city"]

BUCKETS = 4096
LONG = 80  # characters of a long text
PART = 2000  # characters of the longest paragraph in a layout
_TAG = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_CUT = re.compile(r"[\W\d_]+|(?<=[a-z])(?=[A-Z])")
_PUNCT = re.compile(r"[.,;:!?]")


class Page:
    """The block elements of a page in order, and its runs of text: (block number, node, text, in a link)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.tokens, self.runs = ["#root"], [-1], [()], []
        self.source, self.stack, self.at_depth, self.silent = source, [0], {}, 0
        self.block, self.link = 0, None
        self._marks: dict[str, tuple[list[int], list[int]]] = {}
        at, quotes = 0, {'"', "'"}
        while at < len(source):
            start = source.find("<", at)
            if start < 0:
                break
            after = source[start + 1 : start + 2]
            if after in ("!", "?"):
                self._text(at, start)
                end = source.find("-->", start + 4) if source.startswith("<!--", start) else source.find(">", start)
                at = len(source) if end < 0 else end + (3 if source.startswith("<!--", start) else 1)
                continue
            closing = after == "/"
            name = _TAG.match(source, start + 1 + closing)
            if not name:  # a bare sign
                self._text(at, start + 1)
                at = start + 1
                continue
            self._text(at, start)
            end = self._end_of_tag(name.end(), quotes)
            attributes, at = source[name.end() : end], end + 1
            if end >= len(source):
                break
            if closing:
                self._close(name[0].lower())
            else:
                at = self._open(name[0].lower(), attributes, at)
        self._text(at, len(source))

    def _end_of_tag(self, at: int, quotes: set) -> int:
        """Where the tag's > is, outside of quoted values; the length of the page where there is none."""
        while m := _STOP.search(self.source, at):
            if m[0] == ">":
                return m.start()
            at = m.end()
            if m[0] in quotes and self.source[max(0, m.start() - 8) : m.start()].rstrip().endswith("="):
                end = self.source.find(m[0], at)
                if end < 0:
                    quotes.discard(m[0])  # none is left to close a value
                else:
                    at = end + 1
        return len(self.source)

    def _text(self, a: int, b: int) -> None:
        if a >= b:
            return
        t = self.source[a:b]
        full = bool(t.strip())
        if full and self.tag[self.stack[-1]] == "head":
            self._leave_head(False)
        if self.silent:
            return
        if full:
            self.runs.append((self.block, self.stack[-1], _html.unescape(t), self.link is not None))
        elif self.runs and self.runs[-1][0] == self.block:
            self.runs.append((self.block, self.stack[-1], " ", self.link is not None))

    def _pop(self, depth: int) -> None:
        """Close all elements from this depth of the stack on."""
        while len(self.stack) > depth:
            name = self.tag[self.stack.pop()]
            self.at_depth[name].pop()
            self.silent -= name in SILENT
        if self.link is not None and self.link > len(self.stack):
            self.link = None

    def _deepest(self, names) -> int:
        return max((self.at_depth[n][-1] for n in names if self.at_depth.get(n)), default=0)

    def _leave_head(self, all_: bool) -> None:
        """Close head where its end tag is left out; with what is open in it for `all_`."""
        if self.at_depth.get("head") and (all_ or self.at_depth["head"][-1] == len(self.stack) - 1):
            self._pop(self.at_depth["head"][0])

    def _unclosed(self, name: str, at: int) -> bool:
        """No end tag of the element that begins here follows, or not before another that can't be inside it."""
        if name not in self._marks:
            found = [(m.start(), bool(m[1])) for m in re.finditer(f"<(/?){re.escape(name)}(?=[\\s/>])", self.source, re.I)]
            self._marks[name] = [a for a, end in found if end], [a for a, end in found if not end]
        ends, starts = self._marks[name]
        k = bisect_left(ends, at)
        if k == len(ends):
            return True
        if name not in ("button", "select"):
            return False
        j = bisect_left(starts, at)
        return j < len(starts) and starts[j] < ends[k]

    def _close(self, name: str) -> None:
        if name in INLINE:
            if name == "a":
                self.link = None
            elif name == "br" and self.runs:
                self.runs.append((self.block, self.stack[-1], " ", False))
        elif self.at_depth.get(name):
            self._pop(self.at_depth[name][-1])
            self.block += 1

    def _open(self, name: str, attributes: str, at: int) -> int:
        """Begin an element; returns where the page goes on."""
        if name in INLINE:
            if name == "a":
                self.link = len(self.stack)
            elif name == "br" and self.runs:
                self.runs.append((self.block, self.stack[-1], " ", False))
            return at
        if name in VOID:
            self.block += name == "hr"
            return at
        empty = attributes.rstrip().endswith("/")
        if name == "body" or name not in IN_HEAD:
            self._leave_head(name == "body")
        if name in SILENT and name not in RAW and name != "head" and not empty and self._unclosed(name, at):
            self.block += 1
            return at
        if name in CLOSES:
            same, within = CLOSES[name]
            while (depth := self._deepest(same)) > self._deepest(within):
                self._pop(depth)
        elif self.tag[self.stack[-1]] == "p":
            self._pop(len(self.stack) - 1)
            self.link = None
        self.block += 1
        self.at_depth.setdefault(name, []).append(len(self.stack))
        self.parent.append(self.stack[-1])
        self.stack.append(len(self.tag))
        self.tag.append(name)
        self.tokens.append(tokens_of(attributes) if attributes else ())
        self.silent += name in SILENT
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}", re.I).search(self.source, at)
            return end.start() if end else len(self.source)
        if empty and name not in TAGS:
            self._pop(len(self.stack) - 1)
        return at


@lru_cache(maxsize=4096)
def tokens_of(attributes: str) -> tuple[tuple[int, ...], ...]:
    """For each token of class, id and role: the buckets of its character n-grams and of itself."""
    if len(attributes) > 10_000:
        attributes = " ".join(m[0] for m in _ATTR.finditer(attributes))
    words = {w.lower() for value in _ATTR.findall(attributes) for w in _CUT.split(value.strip("\"'")) if w}
    return tuple(tuple(sorted({zlib.crc32(g.encode("utf-8", "replace")) % BUCKETS for g in [f"={w}", *[f"<{w}>"[i : i + n] for n in (3, 4) for i in range(len(w) + 3 - n)]]})) for w in sorted(words))


@lru_cache(maxsize=4096)
def tag_bucket(tag: str) -> int:
    return zlib.crc32(f"#{tag}".encode("utf-8", "replace")) % BUCKETS


def token_weights(pages: list[tuple[Page, np.ndarray]]) -> np.ndarray:
    """The log odds of main text for each bucket of tokens and tags, against those of all; 0 for buckets never met."""
    held = np.zeros((2, BUCKETS))
    for page, main in pages:
        for tag, tokens, m in zip(page.tag, page.tokens, main, strict=True):
            held[int(m), tag_bucket(tag)] += 1
            for t in tokens:
                held[int(m), list(t)] += 1
    share = held.sum(axis=1) + 1
    odds = np.log((held[1] + 0.5) / share[1]) - np.log((held[0] + 0.5) / share[0])
    return np.where(held.sum(axis=0) > 0, odds, 0.0)


def features(page: Page, weights: np.ndarray) -> np.ndarray:
    """A row for each node."""
    n = len(page.tag)
    own = np.zeros((n, 4))  # characters, characters in links, words, punctuation marks
    start = np.full(n, np.inf)
    seen = 0
    for _, node, t, linked in page.runs:
        c = len(t)
        own[node] += (c, c * linked, t.count(" ") + 1, len(_PUNCT.findall(t)))
        start[node] = min(start[node], seen)
        seen += c
    parent = page.parent
    total, tags, kids, depth, p_below = own.copy(), np.ones(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
        tags[parent[i]] += tags[i]
        start[parent[i]] = min(start[parent[i]], start[i])
        kids[parent[i]] += 1
        p_below[parent[i]] += p_below[i] + (page.tag[i] == "p")
    place, same, order, counts = np.zeros(n), np.zeros(n), [0] * n, [{} for _ in range(n)]
    least, most, above, above_most, marks_above = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros((n, len(OUTER)))
    plain = (own[:, 0] >= LONG) & (own[:, 1] < own[:, 0] / 2)  # a block of running text
    long_in, long_before, long_chars = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        if page.tokens[i]:
            each = [weights[list(t)].mean() for t in page.tokens[i]]
            least[i], most[i] = min(each), max(each)
        above[i], above_most[i] = min(above[p], least[p]), max(above_most[p], most[p])
        marks_above[i] = marks_above[p]
        if page.tag[p] in OUTER:
            marks_above[i, OUTER[page.tag[p]]] = 1
        order[p] += 1
        place[i] = order[p]
        counts[p][page.tag[i]] = counts[p].get(page.tag[i], 0) + 1
        long_before[i] = long_in[p]
        if plain[i]:
            long_in[p] += 1
            long_chars[p] += own[i, 0]
    for i in range(1, n):
        same[i] = counts[parent[i]][page.tag[i]]
    par = np.array([0, *parent[1:]])
    chars, all_long = total[:, 0], long_chars.sum() + 1
    numeric = np.stack(
        [
            depth, np.log1p(chars), np.log1p(total[:, 2]), total[:, 1] / (chars + 1), total[:, 3] / (total[:, 2] + 1), chars / tags, np.log1p(own[:, 0]), own[:, 0] / (chars + 1),
            chars / (chars[0] + 1), chars / (chars[par] + 1), np.where(np.isinf(start), seen, start) / (seen + 1), kids[par], place / (kids[par] + 1), same, kids, p_below, total[par, 1] / (chars[par] + 1),
            long_in, long_in[par], long_before, long_chars / all_long, long_chars[par] / all_long, p_below[par], tags[par], weights[[tag_bucket(t) for t in page.tag]], least, most, above, above_most, least[par], most[par],
        ],
        axis=1,
    )
    marks = np.array([[t == x for x in TAGS] for t in page.tag], dtype=float)
    return np.concatenate([numeric, marks, marks_above], axis=1)


OUTER = {"nav": 0, "header": 1, "footer": 2, "aside": 3, "form": 4, "article": 5, "main": 6, "table": 7}


class Boosted:
    """Gradient-boosted trees for a yes or no, on features cut into bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._bins(x)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(mean / (1 - mean))), []
        f = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(b, y - p, p * (1 - p), depth, rate)
            self.trees.append(tree)
            f += self._leaf(b, tree)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1).astype(np.int16)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A complete tree: feature and cut of each inner node, value of each leaf."""
        inner = (1 << depth) - 1
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64), np.zeros(len(g), np.int64)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            best, choice = np.full(width, 1e-6), [(0, BINS)] * width
            for j in range(b.shape[1]):
                if not len(self.cuts[j]):
                    continue
                where = (at - first) * (BINS + 1) + b[:, j]
                gs, hs = (np.bincount(where, v, width * (BINS + 1)).reshape(width, -1).cumsum(1) for v in (g, h))
                gain = gs**2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                k = gain[:, :-1].argmax(1)
                for w in range(width):
                    if gain[w, k[w]] > best[w]:
                        best[w], choice[w] = gain[w, k[w]], (j, k[w])
            for w, (j, k) in enumerate(choice):
                feature[first + w], cut[first + w] = j, k
            at = 2 * at + 1 + (b[np.arange(len(at)), feature[at]] > cut[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + 1)
        return feature, cut, value

    def _leaf(self, b: np.ndarray, tree: tuple) -> np.ndarray:
        feature, cut, value = tree
        at, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(int(np.log2(len(value)))):
            at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
        return value[at - len(feature)]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self._bins(x)
        return self.base + sum(self._leaf(b, t) for t in self.trees)


def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """Keep or drop for each node: the greatest sum of log odds of kept nodes with nothing kept below a dropped one."""
    n = len(parent)
    best = odds.astype(float).copy()
    for i in range(n - 1, 0, -1):
        best[parent[i]] += max(0.0, best[i])
    keep = np.zeros(n, bool)
    keep[0] = True  # the page itself
    for i in range(1, n):
        keep[i] = keep[parent[i]] and best[i] > 0
    return keep


def blocks(page: Page, keep: np.ndarray) -> list[str]:
    out, last = [], None
    for block, node, t, _ in page.runs:
        if keep[node]:
            if block != last:
                out.append([])
                last = block
            out[-1].append(t)
    return [x for x in (" ".join("".join(parts).split()) for parts in out) if x]


# Layouts of known structure, for fitting


def layout(rng: random.Random, paragraphs: list[str], phrases: list[str]) -> str:
    """A page; a comment <!--+--> and <!----> around its main parts says what is main text."""
    e = _html.escape
    para, phrase = (lambda: e(rng.choice(paragraphs))), (lambda: e(rng.choice(phrases)))
    some = lambda lo, hi, f: "".join(f() for _ in range(rng.randint(lo, hi)))

    def name_of(kind: str) -> str:
        words = NAMES[kind].split()
        x = rng.random()
        if x < 0.6:
            return rng.choice(words)
        if x < 0.85:
            return f"{rng.choice(('site', 'page', 'block', 'box', 'c', 'x', 'js'))}-{rng.choice(words)}" if rng.random() < 0.5 else f"{rng.choice(words)}-{rng.choice(('box', 'area', 'wrap', 'inner', 'list', '1'))}"
        return f"{rng.choice('abcdxyz')}{rng.randint(1, 99)}" if rng.random() < 0.5 else "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8)))  # says nothing

    def named(kind: str, inner: str, tags: tuple = ("div",), odds: float = 0.85) -> str:
        tag = rng.choice(tags)
        attr = f' {rng.choice(("class", "class", "id"))}="{name_of(kind)}"' if tag == "div" and rng.random() < 0.97 or rng.random() < odds * 0.6 else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    links = lambda lo, hi: "<ul>" + some(lo, hi, lambda: f'<li><a href="/{phrase()}">{phrase()}</a></li>') + "</ul>"
    loose = lambda lo, hi: some(lo, hi, lambda: f'<a href="#">{phrase()}</a> ')
    menu = lambda: named("menu", links(3, 9) if rng.random() < 0.8 else loose(3, 8), ("nav", "div", "nav"))
    advert = lambda: named("advert", rng.choice((phrase(), f"<p>{para()}</p>", f'<a href="/x">{phrase()}</a>', para())), ("div", "div", "aside", "section"))
    notice = lambda: named("notice", f"<p>{rng.choice((phrase(), para()))}</p>" + rng.choice(("", "<button>OK</button>", f'<a href="#">{phrase()}</a>')), ("div", "div", "section", "aside"))
    side = lambda: named("side", rng.choice((f"<h3>{phrase()}</h3>", "")) + rng.choice((links(3, 8), f"<p>{para()}</p>", some(1, 3, lambda: f"<p>{phrase()} {phrase()}</p>"))), ("aside", "div", "aside", "section"))
    form = lambda: rng.choice((lambda x: f'<form action="/">{x}</form>', lambda x: named("form", f"<form>{x}</form>"), lambda x: named("form", x)))(f'<label>{phrase()}</label><input name="q"><p>{phrase()}</p><button>{phrase()}</button>')
    share = lambda: named("share", rng.choice((links(2, 5), loose(2, 5), phrase())), ("div", "ul", "div"))
    remark = lambda: rng.choice((f"<p>{para()}</p>", f"<div><b>{phrase()}</b> <p>{para()}</p></div>", f"<li><p>{phrase()}: {para()}</p></li>", f"<article><p>{para()}</p></article>"))
    comments = lambda: named("comment", rng.choice((f"<h2>{phrase()}</h2>", f"<h3>{phrase()}</h3>", "")) + some(1, 6, remark) + (form() if rng.random() < 0.3 else ""), ("section", "div", "div", "ol", "aside"), 1.6)
    head = lambda: named("header", rng.choice((f"<h1>{phrase()}</h1>", f"<p>{phrase()}</p>", f'<a href="/">{phrase()}</a>', phrase())) + (menu() if rng.random() < 0.5 else ""), ("header", "div", "header"))
    foot = lambda: named("footer", rng.choice((f"&copy; {phrase()} &middot; {para()}", links(2, 6) + f"<p>&copy; {phrase()}</p>", f"<p>{para()}</p>")), ("footer", "footer", "div"))

    def body_part() -> str:
        x = rng.random()
        if x < 0.66:
            return f"<p>{para() if rng.random() < 0.8 else phrase()}</p>" if rng.random() < 0.8 else f"<p><b>{phrase()}<br><p>{para()}"
        if x < 0.76:
            return f"<{(h := rng.choice(('h2', 'h3')))}>{phrase()}</{h}>"
        if x < 0.82:
            return f"<blockquote>{rng.choice((para(), f'<p>{para()}</p>'))}</blockquote>"
        if x < 0.9:
            return "<ul>" + some(2, 5, lambda: f"<li>{rng.choice((phrase(), para()))}</li>") + "</ul>"
        if x < 0.95:
            return f'<p>{para()} <a href="/y">{phrase()}</a> {para()}</p>'
        return f"<div><p>{para()}</p></div>"

    title = rng.choice((f"<h1>{phrase()}</h1>", f"<h1>{phrase()}</h1>", f"<h2>{phrase()}</h2>", f"<header><h1>{phrase()}</h1></header>", ""))
    parts = [f"<!--+-->{body_part()}<!---->" for _ in range(rng.choice((rng.randint(1, 2), rng.randint(1, 14), rng.randint(1, 14))))]
    for extra, chance in ((advert, 0.25), (share, 0.15), (side, 0.1), (notice, 0.06), (form, 0.06), (comments, 0.05)):
        if rng.random() < chance:
            parts.insert(rng.randint(0, len(parts)), extra())
    heading = f"<!--+-->{title}<!---->" if title else ""
    inner = heading + "".join(parts)
    if rng.random() < 0.2:  # the heading beside the box of the text
        inner = f"{heading}<div{rng.choice(('', f' class={chr(34)}{name_of(chr(99) + 'ontent')}{chr(34)}'))}>{''.join(parts)}</div>"
    kind = rng.random()
    if kind < 0.35:
        main = f"<article>{inner}</article>"
    elif kind < 0.45:
        main = f"<main>{inner}</main>"
    elif kind < 0.75:
        main = f'<div {rng.choice(("class", "id"))}="{name_of("content")}">{inner}</div>'
    elif kind < 0.88:
        main = f"<div>{inner}</div>"
    elif kind < 0.94:
        main = f"<table><tr>{rng.choice(('', f'<td>{menu()}</td>'))}<td>{inner}</td>{rng.choice(('', f'<td>{side()}</td>'))}</tr></table>"
    else:
        main = inner  # right in the body
    if rng.random() < 0.3:
        main = f"<main>{main}{comments() if rng.random() < 0.3 else ''}</main>"
    around = [("head", head, 0.6), ("menu", menu, 0.6), ("notice", notice, 0.3), ("advert", advert, 0.5), ("form", form, 0.2), ("side", side, 0.25)]
    rng.shuffle(around)
    before = [f() for _, f, p in around if rng.random() < p]
    after = [f() for f, p in ((share, 0.2), (comments, 0.45), (side, 0.35), (advert, 0.3), (form, 0.2), (notice, 0.15), (foot, 0.8)) if rng.random() < p]
    if rng.random() < 0.3:
        after.sort(key=lambda _: rng.random())
    page = main if rng.random() < 0.06 else "".join(before) + main + "".join(after)
    if rng.random() < 0.35:
        page = f'<div class="{rng.choice(("wrapper", "container", "page", "site", "layout"))}">{page}</div>'
    return f"<!DOCTYPE html><html><head><title>{phrase()}</title></head><body>{page}</body></html>"


#: Code points for private use, which stand for the comments around main text while labels are read.
_BEGIN, _END = "\ue000", "\ue001"


def labelled(source: str) -> tuple[Page, np.ndarray]:
    """The page of a layout, and for each node whether it holds main text."""
    marked = source.replace("<!--+-->", _BEGIN).replace("<!---->", _END)
    depth, page = 0, Page(marked)
    main = [False] * len(page.tag)
    for _, node, t, _ in page.runs:
        for c in t:
            depth += (c == _BEGIN) - (c == _END)
            if depth > 0 and c != _BEGIN and not c.isspace():
                main[node] = True
    for i in range(len(main) - 1, 0, -1):
        if main[i]:
            main[page.parent[i]] = True
    return Page(source), np.array(main)


def fit(samples: list[str], seed: int = SEED, pages: int = TRAIN_PAGES) -> tuple[np.ndarray, Boosted]:
    """Weights of attribute tokens and trees, for layouts that use the texts of the sample."""
    paragraphs, phrases = [], []
    for s in sorted(x for x in samples if x):
        for t in blocks(p := Page(s), np.ones(len(p.tag), bool)):
            for part in (t[i : i + PART] for i in range(0, len(t), PART)):  # a long paragraph is lent in parts
                (paragraphs if part.count(" ") >= 8 else phrases).append(part)
    rng = random.Random(seed)
    phrases = phrases or [" ".join(rng.choices(TAG_WORDS, k=rng.randint(1, 4))) for _ in range(50)]
    paragraphs = paragraphs or [" ".join(rng.choices(TAG_WORDS, k=rng.randint(9, 60))).capitalize() + "." for _ in range(200)]
    phrases += [" ".join(p.split()[: rng.randint(1, 6)]) for p in rng.choices(paragraphs, k=200)]
    paragraphs += [" ".join(p.split()[: rng.randint(3, 12)]) + "." for p in rng.choices(paragraphs, k=len(paragraphs) // 5 + 1)]
    drawn = [labelled(layout(rng, paragraphs, phrases)) for _ in range(pages)]
    halves = drawn[::2], drawn[1::2]  # each half's trees see weights of the other
    rows = [(features(page, w)[1:], main[1:]) for w, half in ((token_weights(halves[1]), halves[0]), (token_weights(halves[0]), halves[1])) for page, main in half]
    return token_weights(drawn), Boosted(np.concatenate([x for x, _ in rows]), np.concatenate([y for _, y in rows]).astype(float))


def main_text(sources: list[str | None], model: tuple[np.ndarray, Boosted]) -> list[str]:
    weights, trees = model
    pages = [Page(s) for s in sources if s]
    if not pages:
        return [""] * len(sources)
    rows = [features(p, weights) for p in pages]
    odds, at = trees.log_odds(np.concatenate(rows)), 0
    found = []
    for p, r in zip(pages, rows, strict=True):
        found.append("\n\n".join(blocks(p, decode(p.parent, odds[at : at + len(r)]))))
        at += len(r)
    texts = iter(found)
    return [next(texts) if s else "" for s in sources]


def extract(pages: DataFrame, html_col: str = "html", key: str = "url", sample: int = FIT_PAGES) -> DataFrame:
    """`pages` with text and n_chars."""
    some, order = pages.where(F.col(html_col).isNotNull()), F.xxhash64(F.lit(SEED), key, html_col)
    n = some.count()
    if n > 4 * sample:  # about twice the sample, so that no task sends more than its share
        some = some.where(F.pmod(order, F.lit(1 << 30)) < int((1 << 30) * 2 * sample / n))
    chosen = some.orderBy(order).limit(sample)
    sent = pages.sparkSession.sparkContext.broadcast(fit([r[0] for r in chosen.select(html_col).collect()]))

    @F.pandas_udf("string")
    def text_of(source: pd.Series) -> pd.Series:
        out: list[str] = []
        for a in range(0, len(source), 100):
            out += main_text(source.iloc[a : a + 100].tolist(), sent.value)
        return pd.Series(out, dtype=object)

    found = free_name(pages, "found")
    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars") or c == html_col]
    out = pages.withColumn(found, text_of(F.col(html_col)))
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col(found).alias("text"), F.length(found).cast("long").alias("n_chars"))


def op5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
