"""HTML extraction: the main text of pages by gradient-boosted trees over DOM-node features.

A page becomes a tree of block elements. Every block gets features of its subtree (text, links, density), its attribute
tokens and those around it, its depth and its siblings; boosted trees give the log-odds that it holds main text. Decoding is
hierarchical: the kept blocks are the connected part of the tree, from the root down, whose log-odds add up to the most, so
nothing is kept inside a dropped block. The trees are trained on pages that are made up here in many layouts.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements that make blocks, those that never hold text to read, and those without an end tag.
BLOCKS = """html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
SILENT = frozenset("script style noscript template title svg math iframe object canvas textarea select button audio video datalist".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(("br", "hr"))
#: Words in class, id and role that hint at what a block is.
HINTS = {
    "content": "article content post entry story body main text prose markdown",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip",
    "header": "header masthead topbar logo branding banner hero",
    "footer": "footer foot copyright colophon legal bottom credits imprint",
    "side": "sidebar side aside rail widget widgets related recommended recommendations trending popular tags tagcloud archive",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted affiliate dfp adsense",
    "notice": "cookie cookies notice notices consent gdpr alert popup modal overlay newsletter subscribe subscription signup paywall message warning disclaimer toast",
    "comment": "comment comments reply replies respond discussion disqus thread responses feedback reviews reader",
    "share": "share sharing social follow likes twitter facebook meta byline author toolbar tools",
    "form": "form search login signin register contact input field",
    "hidden": "hidden none invisible sr visually print",
}
_HINT = {w: 1 << i for i, words in enumerate(HINTS.values()) for w in words.split()}
_TAGS = {t: i for i, t in enumerate(BLOCKS)}
#: The tag of a run of bare text.
RUN = len(BLOCKS)
_GROUPS = [("article", "main"), ("nav", "menu"), ("header", "hgroup"), ("footer", "address"), ("aside", "dialog"), ("form", "fieldset")]
_TAG_GROUP = {t: 1 << i for i, ts in enumerate(_GROUPS) for t in ts}
#: An open p ends where one of these begins; an open item where another of its kind begins, within its list or table.
_ENDS_P = frozenset(BLOCKS) - {"html", "body"}
_SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S
)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|style|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(8192)
def hints_of(attributes: str) -> int:
    """Bits of the hints that an element's attributes give."""
    bits = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("hidden", "aria-hidden"):
            bits |= _HINT["hidden"] if value.strip("\"'").lower() != "false" else 0
        elif name.lower() == "style":
            bits |= _HINT["hidden"] if "none" in value.lower() else 0
        else:
            for part in _PART.findall(value):
                bits |= _HINT.get(part.lower(), 0)
    return bits


def unclosed(name: str, source: str) -> set[int]:
    """Where the elements of a name begin that have no end tag of their own."""
    open_: list[int] = []
    for m in re.finditer(rf"<(/?){name}(?=[\s/>])(?:[^<>]*+>)?", source, re.I):
        if m[1]:
            del open_[-1:]
        elif not m[0].endswith("/>"):
            open_.append(m.start())
    return set(open_)


def past_raw(name: str, source: str, at: int) -> int:
    """Where a raw element ends whose start tag ends at `at`."""
    stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at)
    return stop.end() if stop else len(source)


class Page:
    """Blocks of a page in the order of their start tags, and its pieces of text: (block, text, whether a break is before).

    Text that stands straight under the root, or beside blocks within another, is a block of its own from one block's edge
    or hr to the next: a run.
    """

    __slots__ = ("tag", "parent", "hint", "pieces", "links")

    def __init__(self, source: str):
        self.tag, self.parent, self.hint = [_TAGS["html"]], [-1], [0]
        self.pieces: list[tuple[int, str, bool]] = []
        self.links: list[bool] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, names = [0], ["html"]
        held = Counter()  # how many elements of each name are open, but for the outermost
        at, link, gap = 0, False, True
        n = len(source)
        silent: list[str] = []  # open silent elements, and the blocks within them
        loose, lacking = False, {}
        edge, edges = 0, []  # edges passed before each piece
        started: list[int] = []  # blocks started before each piece
        while at < n:
            m = _TOKEN.search(source, at)
            begin, end = m.span() if m else (n, n)
            if begin > at and not silent:
                self.pieces.append((stack[-1], source[at:begin], gap))
                self.links.append(link)
                edges.append(edge)
                started.append(len(self.tag))
                gap = False
            at = end
            if not m:
                break
            name = m[2] or m[5]
            if name is None:
                continue
            name, closing = name.lower(), bool(m[1] or m[4])
            attributes = m[3] if m[2] else m[6]
            if silent:
                if closing and name in silent:
                    while silent.pop() != name:
                        pass
                    continue
                # The end of a block around a silent element ends it, as does a new block if it has no end tag.
                if name == "body" or (name == "html" or held[name] if closing else loose and name in _TAGS):
                    silent.clear()
                elif not closing and not attributes.endswith("/"):
                    if name in RAW:
                        at = past_raw(name, source, at)
                    elif name in SILENT or name in _TAGS:
                        silent.append(name)
                    continue
                else:
                    continue
            if name in SILENT:
                if not closing and not attributes.endswith("/"):
                    if name in RAW:
                        at = past_raw(name, source, at)
                    else:
                        if name not in lacking:
                            lacking[name] = unclosed(name, source)
                        silent.append(name)
                        loose = begin in lacking[name]
                continue
            if name not in _TAGS:
                link = link if name != "a" else not closing
                gap = gap or name in BREAKS
                edge += name == "hr"
                continue
            gap = True
            edge += 1
            if closing:
                if held[name]:
                    while True:
                        ended = names.pop()
                        stack.pop()
                        held[ended] -= 1
                        if ended == name:
                            break
                link = False
                continue
            if name in ("html", "body"):
                self.hint[0] |= hints_of(attributes) & ~_HINT["hidden"]
                continue
            if name in _ENDS_P and names[-1] == "p":
                held[names.pop()] -= 1
                stack.pop()
            if name in _SAME:
                kinds, within = _SAME[name]
                i = len(names) - 1
                while i > 0 and names[i] not in within and names[i] not in kinds:
                    i -= 1
                if i > 0 and names[i] in kinds:
                    held.subtract(names[i:])
                    del names[i:], stack[i:]
            self.tag.append(_TAGS[name])
            self.parent.append(stack[-1])
            self.hint.append(hints_of(attributes) if attributes else 0)
            stack.append(len(self.tag) - 1)
            names.append(name)
            held[name] += 1
            link = False
        self._set_runs(edges, started)

    def _set_runs(self, edges: list[int], started: list[int]) -> None:
        mixed = {0, *self.parent}
        first: dict[int, tuple[int, int]] = {}  # by edge: blocks started before the run, and the block that it is in
        for (block, piece, _), e, s in zip(self.pieces, edges, started, strict=True):
            if e not in first and block in mixed and piece.strip():
                first[e] = (s, block)
        if not first:
            return
        before = np.bincount([s for s, _ in first.values()], minlength=len(self.tag) + 1).cumsum()
        place = np.arange(len(self.tag)) + before[: len(self.tag)]
        n = len(self.tag) + len(first)
        tag, parent, hint = np.full(n, RUN), np.zeros(n, np.int64), np.zeros(n, np.int64)
        up = np.array(self.parent)
        tag[place], hint[place], parent[place] = self.tag, self.hint, np.where(up < 0, -1, place[up])
        own = {e: s + k for k, (e, (s, _)) in enumerate(first.items())}
        for e, (_, block) in first.items():
            parent[own[e]] = place[block]
        self.tag, self.parent, self.hint = tag.tolist(), parent.tolist(), hint.tolist()
        self.pieces = [(own[e] if e in own else int(place[b]), t, g) for (b, t, g), e in zip(self.pieces, edges, strict=True)]

    def text(self, kept: np.ndarray) -> str:
        """The text of kept blocks, with white space made single."""
        out, skipped = [], False
        for block, piece, gap in self.pieces:
            if kept[block]:
                if gap or skipped:
                    out.append(" ")
                out.append(html.unescape(piece) if "&" in piece else piece)
                skipped = False
            else:
                skipped = True
        return " ".join("".join(out).split())


class Forest:
    """The blocks of many pages as arrays, and their features."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.tag) for p in pages])
        base = np.cumsum(sizes) - sizes
        self.base, self.sizes, n = base, sizes, int(sizes.sum())
        self.tag = np.concatenate([p.tag for p in pages]).astype(np.int64)
        parent = np.concatenate([np.array(p.parent) + (b if len(p.parent) else 0) for p, b in zip(pages, base, strict=True)])
        self.root = np.zeros(n, bool)
        self.root[base] = True
        self.parent = np.where(self.root, np.arange(n), parent)
        self.hint = np.concatenate([p.hint for p in pages]).astype(np.int64)
        # Parents come before children, so depths are filled in rounds, from the roots down.
        self.depth = np.full(n, -1)
        self.depth[base] = 0
        self.levels = [base]
        order = np.argsort(self.parent, kind="stable")
        order = order[~self.root[order]]
        counts = np.bincount(self.parent[order], minlength=n)
        begin = np.cumsum(counts) - counts
        while len(self.levels[-1]):
            up = self.levels[-1]
            c = counts[up]
            nth = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            down = order[np.repeat(begin[up], c) + nth]
            self.depth[down] = len(self.levels)
            self.levels.append(down)
        self.levels.pop()
        self.children = counts
        self.place = np.zeros(n)
        self.place[order] = np.arange(len(order)) - begin[self.parent[order]]
        owner = np.concatenate([np.array([b for b, *_ in p.pieces], np.int64) + at for p, at in zip(pages, base, strict=True)])
        texts = [t for p in pages for _, t, _ in p.pieces]
        links = np.array([x for p in pages for x in p.links], float)
        trimmed = [t.strip() for t in texts]
        chars = np.array([len(t) for t in trimmed], float)
        words = np.array([t.count(" ") + 1 if t else 0 for t in trimmed], float)
        stops = np.array([t.count(".") + t.count(",") + t.count("?") + t.count("!") for t in trimmed], float)
        add = lambda v: np.bincount(owner, v, n) if len(owner) else np.zeros(n)
        self.own = np.stack([add(chars), add(words), add(stops), add(chars * links), add(links)], axis=1)
        self.sub = np.column_stack([self.own, np.ones(n), (self.tag == _TAGS["p"]).astype(float)])
        for level in reversed(self.levels[1:]):
            np.add.at(self.sub, self.parent[level], self.sub[level])
        group = np.zeros(n, np.int64)
        for t, bit in _TAG_GROUP.items():
            group |= np.where(self.tag == _TAGS[t], bit, 0)
        self.group, self.above_hint, self.above_group = group, np.zeros(n, np.int64), np.zeros(n, np.int64)
        for level in self.levels[1:]:
            up = self.parent[level]
            self.above_hint[level] = self.above_hint[up] | np.where(self.root[up], 0, self.hint[up])
            self.above_group[level] = self.above_group[up] | group[up]

    def features(self) -> np.ndarray:
        bits = lambda x, k: np.stack([(x >> i) & 1 for i in range(k)], axis=1)
        chars, words, stops, linked, links, blocks, paragraphs = self.sub.T
        up = self.sub[self.parent]
        siblings = np.maximum(self.children[self.parent], 1)
        prev_text = self.own[:, 0] / np.maximum(self.own[self.parent, 0] + 1, 1)
        numbers = [
            np.log1p(chars), np.log1p(words), stops / (words + 1), linked / (chars + 1), links / (blocks + 1), chars / (blocks + 1), np.log1p(blocks), paragraphs / (blocks + 1),
            np.log1p(self.own[:, 0]), self.own[:, 3] / (self.own[:, 0] + 1), prev_text, chars / (up[:, 0] + 1), up[:, 3] / (up[:, 0] + 1),
            up[:, 6] / (up[:, 5] + 1), np.log1p(siblings), self.place / siblings, np.minimum(self.depth, 30), np.log1p(self.children), chars / (words + 1),
        ]
        kinds = [("p",), ("div", "section", "center"), ("ul", "ol", "dl", "menu"), ("li", "dd", "dt"), ("table", "tr", "td", "tbody", "th"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("blockquote", "pre", "figure", "figcaption")]
        tags = [np.isin(self.tag, [_TAGS[t] for t in k]) for k in kinds] + [self.tag == RUN]
        return np.column_stack([*numbers, *tags, bits(self.hint, len(HINTS)), bits(self.above_hint, len(HINTS)), bits(self.group, len(_GROUPS)), bits(self.above_group, len(_GROUPS))]).astype(np.float32)

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Blocks to keep: the part of each tree from the root down with the largest sum of scores. Roots are kept."""
        best = scores.astype(float).copy()
        best[self.root] = 0
        for level in reversed(self.levels[1:]):
            np.add.at(best, self.parent[level], np.maximum(best[level], 0))
        kept = self.root.copy()
        for level in self.levels[1:]:
            kept[level] = kept[self.parent[level]] & (best[level] > 0)
        # Runs straight under the root that the trees drop are main text only on pages that have no other.
        fed = np.zeros(len(self.base), bool)
        page = np.repeat(np.arange(len(self.base)), self.sizes)
        np.logical_or.at(fed, page, kept & ~self.root & (self.own[:, 0] > 0))
        kept[self.base[fed]] = False
        kept |= (self.tag == RUN) & self.root[self.parent] & ~fed[page]
        return kept


class Trees:
    """Boosted regression trees of fixed depth on the logistic loss, with splits at quantiles."""

    def __init__(self, depth: int = 4, rounds: int = 50, rate: float = 0.3, bins: int = 24, ridge: float = 2.0):
        self.depth, self.rounds, self.rate, self.bins, self.ridge = depth, rounds, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(n, self.base)
        offset = np.arange(m) * (self.bins + 1)
        flat = (code + offset).ravel()
        drawing = np.random.default_rng(1)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            drawn = weight * (drawing.random(n) < 0.7)
            g, h = (p - y) * drawn, np.maximum(p * (1 - p), 1e-6) * drawn
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for d in range(self.depth):
                first, width = 2**d - 1, m * (self.bins + 1)
                key = (np.repeat(node - first, m) * width + flat) if d else flat
                shape = (2**d, m, self.bins + 1)
                gs = np.bincount(key, np.repeat(g, m), 2**d * width).reshape(shape).cumsum(axis=2)
                hs = np.bincount(key, np.repeat(h, m), 2**d * width).reshape(shape).cumsum(axis=2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                gain[:, :, -1] = 0
                for k in range(2**d):
                    j, b = np.unravel_index(int(gain[k].argmax()), gain[k].shape)
                    if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                        feature[first + k], cut[first + k] = j, edges[j][b]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            gl, hl = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
            value = -self.rate * gl / (hl + self.ridge)
            self.trees.append((feature, cut, value))
            score += value[leaf]
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def made_up_pages(n: int, seed: int = 7) -> list[tuple[str, str]]:
    """Pages in many layouts, with their main text."""
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    chance = lambda p: rng.random() < p
    integer = rng.randrange
    words = ["".join(rng.choices("aaeeiioouubcdfghlmnprstvwéüñ", k=rng.randint(1, 10))) for _ in range(3000)]
    word = lambda: rng.choice(words)

    def sentence(low: int = 1, high: int = 22) -> str:
        w = rng.choices(words, k=rng.randrange(low, high))
        if chance(0.06):
            w = [x + pick("###", "***", "&amp;&amp;", "!!", " |") for x in w]
        if chance(0.04):
            w = [x.upper() for x in w]
        return " ".join(w).capitalize() + "."

    def prose(most: int = 6) -> str:
        return " ".join(sentence() for _ in range(int(integer(1, most + 1))))

    def named(kind: str) -> str:
        w = pick(*HINTS[kind].split())
        form = pick("{}", "{}", "site-{}", "{}-box", "page-{} wide", "main_{}" if kind != "content" else "{}", "{}-wrapper", "c12 {}")
        return f' {pick("class", "class", "id")}="{form.format(w)}"'

    def wrap(tag: str, attributes: str, inner: str) -> str:
        tag = "div" if tag == "p" and "<p" in inner else tag  # a p ends where another begins
        return f"<{tag}{attributes}>{inner}</{tag}>"

    def links(k: int, text=None) -> str:
        text = text or (lambda: " ".join(word() for _ in range(int(integer(1, 4)))))
        return wrap("ul", "", "".join(f'<li><a href="/{word()}">{text()}</a></li>' for _ in range(k)))

    def boiler(kind: str) -> str:
        few = int(integer(1, 9))
        if kind == "nav":
            body = pick(links(few), "".join(f'<a href="/{word()}">{word()}</a> ' for _ in range(few)))
            return wrap(pick("nav", "nav", "div", "menu"), pick("", "", named("nav")), body) if chance(0.7) else wrap("div", named("nav"), body)
        if kind == "header":
            body = pick("", wrap("h1", "", word()), wrap("p", "", sentence())) + pick("", links(few)) + wrap("a", "", word())
            return wrap("header", pick("", named("header")), body) if chance(0.6) else wrap("div", named("header"), body)
        if kind == "footer":
            body = pick(f"&copy; {word()}.example.com &middot; {sentence()}", wrap("p", "", prose(2)), links(few), wrap("p", "", sentence()) + links(few), wrap("div", "", sentence()))
            return wrap("footer", pick("", named("footer")), body) if chance(0.7) else wrap("div", named("footer"), body)
        if kind == "side":
            body = wrap(pick("h2", "h3", "h4"), "", word()) + pick(links(few, lambda: sentence(2, 8)), wrap("p", "", prose(2)), "".join(wrap("p", "", sentence()) for _ in range(few)))
            return wrap("aside", pick("", named("side")), body) if chance(0.6) else wrap(pick("div", "section"), named("side"), body)
        if kind == "ad":
            body = pick(sentence(), wrap("p", "", sentence()), wrap("p", "", prose(3)), f'<a href="/x">{sentence()}</a>')
            return wrap(pick("div", "div", "aside", "section", "p"), named("ad"), body)
        if kind == "notice":
            body = pick(sentence(), wrap("p", "", prose(2)), wrap("p", "", sentence()) + "<button>OK</button>")
            return wrap(pick("div", "div", "section", "aside", "p", "dialog"), pick(named("notice"), named("notice"), ' role="alert"'), body)
        if kind == "comment":
            one = lambda: wrap(pick("div", "li", "article", "p"), pick("", named("comment")), pick(wrap("b", "", word()), wrap("h4", "", word()), "") + wrap("p", "", prose(4)))
            body = pick("", wrap("h3", "", word()), wrap("h2", "", word())) + "".join(one() for _ in range(few))
            return wrap(pick("section", "div", "div", "ol", "ul"), named("comment"), body)
        if kind == "form":
            body = pick("", wrap("label", "", word())) + '<input type="text">' + pick("", wrap("p", "", sentence()), sentence()) + "<button>Go</button>"
            return wrap("form", pick("", named("form")), body) if chance(0.8) else wrap("div", named("form"), wrap("form", "", body))
        return wrap(pick("div", "ul", "p"), named("share"), pick(links(few), sentence(1, 4)))

    pages = []
    for _ in range(n):
        paragraphs, shown = [], []
        title = sentence(1, 14).rstrip(pick(".", ".", ""))
        if chance(0.8):
            paragraphs.append(wrap(pick("h1", "h1", "h2"), "", title))
            shown.append(title)
        broken, bare = chance(0.4), chance(0.2)
        for k in range(int(integer(1, 12)) if chance(0.9) else 40):
            p = prose(6) if chance(0.8) else sentence(1, 4).rstrip(pick(".", ""))
            if chance(0.08):
                p = pick(" | ", " ", ", ").join(rng.choices(words, k=integer(1, 40)))
            shown.append(p)
            if bare and chance(0.85):
                paragraphs.append(p + pick("<br>", "<br><br>", "<br><br>", "<br /><br />\n"))
            elif broken and k % 4 == 0:
                paragraphs.append(f"<p><b>{p}<br>")
            elif chance(0.06):
                paragraphs.append(wrap(pick("h2", "h3", "blockquote", "pre"), "", p))
            elif chance(0.05):
                paragraphs.append(wrap(pick("ul", "ol"), "", wrap("li", "", p)))
            elif chance(0.05):
                paragraphs.append(wrap("table", "", wrap("tr", "", wrap("td", "", p))))
            else:
                paragraphs.append(wrap(pick("p", "p", "p", "p", "div"), "", p) if chance(0.9) else wrap("p", "", wrap(pick("b", "i", "span", "a"), "", p)))
            if chance(0.06):
                paragraphs.append(boiler(pick("ad", "side", "notice", "share", "form")))
        body = "".join(paragraphs)
        if chance(0.15):
            body = boiler("header") + body
        if chance(0.2):
            body += boiler(pick("comment", "share", "footer", "form", "ad"))
        article = pick(
            lambda: wrap("article", pick("", "", named("content")), body), lambda: wrap("article", "", body), lambda: wrap("main", pick("", named("content")), body),
            lambda: wrap("div", named("content"), body), lambda: wrap("section", named("content"), body), lambda: wrap("main", "", wrap("article", "", body)),
            lambda: wrap("div", named("content"), wrap("div", pick("", named("content")), body)), lambda: body,
        )() if not bare or chance(0.4) else pick(body, body, wrap("div", "", body))
        before = [boiler(k) for k in ("nav", "header", "notice", "ad", "form", "side") if chance({"nav": 0.8, "header": 0.5, "ad": 0.5}.get(k, 0.3))]
        after = [boiler(k) for k in ("side", "ad", "comment", "notice", "form", "share", "nav", "footer") if chance({"footer": 0.8, "comment": 0.45}.get(k, 0.3))]
        if chance(0.15):
            before, after = [], []
        rng.shuffle(before)
        if chance(0.2):
            before.insert(0, pick(" | ", " ", " &middot; ").join(f'<a href="/{word()}">{word()}</a>' for _ in range(int(integer(1, 9)))) + "<hr>")
        if chance(0.2):
            after.append("<hr>" + pick(f"&copy; {word()} {word()}", sentence(1, 8), f'<a href="/{word()}">{word()}</a> | <a href="/">{word()}</a>', f"{word()} {sentence(1, 6)}<br>{word()}"))
        parts = "".join(before) + "<!-- ad -->" + article + "".join(after)
        if chance(0.3):
            parts = wrap("div", pick("", ' class="container"', ' id="wrapper"', ' class="page"', ' class="layout row"'), parts)
        pages.append((f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body><script>x('</p>')</script>{parts}</body></html>", " ".join(" ".join(map(html.unescape, shown)).split())))
    return pages


def labelled(pages: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all blocks, and whether each holds main text: a block below does whose words, in order, are in it."""
    parsed = [Page(s) for s, _ in pages]
    forest = Forest(parsed)
    main = np.zeros(len(forest.tag), bool)
    for page, (_, text), base in zip(parsed, pages, forest.base, strict=True):
        at = 0
        for block, piece, _ in page.pieces:
            t = " ".join(html.unescape(piece).split())
            found = text.find(t, at) if t else -1
            if found >= 0 and found <= at + 1:
                main[base + block] = True
                at = found + len(t)
    for level in reversed(forest.levels[1:]):
        np.logical_or.at(main, forest.parent[level], main[level])
    real = ~forest.root & (forest.sub[:, 0] > 0)
    return forest.features()[real], main[real].astype(float)


def train(pages: int = 800, seed: int = 7) -> Trees:
    x, y = labelled(made_up_pages(pages, seed))
    return Trees().fit(x, y, np.where(y > 0, 1.0, max(1.0, y.mean() / max(1e-9, 1 - y.mean()))))


def texts_of(trees: Trees, sources: list[str | None]) -> list[str]:
    """The main text of each page; empty for null and empty pages and pages without text."""
    pages = [Page(s or "") for s in sources]
    if not pages:
        return []
    forest = Forest(pages)
    kept = forest.decode(trees.scores(forest.features()))
    return [p.text(kept[b : b + n]) for p, b, n in zip(pages, forest.base, forest.sizes, strict=True)]


def extract(pages: DataFrame, trees: Trees | None = None, html_col: str = "html") -> DataFrame:
    """pages, with text and n_chars in place of the html.

    Null and empty html give an empty text. Null ids and repeated rows are kept as they are; columns named text or n_chars
    are replaced; an empty table stays empty. Whole pages are read, whatever their length.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees or train())  # a few thousand numbers
    own = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                texts = texts_of(shared.value, part.column(len(own)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(own)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*own, "text", "n_chars"])

    schema = T.StructType([*(pages.schema[c] for c in own), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*own, F.col(html_col)).mapInArrow(run, schema)
