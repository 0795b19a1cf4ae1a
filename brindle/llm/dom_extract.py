"""Main text of web pages: gradient-boosted trees over DOM nodes and a hierarchical decoding.

A tolerant parser builds the tree. Each element gets features of its tag, attribute tokens, depth, subtree (text density, links, controls), siblings and ancestors; boosted
symmetric trees, trained in numpy on generated pages of many layouts, give the log odds that its subtree holds main text. The decoding then picks the most likely consistent labelling: an element is kept
only if all its ancestors are, so no choice contradicts another. Text of kept elements is written block by block.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import small_batches

#: Fixed values of HTML: elements without content, of raw text, of blocks, and start tags that end an open element of the same group.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
FOREIGN = frozenset("svg math".split())
#: Foreign elements that hold HTML again, and HTML start tags that end foreign elements otherwise.
INTEGRATION = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
_P, _P_STOPS, _TABLE = {"p"}, {"button", "td", "th", "table"}, {"table"}
CLOSE_P = BLOCKS - frozenset("body button caption dd dt head html legend li optgroup option summary tbody td tfoot th thead tr".split())

FLOWING = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre caption figcaption summary".split())

#: Attribute tokens that speak for and against main text.
NEGATIVE = frozenset("ad ads advert adverts advertisement alert aside banner bar breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disqus dialog flyout foot footer form gdpr head header legal links login masthead menu meta modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion recommended related reply replies respond search share sharing side sidebar signup skip social sponsor sponsored subscribe tags teaser toc toolbar top tracking widget".split())
POSITIVE = frozenset("article articlebody blog body content contents copy entry hentry main news page post prose readable story text".split())
NEG_TAGS = frozenset("nav footer aside header form menu dialog button label fieldset".split())
GROUPS = {t: i for i, g in enumerate(("article main", "p blockquote pre", "h1 h2 h3 h4 h5 h6 hgroup", "ul ol dl", "li dt dd", "table tbody thead tr td th", "div section body html center", "a", "nav footer aside header menu dialog", "form button label fieldset input")) for t in g.split()}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTR = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class _Open:
    """The open elements, innermost last, and where each name is open, so that no tag needs a walk over the whole stack."""

    def __init__(self) -> None:
        self.elements, self.names, self.foreign, self.places = [0], ["#root"], [0], {}

    def push(self, element: int, name: str) -> None:
        at = len(self.names)
        inner = self.names[-1] in FOREIGN
        self.foreign.append((self.foreign[-1] if inner else at) if name in FOREIGN else 0)  # the outermost of foreign elements right above one another
        self.elements.append(element)
        self.names.append(name)
        self.places.setdefault(name, []).append(at)

    def cut(self, at: int) -> bool:
        """Ends the elements from place at on; whether a block is among them."""
        block = False
        while len(self.names) > at:
            name = self.names.pop()
            self.elements.pop()
            self.foreign.pop()
            self.places[name].pop()
            block |= name in BLOCKS
        return block

    def last(self, names) -> int:
        """The innermost place where one of names is open; 0 if none is."""
        places = self.places
        return max((p[-1] for n in names if (p := places.get(n))), default=0)

    def outermost(self, names, stops) -> int:
        """The outermost place where one of names is open with no element of stops inside it; 0 if there is none."""
        if not self.last(names):
            return 0
        stop = self.last(stops - names)
        found = [p[k] for n in names if (p := self.places.get(n)) and (k := bisect_right(p, stop)) < len(p)]
        return min(found, default=0)

    def foreign_root(self) -> int:
        """The place of the outermost open element of the foreign content that a start tag is in; 0 in HTML."""
        at = self.last(FOREIGN)
        return self.foreign[at] if at > self.last(INTEGRATION) else 0


class Page:
    """The elements of a page in document order, and its text runs as (element, text) with None where a block begins or ends."""

    def __init__(self, html: str) -> None:
        self.tags, self.parents, self.attrs, self.runs = ["#root"], [-1], [""], []
        self._parse(html)

    def _parse(self, html: str) -> None:
        tags, parents, attrs, runs = self.tags, self.parents, self.attrs, self.runs
        stack, at, end, tag_at, foreign = _Open(), 0, len(html), _TAG, False
        while at < end:
            lt = html.find("<", at)
            if lt < 0:
                lt = end
            if lt > at:
                runs.append((stack.elements[-1], unescape(html[at:lt])))
            if lt == end:
                break
            if html.startswith("<!--", lt):
                close = html.find("-->", lt + 4)
                at = end if close < 0 else close + 3
                continue
            if html[lt + 1 : lt + 2] in ("!", "?"):
                close = html.find(">", lt)
                at = end if close < 0 else close + 1
                continue
            m = tag_at.match(html, lt)
            if m is None and tag_at is _TAG and html[lt + 1 : lt + 2].replace("/", "a").isalpha():
                tag_at = _PLAIN_TAG  # an open quote: from here on quotes do not count
                m = tag_at.match(html, lt)
            if m is None:
                runs.append((stack.elements[-1], "<"))
                at = lt + 1
                continue
            at, name = m.end(), m.group(2).lower()
            if m.group(1):
                place = stack.last((name,))
                if place and stack.cut(place):
                    runs.append(None)
                continue
            inside = foreign and stack.foreign_root()
            if inside and name in BREAKOUT:
                stack.cut(inside)
                inside = 0
            foreign = foreign or name in FOREIGN
            if name in CLOSE_P:
                self._end(stack, _P, _P_STOPS)
            if name in CLOSES:
                self._end(stack, CLOSES[name], STOPS.get(name, _TABLE))
            if name in BLOCKS:
                runs.append(None)
            elif name == "br":
                runs.append((stack.elements[-1], "\n"))
            tags.append(name)
            parents.append(stack.elements[-1])
            attrs.append(m.group(3))
            if name in RAW and not (inside and m.group(3).endswith("/")):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
                if close is None:
                    break
                gt = html.find(">", close.end())
                at = end if gt < 0 else gt + 1
            elif name not in VOID and not (m.group(3).endswith("/") and name not in BLOCKS and name != "a"):
                stack.push(len(tags) - 1, name)

    def _end(self, stack: _Open, names: set, stops: set) -> None:
        place = stack.outermost(names, stops)
        if place and stack.cut(place):
            self.runs.append(None)

    def text(self, kept) -> str:
        """Blocks of the kept elements, white space inside each turned into one space, joined by line ends."""
        blocks, now = [], []
        for run in self.runs + [None]:
            if run is not None:
                if kept[run[0]]:
                    now.append(run[1])
            elif now:
                if block := " ".join("".join(now).split()):
                    blocks.append(block)
                now = []
        return "\n".join(blocks)


def _tokens(attrs: str) -> set[str]:
    if not attrs:
        return set()
    return {t.lower() for m in _ATTR.finditer(attrs) for v in m.groups()[1:] if v for t in _TOKEN.findall(v)}


def node_features(page: Page) -> np.ndarray:
    """A row of statistics for each element of the page."""
    tags, parents, n = page.tags, page.parents, len(page.tags)
    own, words, points, links, controls, paras, link_text = ([0] * n for _ in range(7))
    first = [-1] * n
    total = 0
    for run in page.runs:
        if run is None:
            continue
        i, text = run
        size = len(text.strip())
        if size:
            if first[i] < 0:
                first[i] = total
            total += size
            own[i] += size
            words[i] += text.count(" ") + 1
            points[i] += text.count(".") + text.count(",")
    subtree, nodes = list(own), [1] * n
    children, index, same, nth = [0] * n, [0] * n, [0] * n, {}
    depth, group = [0] * n, [GROUPS.get(t, 10) for t in tags]
    neg, pos, neg_above, pos_above = ([0] * n for _ in range(4))
    for i in range(1, n):
        p, t = parents[i], tags[i]
        depth[i] = depth[p] + 1
        index[i] = children[p]
        children[p] += 1
        nth[p, t] = same[i] = nth.get((p, t), 0) + 1
        found = _tokens(page.attrs[i])
        neg[i] = len(found & NEGATIVE) + 2 * (t in NEG_TAGS)
        pos[i] = len(found & POSITIVE) + 2 * (t in ("article", "main"))
        neg_above[i] = neg_above[p] + neg[p]
        pos_above[i] = pos_above[p] + pos[p]
    for i in range(n - 1, 0, -1):
        p, t = parents[i], tags[i]
        if t == "a":
            link_text[i] = subtree[i]
            links[i] += 1
        elif t in ("input", "button", "select", "textarea", "label"):
            controls[i] += 1
        elif t == "p":
            paras[i] += 1
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
        subtree[p] += subtree[i]
        words[p] += words[i]
        points[p] += points[i]
        links[p] += links[i]
        nodes[p] += nodes[i]
        controls[p] += controls[i]
        paras[p] += paras[i]
        link_text[p] += link_text[i]
    up = np.array([max(p, 0) for p in parents])
    kinds = [nth.get((parents[i], tags[i]), 1) for i in range(n)]
    (own, words, points, links, controls, paras, link_text, first, subtree, nodes, children, index, same, depth, group, neg, pos, neg_above, pos_above, kinds) = (
        np.array(x, dtype=float)
        for x in (own, words, points, links, controls, paras, link_text, first, subtree, nodes, children, index, same, depth, group, neg, pos, neg_above, pos_above, kinds)
    )
    many = np.maximum(subtree, 1)
    return np.column_stack([
        depth, group, group[up], neg, pos, np.minimum(neg_above, 6), np.minimum(pos_above, 6), neg[up], pos[up],
        np.log1p(own), np.log1p(subtree), subtree / max(total, 1), subtree / np.maximum(subtree[up], 1), link_text / many, np.log1p(links),
        np.log1p(nodes), subtree / nodes, np.log1p(children), np.log1p(paras), index, children[up] - index, same, kinds,
        points / np.maximum(words, 1), words / nodes, np.maximum(first, 0) / max(total, 1), controls, link_text[up] / many[up], np.log1p(paras[up]),
    ])


class Forest:
    """Gradient-boosted symmetric trees with logistic loss: each level of a tree asks one question of all its leaves."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 140, depth: int = 5, rate: float = 0.2, bins: int = 32, ridge: float = 2.0) -> None:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        codes = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
        n, k = x.shape
        self.start = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        self.depth, score = depth, np.full(n, self.start)
        columns, limits, leaves = [], [], []
        flat = codes + np.arange(k) * bins
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            leaf = np.zeros(n, dtype=np.int64)
            for level in range(depth):
                at = (leaf[:, None] * (k * bins) + flat).ravel()
                shape = (1 << level, k, bins)
                gs = np.bincount(at, np.repeat(g, k), minlength=np.prod(shape)).reshape(shape)
                hs = np.bincount(at, np.repeat(h, k), minlength=np.prod(shape)).reshape(shape)
                gl, hl = gs.cumsum(axis=2), hs.cumsum(axis=2)
                gr, hr = gl[:, :, -1:] - gl, hl[:, :, -1:] - hl
                gain = (gl**2 / (hl + ridge) + gr**2 / (hr + ridge)).sum(axis=0)
                for j, e in enumerate(edges):
                    gain[j, len(e) :] = -1
                j, b = divmod(int(np.argmax(gain)), bins)
                columns.append(j)
                limits.append(edges[j][b])
                leaf = leaf << 1 | (codes[:, j] > b)
            value = rate * np.bincount(leaf, g, minlength=1 << depth) / (np.bincount(leaf, h, minlength=1 << depth) + ridge)
            leaves.append(value)
            score += value[leaf]
        self.columns, self.limits, self.leaves = np.array(columns), np.array(limits), np.array(leaves)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for t, value in enumerate(self.leaves):
            s = slice(t * self.depth, (t + 1) * self.depth)
            bits = x[:, self.columns[s]] > self.limits[s]
            out += value[bits @ (1 << np.arange(self.depth)[::-1])]
        return out


def tied_elements(page: Page) -> np.ndarray:
    """Inline elements in the midst of text: they share their parent's label, so that no block loses words."""
    n = len(page.tags)
    flowing = np.array([t in FLOWING for t in page.tags])
    for run in page.runs:
        if run is not None and run[1].strip():
            flowing[run[0]] = True
    tied = np.zeros(n, dtype=bool)
    math = np.zeros(n, dtype=bool)
    for i in range(1, n):
        math[i] = page.tags[i] == "math" or math[page.parents[i]]
        flowing[i] |= math[i]
        tied[i] = page.tags[i] not in BLOCKS and page.tags[i] not in RAW and flowing[page.parents[i]]
    return tied


def decode(parents: list[int], odds: np.ndarray, tied: np.ndarray | None = None) -> np.ndarray:
    """The consistent labelling of greatest likelihood: an element may be kept only with its parent, and a tied one exactly with it. The root is kept."""
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    if tied is None:
        tied = np.zeros(len(parents), dtype=bool)
    keep[tied] = drop[tied] = 0.0
    best, dropped = keep.copy(), drop.copy()  # of whole subtrees
    for i in range(len(parents) - 1, 0, -1):
        p = parents[i]
        best[p] += best[i] if tied[i] else max(best[i], dropped[i])
        dropped[p] += dropped[i]
    kept = np.zeros(len(parents), dtype=bool)
    kept[0] = True
    for i in range(1, len(parents)):
        kept[i] = kept[parents[i]] and (tied[i] or best[i] > dropped[i])
    return kept


def decoded_text(page: Page, odds: np.ndarray) -> str:
    """The text of the best labelling; empty where no element is more likely main text than not."""
    return page.text(decode(page.parents, odds, tied_elements(page)))


# generated pages for training


class _Writer:
    """Random pages: layout, names and noise vary; data-y marks where main text begins and where it is interrupted."""

    def __init__(self, rng: random.Random) -> None:
        self.r = rng
        self.letters = "".join(rng.sample("abcdefghijklmnopqrstuvwxyzéäöüñçß", 18))
        self.vocabulary = [self.word() for _ in range(150)]
        self.informative = rng.random() < 0.75

    def word(self) -> str:
        return "".join(self.r.choices(self.letters, k=self.r.randint(2, 9)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.r.choices(self.vocabulary, k=self.r.randint(a, b)))

    def sentence(self) -> str:
        s = self.words(1, 18)
        if self.r.random() < 0.1:
            s += self.r.choice([" &amp;", " &lt;x&gt;", " ###", "%%% ***", " 12.5"])
        return s.capitalize() + self.r.choice([".", ".", ".", "!", "?", ","])

    def prose(self, a: int = 1, b: int = 9) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(a, b)))

    def name(self, pool) -> str:
        r = self.r
        token = r.choice(pool) if self.informative and r.random() < 0.85 else r.choice(["box", "wrap", "c1", "col", "x7", "block", "inner", "module", self.word()])
        return r.choice([f' class="{token}"', f' id="{token}"', f' class="{token}-{self.word()}"', f' class="{self.word()} {token}"', f" class={token}"])

    def links(self, a: int, b: int) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 4)}</a>' for _ in range(self.r.randint(a, b))]
        close = "</li>" if self.r.random() < 0.8 else ""
        return self.r.choice(["<ul>" + "".join(f"<li>{x}{close}" for x in items) + "</ul>", " | ".join(items), "".join(f"<p>{x}</p>" for x in items), "".join(f"<div>{x}</div>" for x in items)])

    def boilerplate(self) -> str:
        r, w = self.r, self
        kind = r.choice("menu header footer sidebar ad comments notice form related share crumbs".split())
        if kind == "menu":
            tag, pool, body = r.choice(["nav", "div", "ul", "header"]), ["menu", "nav", "navigation", "navbar", "top"], w.links(2, 12)
        elif kind == "header":
            tag, pool, body = r.choice(["header", "div"]), ["header", "masthead", "banner", "head"], r.choice([f"<h1>{w.words(1, 4)}</h1>", f"<div>{w.words(1, 4)}</div>", f"<p>{w.sentence()}</p>"]) + r.choice(["", w.links(2, 6)])
        elif kind == "footer":
            tag, pool, body = r.choice(["footer", "footer", "div"]), ["footer", "foot", "copyright", "legal"], r.choice([f"&copy; {w.words(1, 3)} &middot; {w.prose(1, 2)}", f"<p>&copy; 2024 {w.words(1, 5)}</p>" + w.links(1, 5), f"<p>{w.prose(1, 2)}</p>"])
        elif kind == "sidebar":
            tag, pool, body = r.choice(["aside", "div"]), ["sidebar", "side", "widget", "aside"], f"<h3>{w.words(1, 4)}</h3>" + r.choice([w.links(2, 8), f"<p>{w.prose(1, 3)}</p>"])
        elif kind == "ad":
            tag = r.choice(["div", "div", "aside", "section", "p"])
            pool, body = ["ad", "ads", "advert", "sponsored", "promo", "banner"], r.choice([w.prose(1, 2), f'<a href="/{w.word()}">{w.words(2, 10)}</a>', f"<b>{w.words(1, 4)}</b> {w.prose(1, 2)}" if tag == "p" else f"<p>{w.prose(1, 3)}</p>"])
        elif kind == "comments":
            tag, pool = r.choice(["section", "div", "ol"]), ["comments", "comment", "replies", "disqus", "respond"]
            body = (f"<h3>{w.words(1, 3)}</h3>" if r.random() < 0.6 else "") + "".join(f"<{(t := r.choice(['div', 'li', 'article']))}{w.name(['comment', 'reply'])}><b>{w.words(1, 2)}</b><p>{w.prose(1, 5)}</p></{t}>" for _ in range(r.randint(1, 6)))
        elif kind == "notice":
            tag, pool, body = r.choice(["div", "dialog", "section"]), ["cookie", "consent", "notice", "alert", "gdpr", "popup", "newsletter", "subscribe"], f"<p>{w.prose(1, 3)}</p>" + r.choice(["", f"<button>{w.words(1, 2)}</button>"])
        elif kind == "form":
            tag, pool, body = r.choice(["form", "form", "div"]), ["form", "search", "login", "signup", "newsletter"], f"<label>{w.words(1, 4)}</label><input name=q>" + r.choice(["", f"<p>{w.sentence()}</p>"]) + f"<button>{w.words(1, 2)}</button>"
            if tag == "div":
                body = f"<form>{body}</form>"
        elif kind == "related":
            tag, pool, body = r.choice(["section", "div", "aside"]), ["related", "recommended", "teaser"], f"<h2>{w.words(1, 4)}</h2>" + w.links(2, 8)
        elif kind == "share":
            tag, pool, body = r.choice(["div", "ul"]), ["share", "social", "tags", "toolbar", "sharing"], w.links(2, 5)
        else:
            tag, pool, body = r.choice(["div", "nav", "p"]), ["breadcrumb", "breadcrumbs"], " &gt; ".join(f'<a href="/">{w.words(1, 2)}</a>' for _ in range(r.randint(2, 4)))
        return f'<{tag}{w.name(pool) if r.random() < 0.8 or tag in ("div", "section", "p", "ul", "ol") else ""} data-y="0">{body}</{tag}>'

    def parts(self) -> str:
        """The blocks of an article."""
        r, w = self.r, self
        parts = [f"<{(h := r.choice(['h1', 'h1', 'h2']))}>{w.words(2, 12)}</{h}>"] if r.random() < 0.85 else []
        if parts and r.random() < 0.2:
            parts = [f"<header>{parts[0]}</header>"]
        size = r.choice([1, 2, 4, 8, 14])
        for _ in range(r.randint(1, size)):
            kind = r.random()
            text = w.prose(1, r.choice([1, 3, 9]))
            if kind < 0.7:
                if r.random() < 0.25:
                    text = text.replace(" ", f" <a href='/{w.word()}'>{w.words(1, 2)}</a> ", 1)
                if r.random() < 0.2:
                    text = f"<b>{text}</b>" if r.random() < 0.5 else f"<b>{text}<br>"
                parts.append(f"<p>{text}" + ("</p>" if r.random() < 0.85 else ""))
            elif kind < 0.78:
                parts.append(f"<ul>{''.join(f'<li>{w.sentence()}</li>' for _ in range(r.randint(1, 5)))}</ul>")
            elif kind < 0.84:
                parts.append(f"<h2>{w.words(1, 6)}</h2>")
            elif kind < 0.88:
                parts.append(f"<blockquote>{r.choice([text, f'<p>{text}</p>'])}</blockquote>")
            elif kind < 0.92:
                parts.append(f"<table><tr><td>{w.words(1, 3)}</td><td>{w.sentence()}</td></tr></table>")
            elif kind < 0.94:
                parts.append(f"<div>{text}</div>")
            elif kind < 0.96:
                parts.append(f'<figure><img src="/{w.word()}.png"><figcaption>{w.sentence()}</figcaption></figure>')
            else:
                parts.append(f"<pre>{text}</pre>")
            if r.random() < 0.06:
                parts.append(w.boilerplate())
        return "".join(parts)

    def article(self) -> str:
        r, w = self.r, self
        tag = r.choice(["article", "article", "article", "main", "div", "section"])
        name = w.name(["article", "content", "main", "post", "entry", "story", "body", "text"]) if tag in ("div", "section") or r.random() < 0.3 else ""
        return f'<{tag}{name} data-y="1">{w.parts()}</{tag}>'

    def page(self) -> str:
        """A page; some have no main text, and in some it stands in the body with no element around it."""
        r, w = self.r, self
        before, after = ([w.boilerplate() for _ in range(r.randint(0, 4))] for _ in range(2))
        kind = r.random()
        bare = ' data-y="1"' if kind < 0.1 else ""
        body = w.parts() if bare else "" if kind < 0.22 else w.article()
        inside = [w.boilerplate() for _ in range(r.choice([0, 0, 1, 2]))]
        both = [body, *inside]
        r.shuffle(both)
        middle = "".join(both)
        for _ in range(0 if bare else r.choice([0, 0, 1, 2])):
            middle = f"<div{w.name(['content', 'main', 'page', 'container', 'wrapper'])}>{middle}</div>"
        script = '<script>var t="</p>";</script>' * r.randint(0, 2)
        end = "</body></html>" if r.random() < 0.85 else ""
        if not bare and r.random() < 0.15:  # a fragment, often of one part alone
            return "".join([*before[: r.randint(0, 2)], middle, *after[: r.randint(0, 2)]])
        return f"<!DOCTYPE html><html><head><title>{w.words(1, 8)}</title><style>p{{}}</style>{script}</head><body{bare}>{''.join(before)}{middle}{''.join(after)}{script}{end}"


def _labels(page: Page) -> np.ndarray:
    """Of each element, whether its subtree holds marked main text."""
    inside, label = np.zeros(len(page.tags), dtype=bool), np.zeros(len(page.tags), dtype=bool)
    for i in range(1, len(page.tags)):
        inside[i] = 'data-y="1"' in page.attrs[i] or (inside[page.parents[i]] and 'data-y="0"' not in page.attrs[i])
    for run in page.runs:
        if run is not None and run[1].strip():
            label[run[0]] |= inside[run[0]]
    for i in range(len(page.tags) - 1, 0, -1):
        label[page.parents[i]] |= label[i]
    return label


@lru_cache(maxsize=2)
def trained_forest(pages: int = 2400, seed: int = 7) -> Forest:
    """The forest for generated pages; the same on every run."""
    rng = random.Random(seed)
    made = [Page(_Writer(rng).page()) for _ in range(pages)]
    return Forest(np.concatenate([node_features(p) for p in made]), np.concatenate([_labels(p) for p in made]).astype(float))


def main_texts(htmls: list[str], forest: Forest) -> list[str]:
    pages = [Page(h) for h in htmls]
    rows = [node_features(p) for p in pages]
    odds = np.split(forest.log_odds(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1]) if rows else []
    return [decoded_text(p, o) for p, o in zip(pages, odds)]


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (main text, blocks joined by line ends; empty if none), n_chars (its code points).

    Null html counts as empty. Pages are read whole; malformed markup is repaired as browsers do in the common cases. Repeated rows each give a row.
    """
    small_batches(pages.sparkSession)
    forest = trained_forest()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 32):
                texts = main_texts([h or "" for h in b.column(2).slice(at, 32).to_pylist()], forest)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, 32) for c in b.columns[:2]), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
