"""HTML extraction: boosted trees over DOM nodes, decoded along the tree.

A page is read into a tree of its block elements; inline markup leaves only its text (and how much of it is
links). Each node gets features: its tag and those above it, tokens of its class, id and role, depth, siblings,
and the density of text, links, punctuation and lists in its subtree. Gradient-boosted oblivious trees give each
node the log-odds that it holds main text. Decoding then chooses the states of all nodes together: a node is in
or out, everything below one that is out is out, and the sum of log-odds over the nodes is the largest. The text
blocks of nodes that are in are the result.

The trees are trained when the operator is called, on pages made from a seed by a generator of layouts with known
states: `TRAINING_PAGES` of them, whatever the input. Training takes about four seconds on the driver; the model (some
tens of kB) is sent to the tasks. Pages are independent: one pass, no shuffle.

Defined cases: null or empty html gives empty text; text outside any element belongs to the page itself; unclosed
and misnested elements are closed as browsers do for the common cases; `<br>` counts as white space. An element that
closes itself (`<svg/>`) holds nothing. A muted or foreign element whose end tag never comes, or comes after the end
of the element around it, ends there: what follows is read on.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from footreach.llm.common import arrow_schema, extended, slices, with_columns

#: Elements by what they do to text. Fixed values of public HTML.
RAW = "script style textarea title".split()
#: Elements whose text isn't shown, or is that of a form. They end with their end tag, or with an element around them.
MUTED = frozenset("template select datalist iframe canvas audio video".split())
#: Elements with tags of their own, which don't cut the line they stand in.
FOREIGN = frozenset(["svg", "math"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr noscript object picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr area map base link meta param track embed".split()
)
CLOSED_BY: dict[str, frozenset[str]] = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"]), "option": frozenset(["select"])}
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<({'|'.join(RAW)})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*+)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TOKEN = re.compile(r"[a-z]+")
TAG_KINDS = "html body div p li ul ol nav footer header aside article main section form h1 h2 h3 table td blockquote pre figure button dl".split()
ENDS = {k: re.compile(f"</{k}", re.I) for k in MUTED | FOREIGN}
KINDS = frozenset(TAG_KINDS) | {"dt", "dd", "hr", "tr", "th", "h4", "h5", "h6"}
BOILER = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login share sharing social menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead topbar footer bottom copyright sidebar aside widget related recommended trending popular more comment comments disqus reply replies respond discussion form search pagination pager tags toolbar skip hidden".split()
)
#: Beginnings that also count inside longer words, such as cookiebar or siteFooter.
STEMS = re.compile("cookie|consent|advert|sponsor|promo|banner|newslet|subscri|social|sidebar|comment|footer|header|masthead|navbar|navigat|menu|breadcrumb|recommend|popup|modal|signup|copyright|paginat|disqus|widget|notice")
CONTENT = frozenset("article content post entry story body main text articlebody maincontent page blog paragraph".split())
ABOVE = ("nav", "footer", "aside", "form", "article", "main")
FEATURES = 2 * len(TAG_KINDS) + len(ABOVE) + 4 + 18


class Page:
    """The block elements of a page in page order, and its text blocks as (node, text)."""

    def __init__(self, source: str | None):
        self.tags, self.parents, self.attributes, self.depths = ["#"], [-1], [""], [0]
        self.own_text, self.own_links, self.own_stops, self.inline = [0], [0], [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self._read(source or "")

    def _read(self, source: str) -> None:
        stack, pieces, links, at, inside = [0], [], 0, 0, ""

        def flush() -> None:
            if pieces:
                text = " ".join("".join(pieces).split())
                pieces.clear()
                if text:
                    node = stack[-1]
                    self.blocks.append((node, text))
                    self.own_text[node] += len(text)
                    self.own_stops[node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")

        for m in TAG.finditer(source):
            if m.start() > at and inside not in MUTED:
                text = source[at : m.start()]
                text = html.unescape(text) if "&" in text else text
                pieces.append(text)
                if links:
                    self.own_links[stack[-1]] += len(text)
            at = m.end()
            name = m[3]
            if name is None:
                continue
            name = name.lower()
            if inside:
                if name == inside and m[2]:
                    inside = ""
                    continue
                # an end tag of an element around it, or a block that can't stand in it, ends it
                around = m[2] and name in (self.tags[k] for k in stack)
                if not around and (m[2] or name not in KINDS or inside in MUTED - {"select"}):
                    continue
                inside = ""
            if name in MUTED or name in FOREIGN:
                if not m[2] and not m[4].endswith("/") and (name == "select" or ENDS[name].search(source, at)):
                    inside = name
                self.inline[stack[-1]] += 1
                continue
            if name in INLINE:
                if name == "a":
                    links = 0 if m[2] else 1
                elif name == "br":
                    pieces.append(" ")
                self.inline[stack[-1]] += 1
                continue
            flush()
            if m[2]:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[k]] == name:
                        del stack[k:]
                        break
                continue
            if self.tags[stack[-1]] == "p":
                stack.pop()
            if name in CLOSED_BY:
                for k in range(len(stack) - 1, 0, -1):
                    own = self.tags[stack[k]]
                    if own in CLOSED_BY[name]:
                        break
                    if own == name or (name in ("dt", "dd") and own in ("dt", "dd")) or (name in ("td", "th") and own in ("td", "th")):
                        del stack[k:]
                        break
            self.tags.append(name)
            self.parents.append(stack[-1])
            self.depths.append(len(stack))
            self.attributes.append(m[4])
            for column in (self.own_text, self.own_links, self.own_stops, self.inline):
                column.append(0)
            if name not in VOID and not m[4].endswith("/"):
                stack.append(len(self.tags) - 1)
        if at < len(source) and inside not in MUTED:
            text = source[at:]
            pieces.append(html.unescape(text) if "&" in text else text)
        flush()

    def features(self) -> np.ndarray:
        n = len(self.tags)
        parents = np.array(self.parents)
        columns = np.array([self.own_text, self.own_links, self.own_stops, self.inline, [1] * n, [t == "p" for t in self.tags], [t == "li" for t in self.tags]], np.float64)
        sums = columns.copy()
        kids = np.zeros(n)
        index = np.zeros(n)
        before = np.zeros(n)  # text of the page in front of a node
        total = sums.T.tolist()
        text_before, seen = [0.0] * n, 0.0
        for i in range(n):
            text_before[i] = seen
            seen += self.own_text[i]
        for i in range(n - 1, 0, -1):
            p, own = self.parents[i], total[i]
            up = total[p]
            for k in range(7):
                up[k] += own[k]
        sums = np.array(total).T
        before[:] = text_before
        counter = [0] * n
        for i in range(1, n):
            p = self.parents[i]
            index[i] = counter[p]
            counter[p] += 1
        kids[:] = counter
        kind = {t: k for k, t in enumerate(TAG_KINDS)}
        x = np.zeros((n, FEATURES), np.float32)
        above = [0] * n
        flags = [0] * n
        t = len(TAG_KINDS)
        for i in range(n):
            tag, p = self.tags[i], self.parents[i]
            if (k := kind.get(tag)) is not None:
                x[i, k] = 1
            if p >= 0 and (k := kind.get(self.tags[p])) is not None:
                x[i, t + k] = 1
            bits = above[p] if p >= 0 else 0
            if tag in ABOVE:
                bits |= 1 << ABOVE.index(tag)
            above[i] = bits
            own = 0
            if self.attributes[i]:
                for a in ATTRIBUTE.findall(self.attributes[i]):
                    value = "".join(a).lower()
                    tokens = set(TOKEN.findall(value))
                    own |= 1 * bool(tokens & BOILER or STEMS.search(value)) | 2 * bool(tokens & CONTENT)
            inherited = flags[p] & 12 if p >= 0 else 0
            flags[i] = own | inherited | (4 if own & 1 else 0) | (8 if own & 2 else 0)
        at = 2 * t
        bits, flags_ = np.array(above), np.array(flags)
        for k in range(len(ABOVE)):
            x[:, at + k] = bits >> k & 1
        at += len(ABOVE)
        for k in range(4):
            x[:, at + k] = flags_ >> k & 1
        at += 4
        text, links, stops, inline, nodes, ps, lis = sums
        page = max(1.0, text[0])
        up = np.maximum(parents, 0)
        own_text = columns[0]
        x[:, at : at + 18] = np.stack(
            [
                np.log1p(text), np.log1p(own_text), links / np.maximum(1, text), columns[1] / np.maximum(1, own_text), stops / np.maximum(1, text) * 100, text / page,
                text / nodes, ps / nodes, lis / nodes, np.array(self.depths), kids, index, kids[up], text[up] / page, links[up] / np.maximum(1, text[up]),
                before / page, inline / nodes, np.log1p(text[up]),
            ],
            axis=1,
        )
        return x

    def text(self, log_odds: np.ndarray) -> str:
        """The blocks of the nodes that are in, when in and out are chosen for the whole tree."""
        n = len(self.tags)
        own = log_odds.tolist()
        gain = [0.0] * n  # over being out altogether, if the node is in
        for i in range(n - 1, -1, -1):
            gain[i] += own[i]
            p = self.parents[i]
            if p >= 0 and gain[i] > 0:
                gain[p] += gain[i]
        inside = [False] * n
        for i in range(n):
            inside[i] = gain[i] > 0 and (i == 0 or inside[self.parents[i]])
        return "\n".join(t for k, t in self.blocks if inside[k])


class Boosted:
    """Gradient-boosted oblivious trees for log-loss: a tree asks the same question of all nodes of a level."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 24, l2: float = 1.0):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        cuts = [np.unique(np.append(c, (np.unique(x[:, f])[:-1] + np.unique(x[:, f])[1:]) / 2)) if len(np.unique(x[:, f])) <= bins else c for f, c in enumerate(cuts)]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        width = max(len(c) for c in cuts) + 1
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        self.trees: list[tuple[list[int], list[float], np.ndarray]] = []
        score = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            leaf = np.zeros(len(y), np.int64)
            features, thresholds = [], []
            for level in range(depth):
                best = (-1.0, 0, 0)
                for f in range(x.shape[1]):
                    if not len(cuts[f]):
                        continue
                    at = leaf * width + binned[:, f]
                    size = (1 << level) * width
                    gs = np.bincount(at, weights=g, minlength=size).reshape(-1, width).cumsum(axis=1)
                    hs = np.bincount(at, weights=h, minlength=size).reshape(-1, width).cumsum(axis=1)
                    gain = (gs**2 / (hs + l2) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + l2)).sum(axis=0)[: len(cuts[f])]
                    k = int(gain.argmax())
                    if gain[k] > best[0] + 1e-9:
                        best = (float(gain[k]), f, k)
                _, f, k = best
                features.append(f)
                thresholds.append(float(cuts[f][k]))
                leaf = leaf * 2 + (binned[:, f] > k)
            size = 1 << depth
            values = rate * np.bincount(leaf, weights=g, minlength=size) / (np.bincount(leaf, weights=h, minlength=size) + l2)
            self.trees.append((features, thresholds, values))
            score += values[leaf]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        columns = np.ascontiguousarray(x.T)
        for features, thresholds, values in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for f, cut in zip(features, thresholds, strict=True):
                leaf = leaf * 2 + (columns[f] > cut)
            out += values[leaf]
        return out


TRAINING_PAGES = 500


def made_page(rng: random.Random) -> str:
    """A page of a random layout. Elements of the article carry the attribute data-in, all others do not."""

    def words(low: int, high: int) -> str:
        out = []
        for k in range(rng.randint(low, high)):
            word = "".join(rng.choice("aeioulnrstdcmpéß") for _ in range(rng.randint(1, 9)))
            out.append((word.capitalize() if k == 0 else word) + rng.choice(["", "", "", "", "", ",", ".", ". ***", "&amp;"]))
        return " ".join(out) + rng.choice([".", "", "!"])

    def attribute(names: list[str]) -> str:
        return rng.choice(["", f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"', f" class='{rng.choice(names)} {rng.choice('abcdxyz')}{rng.randint(1, 9)}'"])

    def must(names: list[str]) -> str:
        return rng.choice([f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"', f' class="x{rng.randint(1, 99)} {rng.choice(names)}"'])

    def linked(low: int, high: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{k}">{words(1, 3)}</a></{tag}>' for k in range(rng.randint(low, high)))

    def menu() -> str:
        return rng.choice([lambda: f"<nav{attribute(['menu', 'top'])}><ul>{linked(2, 9)}</ul></nav>", lambda: f"<div{must(['menu', 'navbar', 'navigation', 'breadcrumbs'])}><ul>{linked(2, 9)}</ul></div>", lambda: f"<nav>{linked(3, 8, 'div')}</nav>", lambda: f"<ul{must(['nav', 'menu'])}>{linked(3, 8)}</ul>"])()

    def header() -> str:
        return rng.choice([lambda: f"<header><div{must(['logo', 'brand'])}>{words(1, 4)}</div>{rng.choice(['', menu()])}<p>{words(2, 8)}</p></header>", lambda: f"<div{must(['header', 'masthead', 'topbar'])}><h2>{words(1, 5)}</h2><p>{words(2, 9)}</p></div>", lambda: f"<header>{words(1, 6)}</header>"])()

    def footer() -> str:
        return rng.choice([lambda: f"<footer>&copy; {words(2, 25)}</footer>", lambda: f"<footer><p>{words(2, 20)}</p><ul>{linked(1, 5)}</ul></footer>", lambda: f"<div{must(['footer', 'copyright', 'bottom'])}><p>{words(3, 25)}</p></div>"])()

    def side() -> str:
        inner = rng.choice([lambda: f"<h3>{words(1, 3)}</h3><ul>{linked(2, 6)}</ul>", lambda: f"<p>{words(4, 40)}</p>", lambda: f"<h3>{words(1, 3)}</h3><p>{words(5, 30)}</p><p>{words(3, 9)}</p>"])()
        return rng.choice([f"<aside{attribute(['sidebar', 'x'])}>{inner}</aside>", f"<div{must(['sidebar', 'widget', 'related', 'popular', 'recommended'])}>{inner}</div>", f"<section{must(['related', 'sidebar', 'trending'])}>{inner}</section>"])

    def notice() -> str:
        return f"<{(tag := rng.choice(['div', 'section', 'p']))}{must(['cookie', 'notice', 'cookie-consent', 'gdpr', 'alert', 'newsletter', 'popup', 'subscribe'])}>{words(4, 40) if tag == 'p' else rng.choice([words(4, 40), '<p>' + words(4, 40) + '</p><button>' + words(1, 2) + '</button>'])}</{tag}>"

    def advert() -> str:
        return f"<{(tag := rng.choice(['div', 'div', 'aside', 'section', 'p']))}{must(['ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner', 'ad-slot'])}>{words(2, 40) if tag == 'p' else rng.choice([words(2, 40), '<p>' + words(2, 40) + '</p>'])}</{tag}>"

    def form() -> str:
        return f"<form{attribute(['search', 'login', 'x'])}>{rng.choice(['<p>', '<div>', ''])}<label>{words(1, 6)}</label><input name='q'><button>{words(1, 2)}</button></form>"

    def comments() -> str:
        one = lambda: rng.choice([f"<div{must(['comment', 'reply', 'comment-body'])}><p>{words(3, 50)}</p></div>", f"<li{must(['comment'])}><p>{words(3, 50)}</p></li>", f"<article{must(['comment'])}><p>{words(3, 40)}</p></article>"])
        return f"<{(tag := rng.choice(['div', 'section', 'ol']))}{must(['comments', 'discussion', 'disqus', 'replies', 'respond'])}>{rng.choice(['', f'<h3>{words(1, 3)}</h3>'])}{''.join(one() for _ in range(rng.randint(1, 4)))}</{tag}>"

    def paragraph() -> str:
        kind = rng.random()
        link = rng.choice(["", "", f' <a href="/x">{words(1, 4)}</a> {words(1, 9)}'])
        if kind < 0.7:
            return rng.choice([f"<p data-in>{words(1, 3)}</p>", f"<p data-in>{words(1, 90)}{link}</p>", f"<p data-in>{words(1, 4)}", f"<p data-in><b>{words(1, 60)}<br>", f"<p data-in>{words(1, 60)}{link}", f'<p data-in class="{rng.choice(["intro", "lead", "x1", "paragraph"])}">{words(3, 70)}</p>'])
        if kind < 0.78:
            return f"<h2 data-in>{words(1, 8)}</h2>"
        if kind < 0.84:
            return f"<ul data-in>{''.join(f'<li data-in>{words(2, 25)}</li>' for _ in range(rng.randint(1, 5)))}</ul>"
        if kind < 0.88:
            return f"<blockquote data-in>{rng.choice([words(4, 40), '<p data-in>' + words(4, 40) + '</p>'])}</blockquote>"
        if kind < 0.91:
            return f"<pre data-in>{words(3, 20)}</pre>"
        if kind < 0.94:
            return f"<table data-in><tr data-in>{''.join(f'<td data-in>{words(1, 5)}</td>' for _ in range(3))}</tr></table>"
        return f"<div data-in>{words(3, 80)}</div>"

    def article() -> str:
        inner = [paragraph() for _ in range(rng.choice([1, 2, rng.randint(1, 6), rng.randint(3, 18)]))]
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            inner.insert(rng.randint(0, len(inner)), rng.choice([advert, notice, side, form])())
        if rng.random() < 0.15:
            inner.append(rng.choice([comments, lambda: f"<div{must(['share', 'social', 'tags'])}><ul>{linked(1, 5)}</ul></div>"])())
        title = rng.choice([f"<h1 data-in>{words(1, 12)}</h1>"] * 3 + [f"<h2 data-in>{words(1, 12)}</h2>", f"<header data-in><h1 data-in>{words(1, 12)}</h1></header>", f'<div data-in class="entry-header"><h1 data-in>{words(1, 12)}</h1></div>', ""])
        names = ["article", "content", "post", "entry-content", "story", "article-body", "main-content", "post-body"]
        tag = rng.choice(["article", "article", "main", "div", "div", "section"])
        outer = attribute(names) if tag in ("article", "main") else must(names)
        body = f"<{tag} data-in{outer}>{title}{''.join(inner)}</{tag}>"
        if rng.random() < 0.25:
            body = f"<{(w := rng.choice(['main', 'div', 'section']))} data-in{attribute(['content', 'main', 'wrapper', 'page'])}>{body}</{w}>"
        return body

    def some(makers: list, chance: float) -> list[str]:
        return [make() for make in makers if rng.random() < chance]

    parts = [*some([header], 0.45), *some([menu], 0.8), *some([advert, notice], 0.35), *some([side, form], 0.15), article(), *some([side], 0.4), *some([comments], 0.4), *some([advert, notice, form], 0.2), *some([footer], 0.9)]
    body = "".join(parts)
    if rng.random() < 0.3:
        body = f"<div data-in{attribute(['wrapper', 'page', 'container', 'site'])}>{body}</div>"
    return f'<!DOCTYPE html><html data-in lang="x"><head><title>{words(1, 9)}</title><style>p{{}}</style><script>a("</p>")</script></head><body data-in>{body}</body></html>'


def train(seed: int = 7) -> Boosted:
    rng = random.Random(seed)
    pages = [Page(made_page(rng)) for _ in range(TRAINING_PAGES)]
    x = np.concatenate([p.features() for p in pages])
    y = np.concatenate([[i == 0 or "data-in" in a for i, a in enumerate(p.attributes)] for p in pages]).astype(np.float64)
    return Boosted(x, y)


def extract_text(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """pages without html, with text (the main text) and n_chars."""
    sent = pages.sparkSession.sparkContext.broadcast(model or train())
    schema = extended(pages.drop("text", "n_chars"), {"text": T.StringType(), "n_chars": T.LongType()})
    schema = T.StructType([f for f in schema.fields if f.name != "html"])
    out = arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches, "html"):
            read = [Page(h) for h in batch.column(batch.schema.get_field_index("html")).to_pylist()]
            features = [p.features() for p in read]
            ends = np.cumsum([len(f) for f in features])
            odds = np.split(own.log_odds(np.concatenate(features)), ends[:-1])
            texts = [p.text(o) for p, o in zip(read, odds, strict=True)]
            yield with_columns(batch, out, {"text": texts, "n_chars": np.array([len(t) for t in texts], np.int64)})

    return pages.drop("text", "n_chars").mapInArrow(rows, schema)
