"""Main text of web pages: gradient-boosted trees over DOM-node features with hierarchical decoding.

A lenient parser makes a tree of the page's elements (inline elements without attributes belong to their parent). Each node gets
features: its tag, the kinds of its class, id and role tokens and those of its ancestors, text, link and punctuation density of its
subtree, depth, sibling statistics, and its place and share in the page. Boosted trees, trained in numpy on generated pages whose labels
are known by construction, give each node the log-odds of belonging to the main text. Decoding maximises the sum over the page of
the chosen sides under one rule: below a dropped node nothing is kept. So an ancestor and its descendant never contradict each other.

Text: character references are decoded, white space in a block is one space, blocks are joined in page order by one space. Nothing is
capped. Scripts, styles, comments and the head never hold text.

Cases: null and empty pages have the text ''; broken markup, unclosed and stray tags, and pages cut anywhere are read as far as they
go; null identifiers, repeated rows and extra columns pass through; very long pages cost time in proportion to their length;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ._common import steps

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:"[^"<>]*+"|'[^'<>]*+'|"[^"]{0,4000}+"|'[^']{0,4000}+'|[^'">])*+)>|<(/?)([a-zA-Z][\w:-]*)[^<>]*>""", re.S)
OPENING = re.compile(r"<(/?)([a-zA-Z][\w:-]*)")
UNQUOTED = re.compile(r"""[^"'>]*""")
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TOKEN = re.compile(r"[a-z]+")
#: Fixed lists of HTML element names.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noframes", "xmp", "iframe"}
NO_TEXT = {"head", "noscript", "template", "svg", "object", "audio", "video", "canvas", "math"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "label", "acronym"}
#: What an open element is closed by, and where looking for it ends.
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = {"article", "aside", "blockquote", "body", "button", "dd", "div", "figure", "footer", "form", "header", "html", "li", "main", "nav", "ol", "section", "table", "td", "th", "ul"}
TAGS = [("article",), ("main",), ("section",), ("div",), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "input", "select", "button", "fieldset", "label", "option"), ("table", "tbody", "tr", "td", "th"), ("blockquote", "pre", "figure", "figcaption"), ("html", "body")]
#: Kinds of class, id and role tokens, the elements of the same kind with them.
KINDS = [
    {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs"},
    {"header", "masthead", "topbar", "banner", "logo", "site"},
    {"footer", "foot", "copyright", "legal", "colophon", "contentinfo"},
    {"sidebar", "side", "aside", "rail", "widget", "complementary", "related", "recommended", "trending", "popular", "more"},
    {"ad", "ads", "advert", "advertisement", "adsense", "promo", "promotion", "sponsor", "sponsored", "sponsors", "outbrain", "taboola", "dfp"},
    {"cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "paywall", "disclaimer"},
    {"comment", "comments", "disqus", "reply", "replies", "respond", "discussion", "reader", "responses"},
    {"form", "search", "login", "register", "share", "social", "sharing", "follow", "tags", "meta", "byline", "buttons", "toolbar"},
    {"article", "post", "entry", "story", "main", "prose", "hentry"},
    {"content", "text", "body", "page", "copy", "paragraph"},
]
OF_TAG = {"nav": 0, "menu": 0, "header": 1, "footer": 2, "aside": 3, "form": 7, "article": 8, "main": 8}
TAG_AT = {t: k for k, group in enumerate(TAGS) for t in group}
KIND_AT = {w: k for k, kind in enumerate(KINDS) for w in kind}


class TagEnds:
    """Ends of tags whose quoted values may be of any length; what led nowhere once is not read again, so the time is linear."""

    def __init__(self, html: str):
        self.html, self.hopeless, self.dead = html, set(), (0, -1)

    def after(self, at: int) -> int:
        """The place behind the tag whose name ends at ``at``; 0 if a quote or the tag is never closed."""
        if self.dead[0] <= at <= self.dead[1]:
            return 0
        start, seen = at, []
        while True:
            at = UNQUOTED.match(self.html, at).end()
            if self.html[at : at + 1] == ">":
                return at + 1
            seen.append(at)
            close = -1 if at == len(self.html) or at in self.hopeless else self.html.find(self.html[at], at + 1)
            if close < 0:
                self.hopeless.update(seen)
                self.dead = (start, seen[0])
                return 0
            at = close + 1


class Page:
    """Tree of one page. ``pieces``: (node, text, whether in a link) in page order, None between blocks."""

    def __init__(self, html: str):
        self.tag, self.parent, self.depth, self.kinds, self.barred = [""], [-1], [0], [0], [False]
        self.pieces: list[tuple[int, str, bool] | None] = []
        self.read(html)

    def read(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]
        open_at: dict[str, list[int]] = {}  # places on the stack, by name, so that no tag looks through the stack
        at, links, size = 0, 0, len(html)
        m, sought, tag_end = None, False, TagEnds(html)

        def text(part: str) -> None:
            if part:
                self.pieces.append((stack[-1][1], unescape(part) if "&" in part else part, links > 0))

        def close(k: int) -> None:
            nonlocal links
            for name, _ in stack[k:]:
                links -= name == "a"
                open_at[name].pop()
                if name not in INLINE:
                    self.pieces.append(None)
            del stack[k:]

        while at < size:
            if not sought or (m is not None and m.start() < at):
                m, sought = MARKUP.search(html, at), True
            # MARKUP gives up on very long quoted values; tags that it passed over or cut are read again.
            whole = None
            for tag in OPENING.finditer(html, at, len(html) if m is None else m.start() + 2 + len(m[5] or "")):
                if m is not None and tag.start() >= m.start() and not m[5]:
                    break
                end = tag_end.after(tag.end())
                if end:
                    whole = tag
                    break
            if whole:
                text(html[at : whole.start()])
                at, closing, name, attributes = end, whole[1], whole[2].lower(), html[whole.end() : end - 1]
            elif m is None:
                cut = html.rfind("<", at)  # a tag that the page's end cuts is no text
                rest = html[at:] if cut < 0 or not re.match(r"</?[a-zA-Z!]", html[cut:]) else html[at:cut]
                text(rest)
                break
            else:
                text(html[at : m.start()])
                at, closing, name, attributes = m.end(), m[1] or m[4], (m[2] or m[5] or "").lower(), m[3] or ""
            if not name:
                continue
            if closing:
                if open_at.get(name):
                    close(open_at[name][-1])
                continue
            if name not in INLINE:
                self.pieces.append(None)
                ends, stop = CLOSED_BY.get(name, ({"p"}, SCOPE))
                last = lambda names: max((open_at[x][-1] for x in names if open_at.get(x)), default=0)
                if (k := last(ends)) and k >= last(stop):
                    close(k)
            if name in VOID:
                continue
            kinds = 0
            if attributes:
                for value in ATTRIBUTE.finditer(attributes):
                    for token in TOKEN.findall((value[1] or value[2] or value[3] or "").lower()):
                        if token in KIND_AT:
                            kinds |= 1 << KIND_AT[token]
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else size
                continue
            node = stack[-1][1]
            if name not in INLINE or kinds:
                if name in OF_TAG:
                    kinds |= 1 << OF_TAG[name]
                self.tag.append(name)
                self.parent.append(node)
                self.depth.append(self.depth[node] + 1)
                self.kinds.append(kinds)
                self.barred.append(self.barred[node] or name in NO_TEXT)
                node = len(self.tag) - 1
            if not attributes.endswith("/") or name not in NO_TEXT:
                open_at.setdefault(name, []).append(len(stack))
                stack.append((name, node))
                links += name == "a"
        close(1)


def features(page: Page) -> np.ndarray:
    """One row a node."""
    n = len(page.tag)
    own, linked, marks, start = [0] * n, [0] * n, [0] * n, [-1] * n
    seen = 0
    for piece in page.pieces:
        if piece is not None and not page.barred[piece[0]]:
            node, text, link = piece
            size = len(text.strip())
            if size and start[node] < 0:
                start[node] = seen
            own[node] += size
            linked[node] += size * link
            marks[node] += text.count(",") + text.count(".")
            seen += size
    parent = page.parent
    total, all_linked, all_marks, below, paragraphs = own[:], linked[:], marks[:], [0] * n, [0] * n
    children: list[list[int]] = [[] for _ in range(n)]
    for k in range(n - 1, 0, -1):
        p = parent[k]
        total[p] += total[k]
        all_linked[p] += all_linked[k]
        all_marks[p] += all_marks[k]
        below[p] += below[k] + 1
        paragraphs[p] += paragraphs[k] + (page.tag[k] == "p")
        if start[k] >= 0 and (start[p] < 0 or start[k] < start[p]):
            start[p] = start[k]
        children[p].append(k)
    above = [0] * n
    for k in range(1, n):
        above[k] = above[parent[k]] | page.kinds[parent[k]]
    has = [any(t == name for t in page.tag) for name in ("article", "main")]
    place, brothers, alike = [0] * n, [1] * n, [1] * n
    for group in children:
        names: dict[str, int] = {}
        for k in group:
            names[page.tag[k]] = names.get(page.tag[k], 0) + 1
        for j, k in enumerate(reversed(group)):
            place[k], brothers[k], alike[k] = j, len(group), names[page.tag[k]]
    rows = np.zeros((n, WIDTH), dtype=np.float32)
    whole = max(1, seen)
    for k in range(n):
        row = rows[k]
        if (t := TAG_AT.get(page.tag[k])) is not None:
            row[t] = 1
        for j in range(len(KINDS)):
            row[len(TAGS) + j] = page.kinds[k] >> j & 1
            row[len(TAGS) + len(KINDS) + j] = above[k] >> j & 1
        size, up = total[k], total[parent[k]] if k else seen
        row[-18:] = (log1p(size), log1p(own[k]), all_linked[k] / max(1, size), linked[k] / max(1, own[k]), log1p(below[k]), size / (1 + below[k]), log1p(paragraphs[k]), all_marks[k] / max(1, size), page.depth[k], place[k] / brothers[k], log1p(brothers[k]), alike[k] / brothers[k], (start[k] if start[k] >= 0 else seen) / whole, size / whole, size / max(1, up), own[k] / max(1, size), has[0], has[1])
    return rows


WIDTH = len(TAGS) + 2 * len(KINDS) + 18
TREES, DEPTH, BINS, RATE, PENALTY = 60, 4, 32, 0.25, 1.0


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Boosted complete trees of DEPTH levels on logistic loss, splits at quantile bins."""
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    z, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (p - y), weight * p * (1 - p) + 1e-9
        node = np.zeros(len(y), dtype=np.int64)
        split_on, split_at = np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, np.inf)
        for level in range(DEPTH):
            first, count = 2**level - 1, 2**level
            best, on, at = np.full(count, 1e-6), np.zeros(count, dtype=np.int64), np.full(count, BINS)
            for j in range(x.shape[1]):
                if not len(cuts[j]):
                    continue
                key = (node - first) * BINS + binned[:, j]
                gs = np.bincount(key, weights=g, minlength=count * BINS).reshape(count, BINS).cumsum(axis=1)
                hs = np.bincount(key, weights=h, minlength=count * BINS).reshape(count, BINS).cumsum(axis=1)
                gain = gs**2 / (hs + PENALTY) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + PENALTY) - gs[:, -1:] ** 2 / (hs[:, -1:] + PENALTY)
                top = gain.argmax(axis=1)
                value = gain[np.arange(count), top]
                better = value > best
                best[better], on[better], at[better] = value[better], j, top[better]
            for i in range(count):
                split_on[first + i] = on[i]
                split_at[first + i] = cuts[on[i]][at[i]] if at[i] < len(cuts[on[i]]) else np.inf
            node = 2 * node + 1 + (x[np.arange(len(y)), split_on[node]] > split_at[node])
        leaf = node - (2**DEPTH - 1)
        value = -RATE * np.bincount(leaf, weights=g, minlength=2**DEPTH) / (np.bincount(leaf, weights=h, minlength=2**DEPTH) + PENALTY)
        z = z + value[leaf]
        trees.append((split_on, split_at, value))
    return {"on": np.array([t[0] for t in trees]), "at": np.array([t[1] for t in trees]), "value": np.array([t[2] for t in trees])}


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    rows, z = np.arange(len(x)), np.zeros(len(x))
    for on, at, value in zip(model["on"], model["at"], model["value"], strict=True):
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, on[node]] > at[node])
        z += value[node - (2**DEPTH - 1)]
    return z


def decode(page: Page, odds: list[float]) -> list[bool]:
    """The kept nodes: greatest sum of odds of kept ones, none kept below a dropped one."""
    n = len(odds)
    gain = [float("-inf") if page.barred[k] else odds[k] for k in range(n)]
    for k in range(n - 1, 0, -1):  # what keeping a node, and the best below it, adds
        if gain[k] > 0:
            gain[page.parent[k]] += gain[k]
    keep = [False] * n
    for k in range(n):
        keep[k] = (k == 0 or keep[page.parent[k]]) and (k == 0 or gain[k] > 0)
    return keep


def main_text(page: Page, keep: list[bool]) -> str:
    blocks, held = [], []
    for piece in [*page.pieces, None]:
        if piece is None:
            if held and (block := " ".join("".join(held).split())):
                blocks.append(block)
            held = []
        elif keep[piece[0]] and not page.barred[piece[0]]:
            held.append(piece[1])
    return " ".join(blocks)


def generated(n: int, seed: int) -> list[str]:
    """Pages with markers: each main-text run starts with U+E000, so labels come from the parsed tree itself."""
    rng = np.random.default_rng(seed)
    pick = lambda items: items[int(rng.integers(len(items)))]
    chance = lambda p: rng.random() < p
    syllables = "an er in on re th st en ed ou ti lo ma ve sa ch ei gu es que".split()
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))

    def prose(low: int, high: int) -> str:
        size = int(np.exp(rng.uniform(np.log(low), np.log(high))))
        return " ".join(word() + (pick([",", ".", ""]) if chance(0.15) else "") for _ in range(size)) + pick([".", ".", ""])

    def attribute(kind: int, p: float = 0.8) -> str:
        if not chance(p):
            return pick(["", ' class="row"', ' id="x1"'])
        token = pick(sorted(KINDS[kind]))
        return f' {pick(["class", "class", "id"])}="{pick([token, token, f"site-{token}", f"{token}-box", f"{token} wide"])}"'

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{prose(1, 4)}</a></li>' for _ in range(k)) + "</ul>"

    def box(tags: list[str], kind: int, inner: str, p: float = 0.8) -> str:
        t = pick(tags)
        return f"<{t}{attribute(kind, p if t == 'div' else 0.4)}>{inner}</{t}>"

    def clutter() -> str:
        return pick([
            lambda: box(["nav", "nav", "div"], 0, links(int(rng.integers(2, 12)))),
            lambda: box(["div", "aside", "section"], 4, pick([prose(3, 40), f"<p>{prose(3, 30)}</p>", f'<a href="/x">{prose(3, 12)}</a>']), 1.0),
            lambda: box(["div", "section"], 5, f"<p>{prose(8, 60)}</p><button>{prose(1, 2)}</button>", 1.0),
            lambda: box(["aside", "div"], 3, pick([f"<h3>{prose(1, 4)}</h3>{links(5)}", f"<p>{prose(5, 60)}</p>", f"<h4>{prose(1, 4)}</h4><p>{prose(10, 80)}</p>"]), 1.0),
            lambda: box(["form", "form", "div"], 7, f'<label>{prose(1, 3)}</label><input name="q"><p>{prose(3, 20)}</p><button>{prose(1, 2)}</button>', 1.0),
            lambda: box(["div", "ul"], 7, "".join(f'<a href="#">{prose(1, 2)}</a> ' for _ in range(4)), 1.0),
        ])()

    def comments() -> str:
        tag = pick(["div", "li", "article"])
        one = lambda: f'<{tag} class="{pick(["comment", "reply", "comment-body"])}"><b>{word()}</b><p>{prose(4, 120)}</p></{tag}>'
        return box(["section", "div", "ol"], 6, f"<h3>{prose(1, 3)}</h3>" * chance(0.6) + "".join(one() for _ in range(int(rng.integers(1, 7)))), 1.0)

    def body_text() -> str:
        mark = "\ue000"
        out = f"<h1>{mark}{prose(3, 14)}</h1>" if chance(0.85) else ""
        for _ in range(int(rng.integers(1, 14))):
            roll = rng.random()
            if roll < 0.7:
                open_ = "<b>" if chance(0.15) else ""
                out += f"<p>{open_}{mark}{prose(1, 220)}" + ("</b>" if open_ and chance(0.5) else "") + pick(["</p>", "</p>", "</p>", "<br>", ""])
            elif roll < 0.78:
                out += f"<h2>{mark}{prose(1, 8)}</h2>"
            elif roll < 0.85:
                out += "<ul>" + "".join(f"<li>{mark}{prose(2, 30)}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>"
            elif roll < 0.9:
                out += f"<blockquote>{mark}{prose(5, 60)}</blockquote>"
            elif roll < 0.93:
                out += f"<table><tr><td>{mark}{word()}</td><td>{mark}{prose(1, 5)}</td></tr></table>"
            else:
                out += clutter()
        return out

    pages = []
    for _ in range(n):
        main = body_text() + (comments() if chance(0.12) else "")
        tag = pick(["article", "article", "article", "main", "div", "section"])
        main = f"<{tag}{attribute(pick([8, 9]), 0.95 if tag in ('div', 'section') else 0.3)}>{main}</{tag}>"
        if chance(0.3):
            main = f'<div{attribute(9, 0.6)}>{main}{clutter() if chance(0.5) else ""}</div>'
        top = "".join([box(["header", "div"], 1, f"<h2>{prose(1, 3)}</h2>" + (f"<p>{prose(2, 15)}</p>" if chance(0.4) else ""), 1.0) if chance(0.4) else "", *(clutter() for _ in range(int(rng.integers(0, 4))))])
        end = "".join([*(clutter() for _ in range(int(rng.integers(0, 3)))), comments() if chance(0.35) else "", box(["footer", "footer", "div"], 2, pick([f"&copy; {prose(2, 14)}", f"<p>{prose(3, 25)}</p>", f"&copy; {word()} {links(3)}"]), 1.0) if chance(0.85) else ""])
        pages.append(f"<!DOCTYPE html><html><head><title>x</title></head><body>{top}{main}{end}" + ("</body></html>" if chance(0.9) else ""))
    return pages


@lru_cache(maxsize=2)
def train(pages: int = 700, seed: int = 17) -> dict:
    """The boosted trees, from generated pages; some seconds, once a driver process."""
    xs, ys, ws = [], [], []
    for html in generated(pages, seed):
        page = Page(html)
        label = [False] * len(page.tag)
        for piece in page.pieces:
            if piece is not None and piece[1].startswith("\ue000"):
                k = piece[0]
                while k >= 0 and not label[k]:
                    label[k] = True
                    k = page.parent[k]
        page.pieces = [p and (p[0], p[1].replace("\ue000", ""), p[2]) for p in page.pieces]
        xs.append(features(page))
        ys += label
        ws.append(np.full(len(label), 1.0))
    return boost(np.concatenate(xs), np.array(ys, dtype=np.float64), np.concatenate(ws))


def extract(htmls: list[str | None], model: dict) -> list[str]:
    pages = [Page(h or "") for h in htmls]
    rows = [features(p) for p in pages]
    odds = log_odds(model, np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for page, part in zip(pages, rows, strict=True):
        out.append(main_text(page, decode(page, odds[at : at + len(part)].tolist())))
        at += len(part)
    return out


def main_texts(pages: DataFrame, model: dict, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, text and n_chars (code points), one row per row of ``pages``."""
    held = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(*keep, F.col(html).cast("string").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "__html"):
            htmls = batch.column(len(keep)).to_pylist()
            texts = [t for k in range(0, len(htmls), 256) for t in extract(htmls[k : k + 256], held.value)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return rows.mapInArrow(run, StructType([*rows.select(*keep).schema.fields, StructField("text", StringType()), StructField("n_chars", LongType())]))
