"""Main text of HTML pages by boosted trees over DOM nodes and hierarchical decoding.

A page becomes a tree of block elements. Each has features of its subtree (text,
links, density), its tag, the tokens of its attributes, depth and siblings.
Gradient-boosted trees give the log-odds that a block belongs to the article. Decoding picks
the blocks with the greatest sum of log-odds among choices in which no block is kept
under a dropped one, so ancestors and descendants never contradict each other.

The trees are trained on at most ``TRAIN_PAGES`` pages, those with the least hash of
their id. Labels come from elements that name their role; each page is
also dressed anew in other elements and class names, with blocks of every kind around
it, so that no single template is learnt. Extraction is one pass over all pages
without a shuffle.

Null and empty pages, and pages without an article, have empty text. Repeated rows
are treated alike. Pages of any length are read whole. An empty table gives no rows.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import bounded_sample
from tessera.sources.tables import table

TRAIN_PAGES = 300
TREES, LEVELS, RATE, BINS = 100, 4, 0.3, 24

# Fixed vocabularies of HTML: elements by their role.
SKIPPED = frozenset("script style noscript template svg math title textarea iframe object select option canvas audio video head".split())
#: Skipped elements that, as in a browser, take the rest of the page when they aren't closed.
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
KINDS = {
    "article": ("article", "main"),
    "box": ("div", "section", "center", "td", "tr", "table", "tbody", "thead", "tfoot", "th", "fieldset", "details", "figure", "figcaption", "body", "html"),
    "nav": ("nav", "menu"),
    "header": ("header", "hgroup"),
    "footer": ("footer", "address"),
    "aside": ("aside", "dialog", "summary"),
    "form": ("form", "button", "legend"),
    "list": ("ul", "ol", "dl", "li", "dt", "dd"),
    "text": ("p", "pre", "blockquote"),
    "heading": ("h1", "h2", "h3", "h4", "h5", "h6"),
}
KIND_OF = {tag: k for k, tags in enumerate(KINDS.values()) for tag in tags}
#: Tokens of class, id and role attributes, by what they tell of an element.
TOKENS = {
    "content": "article articlebody body content entry main post story text".split(),
    "menu": "breadcrumb breadcrumbs links menu nav navbar navigation pager pagination tabs topnav".split(),
    "head": "banner brand header logo masthead topbar".split(),
    "foot": "bottom copyright foot footer legal".split(),
    "side": "aside more recommended related sidebar sidebox trending widget".split(),
    "notice": "alert consent cookie cookies gdpr modal notice overlay popup".split(),
    "advert": "ad ads advert advertisement adbox promo promoted sponsor sponsored".split(),
    "form": "form login newsletter register search signup subscribe".split(),
    "comment": "comment comments discussion disqus replies reply respond".split(),
}
TOKEN_OF = {w: k for k, words in enumerate(TOKENS.values()) for w in words}
CLOSES_P = frozenset(t for tags in KINDS.values() for t in tags) - {"td", "tr", "th", "tbody", "thead", "tfoot", "body", "html"}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
#: The end tag of an option may be left out: then it ends before the next tag that can't be within it.
OPTION_END = re.compile(rf"</option\b[^>]*>|(?=</?(?:option|optgroup|select|datalist|{'|'.join(KIND_OF)})[\s/>])", re.I)
FEATURES = (
    *(f"is_{k}" for k in KINDS), *(f"has_{k}" for k in TOKENS), *(f"under_{k}" for k in KINDS), *(f"under_has_{k}" for k in TOKENS),
    "within_article", "within_other", "depth", "chars", "link_share", "chars_per_tag", "texts", "share_of_parent", "place", "siblings", "text_siblings",
)


@dataclass
class Node:
    """A block element."""

    tag: str
    parent: int
    depth: int
    attributes: str
    tokens: int = 0
    own: int = 0
    chars: int = 0
    linked: int = 0
    tags: int = 1
    texts: int = 0
    children: list[int] = field(default_factory=list)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(blocks in page order, the first being the root; pieces of text with their block)."""
    nodes, pieces = [Node("html", -1, 0, "")], []
    at, open_, links, size = 0, [0], 0, len(page)

    def text(raw: str) -> None:
        value = html.unescape(raw) if "&" in raw else raw
        pieces.append((open_[-1], value))
        n = len(value) - value.count(" ") - value.count("\n")
        if n:
            node = nodes[open_[-1]]
            node.own += n
            node.linked += n * (links > 0)

    while at < size:
        m = TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closes = m[2].lower(), bool(m[1])
        if tag in SKIPPED:
            if not closes and not m[3].endswith("/"):
                end = (OPTION_END if tag == "option" else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I)).search(page, at)
                if end is None and tag not in RAW:
                    continue
                at = end.end() if end else size
            continue
        if tag == "a":
            links = 0 if closes else 1
        elif tag == "br":
            pieces.append((open_[-1], " "))
        elif tag in KIND_OF and tag != "html":
            if closes:
                found = next((k for k in range(len(open_) - 1, 0, -1) if nodes[open_[k]].tag == tag), 0)
                if found:
                    del open_[found:]
            elif not (tag == "body" and any(nodes[k].tag == "body" for k in open_)):
                if tag in CLOSES_P and nodes[open_[-1]].tag == "p":
                    open_.pop()
                if tag in ("li", "dt", "dd") and nodes[open_[-1]].tag in ("li", "dt", "dd"):
                    open_.pop()
                words = {w for x in NAMED.finditer(m[3]) for w in WORD.findall((x[1] or x[2] or x[3] or "").lower())} if m[3] else ()
                nodes.append(Node(tag, open_[-1], nodes[open_[-1]].depth + 1, m[3], sum(1 << k for k in {TOKEN_OF[w] for w in words if w in TOKEN_OF})))
                nodes[open_[-1]].children.append(len(nodes) - 1)
                if tag not in VOID:
                    open_.append(len(nodes) - 1)
            links = 0 if tag in ("p", "div", "li") else links
        else:
            nodes[open_[-1]].tags += not closes
    for k in range(len(nodes) - 1, -1, -1):
        node = nodes[k]
        node.chars += node.own
        node.texts += node.tag in ("p", "pre", "blockquote") and node.own > 0
        if k:
            up = nodes[node.parent]
            up.chars, up.linked, up.tags, up.texts = up.chars + node.chars, up.linked + node.linked, up.tags + node.tags, up.texts + node.texts
    return nodes, pieces


#: Columns of kinds and tokens that speak for the article, and of those that speak for something else.
_ROLES = (
    [k for k, name in enumerate((*KINDS, *TOKENS)) if name in ("article", "content")],
    [k for k, name in enumerate((*KINDS, *TOKENS)) if name not in ("article", "content", "box", "list", "text", "heading")],
)


def features(nodes: list[Node]) -> np.ndarray:
    """A row of ``FEATURES`` for each block."""
    kinds, tokens = len(KINDS), len(TOKENS)
    x = np.zeros((len(nodes), len(FEATURES)), np.float32)
    base = 2 * (kinds + tokens)
    of_article, of_others = _ROLES
    for k, node in enumerate(nodes):
        row = x[k]
        row[KIND_OF[node.tag]] = 1
        for t in range(tokens):
            if node.tokens >> t & 1:
                row[kinds + t] = 1
        up = nodes[node.parent] if k else node
        if k:  # what stands above
            above = x[node.parent]
            row[kinds + tokens : base] = np.maximum(above[kinds + tokens : base], above[: kinds + tokens])
        beside = up.children if k else [0]
        named = np.maximum(row[: kinds + tokens], row[kinds + tokens : base])
        row[base:] = (
            named[of_article].any(), named[of_others].any(),
            node.depth, np.log1p(node.chars), node.linked / max(1, node.chars), np.log1p(node.chars / node.tags), np.log1p(node.texts),
            node.chars / max(1, up.chars), beside.index(k) / len(beside) if len(beside) < 64 else 0.5, np.log1p(len(beside)), np.log1p(up.texts),
        )
    return x


@dataclass
class BoostedTrees:
    """Trees of fixed depth as arrays of features, cuts and leaf values."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, levels: int = LEVELS, rate: float = RATE) -> BoostedTrees:
        """Logistic boosting with second-order leaf values; cuts at quantiles."""
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        base = float(np.log(share / (1 - share)))
        inner = (1 << levels) - 1
        feature, cut, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, 1 << levels))
        if not len(y):
            return cls(base, feature, cut, value)
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
        binned = np.column_stack([np.searchsorted(e, c, "right") for e, c in zip(edges, x.T, strict=True)])
        total = np.full(len(y), base)
        for t in range(trees):
            p = 1 / (1 + np.exp(-total))
            g, h, at = y - p, p * (1 - p), np.zeros(len(y), np.int64)
            for level in range(levels):
                width, first = 1 << level, (1 << level) - 1
                best, new = np.full(width, 1e-6), np.zeros(len(y), np.int64)
                chosen = [(0, np.inf, BINS + 1)] * width
                for f in range(t % 2, len(edges), 2):  # half of the features, by turns: no kind of evidence crowds out another
                    e = edges[f]
                    if not len(e):
                        continue
                    n = len(e) + 1
                    cell = at * n + binned[:, f]
                    gs, hs = (np.bincount(cell, v, width * n).reshape(width, n).cumsum(1) for v in (g, h))
                    gain = gs[:, :-1] ** 2 / (hs[:, :-1] + 1) + (gs[:, -1:] - gs[:, :-1]) ** 2 / (hs[:, -1:] - hs[:, :-1] + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                    top = gain.argmax(1)
                    for w in np.flatnonzero(gain[np.arange(width), top] > best):
                        best[w], chosen[w] = gain[w, top[w]], (f, e[top[w]], top[w])
                for w, (f, c, b) in enumerate(chosen):
                    feature[t, first + w], cut[t, first + w] = f, c
                    own = at == w
                    new[own] = 2 * w + (binned[own, f] > b)
                at = new
            gs, hs = (np.bincount(at, v, 1 << levels) for v in (g, h))
            value[t] = rate * gs / (hs + 1)
            total += value[t][at]
        return cls(base, feature, cut, value)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total, rows, inner = np.full(len(x), self.base), np.arange(len(x)), self.feature.shape[1]
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] >= cut[at])
            total += value[at - inner]
        return total


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """Which blocks to keep: no kept block has a dropped one above it, and the weighted log-odds are greatest."""
    worth = [0.0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        node = nodes[k]
        worth[k] += float(odds[k]) * (1 + node.own + 0.2 * (node.chars - node.own))
        if k and worth[k] > 0:
            worth[node.parent] += worth[k]
    keep = [True] * len(nodes)
    for k, node in enumerate(nodes):
        keep[k] = k == 0 or keep[node.parent] and (worth[k] > 0 or node.tag == "body")
    return keep


def main_text(page: str, model: BoostedTrees) -> str:
    """Text of the kept blocks, white space within and between them made one space."""
    return _texts([page], model)[0]


def _texts(pages: list[str], model: BoostedTrees) -> list[str]:
    parsed = [parse(p) for p in pages]
    rows = [features(nodes) for nodes, _ in parsed]
    odds = model.log_odds(np.vstack(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for nodes, pieces in parsed:
        own = odds[at : at + len(nodes)]
        at += len(nodes)
        keep = decode(nodes, own)
        shown = [keep[k] and (nodes[k].tag not in ("html", "body") or own[k] > 0) for k in range(len(nodes))]
        parts, before = [], -1
        for k, text in pieces:
            if shown[k]:
                if k != before:
                    parts.append(" ")
                parts.append(text)
            before = k
        out.append(" ".join("".join(parts).split()))
    return out


_BAD_KINDS = {KIND_OF[t] for t in ("nav", "header", "footer", "aside", "form")}


def labels(nodes: list[Node], marked: bool = False) -> np.ndarray:
    """Whether each block belongs to the article, judged by elements and attributes that name their role; on a dressed page, by its mark."""
    y = np.zeros(len(nodes), bool)
    bad_tokens = sum(1 << k for k, name in enumerate(TOKENS) if name != "content")
    for k, node in enumerate(nodes):
        starts = 'data-y="1"' in node.attributes if marked else node.tag in ("article", "main")
        bad = KIND_OF[node.tag] in _BAD_KINDS or node.tokens & bad_tokens
        y[k] = not bad and (starts or (k > 0 and y[node.parent]))
    return y


def dressed(page: str, rnd: random.Random) -> str:
    """The page's texts in other elements and class names, with blocks of every other kind around the article."""
    nodes, pieces = parse(page)
    y, inside, outside = labels(nodes), [], []
    for k, text in pieces:
        if text.strip():
            (inside if y[k] else outside).append((nodes[k].tag, html.escape(text.strip())))
    words = " ".join(t for _, t in outside).split() or ["more"]
    some = lambda n: " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, n)))
    named = lambda kind: rnd.choice(TOKENS[kind])

    def box(kind: str, tag: str, body: str) -> str:
        if rnd.random() < 0.5 and tag != "div":
            return f"<{tag}>{body}</{tag}>"
        return f'<div {rnd.choice(["class", "id"])}="{named(kind)}{rnd.choice(["", "-box", " wide"])}">{body}</div>'

    links = lambda: "<ul>" + "".join(f'<li><a href="/{k}">{some(4)}</a></li>' for k in range(rnd.randrange(2, 9))) + "</ul>"
    paragraphs = lambda: "".join(f"<p>{some(40)}</p>" for _ in range(rnd.randrange(1, 4)))
    others = {
        "menu": lambda: box("menu", "nav", links()),
        "head": lambda: box("head", "header", f"<h1>{some(5)}</h1>" * (rnd.random() < 0.5) + f"<p>{some(8)}</p>"),
        "foot": lambda: box("foot", "footer", f"&copy; {some(25)}" if rnd.random() < 0.5 else paragraphs() + links()),
        "side": lambda: box("side", "aside", f"<h3>{some(4)}</h3>" + (links() if rnd.random() < 0.5 else paragraphs())),
        "notice": lambda: box("notice", "dialog", f"<p>{some(30)}</p><button>{some(3)}</button>"),
        "advert": lambda: box("advert", "div", some(30) if rnd.random() < 0.5 else paragraphs()),
        "form": lambda: box("form", "form", f"<p>{some(10)}</p><input type='text'><button>{some(3)}</button>"),
        "comment": lambda: box("comment", "div", f"<h3>{some(3)}</h3>" + "".join(f'<div class="comment"><p>{some(40)}</p></div>' for _ in range(rnd.randrange(1, 5)))),
    }
    pick = lambda kinds: "".join(others[k]() for k in kinds if rnd.random() < 0.6)
    body = "".join(f"<{tag if tag in KIND_OF and tag not in ('article', 'body', 'html', 'div') else 'p'}>{t}</{tag if tag in KIND_OF and tag not in ('article', 'body', 'html', 'div') else 'p'}>" for tag, t in inside)
    if rnd.random() < 0.4:
        cut = body.find("</p>", len(body) // 2) + 4
        body = body[:cut] + pick(("advert", "side", "form")) + body[cut:]
    if rnd.random() < 0.3:
        body += pick(("comment", "form", "side"))
    tag = rnd.choice(["article", "main", "div", "div", "section"])
    name = f' class="{named("content")}"' if tag not in ("article", "main") and rnd.random() < 0.8 else ""
    core = f'<{tag}{name} data-y="1">{body}</{tag}>' if inside else ""
    if rnd.random() < 0.4:
        core = f'<div class="{rnd.choice(["wrap", "container", "page", "row", "col"])}">{core}{pick(("side", "advert"))}</div>'
    return f"<html><body>{pick(('notice', 'head', 'menu', 'advert'))}{core}{pick(('comment', 'side', 'form', 'notice', 'foot'))}</body></html>"


def shortened(page: str, rnd: random.Random) -> str:
    """The page with one or two of its paragraphs: size alone tells nothing of a block's role."""
    starts, end = [m.start() for m in re.finditer(r"<p\b", page)], page.rfind("</p>")
    k = rnd.randrange(0, 3)
    return page[: starts[k]] + page[end + 4 :] if k < len(starts) and end > starts[k] else page


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for page_id, page in zip(batch["id"].to_pylist(), batch["html"].to_pylist(), strict=True):
            rnd = random.Random(f"{page_id}")
            short = shortened(page or "", rnd)
            own, new = (page or "", short), (*(dressed(page or "", rnd) for _ in range(3)), dressed(short, rnd))
            for one, marked in [*((x, False) for x in own), *((x, True) for x in new)]:
                nodes, _ = parse(one)
                yield pa.RecordBatch.from_arrays([pa.array(labels(nodes, marked).astype(np.int32)), pa.array(list(features(nodes)), pa.list_(pa.float32()))], names=["y", "x"])


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", train_pages: int = TRAIN_PAGES) -> BoostedTrees:
    """Trees trained on at most ``train_pages`` pages."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    sample = bounded_sample(rows.select("id").filter("id IS NOT NULL").distinct(), "id", train_pages)
    chosen = rows.join(F.broadcast(sample), "id").dropDuplicates(["id"])
    found = chosen.mapInArrow(_training_rows, "y int, x array<float>").toArrow()
    y = found["y"].to_numpy().astype(float)
    x = np.array(found["x"].combine_chunks().flatten().to_numpy()).reshape(len(y), len(FEATURES))
    order = np.lexsort([*x.T, y])  # rows arrive in any order
    return BoostedTrees.fit(x[order], y[order])


def extract(pages: DataFrame, model: BoostedTrees, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of each row."""
    sent = pages.sparkSession.sparkContext.broadcast(model)
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = _texts([x or "" for x in part["html"].to_pylist()], sent.value)
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    return own.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, folder, "pages")
    return extract(pages, fit(pages))


QUERIES = {"op3_html_extraction": op3_html_extraction}
ORACLES: dict[str, str] = {}
