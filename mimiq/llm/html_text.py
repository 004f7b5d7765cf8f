"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Pages are parsed into block elements. Trees score each by its subtree's density
of text and links, tokens of its attributes, its depth and its siblings. A
pass over the tree then gives each element one of three states: its whole
subtree is main text, none of it is, or it is mixed and its children choose.
So no element is kept within one that is rejected, or the reverse.

The trees are trained here, on pages made by rule with known main text.
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

from .common import read_table

#: Element names of the HTML standard, by what a parser does with them.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SILENT = RAW | frozenset("head template select button option datalist".split())
#: An opening of the first closes an open one of the second, unless one of the third lies between.
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dd": (frozenset({"dd", "dt"}), frozenset({"dl"})),
    "dt": (frozenset({"dd", "dt"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "body": (frozenset({"head"}), frozenset()),
}
_P_STAYS_IN = frozenset({"td", "th", "table", "button", "caption", "html"})
#: Words in class, id and role attributes that speak for main text, and against.
GOOD = ("article", "content", "main", "post", "entry", "story", "body", "text", "prose")
BAD = (
    "nav", "menu", "header", "footer", "side", "aside", "ad", "ads", "advert", "sponsor", "promo", "banner", "cookie", "notice", "consent", "popup", "modal", "comment", "comments",
    "reply", "form", "subscribe", "newsletter", "login", "search", "share", "social", "related", "breadcrumb", "widget", "toolbar", "copyright", "legal", "alert",
)
#: Comments and the like, or a tag. As the standard has it, a quote opens a value only right after the equals sign; one that nothing closes runs to the end.
_VALUE = r"(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)"
_ATTRIBUTES = rf"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE}?+)?+)*+"
_TAG = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*+(?:>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_TOKEN = re.compile(r"[a-z]+")
TAG_GROUPS = ("p", "h", "li", "list", "article", "section", "div", "nav", "aside", "header", "footer", "form", "table", "quote", "body")
_GROUP = {"p": 0, "li": 2, "dd": 2, "dt": 2, "ul": 3, "ol": 3, "dl": 3, "menu": 3, "article": 4, "main": 4, "section": 5, "div": 6, "nav": 7, "aside": 8, "header": 9, "footer": 10, "form": 11, "fieldset": 11, "table": 12, "tbody": 12, "tr": 12, "td": 12, "th": 12, "blockquote": 13, "pre": 13, "figure": 13, "body": 14, "html": 14} | {f"h{k}": 1 for k in range(1, 7)}


@dataclass(slots=True)
class Node:
    """A block element; ``blocks`` are the indices of text blocks directly in it."""

    tag: str
    parent: int
    depth: int
    good: int = 0
    bad: int = 0
    children: list[int] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    link_chars: int = 0


def parse(page: str) -> tuple[list[Node], list[str]]:
    """Block elements in page order, and text blocks in page order with white space settled."""
    nodes = [Node("html", -1, 0)]
    blocks: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements, with the block element they are in or are
    buffer: list[str] = []
    at, links, silent = 0, 0, 0

    def here() -> int:
        return stack[-1][1] if stack else 0

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                nodes[here()].blocks.append(len(blocks))
                blocks.append(text)

    def text(raw: str) -> None:
        if raw and not silent:
            raw = html.unescape(raw)
            buffer.append(raw)
            if links:
                nodes[here()].link_chars += len(raw)

    def pop_to(k: int) -> None:
        nonlocal links, silent
        if any(t in BLOCK for t, _ in stack[k:]):
            flush()
        for t, _ in stack[k:]:
            links -= t == "a"
            silent -= t in SILENT
        del stack[k:]

    while True:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name or not m[4]:
            continue  # a tag that the page's end cuts off is none
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop_to(k)
                    break
            else:
                if name == "p":
                    flush()
                elif name == "br":
                    text(" ")
            continue
        if name == "br":
            text(" ")
            continue
        if name in BLOCK:
            flush()
            if name != "html":
                for k in range(len(stack) - 1, -1, -1):  # an open paragraph ends at a block
                    if stack[k][0] == "p":
                        pop_to(k)
                        break
                    if stack[k][0] in _P_STAYS_IN or stack[k][0] in BLOCK and stack[k][0] not in ("p",):
                        break
        if name in CLOSES:
            ends, stops = CLOSES[name]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    pop_to(k)
                    break
                if stack[k][0] in stops:
                    break
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            if end is None:
                at = len(page)
            else:
                close = page.find(">", end.start())
                at = len(page) if close < 0 else close + 1
            continue
        owner = here()
        if name in BLOCK:
            node = Node(name, owner, nodes[owner].depth + 1)
            for a in _ATTR.finditer(m[3]):
                for w in _TOKEN.findall(a[2].lower()):
                    node.good += w in GOOD
                    node.bad += w in BAD
            nodes[owner].children.append(len(nodes))
            owner = len(nodes)
            nodes.append(node)
        elif name == "a":
            links += 1
        silent += name in SILENT
        stack.append((name, owner))
    flush()
    return nodes, blocks


def node_features(nodes: list[Node], blocks: list[str]) -> np.ndarray:
    """A row of features for each element."""
    n = len(nodes)
    own = np.array([sum(len(blocks[b]) for b in x.blocks) for x in nodes], float)
    link = np.array([x.link_chars for x in nodes], float)
    stops = np.array([sum(blocks[b].count(".") + blocks[b].count(",") for b in x.blocks) for x in nodes], float)
    parent = [x.parent for x in nodes]
    chars, links, points, size = own.copy(), link.copy(), stops.copy(), np.ones(n)
    paragraphs = np.array([float(x.tag == "p") for x in nodes])
    good, bad = np.array([float(x.good) for x in nodes]), np.array([float(x.bad + 2 * (x.tag in ("nav", "aside", "footer", "form"))) for x in nodes])
    for i in range(n - 1, 0, -1):
        for total in (chars, links, points, size, paragraphs):
            total[parent[i]] += total[i]
    above_good, above_bad = good.copy(), bad.copy()
    place, among = np.zeros(n), np.ones(n)
    for i in range(1, n):
        above_good[i] += above_good[parent[i]] + 2 * (nodes[parent[i]].tag in ("article", "main"))
        above_bad[i] += above_bad[parent[i]]
    for x in nodes:
        for k, c in enumerate(x.children):
            place[c], among[c] = k / max(1, len(x.children) - 1), len(x.children)
    whole = max(chars[0], 1.0)
    up = np.array([max(p, 0) for p in parent])
    groups = np.zeros((n, len(TAG_GROUPS)))
    for i, x in enumerate(nodes):
        if x.tag in _GROUP:
            groups[i, _GROUP[x.tag]] = 1
    columns = [
        np.log1p(chars), np.log1p(own), links / np.maximum(chars, 1), chars / size, np.log1p(size), points / np.maximum(chars, 1), paragraphs / size, np.log1p(paragraphs),
        np.array([float(x.depth) for x in nodes]), np.minimum(good, 3), np.minimum(bad, 3), np.minimum(above_good, 4), np.minimum(above_bad, 4),
        place, np.log1p(among), chars / whole, chars / np.maximum(chars[up], 1), chars[up] / np.maximum(size[up], 1), links[up] / np.maximum(chars[up], 1), np.array([len(x.children) for x in nodes], float),
    ]
    return np.column_stack([*columns, groups])


class BoostedTrees:
    """Logistic gradient boosting of shallow trees over binned features."""

    def __init__(self, trees: int = 50, depth: int = 4, rate: float = 0.2, bins: int = 32, least: int = 8, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        binned = self._binned(x)
        rate = y.mean()
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(n, self.base)
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        inner = 2**self.depth - 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            which, cut, value = np.zeros(inner, int), np.full(inner, self.bins + 1), np.zeros(2**self.depth)
            at = np.zeros(n, int)
            for level in range(self.depth):
                first = 2**level - 1
                for k in range(2**level):
                    rows = np.flatnonzero(at == k)
                    if len(rows) >= 2 * self.least:
                        which[first + k], cut[first + k] = self._split(binned[rows], g[rows], h[rows])
                at = 2 * at + (binned[np.arange(n), which[first + at]] >= cut[first + at])
            total_g, total_h = np.bincount(at, g, 2**self.depth), np.bincount(at, h, 2**self.depth)
            value = self.rate * total_g / (total_h + self.ridge)
            score += value[at]
            self.nodes.append((which, cut, value))
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)])

    def _split(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        best, found = 1e-6, (0, self.bins + 1)
        all_g, all_h = g.sum(), h.sum()
        rest = all_g**2 / (all_h + self.ridge)
        for j in range(binned.shape[1]):
            left_g = np.cumsum(np.bincount(binned[:, j], g, self.bins))[:-1]
            left_h = np.cumsum(np.bincount(binned[:, j], h, self.bins))[:-1]
            left_n = np.cumsum(np.bincount(binned[:, j], minlength=self.bins))[:-1]
            gain = left_g**2 / (left_h + self.ridge) + (all_g - left_g) ** 2 / (all_h - left_h + self.ridge) - rest
            gain[(left_n < self.least) | (len(g) - left_n < self.least)] = 0
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = float(gain[k]), (j, k + 1)
        return found

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        binned = self._binned(x)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for which, cut, value in self.nodes:
            at = np.zeros(len(x), int)
            for level in range(self.depth):
                first = 2**level - 1
                at = 2 * at + (binned[rows, which[first + at]] >= cut[first + at])
            out += value[at]
        return out


def decode(nodes: list[Node], odds: np.ndarray, mixed_cost: float = 1.0, container_weight: float = 0.3) -> np.ndarray:
    """Whether each element's own text is kept, by the best states of the whole tree.

    Elements with text of their own count most, containers of them less, and
    the page's outermost elements, which are mixed as a rule, not at all.
    """
    n = len(nodes)
    own = np.array([bool(x.blocks) for x in nodes])
    inside = own.copy()
    for i in range(n - 1, 0, -1):
        inside[nodes[i].parent] |= inside[i]
    outer = np.array([x.tag in ("html", "body") for x in nodes])
    weight = np.where(own, 1.0, np.where(inside & ~outer, container_weight, 0.0))
    s = np.clip(odds, -6, 6) * weight
    keep, free = s.copy(), np.where(own, np.abs(s), 0.0) - np.where(outer, 0.0, mixed_cost)
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        keep[p] += keep[i]
        free[p] += max(keep[i], -keep[i], free[i])
    state = np.zeros(n, int)  # 1 kept, -1 rejected, 0 mixed
    out = np.zeros(n, bool)
    for i in range(n):
        above = state[nodes[i].parent] if i else 0
        state[i] = above or (0 if free[i] > abs(keep[i]) else 1 if keep[i] > 0 else -1)
        out[i] = state[i] > 0 or state[i] == 0 and s[i] > 0
    return out


def made_pages(n: int, seed: int = 11) -> list[tuple[str, set[str]]]:
    """Pages by rule, with the set of their main text blocks: what the trees learn from."""
    r = random.Random(seed)
    fresh = [0]

    def word() -> str:
        return "".join(r.choice("aeioulnrstdm") for _ in range(r.randint(2, 9)))

    def words(lo: int, hi: int) -> str:
        fresh[0] += 1
        return " ".join(word() + r.choice(["", "", "", "", ",", "."]) for _ in range(r.randint(lo, hi))) + f" q{fresh[0]}."

    def attr(*names: str) -> str:
        return r.choice(["", f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="{r.choice(names)} x{r.randint(1, 9)}"'])

    def links(lo: int, hi: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{r.choice([word(), words(1, 4)])}</a></li>' for _ in range(r.randint(lo, hi))) + "</ul>"

    def chrome() -> str:
        kind = r.randrange(9)
        if kind == 0:
            return f"<nav{attr('nav', 'menu', 'topnav')}>{links(3, 12)}</nav>"
        if kind == 1:
            return f"<div{attr('ad', 'ads', 'advert', 'promo', 'sponsor')}>{words(4, 40)}</div>" if r.random() < 0.5 else f'<div class="ad">{words(4, 40)}</div>'
        if kind == 2:
            return f"<aside{attr('sidebar', 'widget', 'related')}><h3>{words(1, 4)}</h3>{links(2, 8)}<p>{words(3, 30)}</p></aside>"
        if kind == 3:
            return f'<div class="{r.choice(["cookie-notice", "consent banner", "notice", "alert popup"])}"><p>{words(5, 30)}</p><button>{word()}</button></div>'
        if kind == 4:
            return f"<form{attr('search', 'newsletter', 'login')}><label>{words(1, 4)}</label><input><p>{words(2, 15)}</p></form>"
        if kind == 5:
            return f'<div class="{r.choice(["menu", "breadcrumb nav", "share social", "toolbar"])}">' + " | ".join(f'<a href="/">{words(1, 2)}</a>' for _ in range(r.randint(2, 8))) + "</div>"
        if kind == 6:
            return f"<header{attr('header', 'banner')}><h2>{words(1, 5)}</h2><p>{words(1, 10)}</p></header>"
        if kind == 7:
            each = "".join(f'<div class="{r.choice(["comment", "reply"])}"><p>{words(3, 60)}</p></div>' for _ in range(r.randint(1, 5)))
            return f'<{r.choice(["div", "section"])} {r.choice(["id", "class"])}="{r.choice(["comments", "comment list"])}"><h3>{words(1, 3)}</h3>{each}</section></div>'
        return f"<div{attr('sidebar', 'side', 'widget')}><p>{words(3, 20)}</p>{links(2, 9)}</div>"

    def article() -> str:
        out = [f"<h1>{words(2, 12)}</h1>"] if r.random() < 0.9 else []
        for _ in range(r.choice([0, 1, 1, 1, 1, 2, 2, 3, 5, 8, 12])):
            k = r.random()
            body = words(1, 8) if r.random() < 0.3 else words(10, 150)
            if k < 0.7:
                out.append(f"<p>{body}" + r.choice(["</p>", "</p>", "</p>", ""]))
            elif k < 0.78:
                out.append(f"<p><b>{body}<br>")
            elif k < 0.84:
                out.append(f"<h2>{words(1, 6)}</h2>")
            elif k < 0.9:
                out.append("<ul>" + "".join(f"<li>{words(3, 25)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.95:
                out.append(f"<blockquote><p>{body}</p></blockquote>")
            else:
                out.append(f'<p>{words(5, 30)}<a href="/{word()}">{words(1, 4)}</a></p>')
        return "".join(out)

    pages = []
    for _ in range(n):
        before = "".join(chrome() for _ in range(r.randint(0, 4)))
        first = fresh[0]
        inside = article()
        main = range(first + 1, fresh[0] + 1)
        tag = r.choice(["article", "article", "article", "main", "div", "section"])
        names = attr("content", "post", "entry", "article-body", "main") if tag in ("article", "main") else f' class="{r.choice(["content", "post", "entry-content", "article", "main text", "story body"])}"'
        if r.random() < 0.25:
            inside += chrome()
        inner = f"<{tag}{names}>{inside}</{tag}>"
        if r.random() < 0.3:
            inner = f"<div{attr('wrap', 'page', 'container')}>{inner}{chrome() if r.random() < 0.5 else ''}</div>"
        after = "".join(chrome() for _ in range(r.randint(0, 3))) + (f"<footer{attr('footer', 'legal')}>&copy; {words(2, 20)}</footer>" if r.random() < 0.8 else "")
        page = f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><script>var a='<p>';</script></head><body>{before}{inner}{after}" + r.choice(["</body></html>", ""])
        pages.append((page, {f"q{k}." for k in main}))
    return pages


def train(pages: int = 800, seed: int = 11) -> BoostedTrees:
    """Trees from pages made by rule; elements of mixed content are no examples."""
    rows, labels = [], []
    for page, main in made_pages(pages, seed):
        nodes, blocks = parse(page)
        is_main = [bool(main & set(b.split())) for b in blocks]
        inside = np.zeros((len(nodes), 2), int)
        for i in range(len(nodes) - 1, -1, -1):
            for b in nodes[i].blocks:
                inside[i, int(is_main[b])] += 1
            if i:
                inside[nodes[i].parent] += inside[i]
        pure = (inside[:, 0] > 0) != (inside[:, 1] > 0)
        rows.append(node_features(nodes, blocks)[pure])
        labels.append(inside[pure, 1] > 0)
    return BoostedTrees().fit(np.concatenate(rows), np.concatenate(labels).astype(float))


def main_texts(pages: list[str], trees: BoostedTrees) -> list[str]:
    parsed = [parse(p) for p in pages]
    odds = trees.score(np.concatenate([node_features(n, b) for n, b in parsed])) if parsed else np.zeros(0)
    out, at = [], 0
    for nodes, blocks in parsed:
        kept = decode(nodes, odds[at : at + len(nodes)])
        at += len(nodes)
        chosen = sorted(b for x, k in zip(nodes, kept, strict=True) if k for b in x.blocks)
        out.append("\n".join(blocks[b] for b in chosen))
    return out


def extract_pages(pages: DataFrame, trees: BoostedTrees, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, text and n_chars (code points) of every page.

    Null html counts as empty, and gives an empty text; so do empty pages and those without text. Whole pages
    are read, of any length. Broken markup is read as a browser would in the main; repeated rows give
    equal texts. States of an element that tie are mixed first, then rejected. Other columns
    are not carried, so their names cannot clash. An empty table gives no rows.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(trees)
    fields = [pages.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            for a in range(0, len(batch), 64):
                texts += main_texts([x.as_py() for x in batch.column(len(fields))[a : a + 64]], shipped.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(fields))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(f.name for f in fields), "text", "n_chars"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "text string, n_chars long"])
    return pages.select(*keep, F.coalesce(F.col(html_col), F.lit("")).alias("__html")).mapInArrow(run, schema)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"), train())
