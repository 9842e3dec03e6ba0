"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into blocks of text between block-level tags. Every block is main text or not; the
weights of its ancestors' tags, classes and roles and of its text add up to its score, transitions
join neighbouring blocks, and Viterbi finds the best labelling of the page.

The field is trained on the driver on labelled pages: made-up layouts filled with text of the given
pages, whose labels are known, and at most ``PAGES`` given pages in which <article> or <main> marks the
main text. On half of these the marks are hidden, so that the rest of the features is learned as well.
Extraction covers every whole page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowmatch.llm.lang_crf import forward_backward
from windowmatch.llm.shared import by_hash

#: Bounds of the training sample: given pages (of at most ``LONGEST`` characters), made-up layouts.
PAGES, LONGEST, LAYOUTS = 200, 200_000, 900
ROUNDS, RATE, DECAY = 120, 0.3, 1e-5

RAW = "script style textarea iframe title".split()
#: Elements without main text that can hold others; they end with their own end tag or an outer one.
HIDDEN = {"svg", "noscript", "template"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: Open elements that a new one of the listed kinds closes, up to the nearest container.
CLOSES = {
    **{t: {"p"} for t in BLOCK - {"option", "button", "body", "html"}},
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"},
    "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
}
CONTAINERS = BLOCK - {"p", "li", "dt", "dd", "tr", "td", "th", "option"} | HIDDEN

#: Tokens of a page. None looks beyond the next "<" in vain, so that unclosed markup costs one pass; a "<"
#: that begins none of them is looked at by ``_Page.odd``.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW)})\b[^<>]*>.*?(?:</\1\s*>|\Z)|<[!?][^<>]*>"
    r"|<(/?)([a-z][a-z0-9:-]*+)((?:[^<>\"']++|\"[^<\"]*+\"|'[^<']*+')*+)>|[^<]+|<",
    re.S | re.I,
)
_START = re.compile(rf"<(?:({'|'.join(RAW)})\b|[!?]|(/?)([a-z][a-z0-9:-]*+))", re.I)
_LIMITS = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PHRASES = re.compile(
    r"cookie|privacy|subscribe|newsletter|copyright|©|all rights|sign up|log ?in|comment|reply|share|advert|sponsor|terms of", re.I
)


@dataclass
class Part:
    """A leaf block: text, features of its ancestors, its own tag, words inside links."""

    text: str
    around: tuple[str, ...]
    tag: str
    linked: int


def _element(tag: str, attributes: str) -> frozenset[str]:
    """Features of an element as an ancestor."""
    found = {f"t:{tag}"}
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = "".join(values)
            name = name.lower()
            if name in ("hidden", "aria-hidden", "style"):
                if name == "hidden" or value == "true" or re.search(r"display\s*:\s*none", value):
                    found.add("c:hidden")
                continue
            for word in map(str.lower, _NAMES.findall(value)):
                found |= {f"c:{word}", f"c4:{word[:4]}"}
    return frozenset(found)


_elements: dict[tuple[str, str], frozenset[str]] = {}


class _Page:
    """The tokens of a page: (piece of text or "", name of a raw element, "/" of an end tag, name, attributes)."""

    def __init__(self, page: str):
        self.page, self.last, self.limits, self.ends = page, page.rfind(">"), None, []

    def __iter__(self):
        page, at, end = self.page, 0, len(self.page)
        while at < end:
            token = _TOKEN.match(page, at)
            if token[0] == "<" and at < self.last:
                at, found = self.odd(at)
                yield found
                continue
            raw, close, name, attributes = token.groups()
            piece = "" if raw or name or token.end() - at > 1 and page[at] == "<" else token[0]
            yield piece, raw, close, name, attributes
            at = token.end()

    def odd(self, at: int):
        """The token at a "<" before the last ">" whose markup holds another "<" or a quote without an end."""
        page = self.page
        start = _START.match(page, at)
        if not start:
            return at + 1, ("<", None, None, None, None)
        raw, close, name = start.groups()
        if not name:
            end = page.find(">", at) + 1
            if raw:
                after = re.compile(rf"</{raw}\s*>", re.I).search(page, end)
                end = after.end() if after else len(page)
            return end, ("", raw, None, None, None)
        end = self.quoted_end(start.end())
        if end < 0:
            end = page.find(">", start.end())
        return end + 1, ("", None, close, name, page[start.end() : end])

    def quoted_end(self, at: int) -> int:
        """The first ">" from ``at`` on that no quotes hold, or -1. One pass from the end of the page finds it for
        all places, as there are but three states: outside of quotes, inside of double ones, of single ones."""
        if self.limits is None:
            self.limits = [m.start() for m in _LIMITS.finditer(self.page)]
            outside = double = single = -1
            for place in reversed(self.limits):
                sign = self.page[place]
                if sign == ">":
                    outside = place
                elif sign == '"':
                    outside, double = double, outside
                else:
                    outside, single = single, outside
                self.ends.append(outside)
            self.ends.reverse()
        i = bisect_left(self.limits, at)
        return self.ends[i] if i < len(self.ends) else -1


@dataclass
class _Open:
    """An open element: its name and features, the nearest block around it, and once asked for all features
    around its text, as a set and in order."""

    name: str
    features: frozenset[str]
    block: str
    around: tuple[frozenset[str], tuple[str, ...]] | None = None


class _Stack:
    """Open elements with the places of every name, so that no step walks over all of them."""

    def __init__(self):
        self.open: list[_Open] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.containers: list[int] = []

    def push(self, name: str, features: frozenset[str]) -> None:
        self.places[name].append(len(self.open))
        if name in CONTAINERS:
            self.containers.append(len(self.open))
        self.open.append(_Open(name, features, name if name in BLOCK else self.block()))

    def cut(self, size: int) -> None:
        while len(self.open) > size:
            name = self.open.pop().name
            self.places[name].pop()
            if name in CONTAINERS:
                self.containers.pop()

    def first(self, name: str, start: int = 0) -> int:
        """The outermost open element of a name from place ``start`` on, or -1."""
        places = self.places.get(name, ())
        i = bisect_left(places, start)
        return places[i] if i < len(places) else -1

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else -1

    def container(self) -> int:
        return self.containers[-1] if self.containers else -1

    def hidden(self) -> int:
        """The outermost element without main text, or -1."""
        return min((i for i in map(self.first, HIDDEN) if i >= 0), default=-1)

    def block(self) -> str:
        return self.open[-1].block if self.open else ""

    def around(self) -> tuple[str, ...]:
        """All features of the open elements in order. Elements that add none share those of the one around."""
        known = len(self.open)
        while known and self.open[known - 1].around is None:
            known -= 1
        have = self.open[known - 1].around if known else (frozenset(), ())
        for element in self.open[known:]:
            if not element.features <= have[0]:
                have = (have[0] | element.features, None)
            element.around = have
        if have[1] is None:
            have = (have[0], tuple(sorted(have[0])))
            self.open[-1].around = have
        return have[1]


def parts(page: str | None) -> list[Part]:
    """The leaf blocks of a page in order. Unclosed and stray tags are taken as browsers do, roughly."""
    stack = _Stack()
    found: list[Part] = []
    text: list[str] = []
    state = {"linked": 0, "tag": "", "around": ()}
    links, fresh, hidden = False, True, -1

    def flush() -> None:
        words = html.unescape("".join(text)).split()
        if words:
            found.append(Part(" ".join(words), state["around"], state["tag"], state["linked"]))
        text.clear()
        state["linked"] = 0

    for piece, raw, close, name, attributes in _Page(page or ""):
        if name is None:
            if raw or hidden >= 0 or not piece:
                continue
            if fresh:
                state["tag"], state["around"] = stack.block(), stack.around()
            text.append(piece)
            fresh = fresh and piece.isspace()
            if links:
                state["linked"] += piece.count(" ") + 1
            continue
        name = name.lower()
        if name == "br":
            if hidden < 0:
                text.append(" ")
            continue
        if hidden >= 0:
            drawing = stack.first("svg", hidden)
            # HTML inside of svg ends it, as in browsers
            if name in BLOCK and not close and drawing >= 0 and stack.last("foreignobject") < hidden:
                stack.cut(drawing)
                hidden = stack.hidden()
            elif close and name in BLOCK and 0 <= stack.last(name) < hidden:
                hidden = -1
        if name in BLOCK and hidden < 0:
            flush()
            fresh = True
        if close:
            place = stack.last(name)
            if place >= 0 and (name in BLOCK or name in HIDDEN or place > stack.container()):
                stack.cut(place)
            hidden = stack.hidden()
            links = stack.last("a") >= 0
            continue
        for other in CLOSES.get(name, ()):
            place = stack.first(other, stack.container() + 1)
            if place >= 0:
                stack.cut(place)
        if name not in VOID and not attributes.endswith("/"):
            key = (name, attributes)
            if key not in _elements:
                if len(_elements) > 50_000:
                    _elements.clear()
                _elements[key] = _element(name, attributes)
            stack.push(name, _elements[key])
            if name in HIDDEN and hidden < 0:
                hidden = len(stack.open) - 1
        links = stack.last("a") >= 0
    flush()
    return found


def text_features(part: Part, place: int, total: int) -> list[str]:
    """Features of a block itself."""
    words = part.text.split(" ")
    n = len(words)
    size = min(n.bit_length(), 8)
    links = 0 if not part.linked else 1 + min(3, 4 * part.linked // (n + 1))
    letters = sum(map(str.isalpha, part.text)) / len(part.text)
    return [
        "bias", f"tag:{part.tag}", f"size:{size}", f"links:{links}", f"end:{part.text[-1] in '.!?…:;”»'}",
        f"commas:{min(2, part.text.count(','))}", f"letters:{int(4 * letters)}", f"phrase:{bool(_PHRASES.search(part.text))}",
        f"first:{place == 0}", f"last:{place == total - 1}", f"tagsize:{part.tag}:{size}",
    ]


@dataclass
class Crf:
    """Weights of a block for being main text, log transition weights (from, to), start weights."""

    weights: dict[str, float]
    transition: np.ndarray
    start: np.ndarray

    def __post_init__(self):
        self.known: dict[tuple[str, ...], float] = {}

    def scores(self, blocks: list[Part]) -> list[float]:
        get = self.weights.get
        made = []
        for i, part in enumerate(blocks):
            around = self.known.get(part.around)
            if around is None:
                if len(self.known) > 50_000:
                    self.known.clear()
                around = self.known[part.around] = sum(get(f, 0.0) for f in part.around)
            made.append(around + sum(get(f, 0.0) for f in text_features(part, i, len(blocks))))
        return made

    def label(self, blocks: list[Part]) -> list[bool]:
        """Viterbi: the most likely labelling."""
        (same0, to1), (to0, same1) = self.transition.tolist()
        zero, one = self.start.tolist()
        back = []
        for i, score in enumerate(self.scores(blocks)):
            if i:
                from0, from1 = (zero + same0, one + to0), (zero + to1, one + same1)
                back.append((from0[1] > from0[0], from1[1] > from1[0]))
                zero, one = max(from0), max(from1)
            one += score
        if not blocks:
            return []
        labels = [one > zero]
        for choice in reversed(back):
            labels.append(choice[labels[-1]])
        return labels[::-1]


#: Stands before main text in made-up pages.
MAIN_SIGN = "\ue000"
#: Layouts: markup around text that is no main text, and around text that is.
ASIDE = (
    '<nav>|<nav class="menu">|<div class="menu">|<div id="nav" role="navigation">|<header>|<header class="site-header">|'
    '<div id="header">|<div class="top-bar">|<aside>|<aside class="sidebar">|<div class="sidebar widget">|<div id="sidebar">|'
    '<div class="cookie-notice">|<div class="notice alert">|<section class="notice">|<div role="alert">|<div class="ad">|'
    '<div class="ads advert">|<div class="advertisement banner">|<section class="sponsored promo">|<form>|<form class="search">|'
    '<form id="login">|<fieldset>|<section class="comments">|<section id="comments">|<div class="comment-list">|'
    '<article class="comment">|<div class="reader-comments reply">|<ol class="commentlist">|<div class="related">|'
    '<section class="related-posts recommended">|<footer>|<footer class="site-footer">|<div id="footer">|<div class="footer copyright">|'
    '<div class="share social">|<div class="newsletter subscribe">|<div class="breadcrumb">|<ul class="breadcrumbs pagination">|'
    '<div class="popup modal">|<div hidden>|<div style="display:none">|<section class="toolbar">|<div class="tags meta">|<dialog>'
).split("|")
MAIN = (
    '<article>|<main>|<main><article>|<div id="content">|<div class="post-content">|<div class="entry">|<section class="story">|'
    '<div class="article-body">|<article class="post">|<div role="main">|<div class="text" itemprop="articleBody">|<table><tr><td>|'
    '<div id="main" class="main-content">|<div class="page"><div class="body">|<section>|<div>'
).split("|")
PLAIN = "<p>|<p>|<p>|<div>|<h2>|<h3>|<li>|<blockquote>|<td>|<b>|<span>|<pre>|<dd>".split("|")
SHORT = '<li><a href="#">|<a href="#">|<p>|<span>|<li>|<h3>|<label>|<button>|<small>|<div>|<p><a href="#">|<td>'.split("|")


def _closing(markup: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", markup)))


def layouts(texts: list[str], number: int = LAYOUTS, seed: int = 3) -> list[tuple[list[Part], list[bool]]]:
    """Made-up pages with their labels: main text in a container, other text before, behind and inside."""
    rng = np.random.default_rng(seed)
    pick = lambda items: items[int(rng.integers(len(items)))]
    long = [t for t in texts if t] or ["Text of a page."]

    def marked(markup: str, text: str, sign: str = "") -> str:
        return markup + sign + html.escape(text) + _closing(markup)

    def words(n: int) -> str:
        return " ".join(pick(long).split(" ")[:n])

    def aside() -> str:
        kind = pick(ASIDE)
        inside = ""
        for _ in range(int(rng.integers(1, 6))):
            if rng.random() < 0.3:
                inside += marked(pick(PLAIN), pick(long))
            else:
                inside += marked(pick(SHORT), words(int(rng.integers(1, 7))))
        return kind + inside + _closing(kind)

    def main() -> str:
        kind = pick(MAIN)
        inside = marked("<h1>", words(int(rng.integers(2, 12))), MAIN_SIGN) if rng.random() < 0.8 else ""
        for _ in range(int(rng.integers(0 if inside else 1, 12)) if rng.random() < 0.8 else 1):
            size = 1000 if rng.random() < 0.7 else int(rng.integers(1, 8))
            inside += marked(pick(PLAIN), words(size), MAIN_SIGN)
            if rng.random() < 0.15:
                inside += aside()
        return kind + inside + _closing(kind)

    made = []
    for _ in range(number):
        before = "".join(aside() for _ in range(int(rng.integers(0, 4))))
        behind = "".join(aside() for _ in range(int(rng.integers(0, 4))))
        blocks = parts(f"<html><body>{before}{main()}{behind}</body></html>")
        plain = [Part(b.text.replace(MAIN_SIGN, ""), b.around, b.tag, b.linked) for b in blocks]
        labels = [MAIN_SIGN in b.text for b in blocks]
        made.append(([b for b in plain if b.text], [y for b, y in zip(plain, labels) if b.text]))
    return made


def marked_pages(pages: Iterable[str], seed: int = 4) -> list[tuple[list[Part], list[bool]]]:
    """Given pages with an <article> or <main>, labelled by it: what stands there and in no element for
    other text. Half of them lose the features of the mark."""
    rng = np.random.default_rng(seed)
    marks = {"t:article", "t:main"}
    other = {f for markup in ASIDE for tag, rest in re.findall(r"<(\w+)([^>]*)>", markup) for f in _element(tag, rest)}
    other -= {"t:div", "t:section", "t:ul", "t:ol", "t:article"}
    made = []
    for page in pages:
        blocks = parts(page)
        labels = [bool(marks & set(b.around)) and not other & set(b.around) for b in blocks]
        if any(labels):
            if rng.random() < 0.5:
                blocks = [Part(b.text, tuple(f for f in b.around if f not in marks), b.tag, b.linked) for b in blocks]
            made.append((blocks, labels))
    return made


def fit(labelled: list[tuple[list[Part], list[bool]]]) -> Crf:
    """Train on labelled blocks of pages by the conditional likelihood."""
    labelled = [(b, y) for b, y in labelled if b]
    names: dict[str, int] = {}
    flat, sizes = [], []
    for blocks, _ in labelled:
        for i, part in enumerate(blocks):
            mine = [*part.around, *text_features(part, i, len(blocks))]
            flat += [names.setdefault(f, len(names)) for f in mine]
            sizes.append(len(mine))
    flat, sizes = np.array(flat), np.array(sizes)
    cuts = np.cumsum(sizes) - sizes
    lengths = np.array([len(b) for b, _ in labelled])
    starts = np.cumsum(lengths) - lengths
    gold = np.concatenate([np.array(y, int) for _, y in labelled])
    truth = np.eye(2)[gold]
    inside = np.ones(len(gold), bool)
    inside[starts] = False
    steps = np.zeros((2, 2))
    np.add.at(steps, (gold[:-1][inside[1:]], gold[1:][inside[1:]]), 1)
    weights, squares = np.zeros(len(names)), np.full(len(names), 1e-8)
    transition, start = np.zeros((2, 2)), np.zeros(2)
    side = [[transition, np.full((2, 2), 1e-8)], [start, np.full(2, 1e-8)]]
    for _ in range(ROUNDS):
        scores = np.add.reduceat(weights[flat], cuts)
        marginal, expected, _ = forward_backward(np.stack([np.zeros_like(scores), scores], 1), lengths, transition, start)
        gap = (truth - marginal)[:, 1]
        grad = np.bincount(flat, np.repeat(gap, sizes), len(names)) / len(gold) - DECAY * weights
        squares += grad**2
        weights += RATE * grad / np.sqrt(squares)
        for (value, square), change in zip(side, (steps - expected, truth[starts].sum(0) - marginal[starts].sum(0))):
            change = change / len(gold)
            square += change**2
            value += RATE * change / np.sqrt(square)
    return Crf({n: float(weights[i]) for n, i in names.items()}, transition, start)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", labelled: list | None = None) -> Crf:
    """Fit on a bounded sample (see the module's text), or on ``labelled`` pages of the caller."""
    if labelled is not None:
        return fit(labelled)
    rows = pages.where(F.length(html_col) <= LONGEST).select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    share = min(1.0, 2 * PAGES / max(1, rows.count()))
    some = rows.where(by_hash(F.col("id"), share)).orderBy(F.xxhash64("id", "html")).limit(PAGES)
    given = [r["html"] for r in some.select("html").collect()]
    texts = [b.text for page in given for b in parts(page) if len(b.text) > 40]
    return fit(layouts(texts) + marked_pages(given))


def main_text(model: Crf, page: str | None) -> str:
    """Main blocks in page order, one to a line; empty if there are none."""
    blocks = parts(page)
    return "\n".join(b.text for b, y in zip(blocks, model.label(blocks)) if y)


def text_column(spark, model: Crf, page: Column) -> Column:
    """The main text of a column of pages. The model has a bounded size and is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    def batch(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(shared.value, p) for p in pages], dtype=object)

    return F.pandas_udf(batch, "string")(page)


def extract(pages: DataFrame, model: Crf, html_col: str = "html", *columns: str) -> DataFrame:
    """``columns`` of every row of ``pages`` with its main ``text`` and ``n_chars``, its code points.

    Defined cases: a NULL or empty page has an empty text; NULLs in other columns, repeated rows and
    columns not asked for do not matter; an empty table gives an empty result.
    """
    found = pages.select(*columns, text_column(pages.sparkSession, model, F.col(html_col)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
