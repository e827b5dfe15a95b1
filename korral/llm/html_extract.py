"""Main-text extraction with a linear-chain CRF over DOM leaf blocks.

A page is parsed into leaf blocks: maximal stretches of text with no block-level
tag inside.  Each block has binary features of its ancestors (tags, and words of
their class and id attributes, alone and together with standing in an article)
and of its text (length, link share, punctuation).  A two-state linear-chain CRF
scores the blocks and their transitions; Viterbi decoding picks the main ones.

The CRF is trained here, by maximum likelihood over labelled pages.  Without
pages of your own, :func:`labelled_pages` makes them: seeded layouts of articles
amid menus, headers, footers, sidebars, notices, adverts, forms and comments.

Scale: one map-only scan; pages are parsed one at a time in a worker, so memory
is bounded by the longest page.  The model is a few hundred weights.

Edge cases: null html counts as empty; a page without main blocks, without
markup at all or with unbalanced tags is defined (no text; its text is one
block; open elements are closed where HTML closes them).  Each input row gives
one row, repeated rows too; other columns are not read.
"""

from __future__ import annotations

import functools
import html as _html
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Quotes hold a tag's end off only where they follow "="; possessive, so that no page takes more than one pass.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+", re.S)
#: Elements whose content is not text of the page; those of RAW hold no tags.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SILENT = RAW | frozenset("head template noscript svg math object select datalist canvas audio video".split())
FOREIGN = frozenset(("svg", "math"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img label".split())
#: What an opening tag closes: itself or its kin, up to the elements that bound it.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)), "body": (("head",), ()),
}
TAGS = frozenset("nav header footer aside form article main section figure figcaption table td th ul ol li dl h1 h2 h3 h4 h5 h6 p div button blockquote pre address dialog menu fieldset".split())
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toc pagination pager",
    "head": "header masthead banner logo branding",
    "foot": "footer foot colophon copyright legal",
    "side": "sidebar side aside widget related recommended rail trending popular",
    "ad": "ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay toast disclaimer subscribe newsletter paywall",
    "comment": "comment comments reply replies discussion disqus respond reader-comments",
    "share": "share sharing social follow",
    "main": "article content post entry main body story text page-content post-body",
    "form": "form search login signup contact",
}
HINT = {w: k for k, ws in HINTS.items() for w in ws.split()}


@dataclass
class Block:
    text: str
    features: list[str]
    label: bool = False


@dataclass(slots=True)
class _Open:
    """An open element, with what is true of it and all that it stands in."""

    tag: str
    silent: bool
    label: bool
    linked: bool
    block: int  # where on the stack the nearest element stands that isn't inline, -1 if none
    near: str  # its tag
    tags: frozenset
    hints: frozenset
    inside: frozenset | None  # features below the article or main element, if in one


_ROOT = _Open("", False, False, False, -1, "none", frozenset(), frozenset(), None)


def _opened(under: _Open, at: int, tag: str, hints: tuple[str, ...], label: bool, silent: bool) -> _Open:
    more = frozenset([tag] if tag in TAGS else [])
    inside = under.inside
    if inside is not None:
        inside = _with(inside, frozenset([*(f"in:{t}" for t in more), *(f"in:hint={h}" for h in hints)]))
    elif tag in ("article", "main"):
        inside = frozenset()
    inline = tag in INLINE
    return _Open(tag, silent or under.silent, label or under.label, under.linked or tag == "a", under.block if inline else at, under.near if inline else tag, _with(under.tags, more), _with(under.hints, frozenset(hints)), inside)


def _with(a: frozenset, b: frozenset) -> frozenset:
    return a if b <= a else a | b


@functools.lru_cache(4096)
def _hints(value: str) -> tuple[str, ...]:
    words = re.split(r"[\s_]+", value.lower())
    parts = {p for w in words for p in (w, *w.split("-"))}
    return tuple(sorted({HINT[p] for p in parts if p in HINT}))


def parse(page: str) -> list[Block]:
    """The page's leaf blocks in order, with their features (and the label of ``data-main`` in training pages).

    One pass: an open element carries what holds of all around it, and for each tag the places of its open elements are
    known, so a tag costs the same however deep it stands.
    """
    blocks: list[Block] = []
    stack: list[_Open] = []
    places: dict[str, list[int]] = {}
    parts: list[str] = []
    linked = 0
    last = page.rfind(">")  # no tag ends after this

    def top() -> _Open:
        return stack[-1] if stack else _ROOT

    def lowest(tags: tuple[str, ...]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                blocks.append(Block(text, _features(text, top(), linked), top().label))
        linked = 0

    def put(raw: str) -> None:
        nonlocal linked
        if raw and not top().silent:
            text = _html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if top().linked:
                linked += len(text)

    def drop(at: int) -> None:
        while len(stack) > at:
            places[stack.pop().tag].pop()

    at = 0
    while True:
        m = TOKEN.search(page, at) if at <= last or page.find("<!", at) >= 0 or page.find("<?", at) >= 0 else None
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:  # closing tag: of the nearest open one, inline ones not across a block
            i = lowest((tag,))
            if i >= 0 and not (tag in INLINE and i < top().block):
                if top().block >= i:
                    flush()
                drop(i)
            continue
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
            if tag != "body" and top().tag == "head" and tag not in SILENT:
                drop(len(stack) - 1)
            kin, bounds = CLOSES.get(tag, (("p",), ("article", "section", "div", "td", "li", "blockquote", "button")))
            i = lowest(kin)
            if i > lowest(tuple(b for b in bounds if b not in kin)):
                drop(i)
        if tag in RAW:  # never open: what it holds is passed over. HTML ignores its slash, SVG and MathML don't
            if not (m[3].rstrip().endswith("/") and any(places.get(f) for f in FOREIGN)):
                end = _end_of(tag).search(page, at)
                at = end.end() if end else len(page)
            continue
        attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(m[3])} if "=" in m[3] else {}
        value = " ".join(attrs[k] for k in ("class", "id", "role") if k in attrs)
        if tag not in INLINE or value or tag == "a":
            if not m[3].rstrip().endswith("/") or tag in INLINE or tag in TAGS:
                places.setdefault(tag, []).append(len(stack))
                stack.append(_opened(top(), len(stack), tag, _hints(value) if value else (), "data-main" in attrs, tag in SILENT))
    flush()
    return blocks


@functools.cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*+>?", re.I)


def _features(text: str, at: _Open, linked: int) -> list[str]:
    out = [f"tag={t}" for t in at.tags] + [f"hint={h}" for h in at.hints]
    if at.inside is not None:  # below the article or main element itself
        out += at.inside
    out.append(f"leaf={at.near if at.near in TAGS else 'other'}")
    words = text.count(" ") + 1
    out.append(f"words={min(words.bit_length(), 7)}")
    share = linked / max(len(text), 1)
    out.append("links=" + ("none" if share == 0 else "some" if share < 0.4 else "most" if share < 0.9 else "all"))
    out.append("stop" if text[-1] in ".!?…。؟\"”" else "nostop")
    if text[0] in "©®" or re.match(r"(?i)\(c\)|copyright\b|all rights", text):
        out.append("copyright")
    if not (at.tags & {"nav", "header", "footer", "aside", "form"}) and not (at.hints - {"main"}):
        out.append("plain")
    return list(dict.fromkeys(out))


@dataclass
class Crf:
    """Weights of a two-state chain: emit[feature] for (other, main), step[previous][next], start."""

    emit: dict[str, tuple[float, float]] = field(default_factory=dict)
    step: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    start: tuple[float, float] = (0.0, 0.0)

    def decode(self, blocks: list[Block]) -> list[bool]:
        """Viterbi: the most probable labels; ties go to not main."""
        if not blocks:
            return []
        emit = [tuple(sum(x) for x in zip((0.0, 0.0), *(self.emit[f] for f in b.features if f in self.emit))) for b in blocks]
        score = [self.start[0] + emit[0][0], self.start[1] + emit[0][1]]
        back = []
        for e in emit[1:]:
            came = [int(score[1] + self.step[1][j] > score[0] + self.step[0][j]) for j in (0, 1)]
            score = [score[came[j]] + self.step[came[j]][j] + e[j] for j in (0, 1)]
            back.append(came)
        state = int(score[1] > score[0])
        out = [bool(state)]
        for came in reversed(back):
            state = came[state]
            out.append(bool(state))
        return out[::-1]


def train(pages: Iterable[list[Block]], rounds: int = 200, rate: float = 0.5, decay: float = 1e-3) -> Crf:
    """Maximum likelihood by gradient ascent; forward and backward sums run over all pages at once."""
    pages = [p for p in pages if p]
    names = sorted({f for p in pages for b in p for f in b.features})
    at = {f: i for i, f in enumerate(names)}
    n, t = len(pages), max(map(len, pages))
    x = np.zeros((n, t, len(names)), np.float32)
    y, real = np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, p in enumerate(pages):
        for j, b in enumerate(p):
            x[i, j, [at[f] for f in b.features]] = 1
            y[i, j], real[i, j] = b.label, True
    emit, step, start = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    flat, hot = x.reshape(-1, len(names)), np.eye(2)[y] * real[..., None]
    pairs = real[:, 1:] & real[:, :-1]
    gold_step = np.einsum("nti,ntj,nt->ij", hot[:, :-1], hot[:, 1:], pairs)
    grad2 = [np.full_like(w, 1e-6) for w in (emit, step, start)]
    for _ in range(rounds):
        e = (flat @ emit).reshape(n, t, 2)
        a, b = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        a[:, 0] = start + e[:, 0]
        for j in range(1, t):
            new = e[:, j] + np.logaddexp(a[:, j - 1, :1] + step[0], a[:, j - 1, 1:] + step[1])
            a[:, j] = np.where(real[:, j, None], new, a[:, j - 1])
        for j in range(t - 2, -1, -1):
            ahead = e[:, j + 1] + b[:, j + 1]
            new = np.logaddexp(step[:, 0] + ahead[:, :1], step[:, 1] + ahead[:, 1:])
            b[:, j] = np.where(real[:, j + 1, None], new, b[:, j])
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])[:, None, None]
        p = np.exp(a + b - z) * real[..., None]
        both = np.exp(a[:, :-1, :, None] + step + (e + b)[:, 1:, None, :] - z[..., None]) * pairs[..., None, None]
        grads = (flat.T @ (hot - p).reshape(-1, 2) / n - decay * emit, (gold_step - both.sum((0, 1))) / n - decay * step, (hot - p)[:, 0].mean(0) - decay * start)
        for w, g, s in zip((emit, step, start), grads, grad2, strict=True):
            s += g * g
            w += rate * g / np.sqrt(s)
    return Crf({f: (float(emit[i, 0]), float(emit[i, 1])) for f, i in at.items()}, tuple(map(tuple, step.tolist())), tuple(start.tolist()))


def labelled_pages(n: int = 400, seed: int = 7) -> Iterator[list[Block]]:
    """Seeded training pages: main blocks are those under a ``data-main`` attribute, which is no feature."""
    r = random.Random(seed)
    syllables = "ba co de fi lo mu ne ro sta tri vel ion er an qu".split()

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(r.randint(lo, hi)))

    def prose(lo: int, hi: int) -> str:
        return ". ".join(words(3, 18).capitalize() for _ in range(r.randint(lo, hi))) + "."

    def some(p: float, f) -> str:
        return f() if r.random() < p else ""

    def links(lo: int, hi: int) -> str:
        return "<ul>" + "".join(f'<li><a href="#">{words(1, 3)}</a></li>' for _ in range(r.randint(lo, hi))) + "</ul>"

    def named(kind: str) -> str:
        return r.choice(HINTS[kind].split())

    for _ in range(n):
        pick = r.choice
        top = [
            some(0.6, lambda: f"<header><div class={named('head')}>{words(1, 4)}</div>{some(0.5, lambda: f'<p>{words(2, 8)}</p>')}</header>"),
            some(0.8, lambda: f"<nav>{links(3, 8)}</nav>" if r.random() < 0.6 else f'<div class="{named("menu")}">{links(3, 8)}</div>'),
            some(0.5, lambda: f'<div class="{named("ad")}">{pick((words, prose))(2, 6)}</div>'),
            some(0.3, lambda: f'<div id="{named("notice")}"><p>{prose(1, 2)}</p><button>{words(1, 2)}</button></div>'),
        ]
        main = [some(0.2, lambda: f'<nav class="breadcrumb"><a href="#">{words(1, 2)}</a> / <a href="#">{words(1, 2)}</a></nav>')]
        head = f"<h1 data-main=1>{words(2, 12)}</h1>" + some(0.2, lambda: f"<p data-main=1>{words(2, 6)}</p>")
        main.append(f"<header>{head}</header>" if r.random() < 0.25 else head)
        for _ in range(r.randint(1, 10)):
            kind = r.random()
            if kind < 0.62:
                main.append(f"<p data-main=1>{some(0.15, lambda: '<b>')}{prose(1, 6)}{some(0.2, lambda: f' <a href=#>{words(1, 3)}</a> {prose(1, 2)}')}" + r.choice(("</p>", "")))
            elif kind < 0.72:
                main.append(f"<h{r.randint(2, 4)} data-main=1>{words(1, 8)}</h2>".replace("</h2>", "</h>"))
            elif kind < 0.8:
                main.append("<ul data-main=1>" + "".join(f"<li>{words(1, 14)}" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.84:
                main.append(f"<blockquote data-main=1>{pick((prose, words))(1, 4)}</blockquote>")
            elif kind < 0.87:
                main.append(f"<table data-main=1><tr><td>{words(1, 3)}<td>{words(1, 3)}</table>")
            elif kind < 0.89:
                main.append(f"<pre data-main=1>{words(2, 20)}</pre>")
            elif kind < 0.92:
                main.append(f"<figure data-main=1><figcaption>{words(3, 10)}</figcaption></figure>")
            elif kind < 0.95:
                main.append(f'<div class="{named("ad")}">{pick((words, prose))(2, 4)}</div>')
            elif kind < 0.975:
                main.append(f"<aside><h3>{words(1, 3)}</h3>{pick((links(2, 4), f'<p>{prose(1, 2)}</p>'))}</aside>")
            else:
                main.append(f'<div class="{named("share")}">{links(2, 4)}</div>')
        main.append(some(0.15, lambda: f'<footer><p>{words(2, 8)}</p></footer>'))
        comments = some(0.3, lambda: f'<section class="{named("comment")}"><h3>{words(1, 3)}</h3>' + "".join(pick((f"<div><p>{prose(1, 3)}</p></div>", f"<article><p>{prose(1, 3)}</p></article>")) for _ in range(r.randint(1, 4))) + "</section>")
        if r.random() < 0.4:
            main.append(comments)
            comments = ""
        wrap = r.choice(("article", "article", "article", "main", "main><article", "div class=content", "div id=main", "div"))
        body = f"<{wrap}>{''.join(main)}" + "".join(f"</{w.split()[0]}>" for w in reversed(wrap.split("><")))
        side = some(0.4, lambda: pick((f"<aside>{links(2, 6)}<p>{prose(1, 2)}</p></aside>", f'<div class="{named("side")}"><h3>{words(1, 3)}</h3>{links(2, 6)}</div>')))
        bottom = [
            comments,
            some(0.25, lambda: f"<form><p>{words(2, 6)}</p><label>{words(1, 2)}</label><input><button>{words(1, 2)}</button></form>"),
            some(0.15, lambda: f'<div class="{named("notice")}">{prose(1, 2)}</div>'),
            some(0.85, lambda: f"<footer>{pick(('&copy; ', 'Copyright ', ''))}{pick((words, prose))(1, 6)}{some(0.3, lambda: links(2, 4))}</footer>" if r.random() < 0.7 else f'<div class="{named("foot")}">{pick(("&copy; ", ""))}{pick((words, prose))(1, 5)}</div>'),
        ]
        first = r.random() < 0.3
        yield parse("<html><head><title>x</title></head><body>" + "".join(top) + (side + body if first else body + side) + "".join(bottom) + "</body></html>")


@functools.cache
def default_model() -> Crf:
    return train(labelled_pages())


def main_text(page: str | None, model: Crf) -> str:
    blocks = parse(page or "")
    return "\n".join(b.text for b, main in zip(blocks, model.decode(blocks), strict=True) if main)


def extract(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """A row per page: page_id, url, text, n_chars, n_blocks."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("html")
            for lo in range(0, len(column), 64):
                texts, counts = [], []
                for page in column.slice(lo, 64):
                    blocks = parse(page.as_py() or "")
                    texts.append("\n".join(x.text for x, main in zip(blocks, shared.value.decode(blocks), strict=True) if main))
                    counts.append(len(blocks))
                yield pa.RecordBatch.from_arrays([b.column("page_id").slice(lo, 64), b.column("url").slice(lo, 64), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(counts, pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks"])

    source = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint, n_blocks bigint")
