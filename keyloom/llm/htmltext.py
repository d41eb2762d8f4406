"""Operator 5, HTML extraction: flat text blocks classified by a decision tree.

A page is cut into blocks of text between block-level tags. A block's features are its word count and link
density, those of its neighbours, whether its element is bare, a list item or a paragraph or heading, whether it lies in the page's
main container (one half if the page has none), and whether its place says boilerplate: an element like ``nav`` or ``footer``, or a class,
id or role that names one. A small decision tree says which blocks belong to the article. It is trained on the blocks of labelled pages,
which :func:`labelled_pages` makes by rule from a seed; a leaf holds ``LEAF`` of them at least, so that no single page
makes a rule.

A name counts as a whole token (``has-sidebar`` names no sidebar). A main container resets names around it and its own, but
not those of reader comments. Headings in a ``header`` within the main container belong to the article.

Defined results: a null or empty page, and one without content blocks, gives an empty text; unclosed
tags, comments and scripts run to the end of the page; unknown character references stay as they are;
repeated pages give the same text.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("words", "link_density", "prev_words", "prev_links", "next_words", "next_links", "main", "boiler", "kind")
#: Labelled pages, and the depth and the least leaf of the tree.
PAGES, DEPTH, LEAF = 700, 8, 12


def _words(rng: random.Random, n: int) -> str:
    return " ".join("x" * rng.randint(1, 9) for _ in range(n))


def _length(rng: random.Random) -> int:
    return rng.choice((rng.randint(1, 6), rng.randint(4, 20), rng.randint(15, 60), rng.randint(50, 300)))


def _text(rng: random.Random, tag: str, n: int, label: str = "+") -> str:
    """A block of n words, some of them linked; ``+`` marks the article's."""
    linked = rng.randint(1, max(1, n // 3)) if rng.random() < 0.3 and n > 3 else 0
    link = f" <a href=x>{_words(rng, linked)}</a>" if linked else ""
    return f"<{tag}>{label} {_words(rng, n - linked)}{link}</{tag}>"


def _link(rng: random.Random, tag: str, n: int, label: str) -> str:
    return f"<{tag}><a href=x>{label} {_words(rng, n)}</a></{tag}>"


def _menu(rng: random.Random) -> str:
    return "<ul>" + "".join(_link(rng, "li", rng.randint(1, 4), "") for _ in range(rng.randint(3, 8))) + "</ul>"


def _teasers(rng: random.Random) -> str:
    return "<ul>" + "".join(_link(rng, "li", rng.randint(4, 14), "") for _ in range(rng.randint(3, 8))) + "</ul>"


def _body(rng: random.Random, contained: bool) -> str:
    """Headings, paragraphs of any length, lists, and links that stand alone among text; in a container also menus, long lists
    of references, and named boilerplate."""
    parts = [_text(rng, rng.choice(("h1", "h2")), rng.randint(1, 14))] if rng.random() < 0.7 else []
    for _ in range(rng.randint(1, 7)):
        kind = rng.random()
        if kind < 0.6:
            parts.append(_text(rng, "p", _length(rng)))
        elif kind < 0.7:
            parts.append(_text(rng, rng.choice(("h2", "h3")), rng.randint(1, 9)))
        elif kind < 0.8:
            parts.append("<ul>" + "".join(_text(rng, "li", rng.randint(2, 20)) for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind < 0.9:  # a link that stands alone has text beside it
            parts += [_link(rng, "p", rng.randint(1, 40), "+"), _text(rng, "p", _length(rng))]
        elif contained and kind < 0.94:
            parts.append(_menu(rng))
        elif not contained:
            parts.append(_text(rng, "div", rng.randint(25, 200)))
        elif contained and kind < 0.97:
            parts.append("<ul>" + "".join(_link(rng, "li", rng.randint(8, 20), "+") for _ in range(rng.randint(2, 5))) + "</ul>")
        elif contained:
            parts.append(rng.choice((f"<div class=share>{_words(rng, 3)}</div>", f"<aside>{_words(rng, _length(rng))}</aside>", f"<section id=comments><p>{_words(rng, _length(rng))}</p></section>", f"<div>+ {_words(rng, _length(rng))}</div>")))
    return "".join(parts)


def _around(rng: random.Random, contained: bool) -> str:
    """What stands before and after the article. Unnamed paragraphs stand there only where the article has a container."""
    made = [_menu(rng), _teasers(rng), f"<nav>{_menu(rng)}</nav>", f"<div class=ad>{_words(rng, _length(rng))}</div>", f"<div>{_words(rng, rng.randint(1, 9))}</div>", f"<footer><p>{_words(rng, _length(rng))}</p></footer>",
            f"<header>{_words(rng, 4)}</header>", f"<form>{_words(rng, _length(rng))}</form>", f"<div class=sidebar><p>{_words(rng, _length(rng))}</p>{_menu(rng)}</div>", f"<div><a href=x>{_words(rng, rng.randint(1, 5))}</a> {_words(rng, 2)}</div>"]
    if not contained:
        made += ["".join(_link(rng, "p", rng.randint(1, 4), "") for _ in range(rng.randint(3, 6)))] * 2
    if contained:
        made += [f"<p>{_words(rng, _length(rng))}</p>", f"<div>{_words(rng, _length(rng))}</div>", _link(rng, "p", rng.randint(1, 30), "")]
    return "".join(rng.choice(made) for _ in range(rng.randint(0, 4)))


def labelled_pages(seed: int = 0, n: int = PAGES) -> list[str]:
    """The labelled table, as pages: the blocks that begin with ``+`` belong to the article. Every third page has no container."""
    out = []
    for i in range(n):
        rng = random.Random(seed * 1_000_003 + i)
        tag = ("article", "main", "")[i % 3]
        body = _body(rng, bool(tag))
        out.append(_around(rng, bool(tag)) + (f"<{tag}>{body}</{tag}>" if tag else rng.choice((body, f"<div>{body}</div>"))) + _around(rng, bool(tag)))
    return out


# Element names of HTML by their part in a page.
RAW = "script|style|title|textarea|noscript|template|svg|iframe|select|button|object|math"
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article aside blockquote details dialog div dl fieldset figure footer form header hgroup main menu nav ol section table td th ul".split())
BOILER = frozenset("aside dialog fieldset footer form header menu nav".split())
MAIN = frozenset("article main".split())
TEXTUAL = frozenset("p pre h1 h2 h3 h4 h5 h6 hgroup blockquote caption figcaption summary dd td address".split())
ITEMS = frozenset("li dt option menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# Names by which pages mark boilerplate; those of reader comments hold in a main container too.
_AFFIX = r"(?:site|page|main|global|top|bottom|left|right|post|article|reader|user)[-_]", r"[-_](?:\d+|area|bar|block|body|bottom|box|buttons?|container|content|form|inner|item|left|links?|list|message|notice|popup|right|section|slot|text|top|unit|wrap|wrapper)"
COMMENT_NAME = re.compile(rf"(?:{_AFFIX[0]})?(?:comments?|commentlist|disqus|discussion|replies|reply|respond)(?:{_AFFIX[1]})*", re.I).fullmatch
LAYOUT_NAME = re.compile(rf"(?:{_AFFIX[0]})?(?:ads?|adverts?|advertisement|banner|breadcrumbs?|complementary|consent|contentinfo|cookies?|footer|gdpr|header|masthead|menu|nav|navbar|navigation|newsletter|notice|pager|pagination|popup|promo|promotion|related(?:[-_](?:posts|articles|stories))?|search|share|sharing|side[-_]?bar|social|sponsor(?:ed)?|subscribe|toolbar|widget)(?:{_AFFIX[1]})*", re.I).fullmatch
_TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.I | re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def _named(attrs: str | None) -> tuple[bool, bool, bool]:
    """Whether class, id or role names a layout part, reader comments, a main container."""
    tokens = [t for x in _NAMED.findall(attrs) for t in (x[0] or x[1] or x[2]).split()] if attrs else ()
    return any(map(LAYOUT_NAME, tokens)), any(map(COMMENT_NAME, tokens)), "main" in tokens


class _Place(NamedTuple):
    """Where text stands: the element, in a main container, in a boilerplate element (``header`` if only in one of a
    main container), in one named so, in reader comments."""

    tag: str = ""
    main: bool = False
    element: str = ""
    layout: bool = False
    comments: bool = False

    def inside(self, tag: str, attrs: str | None) -> _Place:
        layout, comments, main = _named(attrs)
        main = main or tag in MAIN
        element = self.element
        if tag in BOILER and element in ("", "header"):
            element = "header" if tag == "header" and self.main else tag
        return _Place(tag, self.main or main, element if element != "header" or self.main else "boiler", not main and (layout or self.layout), comments or self.comments)

    def boiler(self, heading: bool) -> bool:
        return self.layout or self.comments or bool(self.element and not (self.element == "header" and heading))


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, int]]:
    """Text blocks in page order: text, words, words in links, in the main container, at a boilerplate place, and 0 for bare text, 1 for
    a list item, 2 for a paragraph or heading."""
    out: list[tuple[str, int, int, bool, bool, int]] = []
    stack = [_Place()]
    text: list[str] = []
    linked: list[str] = []
    in_link, at, leaf = False, 0, _Place()

    def flush() -> None:
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            out.append((joined, len(joined.split()), len(html.unescape(" ".join(linked)).split()), leaf.main, leaf.boiler(leaf.tag in HEADINGS), 2 if leaf.tag in TEXTUAL else int(leaf.tag in ITEMS)))
        text.clear()
        linked.clear()

    for m in _TAG.finditer(page):
        piece = page[at : m.start()]
        at = m.end()
        if piece:
            text.append(piece)
            if in_link:
                linked.append(piece)
        name = (m["name"] or "").lower()
        if name == "a":
            in_link = not m["end"]
        elif name == "br":
            text.append(" ")
        if name not in BLOCK:
            continue
        flush()
        if name not in CONTAINER:
            leaf = stack[-1] if m["end"] else stack[-1].inside(name, m["attrs"])
            continue
        if m["end"]:
            if any(x.tag == name for x in stack):
                while stack.pop().tag != name:
                    pass
            in_link = False
        else:
            stack.append(stack[-1].inside(name, m["attrs"]))
        leaf = stack[-1]
    text.append(page[at:])
    flush()
    return out


def features(found: list[tuple[str, int, int, bool, bool, int]]) -> np.ndarray:
    words = np.array([b[1] for b in found], float)
    links = np.array([b[2] for b in found], float) / np.maximum(words, 1)
    main = np.array([b[3] for b in found], float)
    near = lambda x, k: np.concatenate([[0.0], x[:-1]]) if k < 0 else np.concatenate([x[1:], [0.0]])
    return np.column_stack([words, links, near(words, -1), near(links, -1), near(words, 1), near(links, 1), main if main.any() else np.full(len(found), 0.5), [float(b[4]) for b in found], [float(b[5]) for b in found]])


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH, leaf: int = LEAF):
    """A decision tree by Gini impurity: (feature, threshold, low branch, high branch) or a class. Both sides of a split hold
    ``leaf`` rows at least; a split whose sides agree is one leaf."""
    major = int(2 * y.sum() >= len(y))
    if depth == 0 or len(set(y)) == 1:
        return major
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, good = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(v) + 1)
        at = np.flatnonzero((v[1:] > v[:-1]) & (n[:-1] >= leaf) & (len(v) - n[:-1] >= leaf))
        if len(at):
            low, a, b = good[at], n[at], len(v) - n[at]
            high = good[-1] - low
            gini = low * (1 - low / a) + high * (1 - high / b)
            k = int(gini.argmin())
            if best is None or gini[k] < best[0] - 1e-9:
                best = (gini[k], f, (v[at[k]] + v[at[k] + 1]) / 2)
    if best is None:
        return major
    _, f, t = best
    side = x[:, f] <= t
    low, high = grow(x[side], y[side], depth - 1, leaf), grow(x[~side], y[~side], depth - 1, leaf)
    return low if isinstance(low, int) and low == high else (f, t, low, high)


def classify(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, int):
        return np.full(len(x), bool(tree))
    f, t, low, high = tree
    return np.where(x[:, f] <= t, classify(low, x), classify(high, x))


def labelled(seed: int = 0, n: int = PAGES) -> np.ndarray:
    """The features of the labelled pages' blocks, and the label."""
    rows = []
    for page in labelled_pages(seed, n):
        if found := blocks(page):
            rows.append(np.column_stack([features(found), [float(b[0].startswith("+")) for b in found]]))
    return np.concatenate(rows)


@lru_cache(1)
def trained():
    rows = labelled()
    return grow(rows[:, :-1], rows[:, -1])


def article(page: str | None, tree) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return " ".join(b[0] for b, keep in zip(found, classify(tree, features(found))) if keep)


def extract(pages: DataFrame, markup: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` without its markup and with the article's text and length."""
    kept = [c for c in pages.columns if c not in (markup, text, n_chars)]
    tree = trained()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [article(p, tree) for p in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(f"c{i}" for i in range(len(kept))), "t", "n"])

    source = pages.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(kept)), F.col(markup).alias("h"))
    types = "".join(f"c{i} {pages.schema[c].dataType.simpleString()}, " for i, c in enumerate(kept))
    return source.mapInArrow(run, f"{types}t string, n long").toDF(*kept, text, n_chars)


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
