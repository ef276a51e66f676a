"""Main text of web pages from flat text blocks and a decision tree.

A page becomes a flat list of text blocks, cut at block-level tags.  A block's
features are its word count and link density, those of the block before and
after it, whether it is a heading, and whether an element around it is named
as an article or as page furniture.  A decision tree, trained on the small
labelled table below, says which blocks are text; they are joined in page
order.

Defined cases: null or empty html and pages without text give an empty text;
comments, scripts, styles, markup declarations and other elements without
prose are skipped; a ``<`` that opens no tag is text; unclosed elements end
with their parent; a null or repeated ``page_id`` is a row of its own; other
columns are not read.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, importable

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "furniture", "article")
#: Labelled blocks: the features in their order (link densities in per cent), then 1 for text.
LABELLED = np.array([
    # inside an article: prose, short lines and headings are text
    (60, 0, 12, 0, 45, 0, 0, 0, 1, 1), (35, 3, 60, 0, 20, 0, 0, 0, 1, 1), (12, 0, 40, 5, 33, 0, 0, 0, 1, 1), (1, 0, 80, 0, 75, 0, 0, 0, 1, 1),
    (3, 0, 25, 0, 40, 2, 0, 0, 1, 1), (2, 0, 2, 0, 3, 0, 0, 0, 1, 1), (150, 10, 0, 0, 8, 0, 0, 0, 1, 1), (22, 30, 50, 0, 60, 0, 0, 0, 1, 1),
    (40, 20, 7, 100, 9, 100, 0, 0, 1, 1), (6, 0, 5, 0, 90, 0, 1, 0, 1, 1), (2, 0, 30, 0, 45, 0, 1, 0, 1, 1), (9, 0, 4, 100, 70, 0, 1, 0, 1, 1),
    (1, 0, 0, 0, 0, 0, 0, 0, 1, 1), (5, 40, 44, 0, 38, 0, 0, 0, 1, 1), (8, 50, 30, 0, 52, 0, 0, 0, 1, 1),
    (8, 0, 30, 0, 2, 100, 0, 0, 1, 1), (1, 0, 25, 0, 3, 100, 0, 0, 1, 1), (15, 0, 2, 100, 2, 100, 0, 0, 1, 1), (4, 0, 1, 100, 3, 100, 1, 0, 1, 1),
    (2, 0, 3, 50, 40, 30, 0, 0, 1, 1), (11, 5, 70, 20, 5, 60, 0, 0, 1, 1), (6, 0, 0, 0, 9, 100, 0, 0, 1, 1), (13, 35, 4, 100, 6, 100, 0, 0, 1, 1),
    (3, 0, 2, 100, 70, 0, 1, 0, 1, 1), (1, 0, 4, 90, 5, 80, 0, 0, 1, 1),
    # inside an article, but lists of links
    (2, 100, 2, 100, 2, 100, 0, 0, 1, 0), (4, 100, 30, 0, 3, 100, 0, 0, 1, 0), (3, 100, 4, 100, 25, 0, 0, 0, 1, 0), (6, 90, 3, 100, 5, 100, 0, 0, 1, 0),
    (9, 100, 6, 100, 0, 0, 0, 0, 1, 0), (5, 100, 40, 0, 35, 0, 0, 0, 1, 0), (12, 95, 60, 0, 0, 0, 0, 0, 1, 0), (2, 100, 0, 0, 90, 0, 0, 0, 1, 0),
    (4, 100, 50, 0, 90, 0, 0, 0, 1, 0), (3, 100, 9, 0, 70, 0, 0, 0, 1, 0),     (8, 85, 22, 0, 18, 0, 0, 0, 1, 0),
    # furniture by name, whatever it looks like
    (1, 100, 1, 100, 1, 100, 0, 1, 0, 0), (2, 100, 0, 0, 1, 100, 0, 1, 0, 0), (7, 0, 1, 100, 9, 0, 0, 1, 0, 0), (12, 0, 2, 100, 60, 0, 0, 1, 0, 0),
    (45, 0, 7, 0, 80, 0, 0, 1, 0, 0), (80, 0, 60, 0, 70, 0, 0, 1, 0, 0), (9, 10, 70, 0, 0, 0, 0, 1, 0, 0), (25, 0, 120, 0, 3, 0, 0, 1, 0, 0),
    (5, 0, 50, 0, 30, 0, 1, 1, 0, 0), (3, 0, 10, 0, 12, 0, 1, 1, 0, 0), (30, 0, 55, 0, 40, 0, 0, 1, 1, 0), (6, 0, 55, 0, 70, 0, 0, 1, 1, 0),
    (4, 100, 55, 0, 20, 0, 0, 1, 1, 0), (15, 0, 4, 0, 14, 0, 0, 1, 1, 0), (2, 0, 33, 0, 90, 0, 1, 1, 1, 0), (1, 0, 2, 0, 2, 0, 0, 1, 1, 0),
    (120, 2, 90, 0, 15, 0, 0, 1, 0, 0), (18, 5, 6, 100, 0, 0, 0, 1, 0, 0),
    # neither named: long prose is text, so are short lines amid it
    (50, 0, 40, 0, 60, 0, 0, 0, 0, 1), (25, 5, 30, 0, 22, 0, 0, 0, 0, 1), (18, 0, 12, 0, 40, 0, 0, 0, 0, 1), (70, 15, 3, 100, 2, 100, 0, 0, 0, 1),
    (16, 0, 2, 100, 50, 0, 0, 0, 0, 1), (30, 25, 45, 0, 28, 0, 0, 0, 0, 1), (4, 0, 50, 0, 45, 0, 0, 0, 0, 1), (7, 0, 25, 0, 31, 0, 0, 0, 0, 1),
    (20, 0, 60, 0, 2, 100, 0, 0, 0, 1), (110, 0, 0, 0, 0, 0, 0, 0, 0, 1), (6, 0, 3, 100, 55, 0, 1, 0, 0, 1), (3, 0, 40, 0, 35, 0, 1, 0, 0, 1),
    (8, 0, 0, 0, 48, 0, 1, 0, 0, 1), (2, 0, 28, 0, 41, 0, 1, 0, 0, 1),
    # neither named: short lines by themselves and links are not
    (2, 100, 3, 100, 2, 100, 0, 0, 0, 0), (5, 0, 2, 100, 3, 100, 0, 0, 0, 0), (3, 0, 1, 0, 2, 0, 0, 0, 0, 0), (6, 50, 4, 60, 7, 80, 0, 0, 0, 0),
    (14, 90, 30, 0, 20, 100, 0, 0, 0, 0), (20, 80, 12, 100, 16, 100, 0, 0, 0, 0), (4, 100, 45, 0, 50, 0, 0, 0, 0, 0), (9, 0, 3, 100, 0, 0, 0, 0, 0, 0),
    (7, 0, 0, 0, 2, 100, 0, 0, 0, 0), (8, 0, 35, 0, 2, 100, 0, 0, 0, 0), (3, 0, 2, 100, 2, 100, 1, 0, 0, 0), (2, 0, 4, 0, 3, 100, 1, 0, 0, 0),
    (12, 0, 2, 100, 70, 0, 0, 0, 0, 0), (10, 0, 0, 0, 65, 0, 0, 0, 0, 0), (5, 0, 3, 100, 30, 0, 0, 0, 0, 0), (11, 0, 4, 80, 40, 0, 0, 0, 0, 0),
    (3, 100, 5, 100, 80, 0, 0, 0, 0, 0), (2, 0, 2, 0, 95, 0, 0, 0, 0, 0), (4, 90, 2, 100, 60, 0, 0, 0, 0, 0), (8, 0, 1, 0, 33, 0, 0, 0, 0, 0),
    (10, 20, 5, 0, 4, 50, 0, 0, 0, 0), (40, 70, 6, 100, 5, 100, 0, 0, 0, 0),
], float)

#: Element names of HTML, and words that name page furniture or articles.
_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
             "hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = set("noscript template svg math object select datalist button canvas audio video map applet head".split())
_LEAF = set("p h1 h2 h3 h4 h5 h6 li dt dd td th option".split())
_FURNITURE = set("nav footer aside form menu dialog search fieldset".split())
_NAMES = set("ad ads adbox adsense advert adverts advertisement advertising advertorial banner promo promotion sponsor sponsored nav navbar navigation menu "
             "breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets related recommended recommendations share sharing social cookie "
             "cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay login signin search form comment comments "
             "commentlist reply replies discussion respond disqus pagination pager toolbar copyright legal disclaimer skip paywall".split())
_ARTICLE = set("article content post entry story main prose".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>
    |<(?P<raw>script|style|textarea|title|xmp|iframe|noembed|noframes)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)\b[^>]*>|\Z)
    |<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(?P<end2>/?)(?P<name2>[a-z][^\s/>]*+)[^>]*+>""", re.I | re.S | re.X)
_ATTR = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPLIT = re.compile(r"[^a-z]+")
_NOT = re.compile(r"\b(?:has|with|no|without)[-_](?:the[-_])?[a-z]+", re.I)


def _named(name: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element is named as furniture, as an article."""
    if name in ("article", "main"):
        return False, True
    furniture, article = name in _FURNITURE, False
    if attrs and name not in ("body", "html"):
        for _, a, b, c in _ATTR.findall(attrs):
            words = set(_SPLIT.split(_CAMEL.sub(" ", _NOT.sub(" ", a or b or c)).lower()))
            furniture = furniture or not words.isdisjoint(_NAMES)
            article = article or not words.isdisjoint(_ARTICLE)
    return furniture, article and not furniture


def text_blocks(html: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """(text, words, linked words, heading, furniture, article) of each block."""
    out: list[tuple] = []
    stack: list[tuple[str, bool, bool]] = []  # element, inside furniture, inside an article
    parts: list[str] = []
    linked = 0
    link = False
    skip = ""
    deep = 0

    def close():
        nonlocal linked
        if parts:
            words = "".join(parts).split()
            if words:
                _, furniture, article = stack[-1] if stack else ("", False, False)
                out.append((" ".join(words), len(words), min(linked, len(words)), any(len(e[0]) == 2 and e[0][0] == "h" and e[0] != "hr" for e in stack[-2:]), furniture, article))
            parts.clear()
        linked = 0

    def text(raw: str):
        nonlocal linked
        if raw and not skip:
            raw = unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if link:
                linked += len(raw.split())

    at = 0
    for m in _TOKEN.finditer(html):
        text(html[at:m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name, end, attrs = name.lower(), m["end"] or m["end2"], m["attrs"] or ""
        if skip:
            if name == skip:
                deep += -1 if end else not attrs.endswith("/")
                if deep <= 0:
                    skip = ""
            elif name == "body":  # a head that was never closed
                skip = ""
            if skip or name in _SKIP:
                continue
        if name in _SKIP:
            if not end and not attrs.endswith("/"):
                skip, deep = name, 1
            continue
        if name == "br":
            parts.append(" ")
        elif name == "a":
            link = not end
        elif name in _BLOCK:
            close()
            link = False
            if end:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                    if name in _LEAF and stack[i][0] not in _LEAF:
                        break  # a stray end of a leaf closes nothing around it
            elif name not in _VOID:
                while stack and stack[-1][0] in _LEAF and (stack[-1][0][0] in "ph" or stack[-1][0] == name):
                    stack.pop()  # a new block ends an open paragraph, an item ends the one before
                _, furniture, article = stack[-1] if stack else ("", False, False)
                own = _named(name, attrs)
                if name == "header":  # of the page; an article's own header has its title
                    own = (not article, False)
                stack.append((name, furniture or own[0], article or own[1]))
    text(html[at:])
    close()
    return out


def features(blocks: list[tuple]) -> list[tuple]:
    around = [(0, 0.0), *((w, 100.0 * k / w) for _, w, k, *_ in blocks), (0, 0.0)]
    return [(*around[i + 1], *around[i], *around[i + 2], float(b[3]), float(b[4]), float(b[5])) for i, b in enumerate(blocks)]


def train_tree(table: np.ndarray, depth: int = 7, least: int = 2):
    """A tree (feature, bound, at most, above) or a label, split by Gini impurity."""
    y = table[:, -1]
    if depth == 0 or len(set(y.tolist())) == 1 or len(y) < 2 * least:
        return int(2 * y.sum() >= len(y))
    best = None
    for f in range(table.shape[1] - 1):
        values = np.unique(table[:, f])
        for bound in (values[1:] + values[:-1]) / 2:
            low = table[:, f] <= bound
            if min(low.sum(), (~low).sum()) >= least:
                cost = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
                if best is None or cost < best[0] - 1e-12:
                    best = cost, f, float(bound), low
    if best is None:
        return int(2 * y.sum() >= len(y))
    _, f, bound, low = best
    a, b = train_tree(table[low], depth - 1, least), train_tree(table[~low], depth - 1, least)
    return a if a == b and isinstance(a, int) else (f, bound, a, b)


def is_text(tree, x: tuple) -> bool:
    while not isinstance(tree, int):
        f, bound, low, high = tree
        tree = low if x[f] <= bound else high
    return tree == 1


def main_text(html: str | None, tree) -> str:
    blocks = text_blocks(html or "")
    return "\n\n".join(b[0] for b, x in zip(blocks, features(blocks)) if is_text(tree, x))


def _extracted(tree):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = [main_text(h.as_py(), tree) for h in part.column("html")]
                yield from batches_of({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()),
                                       "n_chars": pa.array(map(len, texts), pa.int64())}, schema)
    return run


def extract(pages: DataFrame, labelled: np.ndarray = LABELLED) -> DataFrame:
    """page_id, url, text, n_chars per row of ``pages`` (page_id, url, html)."""
    importable(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(_extracted(train_tree(labelled)), "page_id bigint, url string, text string, n_chars bigint")
