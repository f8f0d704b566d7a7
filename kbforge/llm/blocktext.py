"""Main text of web pages from flat text blocks and a decision tree (operator 3).

A page is cut into text blocks at block-level tags.  Each block gets numbers: its
words and link density, those of the blocks before and after it, and flags for the
tags and class words around it.  A decision tree trained on a small labelled table
(``block_examples``) decides which blocks are the article; their texts are joined
in page order by a line break.  Where the tree keeps no running text (pages of bare text, of
one block, of lines parted by ``br``), the page's dominant blocks are kept: those that
no tag or class word marks, with few links and at least ``DOMINANT`` of the words of the
longest one.  Character references are decoded, white space in a
block (line breaks of ``br`` included) becomes one space.  Scripts, styles,
comments in the markup, forms' controls and hidden parts are not text.

Null html is the empty page; pages without a kept block have text '' and n_chars 0.
Pages of any length are read whole, in one pass whose time grows with the length;
unclosed or misplaced tags end
with the next enclosing end tag, except script, style, textarea and title, which
hold everything up to their own end tag.  A head ends at the latest with the first
text or tag that cannot stand in it.  Repeated rows are separate pages, null ids and
urls are kept.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbforge.llm.common import map_batches
from kbforge.llm.trees import Bins, Tree, grow

# HTML elements by their role.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())       # no tags inside but their own end tag
HIDES = frozenset("noscript template svg math iframe object select option button canvas audio video datalist".split())
IN_LINE = frozenset("svg math noscript".split())                # hidden without ending a block
IN_HEAD = RAW - {"textarea"} | frozenset("base basefont bgsound link meta noscript template head html".split())
# tags of HTML that cannot stand in an svg or math element and so end it
ENDS_DRAWING = frozenset("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 hr li ol p pre table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_SELF = frozenset("p li dt dd tr td th option".split())
# Class, id and role words of what is not the article, and of readers' comments.
ASIDE_WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login notice notices alert "
    "warning share sharing social related recommended recommendations more popular trending sidebar side rail widget "
    "widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar masthead topbar footer header "
    "copyright legal disclaimer contentinfo complementary search dialog skip tags meta byline".split())
# Words that go with an aside word in one name ("share-buttons"); with others ("share-prices", inside
# an article) the name is taken for the article's own.
NEUTRAL_WORDS = frozenset(
    "area article articles bar block blocks bottom box button buttons col column container content group icon icons inner "
    "item items left link links list lists module outer panel post posts right row section slot stories story the title top "
    "unit view wrap wrapper".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion reviews".split())

FEATURES = ("words", "link_density", "words_before", "links_before", "words_after", "links_after", "in_article",
            "page_has_article", "in_nav", "in_aside", "in_header", "in_footer", "in_form", "aside_words",
            "comment_words", "heading", "list_item", "paragraph")

# possessive, so that no tag is read twice; the last alternative is a tag with an unpaired quote
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>"
                  r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.DOTALL)
_BEGUN = re.compile(r"<(?=[a-zA-Z/!?])")
DOMINANT = 0.2
_RAW_ENDS = {name: re.compile(rf"</{name}\b", re.IGNORECASE) for name in sorted(RAW)}
_NAMED = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=\s|/|$)",
                    re.IGNORECASE)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    linked: int          # words inside links
    words: int
    flags: tuple         # in_article, nav, aside, header, footer, form, aside words, comment words
    tag: str


def _roles(name: str, attributes: str, article: bool) -> tuple:
    """Which flags an element turns on for what is inside it; the last says hidden."""
    aside = comment = hidden = False
    if attributes and name not in ("html", "body"):
        for m in _NAMED.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                hidden = True
            elif key == "style":
                hidden |= "display:none" in value.replace(" ", "").lower()
            else:
                pieces = {p.lower() for p in _PIECES.findall(value)}
                comment |= bool(pieces & COMMENT_WORDS)
                if pieces & ASIDE_WORDS and name not in ("article", "main"):
                    aside |= not article or any(_is_aside(token) for token in value.split())
    return (name in ("article", "main"), name in ("nav", "menu"), name in ("aside", "dialog"),
            name == "header", name == "footer", name in ("form", "fieldset"), aside, comment, hidden)


def _is_aside(token: str) -> bool:
    """Whether a name consists of aside words and words that go with them."""
    pieces = {p.lower() for p in _PIECES.findall(token)}
    return bool(pieces & ASIDE_WORDS) and pieces <= ASIDE_WORDS | NEUTRAL_WORDS


def drawing(stack: list, shown: int) -> int:
    """Place of the svg or math element in whose own markup the top of the stack is, 0 if there is none."""
    for k in range(len(stack) - 1, shown - 1, -1):
        if stack[k][0] in ("svg", "math"):
            return k
        if stack[k][0] in ("foreignobject", "annotation-xml", "desc"):
            return 0
    return 0


def blocks(html: str) -> list[Block]:
    """The non-empty text blocks of a page, in order."""
    out: list[Block] = []
    none = (False,) * 9
    stack: list[tuple[str, tuple]] = [("", none)]
    buffer: list[str] = []
    linked: list[str] = []
    in_link, in_head, at, end = 0, False, 0, len(html)
    last = html.rfind(">")                           # no tag ends after it
    comment = html.rfind("<!--")
    # how many elements from the bottom of the stack are not hidden, and open inline elements around hidden ones
    shown, around = 1, Counter()
    opened = Counter()                               # names on the stack

    def flush() -> None:
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                tag, flags = stack[shown - 1]
                out.append(Block(text, len(unescape(" ".join(linked)).split()), text.count(" ") + 1, flags[:8], tag))
            linked.clear()

    def take(text: str) -> None:
        nonlocal in_head
        if text and shown == len(stack):
            in_head = in_head and text.isspace()
            if not in_head:
                buffer.append(text)
                if in_link:
                    linked.append(text)

    def push(name: str, flags: tuple) -> None:
        nonlocal shown
        stack.append((name, flags))
        opened[name] += 1
        if not flags[8]:
            shown = len(stack)

    def cut(size: int) -> None:
        nonlocal shown
        opened.subtract(name for name, _ in stack[size:])
        del stack[size:]
        shown = min(shown, size)

    def place(name: str) -> int:
        """Place of the innermost ``name`` on the stack, 0 if there is none."""
        if not opened[name]:
            return 0
        return next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name)

    def reopen() -> None:
        """End the hidden elements at the top that are open for want of an end tag."""
        cut(next((k for k in range(shown, len(stack)) if stack[k][0] in HIDES), len(stack)))

    while at < end:
        m = _TAG.search(html, at) if at <= max(last, comment) else None
        if m is None:
            unfinished = _BEGUN.search(html, at)     # a tag that the page does not finish is no text
            take(html[at:unfinished.start() if unfinished else end])
            break
        take(html[at:m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        hidden = shown < len(stack)
        if hidden and not closing and name in ENDS_DRAWING and opened["svg"] + opened["math"]:
            cut(drawing(stack, shown) or len(stack))
            hidden = shown < len(stack)
        if in_head and not hidden and not closing and name not in IN_HEAD:
            in_head = False
        if name in ("head", "body"):
            reopen()
            flush()
            in_head = name == "head" and not closing
        elif name in RAW:
            if not closing and not attributes.endswith("/"):
                if not hidden:
                    flush()
                stop = _RAW_ENDS[name].search(html, at)
                at = html.find(">", stop.end()) + 1 or end if stop else end
        elif hidden and not closing and (name in VOID or attributes.endswith("/")):
            continue
        elif hidden and closing and name in INLINE:
            k = place(name)
            if k:
                cut(k)
            elif around[name]:                       # it was opened before what is hidden
                reopen()
                around[name] -= 1
                in_link = 0 if name == "a" else in_link
        elif name in HIDES:
            if closing:
                k = place(name)
                if k:
                    cut(k)
            elif not attributes.endswith("/"):
                if not hidden and name not in IN_LINE:
                    flush()
                k = place(name) if name in ("button", "option", "select") else 0
                if k:                                # these do not stand in themselves
                    cut(k)
                push(name, (*stack[-1][1][:8], True))
        elif name in INLINE and hidden:
            push(name, stack[-1][1])
        elif name == "br":
            take(" ")
        elif name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            if name not in VOID:
                around[name] = max(0, around[name] + (-1 if closing else 1))
        elif closing:
            k = place(name)
            if not hidden or 0 < k <= shown:
                flush()
                in_link = 0
                around.clear()
            if k:
                cut(k)
        else:
            if not hidden:
                flush()
                around.clear()
            if name in CLOSES_SELF and stack[-1][0] == name:
                cut(len(stack) - 1)
            elif stack[-1][0] == "p":                # a block-level tag ends an open paragraph
                cut(len(stack) - 1)
            if name not in VOID:
                own = _roles(name, attributes, stack[-1][1][0])
                push(name, tuple(a or b for a, b in zip(stack[-1][1], own, strict=True)))
    flush()
    return out


def features(page: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` per block."""
    if not page:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b.words for b in page], float)
    links = np.array([min(1.0, b.linked / b.words) for b in page])
    flags = np.array([b.flags for b in page], float)
    shift = lambda v, fill: (np.concatenate([[fill], v[:-1]]), np.concatenate([v[1:], [fill]]))
    (wb, wa), (lb, la) = shift(words, 0.0), shift(links, 1.0)
    has = np.full(len(page), flags[:, 0].max())
    kinds = [[float(b.tag in HEADINGS), float(b.tag in ("li", "dt", "dd")), float(b.tag in ("p", "blockquote", "pre"))]
             for b in page]
    return np.column_stack([words, links, wb, lb, wa, la, flags[:, 0], has, flags[:, 1:], np.array(kinds)])


def train(examples: list[str] | None = None, depth: int = 8) -> Tree:
    """A decision tree from the labelled table: pages whose blocks start with KEEP or DROP."""
    from kbforge.llm.block_examples import pages

    x, y = [], []
    for page in examples if examples is not None else pages():
        parts = blocks(page)
        x.append(features(parts))
        y += [1.0 if b.text.startswith("KEEP") else -1.0 for b in parts]
    table, label = np.concatenate(x), np.array(y)
    return grow(Bins(table, 64), -label, np.ones(len(label)), depth, min_rows=1, ridge=0.1)


@lru_cache(maxsize=1)
def default_tree() -> Tree:
    return train()


def main_text(html: str | None, tree: Tree) -> str:
    page = blocks(html or "")
    if not page:
        return ""
    # what is marked as no article, outside of one, is never kept
    keep = (tree.score(features(page)) > 0) & ~np.array([b.flags[6] and not b.flags[0] for b in page])
    if not any(k and b.tag not in HEADINGS for b, k in zip(page, keep, strict=True)):
        plain = [not any(b.flags[1:]) and b.tag not in HEADINGS and b.linked <= 0.3 * b.words for b in page]
        longest = max((b.words for b, p in zip(page, plain, strict=True) if p), default=0)
        keep |= np.array([p and b.words >= DOMINANT * longest for b, p in zip(page, plain, strict=True)])
    return "\n".join(b.text for b, k in zip(page, keep, strict=True) if k)


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    sent = pages.sparkSession.sparkContext.broadcast(tree or default_tree())

    def run(batch: pa.RecordBatch) -> dict:
        text = [main_text(h.as_py(), sent.value) for h in batch.column(2)]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": text, "n_chars": [len(t) for t in text]}

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return map_batches(rows, run, "page_id long, url string, text string, n_chars long")
