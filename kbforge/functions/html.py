"""STR-1 / STR-3: HTML -> one line of text, code wrapped in triple-backtick marks.

Rules (the behaviour of a tree-building HTML parser followed by
"text joined by one space, whitespace collapsed"):

1. null -> ``""``.
2. Every string between two markup events is one text node; nodes are joined by
   one space, then Unicode whitespace collapses and the ends are stripped.
3. A ``<code>`` element becomes ``\\n```\\n`` + its text joined with nothing +
   ``\\n```\\n``.  Nested code inside code gives one pair of marks.
4. An end tag closes every element back to the nearest open element of the same
   name; an end tag with no open element is ignored.  Void elements never open.
5. Comments, doctype, processing instructions, and text inside ``script``,
   ``style``, ``template``, ``rt``, ``rp`` are dropped; ``title`` text is kept.
6. Entities are decoded once, after markup is recognised; an unknown named
   entity ``&foo;`` stays as ``&foo``; numeric references below 256 are read as
   windows-1252.

Two implementations produce the same output:

* :func:`clean_html_regex` — pure JVM regular expressions, valid for HTML that
  :func:`regex_safe` accepts (code blocks closed with no markup inside, only a
  known entity set, no stray ``<``, no quoted ``>``, closed script/style/comments).
* :func:`clean_html_parsed` — an Arrow pandas UDF over the standard library
  parser with an open-element stack; handles everything.

:func:`clean_html` routes each row: the UDF receives only the rows the regex
path cannot handle (others are passed as null), so most rows stay in codegen.
"""

from __future__ import annotations

import html.entities
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import collapse_ws

# ---------------------------------------------------------------------------
# Fixed values (parser behaviour that output parity depends on)
# ---------------------------------------------------------------------------
# Elements whose text never reaches the output.
HIDDEN_TEXT_TAGS = ["script", "style", "template", "rt", "rp"]
# Elements that are always empty (never pushed on the open-element stack).
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link",
    "menuitem", "meta", "param", "source", "track", "wbr", "basefont", "bgsound",
    "command", "frame", "image", "isindex", "nextid", "spacer",
]
CODE_OPEN = "\n```\n"
CODE_CLOSE = "\n```\n"
# Entities the regex path decodes (applied after tags are removed; &amp; last).
REGEX_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                  ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·")]
# ---------------------------------------------------------------------------

_HIDDEN = set(HIDDEN_TEXT_TAGS)
_VOID = set(VOID_TAGS)
_PY_WS = re.compile(r"\s+")


def _charref(name: str) -> str:
    try:
        n = int(name[1:], 16) if name[:1] in ("x", "X") else int(name)
    except ValueError:
        return "&#" + name
    if n < 256:
        try:
            b = bytes([n]).decode("windows-1252")
            if b:
                return b
        except UnicodeDecodeError:
            pass
    try:
        return chr(n)
    except (ValueError, OverflowError):
        return "�"


class _TextCollector(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.stack: list[str] = []
        self.pieces: list[str] = []
        self.buf: list[str] = []        # pending text node
        self.code_buf: list[str] | None = None
        self.code_depth_at: int | None = None  # stack index of the outermost open <code>

    # -- text nodes -------------------------------------------------------
    def _hidden(self) -> bool:
        return any(t in _HIDDEN for t in self.stack)

    def _flush(self):
        if not self.buf:
            return
        text = "".join(self.buf)
        self.buf = []
        if self.code_buf is not None:
            if not self._hidden_inside_code():
                self.code_buf.append(text)
        elif not self._hidden():
            self.pieces.append(text)

    def _hidden_inside_code(self) -> bool:
        return any(t in _HIDDEN for t in self.stack[self.code_depth_at + 1:])

    def handle_data(self, data):
        self.buf.append(data)

    def handle_entityref(self, name):
        ch = html.entities.html5.get(name + ";")
        self.buf.append(ch if ch is not None else "&" + name)

    def handle_charref(self, name):
        self.buf.append(_charref(name))

    # -- markup -----------------------------------------------------------
    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag in _VOID:
            return
        self.stack.append(tag)
        if tag == "code" and self.code_buf is None:
            self.code_buf = []
            self.code_depth_at = len(self.stack) - 1

    def handle_startendtag(self, tag, attrs):
        self._flush()
        if tag == "code" and self.code_buf is None:
            self.pieces.append(CODE_OPEN + CODE_CLOSE)

    def handle_endtag(self, tag):
        self._flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i] == tag:
                del self.stack[i:]
                if self.code_buf is not None and i <= self.code_depth_at:
                    self._close_code()
                return

    def _close_code(self):
        self.pieces.append(CODE_OPEN + "".join(self.code_buf) + CODE_CLOSE)
        self.code_buf = None
        self.code_depth_at = None

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def unknown_decl(self, data):
        self._flush()
        if data.startswith("CDATA["):
            self.buf.append(data[len("CDATA["):])
            self._flush()

    def result(self) -> str:
        self.close()
        self._flush()
        if self.code_buf is not None:
            self._close_code()
        return _PY_WS.sub(" ", " ".join(self.pieces)).strip()


def clean_html_py(doc: str | None) -> str:
    """Reference implementation for one document (plain Python)."""
    if doc is None or (isinstance(doc, float) and pd.isna(doc)):
        return ""
    p = _TextCollector()
    p.feed(str(doc))
    return p.result()


@F.pandas_udf(T.StringType())
def _clean_html_parsed(docs: pd.Series) -> pd.Series:
    return docs.map(lambda d: None if d is None else clean_html_py(d))


# Arrow batch UDF over :func:`clean_html_py`; null input -> null output.  Marked
# non-deterministic only so the optimizer never copies the cleaning expression
# into a pushed-down filter (which would parse every document twice).
clean_html_parsed = _clean_html_parsed.asNondeterministic()


# Anything the regex path does not reproduce exactly sends the row to the parser.
_UNSAFE = "|".join([
    # code blocks are handled when closed with no markup inside; anything else
    # (nested, unclosed, tags inside) and code next to template/rt/rp go to the parser
    r"(?i)<code\b(?![^>]*>[^<]*</code\s*>)",
    r"(?i)<code\b[^>]*/>",
    # a tag that another one begins in
    r"<[A-Za-z/][^<>]*<",
    r"(?is)^(?=.*<code\b)(?=.*<(?:template|rt|rp)\b)",
    r"&(?!(?:amp|lt|gt|quot|nbsp|copy|middot|#39);|amp[^A-Za-z0-9;])",
    r"<(?![A-Za-z/!?])",
    r"</(?![A-Za-z])",
    r"<[A-Za-z][^<>]*=\s*\"[^\"]*>",
    r"<[A-Za-z][^<>]*=\s*'[^']*>",
    r"(?is)<(script|style|template|rt|rp)\b(?!.*</\1\s*>)",
    r"(?s)<!--(?!.*-->)",
    r"(?i)<!\[CDATA\[",
])


def regex_safe(doc: Column) -> Column:
    return ~doc.rlike(_UNSAFE)


def clean_html_regex(doc: Column) -> Column:
    """Code-free HTML cleaning with JVM regular expressions."""
    x = F.regexp_replace(doc, r"(?is)<(script|style|template|rt|rp)\b.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?i)<code\b[^>]*>([^<]*)</code\s*>", " \n```\n$1\n```\n ")
    x = F.regexp_replace(x, r"<[!?/]?[A-Za-z][^>]*>|<![^>]*>|<\?[^>]*>", " ")
    for ent, ch in REGEX_ENTITIES:
        x = F.replace(x, F.lit(ent), F.lit(ch))
    x = F.regexp_replace(x, "&amp;?", "&")
    return collapse_ws(x)


def clean_html(doc: Column) -> Column:
    """STR-1 with routing: regex path where safe, parser UDF otherwise."""
    safe = regex_safe(doc)
    parsed = clean_html_parsed(F.when(doc.isNotNull() & ~safe, doc))
    return (F.when(doc.isNull(), F.lit(""))
            .when(safe, clean_html_regex(doc))
            .otherwise(parsed))


@F.pandas_udf(T.StringType())
def _clean_html_sql(docs: pd.Series) -> pd.Series:
    return docs.map(clean_html_py)


def register_sql(spark, name: str = "clean_html") -> None:
    """Make STR-1 callable from SQL text, in Arrow batches: ``SELECT clean_html(body) FROM posts``."""
    spark.udf.register(name, _clean_html_sql)


__all__ = ["clean_html", "register_sql", "clean_html_regex", "clean_html_parsed", "clean_html_py", "regex_safe"]
