"""STR-* and FLT-3 with inline fixtures, plus properties against Python."""
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kbforge.functions import text as TX
from kbforge.functions.html import clean_html, clean_html_parsed, clean_html_py, clean_html_regex, regex_safe

from conftest import SF01

HTML_CASES = [
    (None, ""),
    ("<p>a</p><p>b</p>", "a b"),
    ("<b>foo</b>.", "foo ."),
    ("<p>Use <code>x = 1</code>.</p>", "Use ``` x = 1 ``` ."),
    ("<code>a<b>b</b></code>", "``` ab ```"),
    ("<code>x<code>y</code>z</code>", "``` xyz ```"),
    ("<p><code>foo</p>bar", "``` foo ``` bar"),
    ("&lt;b&gt; &amp;lt; &nbsp;x", "<b> &lt; x"),
    ('a<!-- c -->b<script>var t="</p>";</script>d', "a b d"),
    ("<title>T</title><style>p{}</style><p>x", "T x"),
    ("a&amp;b &unknownent; c", "a&b &unknownent c"),
]


@pytest.mark.parametrize("html,expected", HTML_CASES)
def test_clean_html_python(html, expected):
    assert clean_html_py(html) == expected


def test_clean_html_spark_routes_and_matches(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(HTML_CASES)], "i int, h string")
    got = {r["i"]: r["t"] for r in df.select("i", clean_html(F.col("h")).alias("t")).collect()}
    assert got == {i: e for i, (_, e) in enumerate(HTML_CASES)}


def test_regex_path_equals_parser_on_pages(spark):
    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    cmp = pages.select(regex_safe(F.col("html")).alias("safe"), clean_html_regex(F.col("html")).alias("r"),
                       clean_html_parsed(F.col("html")).alias("p"))
    rows = cmp.collect()
    assert all(r["safe"] for r in rows)
    assert sum(r["r"] != r["p"] for r in rows) == 0


def test_code_marks_keep_inner_text():
    assert clean_html_py("<pre><code>def f():\n    return 1</code></pre>") == "``` def f(): return 1 ```"


def test_whitespace_fixture(spark):
    s = "a b\u0085c\u001cd e \tf​g"
    got = spark.createDataFrame([(s,)], "s string").select(TX.collapse_ws(F.col("s"))).first()[0]
    assert got == "a b c d e f​g"


_ws_chars = st.sampled_from([" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", "\x85",
                             "\xa0", " ", " ", " ", " ", " ", " ", " ",
                             " ", "　", "​", "a", "b", "é", "x"])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(_ws_chars, max_size=30), min_size=1, max_size=8))
def test_collapse_matches_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(TX.collapse_ws(F.col("s"))).collect()]
    assert got == [re.sub(r"\s+", " ", t).strip() for t in texts]


def test_validation_classes(spark):
    cases = [("abcd", "too_short", None), ("     ", "empty_after_strip", None), ("  hello  ", "ok", "hello"),
             ("x" * 1000, "ok", "x" * 1000), ("x" * 1001, "too_long", None)]
    df = spark.createDataFrame([(c,) for c, _, _ in cases], "q string")
    st_, clean = TX.validate_question(F.col("q"))
    got = [(r[0], r[1]) for r in df.select(st_, clean).collect()]
    assert got == [(s, c) for _, s, c in cases]


def test_ellipsis_modes(spark):
    df = spark.createDataFrame([("x" * 60,), ("x" * 61,), ("short",)], "s string")
    r = df.select(TX.ellipsis(F.col("s"), 60).alias("a"), TX.ellipsis(F.col("s"), 80, "always").alias("b")).collect()
    assert r[0]["a"] == "x" * 60 and r[1]["a"] == "x" * 60 + "..." and r[2]["a"] == "short"
    assert r[2]["b"] == "short..."


def test_fixed1_rounds_like_python(spark):
    vals = [0.25, 12.35, 49.95, 0.05, 99.95, 12.25, 0.75]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(TX.fixed1(F.col("x"))).collect()]
    assert got == [f"{v:.1f}" for v in vals]


def test_model_label_and_error_action(spark):
    df = spark.createDataFrame([("llama-3.3-70b-versatile", "Error code: 404"), ("gemma", "timeout"),
                                ("a-b", None)], "m string, e string")
    r = df.select(TX.model_label(F.col("m")), TX.error_action(F.col("e"))).collect()
    assert [tuple(x) for x in r] == [("llama-3.3", "retry"), ("gemma", "fail"), ("a-b", "none")]


# --- generated HTML: wherever the regex path claims a document, it equals the parser ---
_words = st.sampled_from(["a", "b", "x y", "é", "Tom & Jerry", "1 < 2", "q\"q", "it's", "  ", "\n", "\xa0",
                          "&amp;", "&amp", "&lt;", "&gt;", "&quot;", "&copy;", "&middot;", "&nbsp;", "&#39;",
                          "&amp;lt;", "&foo;", "&#169;", "x&ampy", "<code/>", "<code />", "<b", "</i", "</template>",
                          "</script>", "<template>", "<style>", "</style>"])
_tags = st.sampled_from(["p", "b", "i", "div", "span", "li", "h1", "title", "a", "em", "code", "pre"])


@st.composite
def _html(draw, depth=0):
    parts = []
    for _ in range(draw(st.integers(0, 4))):
        kind = draw(st.integers(0, 9 if depth < 3 else 3))
        if kind <= 3:
            parts.append(draw(_words))
        elif kind == 4:
            parts.append("<!-- " + draw(_words) + " -->")
        elif kind == 5:
            parts.append('<script>var t="</p>";</script>')
        elif kind == 6:
            parts.append("<br>")
        else:
            tag = draw(_tags)
            attr = draw(st.sampled_from(["", ' class="c"', " href='/x'", ' title="a>b"']))
            close = draw(st.booleans())
            parts.append(f"<{tag}{attr}>" + draw(_html(depth + 1)) + (f"</{tag}>" if close else ""))
    return "".join(parts)


@settings(max_examples=60, deadline=None)
@given(st.lists(_html(), min_size=1, max_size=10))
def test_regex_path_matches_parser_where_safe(spark, docs):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, h string")
    rows = df.select("i", regex_safe(F.col("h")).alias("safe"), clean_html_regex(F.col("h")).alias("r"),
                     clean_html(F.col("h")).alias("routed")).collect()
    for r in rows:
        expect = clean_html_py(docs[r["i"]])
        assert r["routed"] == expect, docs[r["i"]]
        if r["safe"]:
            assert r["r"] == expect, docs[r["i"]]


_texty = st.text(st.sampled_from(list("ab é") + ["\t", "\n", "\xa0", " ", "😀", "𝔸", "\x85", "x"]),
                 max_size=1100)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(_texty, _texty), min_size=1, max_size=6))
def test_cuts_templates_validation_match_python(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    status, clean = TX.validate_question(F.col("a"))
    rows = df.select("i", TX.ellipsis(F.col("a"), 60).alias("e60"), TX.ellipsis(F.col("a"), 180, "strip").alias("s180"),
                     TX.doc_template(F.col("b"), F.col("a"), F.col("b")).alias("doc"),
                     status.alias("st"), clean.alias("q")).collect()
    for r in rows:
        a, b = pairs[r["i"]]
        assert r["e60"] == a[:60] + ("..." if len(a) > 60 else "")
        assert r["s180"] == a[:180].strip() + "..."
        assert r["doc"] == f"Q: {b}\n{a[:600]}\n\nA: {b[:900]}"
        want = ("too_short" if len(a) < 5 else "too_long" if len(a) > 1000
                else "empty_after_strip" if not a.strip() else "ok")
        assert r["st"] == want
        assert r["q"] == (a.strip() if want == "ok" else None)
