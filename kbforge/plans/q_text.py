"""Registered string / record function queries (STR-1 ... STR-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions.html import clean_html
from ..session import spread
from . import adapters as A
from . import sqltext as S
from .registry import register


@register("str1_clean_html_pages", f"SELECT page_id, {S.clean_html('html')} AS text FROM pages")
def str1(spark: SparkSession, sf: str) -> DataFrame:
    p = spread(A.table(spark, sf, "pages"))
    return p.select("page_id", clean_html(F.col("html")).alias("text"))


@register("str3_code_marks", f"""
SELECT doc_id, CASE WHEN body = '' THEN '' ELSE body || ' ' END || '``` ' || lang || ' ``` end' AS text
FROM (SELECT doc_id, lang, {S.collapse_ws('text')} AS body FROM documents)""")
def str3(spark: SparkSession, sf: str) -> DataFrame:
    """STR-3: a page made of every document, with its language in a code block."""
    d = A.table(spark, sf, "documents")
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<p>"), escaped, F.lit("</p><code class='x'>"), F.col("lang"), F.lit("</code><p>end</p>"))
    return d.select("doc_id", clean_html(page).alias("text"))


@register("str2_collapse_whitespace", f"SELECT doc_id, {S.collapse_ws('text')} AS text FROM documents")
def str2(spark: SparkSession, sf: str) -> DataFrame:
    d = A.table(spark, sf, "documents")
    return d.select("doc_id", TX.collapse_ws(F.col("text")).alias("text"))


@register("str4_document_template", f"""
SELECT conv_id AS id, 'Q: ' || left(text, 60) || {S.NL} || left(text, 600) || {S.NL} || {S.NL} || 'A: ' || left(text, 900) AS document
FROM conversations""")
def str4(spark: SparkSession, sf: str) -> DataFrame:
    """Template over every turn (title = first 60 characters, question and answer = the turn)."""
    c = A.table(spark, sf, "conversations")
    t = F.col("text")
    return c.select(F.col("conv_id").alias("id"),
                    TX.doc_template(F.substring(t, 1, 60), t, t).alias("document"))


def _sql_ellipsis(x: str, n: int, mode: str) -> str:
    cut = f"left({x}, {n})"
    if mode == "if_longer":
        return f"CASE WHEN length({x}) > {n} THEN {cut} || '...' ELSE {x} END"
    if mode == "always":
        return f"{cut} || '...'"
    if mode == "never":
        return cut
    return f"{S.py_strip(cut)} || '...'"


_ELLIPSIS = [("q60", 60, "if_longer"), ("s55", 55, "if_longer"), ("a80", 80, "always"),
             ("n50", 50, "never"), ("p180", 180, "strip")]


@register("str5_ellipsis", "SELECT doc_id, " + ", ".join(
    f"{_sql_ellipsis('text', n, m)} AS {name}" for name, n, m in _ELLIPSIS) + " FROM documents")
def str5(spark: SparkSession, sf: str) -> DataFrame:
    d = A.table(spark, sf, "documents")
    return d.select("doc_id", *[TX.ellipsis(F.col("text"), n, m).alias(name) for name, n, m in _ELLIPSIS])


def _model_name_sql(x: str) -> str:
    return f"replace(lower({x}), ' ', '-')"


@register("str7_model_label", f"""
SELECT p_partkey, array_to_string(string_split({_model_name_sql('p_type')}, '-')[1:2], '-') AS label FROM part""")
def str7(spark: SparkSession, sf: str) -> DataFrame:
    p = A.table(spark, sf, "part")
    name = F.replace(F.lower("p_type"), F.lit(" "), F.lit("-"))
    return p.select("p_partkey", TX.model_label(name).alias("label"))


# Error messages attached to event types (a mapping parameter applied to events).
EVENT_ERRORS = {
    "error": "Error code: 404 - {'error': {'code': 'model_not_found'}}",
    "signup": "Error code: 429 - rate limit reached",
    "view": "The model `x` does not exist or you do not have access to it.",
}


def _event_error_sql(x: str) -> str:
    whens = " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in EVENT_ERRORS.items())
    return f"CASE {x} {whens} END"


def event_error(col) -> F.Column:
    e = F.lit(None).cast("string")
    expr = None
    for k, v in EVENT_ERRORS.items():
        expr = (F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v)))
    return expr.otherwise(e)


@register("str8_error_action", f"""
SELECT event_id, CASE WHEN {_event_error_sql('event_type')} IS NULL THEN 'none'
  WHEN contains({_event_error_sql('event_type')}, '404') OR contains({_event_error_sql('event_type')}, 'model_not_found')
    OR contains({_event_error_sql('event_type')}, 'does not exist') THEN 'retry' ELSE 'fail' END AS action
FROM events""")
def str8(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "events")
    return e.select("event_id", TX.error_action(event_error(F.col("event_type"))).alias("action"))


@register("str9_defaults", """
SELECT d.doc_id, coalesce(CASE WHEN l.doc_id IS NOT NULL THEN d.source END, 'Unknown') AS title,
       coalesce(l.quality, 0) AS score
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def str9(spark: SparkSession, sf: str) -> DataFrame:
    d = A.table(spark, sf, "documents")
    lab = A.table(spark, sf, "labels")
    j = d.join(lab, d["doc_id"] == lab["doc_id"], "left")
    return j.select(d["doc_id"], TX.default_title(F.when(lab["doc_id"].isNotNull(), d["source"])).alias("title"),
                    TX.default_score(lab["quality"]).alias("score"))


@register("str10_clock_label", "SELECT event_id, strftime(ts, '%H:%M') AS hhmm FROM events")
def str10(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "events")
    return e.select("event_id", TX.clock_label(F.col("ts")).alias("hhmm"))


@register("str11_session_elapsed", """
SELECT user_id, CAST((epoch_us(max(ts)) - epoch_us(min(ts)) + 500) // 1000 AS BIGINT) / 1000.0 AS elapsed_s
FROM events GROUP BY user_id""")
def str11(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "events")
    g = e.groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return g.select("user_id", TX.elapsed_seconds(F.col("first"), F.col("last"), 3).alias("elapsed_s"))
