"""Registered relational queries (FLT-*, PRJ-*, JOIN-1..3, AGG-1..3, TOP-1, SET-*, SRC-3/4, RAG-8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import relational as R
from . import adapters as A
from . import sqltext as S
from ..session import run_folder
from .curate import DEFAULT_TOP_N, curate, write_curated
from .registry import LIST_SEP, register

URGENT = "1-URGENT"
SEGMENT = "BUILDING"
ORDERS_TOP_N = 1500
CURATE_TAG = "the"


# ---- FLT-1 / JOIN-1 / TOP-1 / JOIN-2 on orders and lineitem -----------------------
@register("flt1_tag_ids", f"SELECT DISTINCT o_orderkey AS Id FROM orders WHERE o_orderpriority = {S.q(URGENT)}")
def flt1(spark: SparkSession, sf: str) -> DataFrame:
    return R.tag_ids(A.rel_questions(spark, sf), URGENT)


@register("join1_semi_orders_of_segment", f"""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = {S.q(SEGMENT)})""")
def join1(spark: SparkSession, sf: str) -> DataFrame:
    o = A.table(spark, sf, "orders")
    c = A.table(spark, sf, "customer").where(F.col("c_mktsegment") == SEGMENT)
    return R.semi_join(o, c, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey", "o_totalprice")


@register("top1_orders_by_price", f"""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT {ORDERS_TOP_N}""")
def top1(spark: SparkSession, sf: str) -> DataFrame:
    o = A.rel_questions(spark, sf)
    return R.top_n(o, ORDERS_TOP_N, "Score", "Id").select(
        F.col("Id").alias("o_orderkey"), F.col("Score").alias("o_totalprice"))


@register("join2_lineitems_of_top_orders", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT {ORDERS_TOP_N})""")
def join2(spark: SparkSession, sf: str) -> DataFrame:
    top = R.top_n(A.rel_questions(spark, sf), ORDERS_TOP_N, "Score", "Id")
    li = A.table(spark, sf, "lineitem")
    return R.bounded_semi_join(li, top, "l_orderkey", "Id").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


# ---- AGG-1 / AGG-2 / JOIN-3 / SET-2: best line item per order -----------------------
def _answers_with_nulls(spark, sf):
    """rel_answers with some values missing: quantity is null on line 1 of every order."""
    a = A.rel_answers(spark, sf)
    return a.withColumn("l_quantity", F.when(F.col("l_linenumber") != 1, F.col("l_quantity")))


_SQL_ANSWERS_NULLS = ("ra AS (SELECT l_orderkey AS ParentId, l_extendedprice AS Score, l_linenumber, l_partkey, l_suppkey, "
                      "CASE WHEN l_linenumber <> 1 THEN l_quantity END AS l_quantity, l_discount FROM lineitem)")
_SQL_ORD = "(Score IS NOT NULL, coalesce(CAST(Score AS DOUBLE), 0.0), -l_linenumber, -l_partkey, -l_suppkey)"
TIES = ["l_linenumber", "l_partkey", "l_suppkey"]


@register("agg1_best_child_per_column", f"""
WITH {_SQL_ANSWERS_NULLS}
SELECT ParentId, max(Score) AS Score, arg_max(l_quantity, {_SQL_ORD}) AS l_quantity,
       arg_max(l_discount, {_SQL_ORD}) AS l_discount
FROM ra WHERE ParentId IS NOT NULL GROUP BY ParentId""")
def agg1(spark: SparkSession, sf: str) -> DataFrame:
    return R.best_child(_answers_with_nulls(spark, sf), "ParentId", "Score", TIES,
                        ["l_quantity", "l_discount"], mode="column")


@register("agg2_best_child_row", f"""
WITH {_SQL_ANSWERS_NULLS}
SELECT ParentId, Score, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount FROM (
  SELECT *, row_number() OVER (PARTITION BY ParentId ORDER BY Score DESC NULLS LAST, l_linenumber, l_partkey, l_suppkey) AS rn
  FROM ra WHERE ParentId IS NOT NULL) WHERE rn = 1""")
def agg2(spark: SparkSession, sf: str) -> DataFrame:
    return R.best_child(_answers_with_nulls(spark, sf), "ParentId", "Score", TIES,
                        ["l_quantity", "l_discount"], mode="row")


@register("join3_orders_with_best_line", """
WITH best AS (SELECT l_orderkey AS ParentId, max(l_extendedprice) AS Score FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderkey, o.o_totalprice, b.Score AS best_line_price
FROM orders o JOIN best b ON o.o_orderkey = b.ParentId""")
def join3(spark: SparkSession, sf: str) -> DataFrame:
    best = R.best_child(A.rel_answers(spark, sf), "ParentId", "Score", TIES, [], mode="column")
    o = A.table(spark, sf, "orders")
    return R.equi_join(o, best, "o_orderkey", "ParentId").select(
        "o_orderkey", "o_totalprice", F.col("Score").alias("best_line_price"))


@register("set2_dedupe_longest_turn", """
SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC NULLS LAST, turn) AS rn
  FROM conversations) WHERE rn = 1""")
def set2(spark: SparkSession, sf: str) -> DataFrame:
    c = A.table(spark, sf, "conversations").withColumn("n_chars", F.length("text").cast("long"))
    d = R.dedupe_by_key(c, "conv_id", [F.col("n_chars").desc_nulls_last(), F.col("turn").asc()])
    return d.select("conv_id", "turn", "n_chars")


# ---- SET-1 / SET-3 --------------------------------------------------------------------
@register("set1_union_corpora", """
SELECT doc_id AS id, 'documents' AS origin, CAST(length(text) AS BIGINT) AS n_chars FROM documents
UNION ALL
SELECT item_id AS id, 'benchmark' AS origin, CAST(length(text) AS BIGINT) AS n_chars FROM benchmark""")
def set1(spark: SparkSession, sf: str) -> DataFrame:
    d = A.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("origin"), "text")
    b = A.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("origin"), "text")
    u = R.union_parts([d, b])
    return u.select("id", "origin", F.length("text").cast("long").alias("n_chars"))


@register("set3_first_seen_event_types", f"""
WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS first FROM events
           WHERE event_type IS NOT NULL AND event_type <> '' GROUP BY user_id, event_type)
SELECT user_id, string_agg(event_type, {S.q(LIST_SEP)} ORDER BY first) AS event_types FROM f GROUP BY user_id""")
def set3(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "events")
    r = R.first_seen_distinct(e, "user_id", F.col("event_type"), [F.col("ts"), F.col("event_id")], "types")
    return r.select("user_id", F.array_join("types", LIST_SEP).alias("event_types"))


# ---- SRC-3 / SRC-4 ------------------------------------------------------------------
NA_EXTRA = ["signup"]


@register("src3_na_tokens", f"""
SELECT event_id, CASE WHEN event_type IN ({', '.join(S.q(t) for t in NA_EXTRA + TX.NA_TOKENS)}) THEN NULL
       ELSE event_type END AS event_type FROM events""")
def src3(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "events")
    return e.select("event_id", TX.normalize_na(F.col("event_type"), NA_EXTRA + TX.NA_TOKENS).alias("event_type"))


@register("src4_parquet_scan_pruned", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1995-06-17 00:00:00' AND l_discount > 0.05""")
def src4(spark: SparkSession, sf: str) -> DataFrame:
    li = A.table(spark, sf, "lineitem")
    return (li.where((F.col("l_shipdate") >= F.lit("1995-06-17 00:00:00").cast("timestamp_ntz"))
                     & (F.col("l_discount") > 0.05))
            .select("l_orderkey", "l_linenumber", "l_extendedprice"))


# ---- FLT-2 / FLT-3 / PRJ-1 / PRJ-2 / RAG-8 / AGG-3 on the question-answer views ------------
@register("flt2_quality_filter", A.sql_with_qa("""
SELECT q.Id AS question_id, a.Id AS answer_id FROM qa_questions q JOIN qa_answers a ON q.Id = a.ParentId
WHERE length(a.Body) > 50 AND length(q.Body) > 20 AND length(q.Title) > 5"""))
def flt2(spark: SparkSession, sf: str) -> DataFrame:
    q = A.qa_questions(spark, sf)
    a = A.qa_answers(spark, sf).select(F.col("Id").alias("answer_id"), "ParentId", F.col("Body").alias("answer_body"))
    pairs = R.equi_join(q, a, "Id", "ParentId").select(
        F.col("Id").alias("question_id"), "answer_id", F.col("Title").alias("title"),
        F.col("Body").alias("question_body"), "answer_body")
    return R.quality_filter(pairs).select("question_id", "answer_id")


@register("flt3_validate_questions", f"""
SELECT conv_id, turn, {S.validate('text')} AS status,
       CASE WHEN {S.validate('text')} = 'ok' THEN {S.py_strip('text')} END AS question
FROM conversations""")
def flt3(spark: SparkSession, sf: str) -> DataFrame:
    c = A.table(spark, sf, "conversations")
    status, clean = TX.validate_question(F.col("text"))
    return c.select("conv_id", "turn", status.alias("status"), clean.alias("question"))


def _curated(spark, sf, tag=CURATE_TAG, observe=False):
    return curate(A.qa_questions(spark, sf), A.qa_answers(spark, sf), A.qa_tags(spark, sf), tag, DEFAULT_TOP_N,
                  observe=observe)


def _sql_curated(tag=CURATE_TAG) -> str:
    from .flagship import _sql_pairs
    return A.sql_with_qa("SELECT 1").replace(" SELECT 1", "") + ", " + _sql_pairs(tag)


@register("rag8_curate_pairs", _sql_curated() + " SELECT * FROM pairs")
def rag8(spark: SparkSession, sf: str) -> DataFrame:
    """RAG-8 end to end with the tag filter (FLT-1, JOIN-1..3, TOP-1, AGG-1, STR-1, FLT-2, SET-2, PRJ-1)."""
    return _curated(spark, sf).pairs


@register("prj2_metadata_records", _sql_curated() + """
 SELECT CAST(question_id AS VARCHAR) AS id, left(title, 200) AS meta_title,
        CAST(question_score AS INTEGER) AS meta_question_score, CAST(answer_score AS INTEGER) AS meta_answer_score
 FROM pairs""")
def prj2(spark: SparkSession, sf: str) -> DataFrame:
    p = _curated(spark, sf).pairs
    m = p.select(F.col("question_id").cast("string").alias("id"),
                 R.metadata_record(F.col("title"), F.col("question_score"), F.col("answer_score")).alias("m"))
    return m.select("id", F.col("m.title").alias("meta_title"),
                    F.col("m.question_score").alias("meta_question_score"),
                    F.col("m.answer_score").alias("meta_answer_score"))


@register("agg3_curate_funnel", _sql_curated() + f""",
 funnel AS (
   SELECT 1 AS step_no, 'tagged_ids' AS step, count(*) AS rows FROM (SELECT DISTINCT Id FROM qa_tags WHERE Tag = {S.q(CURATE_TAG)})
   UNION ALL SELECT 2, 'questions', count(*) FROM qs
   UNION ALL SELECT 3, 'top_questions', count(*) FROM topq
   UNION ALL SELECT 4, 'answers', count(*) FROM ans
   UNION ALL SELECT 5, 'best_answers', count(*) FROM best
   UNION ALL SELECT 6, 'final', count(*) FROM pairs)
 SELECT CAST(step_no AS BIGINT) AS step_no, step, CAST(rows AS BIGINT) AS rows FROM funnel""")
def agg3(spark: SparkSession, sf: str) -> DataFrame:
    """The counts are observed while the pairs are computed and written once."""
    path = run_folder(spark, "funnel")
    counts = write_curated(_curated(spark, sf, observe=True), path)
    return spark.createDataFrame(counts, "step_no long, step string, rows long")
