"""Views over the shared test tables that stand in for the question-answer dump.

Each adapter exists twice: as a DataFrame (used by the jobs) and as SQL text
(used by the DuckDB oracle).  Both read whole tables.

* ``qa_questions`` — per conversation the first ``user`` turn: Id = conv_id,
  Title = the whole first line, Body = text, Score = total characters of all turns.
* ``qa_answers`` — every ``assistant`` turn: Id = turn, ParentId = conv_id,
  Body = text, Score = length(text).
* ``qa_tags`` — one row per distinct word of the question text: Id, Tag.
* ``rel_questions`` / ``rel_answers`` — orders / lineitem in the same shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """SRC-4 on the shared test layout ``{sf_dir}/{name}.parquet``."""
    from ..sources.tables import read_table
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def qa_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    g = conv.groupBy("conv_id").agg(
        F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("Body"),
        F.max((F.col("role") == "user").cast("int")).alias("_has_user"),
        F.sum(F.length("text")).cast("long").alias("Score"),
    )
    return g.where("_has_user = 1").select(
        F.col("conv_id").alias("Id"), F.substring_index("Body", "\n", 1).alias("Title"),
        "Body", "Score")


def qa_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    return conv.where(F.col("role") == "assistant").select(
        F.col("turn").alias("Id"), F.col("conv_id").alias("ParentId"),
        F.col("text").alias("Body"), F.length("text").cast("long").alias("Score"))


def qa_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = qa_questions(spark, sf_dir)
    return q.select("Id", F.explode(F.array_distinct(tokens(F.col("Body")))).alias("Tag"))


def rel_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("Id"), F.col("o_orderpriority").alias("Tag"),
                    F.col("o_totalprice").alias("Score"))


def rel_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("ParentId"), F.col("l_extendedprice").alias("Score"),
                     "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")


# --- the same views as DuckDB SQL -------------------------------------------------
SQL_QA_QUESTIONS = """
SELECT conv_id AS Id, split_part(Body, chr(10), 1) AS Title, Body, Score FROM (
  SELECT conv_id,
         arg_min(text, CASE WHEN role = 'user' THEN turn END) AS Body,
         max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS has_user,
         CAST(sum(length(text)) AS BIGINT) AS Score
  FROM conversations GROUP BY conv_id) WHERE has_user = 1
"""

SQL_QA_ANSWERS = """
SELECT turn AS Id, conv_id AS ParentId, text AS Body, CAST(length(text) AS BIGINT) AS Score
FROM conversations WHERE role = 'assistant'
"""

SQL_TOKENS = r"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: length(t) > 0)"

SQL_QA_TAGS = f"""
SELECT Id, unnest(list_distinct({SQL_TOKENS.format(x='Body')})) AS Tag FROM qa_questions
"""


def sql_with_qa(body: str) -> str:
    """Prefix a query with the qa_* views as CTEs."""
    return (f"WITH qa_questions AS ({SQL_QA_QUESTIONS}), qa_answers AS ({SQL_QA_ANSWERS}), "
            f"qa_tags AS ({SQL_QA_TAGS}) {body}")
