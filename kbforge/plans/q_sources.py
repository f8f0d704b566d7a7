"""Registered source/sink round trips (SRC-1, SRC-2, SRC-5, SNK-1, SNK-2).

Spark writes a shared table (or a result derived from it) through the sink and
reads it back through the source, under the session's checkpoint folder; the
oracle is the SQL of the original data.
"""

from __future__ import annotations

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import run_folder
from ..sources.csv import read_posts_csv, read_tags_csv
from ..sources.tables import read_eval_results, read_table, write_clean_qa, write_eval_results
from ..operators import evaluate as EV
from . import adapters as A
from . import sqltext as S
from .q_eval import SQL_EVAL_ROWS, _SQL_SUMMARY, eval_rows
from .q_relational import _curated, _sql_curated
from .registry import register



CONV_SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                            T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


@register("src1_lenient_csv_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def src1(spark: SparkSession, sf: str) -> DataFrame:
    """Multi-line quoted text (commas, quotes, newlines) survives CSV out and back in."""
    path = run_folder(spark, "csv")
    conv = A.table(spark, sf, "conversations")
    (conv.write.option("header", "true").option("quote", '"').option("escape", '"')
     .option("encoding", "UTF-8").csv(path))
    return read_posts_csv(spark, path, CONV_SCHEMA, encoding="UTF-8", na_tokens=[])


@register("src2_strict_csv_round_trip", "SELECT conv_id AS Id, role AS Tag FROM conversations")
def src2(spark: SparkSession, sf: str) -> DataFrame:
    """The strict reader over a well-formed (id, tag) file derived from the table."""
    path = run_folder(spark, "tags")
    tags = A.table(spark, sf, "conversations").select(F.col("conv_id").alias("Id"), F.col("role").alias("Tag"))
    tags.write.option("header", "true").csv(path)
    schema = T.StructType([T.StructField("Id", T.LongType()), T.StructField("Tag", T.StringType())])
    return read_tags_csv(spark, path, schema, encoding="UTF-8")


@register("snk1_clean_qa_round_trip", _sql_curated() + " SELECT * FROM pairs")
def snk1(spark: SparkSession, sf: str) -> DataFrame:
    path = run_folder(spark, "clean_qa")
    write_clean_qa(_curated(spark, sf).pairs, path)
    return read_table(spark, path)


@register("snk2_eval_results_round_trip", f"WITH {SQL_EVAL_ROWS} SELECT {_SQL_SUMMARY} FROM er")
def snk2(spark: SparkSession, sf: str) -> DataFrame:
    path = run_folder(spark, "eval")
    write_eval_results(eval_rows(spark, sf), path)
    _tests, summary = read_eval_results(spark, path)
    return summary


@register("src1_lenient_csv_ragged", """
SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN NULL ELSE role END AS role,
       CASE WHEN turn % 3 = 1 THEN NULL ELSE text END AS text
FROM conversations WHERE turn % 3 <> 2""")
def src1_ragged(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of too few fields are padded with nulls, rows of too many are skipped."""
    path = run_folder(spark, "ragged")
    conv = A.table(spark, sf, "conversations")
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("conv_id").cast("string"), F.col("turn").cast("string"),
                       F.when(F.col("turn") % 3 != 1, F.col("role")), F.when(F.col("turn") % 3 != 1, quoted),
                       F.when(F.col("turn") % 3 == 2, F.lit('"one, more"')))

    def with_header(batches):                # the reader takes the first line of every file for one
        yield pd.DataFrame({"value": ["conv_id,turn,role,text"]})
        yield from batches

    conv.select(line.alias("value")).mapInPandas(with_header, "value string").write.text(path)
    return read_posts_csv(spark, path, CONV_SCHEMA, encoding="UTF-8", na_tokens=[])


@register("src5_eval_test_rows", f"""WITH {SQL_EVAL_ROWS}
SELECT test_id, status, CASE status WHEN 'PASS' THEN {S.q(EV.OBS_PASS)}
  WHEN 'FAIL' THEN {S.q(EV.OBS_FAIL_PREFIX)} || coalesce(CAST(http_status AS VARCHAR), 'None') || '.'
  ELSE {S.q(EV.OBS_ERROR)} END AS observation, latency_s FROM er""")
def src5(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-5: every test row of the results as read back."""
    path = run_folder(spark, "eval-rows")
    write_eval_results(eval_rows(spark, sf), path)
    tests, _summary = read_eval_results(spark, path)
    return tests.select("test_id", "status", "observation", "latency_s")


DOCUMENT_TESTS = 500        # tests of one results document


@register("src5_drifting_documents", f"""WITH {SQL_EVAL_ROWS}
SELECT test_id, status, CASE WHEN test_id % 3 = 0 THEN NULL ELSE http_status END AS http_status,
       CASE WHEN test_id % 3 = 0 THEN NULL ELSE error END AS error,
       CASE WHEN test_id % 3 = 2 THEN '"r' || (test_id % 7) || '"' END AS region, latency_s FROM er""")
def src5_drifting(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-5: documents of three makes in one scan: without, with, and with more than the known fields."""
    from ..sources.tables import read_eval_documents
    path = run_folder(spark, "eval-documents")
    make, names = F.col("test_id") % 3, ["test_id", "status", "latency_s", "http_status", "error"]
    region = F.concat(F.lit("r"), (F.col("test_id") % 7).cast("string"))
    one = (F.when(make == 0, F.to_json(F.struct(*names[:3]))).when(make == 1, F.to_json(F.struct(*names)))
           .otherwise(F.to_json(F.struct(*names, region.alias("region")))))
    # a document has at most DOCUMENT_TESTS tests of one make
    docs = (eval_rows(spark, sf).select(make.alias("make"), F.floor(F.col("test_id") / (3 * DOCUMENT_TESTS)).alias("no"),
                                        one.alias("test"))
            .groupBy("make", "no").agg(F.concat_ws(",", F.collect_list("test")).alias("tests")))
    docs.select(F.concat(F.lit('{"summary":{},"tests":['), "tests", F.lit("]}"))).write.text(path)
    tests, _summary = read_eval_documents(spark, path, lines=True)
    return tests.select("test_id", "status", "http_status", "error", F.col("other")["region"].alias("region"), "latency_s")
