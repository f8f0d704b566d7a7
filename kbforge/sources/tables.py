"""Parquet and JSON sources and sinks (SRC-4, SRC-5, SNK-1, SNK-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir, path_exists

CLEAN_QA_COLUMNS = ["question_id", "title", "question_body", "question_score",
                    "answer_body", "answer_score"]

EVAL_TEST_SCHEMA = T.StructType([
    T.StructField("test_id", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("sources", T.ArrayType(T.StringType())),
    T.StructField("model", T.StringType()),
    T.StructField("docs_retrieved", T.LongType()),
    T.StructField("latency_s", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("observation", T.StringType()),
    T.StructField("http_status", T.LongType()),
    T.StructField("error", T.StringType()),
])

EVAL_FILE_SCHEMA = T.StructType([
    T.StructField("summary", T.StructType([
        T.StructField("total", T.LongType()),
        T.StructField("passed", T.LongType()),
        T.StructField("failed", T.LongType()),
        T.StructField("avg_latency", T.DoubleType()),
    ])),
    T.StructField("tests", T.ArrayType(EVAL_TEST_SCHEMA)),
])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: parquet scan; a missing input is a clear error, not an empty frame."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"input table not found: {path}")
    return spark.read.parquet(path)


def read_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SET-1 re-aimed: many parquet inputs of one schema as one scan (one file
    listing, splits from every input); missing inputs are a clear error."""
    missing = [p for p in paths if not path_exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"input tables not found: {missing}")
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def write_clean_qa(df: DataFrame, path: str) -> None:
    """SNK-1: the six curated columns, written once, sorted by question score.

    The rows are checkpointed first: the sort samples its input in a job of its own,
    which would otherwise compute the pairs twice.

    The global sort is a range-partitioned shuffle (no single task); readers that
    take the "first row" get the highest-scored pair.
    """
    checkpoint_dir(df.sparkSession)
    (df.select(*CLEAN_QA_COLUMNS).checkpoint(eager=True)
       .orderBy(F.col("question_score").desc_nulls_last(), F.col("question_id"))
       .write.mode("overwrite").parquet(path))


def _eval_frame(tests: DataFrame) -> DataFrame:
    t = tests
    for f in EVAL_TEST_SCHEMA.fields:
        if f.name not in t.columns:
            t = t.withColumn(f.name, F.lit(None).cast(f.dataType))
    return t.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVAL_TEST_SCHEMA.fields])


def export_eval_document(tests: DataFrame, path: str) -> None:
    """SNK-2: one JSON document ``{summary, tests:[...]}`` (non-ASCII kept).

    An explicit export for small runs: the document format itself is one array, built
    by one task.  :func:`write_eval_results` is the sink for runs of any size.
    """
    from ..operators.evaluate import summary_columns
    cols = [f.name for f in EVAL_TEST_SCHEMA.fields]
    t = tests
    for f in EVAL_TEST_SCHEMA.fields:
        if f.name not in t.columns:
            t = t.withColumn(f.name, F.lit(None).cast(f.dataType))
    packed = F.struct(*[F.col(c).cast(f.dataType).alias(c) for c, f in zip(cols, EVAL_TEST_SCHEMA.fields)])
    doc = t.agg(
        F.struct(*summary_columns()).alias("summary"),
        F.array_sort(F.collect_list(packed), lambda a, b: F.when(a["test_id"] < b["test_id"], -1)
                     .when(a["test_id"] > b["test_id"], 1).otherwise(0)).alias("tests"))
    doc.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_eval_results(tests: DataFrame, path: str) -> None:
    """SNK-2 for runs of any size: ``tests/`` as JSON lines written by every task
    in parallel, ``summary/`` as one row from a partial aggregation."""
    from ..operators.evaluate import summary_columns
    t = _eval_frame(tests)
    t.write.mode("overwrite").option("ignoreNullFields", "true").json(f"{path}/tests")
    t.agg(*summary_columns()).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def read_eval_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-5: (tests one row each, summary one row) from either results layout."""
    if path_exists(spark, f"{path.rstrip('/')}/summary"):
        tests = spark.read.schema(EVAL_TEST_SCHEMA).json(f"{path}/tests")
        summary = spark.read.schema(EVAL_FILE_SCHEMA["summary"].dataType).json(f"{path}/summary")
        return tests, summary
    raw = spark.read.schema(EVAL_FILE_SCHEMA).option("multiLine", "true").json(path)
    tests = raw.select(F.explode("tests").alias("t")).select("t.*")
    summary = raw.select("summary.*")
    return tests, summary


def read_eval_documents(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """SRC-5 for documents whose fields drift: (tests, summaries) of all files in one scan.

    Every document is one VARIANT value (``lines``: a document a line, which splits
    files over tasks; else a document a file), so no schema is inferred and none has
    to fit: a field that a document lacks, or has with another type that cannot be
    read as the known one, is null, and fields nobody knows are kept by name, as
    JSON text, in the map ``other``.  ``file`` names the document's file.
    """
    raw = (spark.read.option("singleVariantColumn", "doc").option("multiLine", str(not lines).lower()).json(path)
           .select("doc", F.col("_metadata.file_path").alias("file")))

    def fields(value: str, schema: T.StructType) -> list:
        known = [f.name for f in schema.fields]
        every = F.try_variant_get(value, "$", "map<string,variant>")
        other = F.transform_values(F.map_filter(every, lambda k, v: ~k.isin(known)), lambda k, v: F.to_json(v))
        return [F.try_variant_get(value, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schema.fields] + [
            other.alias("other")]

    tests = raw.select("file", F.explode(F.try_variant_get("doc", "$.tests", "array<variant>")).alias("test"))
    summary = raw.select("file", F.try_variant_get("doc", "$.summary", "variant").alias("summary"))
    return (tests.select("file", *fields("test", EVAL_TEST_SCHEMA)),
            summary.select("file", *fields("summary", EVAL_FILE_SCHEMA["summary"].dataType)))
