"""Command line for the four jobs: ``python -m kbforge.cli <job> ...``.

    curate    Tags/Questions/Answers CSV -> clean pairs parquet (+ step counts)
    index     clean pairs parquet -> committed vector collection
    ask       question table (or one question) -> answers parquet
    evaluate  answers parquet -> results document (summary + one row per question)

Every job runs on the active Spark master (``spark-submit`` or ``--master``).
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F
from pyspark.sql import types as T

S = T.StringType()
# Column layouts of the dump files (all columns, in file order).
QUESTIONS_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("Id", T.LongType()), ("OwnerUserId", S), ("CreationDate", S), ("ClosedDate", S),
    ("Score", T.IntegerType()), ("Title", S), ("Body", S)]])
ANSWERS_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("Id", T.LongType()), ("OwnerUserId", S), ("CreationDate", S), ("ParentId", T.LongType()),
    ("Score", T.IntegerType()), ("Body", S)]])
TAGS_SCHEMA = T.StructType([T.StructField("Id", T.LongType()), T.StructField("Tag", S)])


def run_curate(spark, questions: str, answers: str, tags: str, out: str, tag: str | None = "python",
               top_n: int = 15000, encoding: str = "ISO-8859-1") -> list:
    from .plans.curate import curate, write_curated
    from .session import run_folder
    from .sources.csv import csv_to_parquet, read_posts_csv, read_tags_csv
    # multi-line CSV is read by one task a file; the job's several passes read parquet
    root = run_folder(spark, "csv")
    q = csv_to_parquet(read_posts_csv(spark, questions, QUESTIONS_SCHEMA, encoding)
                       .select("Id", "Title", "Body", "Score"), f"{root}/questions")
    a = csv_to_parquet(read_posts_csv(spark, answers, ANSWERS_SCHEMA, encoding)
                       .select("Id", "ParentId", "Body", "Score"), f"{root}/answers")
    t = csv_to_parquet(read_tags_csv(spark, tags, TAGS_SCHEMA, encoding), f"{root}/tags")
    return write_curated(curate(q, a, t, tag, top_n, observe=True), out)


def run_index(spark, pairs: str, collection: str, mode: str = "skip", name: str = "qa_pairs") -> int:
    from .operators.collection import build_collection
    from .plans.index import qa_records
    from .sources.tables import read_table
    return build_collection(spark, qa_records(read_table(spark, pairs)), collection, name, mode).count()


def run_ask(spark, collection: str, out: str, questions: str | None = None, question: str | None = None,
            k: int = 5) -> int:
    """``questions``: parquet with (query_id, question); or one ``question``."""
    from .operators.collection import open_collection
    from .plans.ask import ask
    if questions:
        qs = spark.read.parquet(questions).select(F.col("query_id").cast("long"), "question")
    else:
        qs = spark.createDataFrame([(1, question)], "query_id long, question string")
    answers = ask(spark, qs, open_collection(spark, collection), k=k)["answers"]
    answers.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out).count()


def run_evaluate(spark, answers: str, out: str, single_document: bool = False) -> dict:
    """Answers -> evaluation rows: answered = PASS (200), rejected question = FAIL
    (422 / 400 as in the request validation), generation failure = ERROR."""
    from .operators.evaluate import eval_status
    from .sources.tables import export_eval_document, read_eval_results, write_eval_results
    a = spark.read.parquet(answers)
    http = (F.when(F.col("status") == "answered", F.lit(200))
            .when(F.col("status").isin("too_short", "too_long"), F.lit(422))
            .when(F.col("status") == "empty_after_strip", F.lit(400)))
    err = F.when(~F.col("status").isin("answered", "too_short", "too_long", "empty_after_strip"),
                 F.coalesce(F.col("error"), F.col("status")))
    status, obs = eval_status(http.cast("long"), err)
    rows = a.select(F.col("query_id").alias("test_id"), "question", "answer", "sources", "model",
                    "docs_retrieved", "latency_s", status.alias("status"),
                    obs.alias("observation"), http.cast("long").alias("http_status"), err.alias("error"))
    if single_document:
        export_eval_document(rows, out)
    else:
        write_eval_results(rows, out)
    return read_eval_results(spark, out)[1].first().asDict()


def main(argv: list[str] | None = None) -> int:
    from .session import build_session, checkpoint_dir
    p = argparse.ArgumentParser(prog="kbforge")
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="job", required=True)
    c = sub.add_parser("curate")
    c.add_argument("--questions", required=True)
    c.add_argument("--answers", required=True)
    c.add_argument("--tags", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--tag", default="python")
    c.add_argument("--top-n", type=int, default=15000)
    c.add_argument("--encoding", default="ISO-8859-1")
    i = sub.add_parser("index")
    i.add_argument("--pairs", required=True)
    i.add_argument("--collection", required=True)
    i.add_argument("--mode", default="skip", choices=["skip", "rebuild", "error"])
    a = sub.add_parser("ask")
    a.add_argument("--collection", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--questions")
    a.add_argument("--question")
    a.add_argument("--k", type=int, default=5)
    e = sub.add_parser("evaluate")
    e.add_argument("--answers", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--single-document", action="store_true")
    args = p.parse_args(argv)

    spark = build_session(args.master)
    checkpoint_dir(spark)
    if args.job == "curate":
        result = run_curate(spark, args.questions, args.answers, args.tags, args.out, args.tag, args.top_n,
                            args.encoding)
    elif args.job == "index":
        result = {"indexed": run_index(spark, args.pairs, args.collection, args.mode)}
    elif args.job == "ask":
        if not (args.questions or args.question):
            p.error("ask needs --questions or --question")
        result = {"answers": run_ask(spark, args.collection, args.out, args.questions, args.question, args.k)}
    else:
        result = run_evaluate(spark, args.answers, args.out, args.single_document)
    print(json.dumps(result))
    return 0


if __name__ == "__main__":
    sys.exit(main())
