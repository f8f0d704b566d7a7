"""SRC-1 .. SRC-5, SNK-1, SNK-2 with inline fixtures."""
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbforge.sources.csv import read_posts_csv, read_tags_csv
from kbforge.sources.tables import read_eval_results, read_table, write_clean_qa, export_eval_document, write_eval_results

LENIENT = (
    b'Id,Score,Title\n'
    b'1,5,ok\n'
    b'2,6,x,\n'
    b'3,6,y,,z\n'
    b'4,6,w,,\n'
    b'5,1,"",\n'
    b'6,1,""\n'
    b'7,2,\n'
    b'8,3\n'
    b'9,4,"a,b ""c"", d\nnew, line"\n'
    b'10,4,"p,q",r\n'
    b'11\n'
    b'12,abc,t\n'
    b'13,2,"caf\xe9, ok"\n'
    b'14,2,"multi\nx",extra\n'
)
SCHEMA = T.StructType([T.StructField("Id", T.LongType()), T.StructField("Score", T.IntegerType()),
                       T.StructField("Title", T.StringType())])


def _write(tmp_dir, name, data):
    p = os.path.join(tmp_dir, name)
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_lenient_csv_keeps_pandas_rows(spark, tmp_dir):
    p = _write(tmp_dir, "q.csv", LENIENT)
    rows = {r["Id"]: r for r in read_posts_csv(spark, p, SCHEMA).collect()}
    assert sorted(rows) == [1, 6, 7, 8, 9, 11, 12, 13]
    for i in (6, 7, 8, 11):
        assert rows[i]["Title"] is None
    assert rows[9]["Title"] == 'a,b "c", d\nnew, line'
    assert rows[12]["Score"] is None and rows[12]["Title"] == "t"
    assert rows[13]["Title"] == "café, ok"


def test_strict_csv_fails_on_long_rows(spark, tmp_dir):
    p = _write(tmp_dir, "t.csv", LENIENT)
    with pytest.raises(Exception, match="malformed CSV row"):
        read_tags_csv(spark, p, SCHEMA).collect()


def test_strict_csv_accepts_clean_file(spark, tmp_dir):
    p = _write(tmp_dir, "t2.csv", b"Id,Score,Title\n1,2,python\n3,4,java\n")
    assert read_tags_csv(spark, p, SCHEMA).count() == 2


def test_na_words_become_null(spark, tmp_dir):
    p = _write(tmp_dir, "na.csv", b"Id,Score,Title\n1,1,NA\n2,2,null\n3,3,None\n4,4,keep\n")
    rows = {r["Id"]: r["Title"] for r in read_posts_csv(spark, p, SCHEMA).collect()}
    assert rows == {1: None, 2: None, 3: None, 4: "keep"}


def test_missing_parquet_is_clear_error(spark, tmp_dir):
    with pytest.raises(FileNotFoundError):
        read_table(spark, os.path.join(tmp_dir, "nope.parquet"))


def test_clean_qa_sink_sorted(spark, tmp_dir):
    df = spark.createDataFrame(
        [(1, "t1", "q", 3, "a", 1), (2, "t2", "q", 9, "a", 1), (3, "t3", "q", None, "a", 1)],
        "question_id long, title string, question_body string, question_score long, answer_body string, answer_score long")
    out = os.path.join(tmp_dir, "clean_qa.parquet")
    write_clean_qa(df, out)
    back = spark.read.parquet(out)
    assert back.columns == ["question_id", "title", "question_body", "question_score", "answer_body", "answer_score"]
    assert back.count() == 3


LATENCIES = [4.186, 4.125, 3.593, 3.846, 3.836, 3.482, 11.652, 10.331, 8.733, 5.439]


def test_eval_results_round_trip_golden(spark, tmp_dir):
    rows = [(i + 1, f"question {i + 1}", "answer", ["s1", "s2", "s3", "s4", "s5"], "m", 5, lat, "PASS",
             "Answer returned successfully with sources.") for i, lat in enumerate(LATENCIES)]
    df = spark.createDataFrame(rows, "test_id long, question string, answer string, sources array<string>, "
                                     "model string, docs_retrieved long, latency_s double, status string, observation string")
    out = os.path.join(tmp_dir, "results")
    export_eval_document(df, out)
    tests, summary = read_eval_results(spark, out)
    s = summary.first()
    assert (s["total"], s["passed"], s["failed"], s["avg_latency"]) == (10, 10, 0, 5.922)
    assert tests.count() == 10
    assert tests.select(F.explode("sources")).count() == 50
    # one JSON document, non-ASCII kept
    files = [f for f in os.listdir(out) if f.endswith(".json")]
    assert len(files) == 1
    doc = json.loads(open(os.path.join(out, files[0]), encoding="utf-8").read())
    assert doc["summary"]["passed"] == 10


def test_eval_summary_zero_pass(spark):
    from kbforge.operators.evaluate import summarize
    df = spark.createDataFrame([(1, "FAIL", 2.0), (2, "ERROR", 1.0)], "test_id long, status string, latency_s double")
    s = summarize(df).first()
    assert (s["total"], s["passed"], s["failed"], s["avg_latency"]) == (2, 0, 2, 0.0)


def test_eval_results_partitioned_layout(spark, tmp_dir):
    rows = [(i + 1, "q", "PASS", lat) for i, lat in enumerate(LATENCIES)]
    df = spark.createDataFrame(rows, "test_id long, question string, status string, latency_s double")
    out = os.path.join(tmp_dir, "results_parts")
    write_eval_results(df.repartition(3), out)
    tests, summary = read_eval_results(spark, out)
    s = summary.first()
    assert (s["total"], s["passed"], s["failed"], s["avg_latency"]) == (10, 10, 0, 5.922)
    assert tests.count() == 10


def test_field_count_of_long_quoted_rows(spark, tmp_dir):
    from kbforge.sources.csv import read_tags_csv
    body = "<p>" + "word, \"\"said\"\"\n" * 60_000 + "</p>"          # about 1 MB, quotes doubled
    text = f'Id,Score,Title\n1,3,"{body}"\n2,"{body}"\n3,4,"{body}",extra\n4\n'
    p = _write(tmp_dir, "long.csv", text.encode("latin-1"))
    got = {r["Id"]: r for r in read_posts_csv(spark, p, SCHEMA).collect()}
    assert set(got) == {1, 2, 4} and len(got[1]["Title"]) > 700_000 and got[4]["Title"] is None
    short = _write(tmp_dir, "short.csv", f'Id,Tag\n1,"{body}"\n"{body}"\n'.encode("latin-1"))
    schema = T.StructType([T.StructField("Id", T.LongType()), T.StructField("Tag", T.StringType())])
    assert read_tags_csv(spark, short, schema).count() == 2
    bad = _write(tmp_dir, "bad.csv", f'Id,Tag\n1,"{body}",x\n'.encode("latin-1"))
    with pytest.raises(Exception, match="malformed CSV row"):
        read_tags_csv(spark, bad, schema).count()


def test_latin1_default_reproduces_mojibake(spark, tmp_dir):
    # UTF-8 bytes read with the default latin-1 decoding, as the curate job does
    p = _write(tmp_dir, "utf8.csv", "Id,Score,Title\n1,3,What’s new\n".encode("utf-8"))
    got = read_posts_csv(spark, p, SCHEMA).first()["Title"]
    assert got == "What’s new".encode("utf-8").decode("latin-1")
    assert got.startswith("Whatâ\x80\x99s")
    assert read_posts_csv(spark, p, SCHEMA, encoding="UTF-8").first()["Title"] == "What’s new"


def test_strict_csv_pads_short_rows(spark, tmp_dir):
    p = _write(tmp_dir, "short.csv", b"Id,Score,Title\n1,2\n3,4,x\n")
    rows = {r["Id"]: (r["Score"], r["Title"]) for r in read_tags_csv(spark, p, SCHEMA).collect()}
    assert rows == {1: (2, None), 3: (4, "x")}


def test_read_tables_multi_path(spark, tmp_dir):
    from kbforge.sources.tables import read_tables
    a, b = os.path.join(tmp_dir, "a"), os.path.join(tmp_dir, "b")
    spark.range(0, 5).write.parquet(a)
    spark.range(5, 8).write.parquet(b)
    assert read_tables(spark, [a, b]).count() == 8
    with pytest.raises(FileNotFoundError):
        read_tables(spark, [a, os.path.join(tmp_dir, "nope")])


def test_documents_whose_fields_drift_are_read_in_one_scan(spark, tmp_dir):
    from kbforge.sources.tables import read_eval_documents
    docs = {
        "old.json": {"summary": {"total": 1, "passed": 1}, "tests": [{"test_id": 1, "status": "PASS", "latency_s": 2, "sources": ["a", "b"]}]},
        "new.json": {"summary": {"total": 2, "passed": 0, "host": "x"}, "tests": [
            {"test_id": 2, "status": "FAIL", "http_status": 500, "latency_s": 0.25},
            {"test_id": 3, "status": "ERROR", "error": "timeout é", "retries": [1, {"at": 2}], "http_status": "none"}]},
        "empty.json": {"summary": {}, "tests": []}, "none.json": {"note": "no tests at all"}}
    for name, doc in docs.items():
        _write(tmp_dir, name, json.dumps(doc, indent=2, ensure_ascii=False).encode("utf-8"))
    tests, summary = read_eval_documents(spark, tmp_dir)
    got = {r.test_id: r for r in tests.collect()}
    assert set(got) == {1, 2, 3} and got[1].sources == ["a", "b"] and got[1].latency_s == 2.0 and got[1].http_status is None
    assert got[2].http_status == 500 and got[2].other == {}
    assert got[3].error == "timeout é" and got[3].http_status is None and got[3].other == {"retries": '[1,{"at":2}]'}
    assert os.path.basename(got[3].file) == "new.json"
    assert sorted((r.total, r.other) for r in summary.collect() if r.total) == [(1, {}), (2, {"host": '"x"'})]
    with open(os.path.join(tmp_dir, "lines.jsonl"), "w") as f:
        f.writelines(json.dumps(d) + "\n" for d in docs.values())
    by_line, _ = read_eval_documents(spark, os.path.join(tmp_dir, "lines.jsonl"), lines=True)
    assert sorted(r.test_id for r in by_line.collect()) == [1, 2, 3]
