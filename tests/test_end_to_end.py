"""Curate -> index -> ask from raw CSV files shaped like the reference dump."""
import os

from pyspark.sql import types as T

from kbforge.functions.vectors import HashingEmbedder
from kbforge.operators.collection import build_collection
from kbforge.plans.ask import ask
from kbforge.plans.curate import curate
from kbforge.plans.index import qa_records
from kbforge.sources.csv import read_posts_csv, read_tags_csv

S = T.StringType()
Q_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("Id", T.LongType()), ("OwnerUserId", S), ("CreationDate", S), ("ClosedDate", S),
    ("Score", T.IntegerType()), ("Title", S), ("Body", S)]])
A_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("Id", T.LongType()), ("OwnerUserId", S), ("CreationDate", S), ("ParentId", T.LongType()),
    ("Score", T.IntegerType()), ("Body", S)]])
TAG_SCHEMA = T.StructType([T.StructField("Id", T.LongType()), T.StructField("Tag", S)])

LIST_BODY = "<p>I have a list and want it backwards. What is the idiomatic way to reverse a list in Python?</p>"
QUESTIONS = f'''Id,OwnerUserId,CreationDate,ClosedDate,Score,Title,Body
1,7,2008,NA,10,How can I reverse a list in Python?,"{LIST_BODY}"
2,7,2008,NA,5,Read a file line by line,"<p>How do I read a text file line by line and strip the newline characters?</p>"
3,8,2008,NA,50,Java generics question,"<p>How do generics work in Java with wildcards and bounded types here?</p>"
4,9,2009,NA,7,Merge two dictionaries in one expression,"<p>I want a single expression that merges two dicts, keeping values of the second.</p>"
5,9,2009,NA,1,bad row,"<p>too many fields</p>",extra
'''
ANSWERS = '''Id,OwnerUserId,CreationDate,ParentId,Score,Body
11,1,2008,1,30,"<p>Use slicing: <code>new = old[::-1]</code> which returns a reversed copy of the list.</p>"
12,1,2008,1,8,"<p>Or call <code>reversed(old)</code> to get an iterator over the list in reverse order.</p>"
13,1,2008,4,9,"<p>In Python 3.9 and later write <code>z = x | y</code>; before that use <code>{**x, **y}</code> for the merge.</p>"
14,1,2008,3,99,"<p>Java answer that should never be indexed because the question is not tagged python.</p>"
15,1,2008,2,3,"<p>short</p>"
'''
TAGS = "Id,Tag\n1,python\n1,list\n2,python\n3,java\n4,python\n4,dictionary\n"


def _write(d, name, text):
    p = os.path.join(d, name)
    with open(p, "w", encoding="latin-1") as f:
        f.write(text)
    return p


def test_csv_to_answers(spark, tmp_dir):
    q = read_posts_csv(spark, _write(tmp_dir, "Questions.csv", QUESTIONS), Q_SCHEMA)
    a = read_posts_csv(spark, _write(tmp_dir, "Answers.csv", ANSWERS), A_SCHEMA)
    t = read_tags_csv(spark, _write(tmp_dir, "Tags.csv", TAGS), TAG_SCHEMA)
    assert q.count() == 4          # the row with an extra field is skipped
    res = curate(q.select("Id", "Title", "Body", "Score"), a.select("Id", "ParentId", "Body", "Score"), t,
                 "python", top_n=2)
    pairs = {r["question_id"]: r for r in res.pairs.collect()}
    # top 2 python questions by score are 1 (10) and 4 (7); both have answers long enough
    assert sorted(pairs) == [1, 4]
    assert pairs[1]["answer_body"] == ("Use slicing: ``` new = old[::-1] ``` which returns a reversed copy "
                                       "of the list.")
    assert pairs[4]["answer_score"] == 9

    coll = build_collection(spark, qa_records(res.pairs, HashingEmbedder()), f"{tmp_dir}/coll", "python_qa")
    questions = spark.createDataFrame([(1, "How do I reverse a list in Python?"), (2, "abc"),
                                       (3, "merge two dictionaries into one dict")], "query_id long, question string")
    out = {r["query_id"]: r for r in ask(spark, questions, coll, HashingEmbedder(), k=5)["answers"].collect()}
    assert out[2]["status"] == "too_short" and out[2]["answer"] is None
    assert out[1]["status"] == "answered" and out[1]["sources"][0] == "How can I reverse a list in Python?"
    assert out[1]["answer"].startswith("Use slicing")
    assert out[3]["sources"][0] == "Merge two dictionaries in one expression"
    assert out[1]["docs_retrieved"] == 5 and out[1]["docs_actual"] == 2


def test_cli_jobs_chain(spark, tmp_dir):
    from kbforge import cli
    funnel = cli.run_curate(spark, _write(tmp_dir, "Q.csv", QUESTIONS), _write(tmp_dir, "A.csv", ANSWERS),
                            _write(tmp_dir, "T.csv", TAGS), f"{tmp_dir}/clean_qa.parquet", "python", top_n=2)
    assert [s for _, s, _ in funnel] == ["tagged_ids", "questions", "top_questions", "answers", "best_answers",
                                         "final"]
    assert funnel[-1][2] == 2
    assert cli.run_index(spark, f"{tmp_dir}/clean_qa.parquet", f"{tmp_dir}/coll") == 2
    qs = spark.createDataFrame([(1, "How do I reverse a list in Python?"), (2, "abc")], "query_id long, question string")
    qs.write.parquet(f"{tmp_dir}/questions")
    assert cli.run_ask(spark, f"{tmp_dir}/coll", f"{tmp_dir}/answers", questions=f"{tmp_dir}/questions") == 2
    summary = cli.run_evaluate(spark, f"{tmp_dir}/answers", f"{tmp_dir}/results")
    assert (summary["total"], summary["passed"], summary["failed"]) == (2, 1, 1)


def test_cli_main_arguments(spark, tmp_dir, capsys):
    import json
    import pytest
    from kbforge import cli
    with pytest.raises(SystemExit):
        cli.main(["ask", "--collection", f"{tmp_dir}/none", "--out", f"{tmp_dir}/o"])   # no question given
    capsys.readouterr()
    cli.main(["curate", "--questions", _write(tmp_dir, "Q.csv", QUESTIONS), "--answers", _write(tmp_dir, "A.csv", ANSWERS),
              "--tags", _write(tmp_dir, "T.csv", TAGS), "--out", f"{tmp_dir}/pairs", "--top-n", "2"])
    funnel = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert funnel[-1][1] == "final" and funnel[-1][2] == 2
