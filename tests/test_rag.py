"""RAG-3/4/5 semantics with inline fixtures."""
from pyspark.sql import functions as F

from kbforge.operators import rag


def test_attempt_resolution_fixtures(spark):
    rows = [(1, 1, "m1", "Error code: 404"), (1, 2, "m2", "model_not_found"), (1, 3, "m3", None),
            (2, 1, "m1", "404"), (2, 2, "m2", "timeout"), (2, 3, "m3", None),
            (3, 1, "m1", "does not exist"), (3, 2, "m2", "model does not exist")]
    df = spark.createDataFrame(rows, "req long, pos long, model string, error string")
    got = {r["req"]: (r["outcome"], r["model"], r["decided_by"]) for r in
           rag.resolve_attempts(df, ["req"], ["pos"], attempt_id="pos").collect()}
    assert got == {1: ("answered", "m3", 3), 2: ("failed", None, 2), 3: ("exhausted", None, 2)}


def test_start_model_and_candidates(spark):
    df = spark.createDataFrame([(["whisper", "Gemma-x", "llama-y"],), (["whisper"],), ([],),
                                (["llama-3.3-70b-versatile", "b"],)], "a array<string>")
    r = df.select(rag.start_model(F.col("a")).alias("s"),
                  rag.candidate_order(rag.start_model(F.col("a")), F.col("a")).alias("c")).collect()
    assert [x["s"] for x in r] == ["Gemma-x", "whisper", rag.PRIMARY_MODEL, rag.PRIMARY_MODEL]
    assert r[0]["c"][:4] == ["Gemma-x", "whisper", "llama-y", rag.PRIMARY_MODEL]
    assert len(r[0]["c"]) == len(set(r[0]["c"]))


def test_generation_fallback(spark):
    def flaky(model, messages):   # defined inline so it ships by value to the workers
        if model == "gone":
            raise RuntimeError("Error code: 404 - model_not_found")
        if model == "broken":
            raise RuntimeError("500 internal")
        return f"{model}:{len(messages)}"

    msgs = [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]
    df = spark.createDataFrame([(1, msgs, ["gone", "ok1"]), (2, msgs, ["gone", "broken", "ok2"]), (3, msgs, ["gone"])],
                               "query_id long, messages array<struct<role:string,content:string>>, candidates array<string>")
    out = {r["query_id"]: (r["status"], r["model"]) for r in
           rag.generate(df.coalesce(1), lambda: flaky).collect()}
    assert out[1] == ("answered", "ok1")
    assert out[3][0] in ("exhausted", "answered")   # per-worker last good model may be tried first
    assert out[2][0] in ("failed", "answered")


def test_extractive_generator_reads_rank1_answer():
    ctx = ("--- Stack Overflow Result 1 ---\nTitle: t (votes: 1)\nRelevance: 90.0%\n\nQ: t\nbody\n\nA: first answer"
           "\n\n--- Stack Overflow Result 2 ---\nTitle: u (votes: 1)\nRelevance: 80.0%\n\nQ: u\nb\n\nA: second")
    msgs = [{"role": "user", "content": "Python Question: q\n\nStack Overflow Context:\n" + ctx +
             "\n\nPlease answer the question based on the context above."}]
    assert rag.extractive_generator("m", msgs) == "first answer"


def test_ask_against_empty_index(spark):
    from kbforge.functions.vectors import HashingEmbedder
    from kbforge.plans.ask import ask
    index = spark.createDataFrame([], "key long, id string, document string, embedding array<double>, "
                                      "meta struct<title:string,question_score:int,answer_score:int>")
    qs = spark.createDataFrame([(1, "how do I sort a list?"), (2, "hi")], "query_id long, question string")
    out = {r["query_id"]: r for r in ask(spark, qs, index, HashingEmbedder(), k=5)["answers"].collect()}
    assert out[1]["status"] == "answered" and out[1]["docs_actual"] == 0 and out[1]["sources"] == []
    assert out[1]["answer"] == ""
    assert out[2]["status"] == "too_short"


def test_knn_empty_corpus(spark):
    from kbforge.operators.knn import knn_search
    corpus = spark.createDataFrame([], "id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert knn_search(spark, corpus, q, 5).count() == 0


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_models = st.lists(st.sampled_from(["llama-a", "Gemma-b", "mixtral-c", "whisper", "other", "",
                                    rag.PRIMARY_MODEL, "LLAMA-Z"]), max_size=8)


def _py_start(active):
    if rag.PRIMARY_MODEL in active:
        return rag.PRIMARY_MODEL
    preferred = [m for m in active if any(k in m.lower() for k in rag.PREFERRED_FAMILIES)]
    return preferred[0] if preferred else (active[0] if active else rag.PRIMARY_MODEL)


@settings(max_examples=40, deadline=None)
@given(st.lists(_models, min_size=1, max_size=5))
def test_candidate_order_matches_python(spark, actives):
    fallbacks = list(dict.fromkeys([m for m in [rag.PRIMARY_MODEL, *rag.CANDIDATE_MODELS] if m]))
    df = spark.createDataFrame([(i, a) for i, a in enumerate(actives)], "i int, a array<string>")
    rows = df.select("i", rag.start_model(F.col("a")).alias("s"),
                     rag.candidate_order(rag.start_model(F.col("a")), F.col("a")).alias("c")).collect()
    for r in rows:
        active = actives[r["i"]]
        start = _py_start(active)
        assert r["s"] == start
        assert r["c"] == [m for m in dict.fromkeys([start] + active + fallbacks) if m]


def test_generation_parameters_reach_the_generator(spark):
    from kbforge.operators import rag

    def factory():
        def gen(model, messages, temperature, **rest):
            return f"{model} {temperature} {sorted(rest.items())}"
        return gen

    def plain():
        return lambda model, messages: model

    df = spark.createDataFrame([(1, [("user", "q")], ["m"])],
                               "query_id long, messages array<struct<role string, content string>>, candidates array<string>")
    assert rag.generate(df, factory).first()["answer"] == "m 0.1 [('max_tokens', 1024)]"
    assert rag.generate(df, factory, params={"temperature": 0.9}).first()["answer"] == "m 0.9 []"
    assert rag.generate(df, plain).first()["answer"] == "m"


def test_native_extractive_answers_equal_the_python_ones(spark):
    from kbforge.operators import rag
    docs = [None, "", "no marker", "Q: t\nq\n\nA: the answer\n\nA: more", "\n\nA: "]
    df = spark.createDataFrame([(i, d, ["m1", "m2"]) for i, d in enumerate(docs)],
                               "query_id long, top_document string, candidates array<string>")
    got = {r["query_id"]: (r["answer"], r["model"]) for r in rag.extractive_answers(df).collect()}
    assert got == {i: (rag.extractive_answer(d), "m1") for i, d in enumerate(docs)}


def test_model_batches_are_bounded(spark):
    from kbforge.functions.vectors import BatchModelEmbedder

    def factory():
        def encode(texts):
            assert len(texts) <= 7
            return [[float(len(t)), float(len(texts))] for t in texts]
        return encode

    df = spark.createDataFrame([("x" * i,) for i in range(40)], "t string").coalesce(1)
    rows = BatchModelEmbedder(factory, 2, batch_size=7).embed(df, "t").collect()
    assert [r["embedding"][0] for r in rows] == [float(len(r["t"])) for r in rows]
    assert max(r["embedding"][1] for r in rows) == 7


def test_a_registered_query_makes_generation_calls(spark, monkeypatch):
    from conftest import SF001
    from kbforge.operators import rag
    from kbforge.plans import catalog
    calls, generate = [], rag.generate
    monkeypatch.setattr(rag, "generate", lambda *a, **k: calls.append(a) or generate(*a, **k))
    rows = lambda name: sorted(map(str, catalog.REGISTRY[name][0](spark, SF001).collect()))
    assert rows("rag_ask_answers") and not calls
    assert rows("rag_ask_answers_ivf") == rows("rag_ask_answers") and len(calls) == 1


_MSGS = "query_id long, messages array<struct<role string, content string>>, candidates array<string>"


def _rows(spark, n, models=("m",)):
    return spark.createDataFrame([(i, [("user", f"q{i}")], list(models)) for i in range(n)], _MSGS).coalesce(1)


def _slow_client(pause):
    """Answers with the number of calls that were open, its own included."""
    def factory():
        import threading
        import time
        lock, state = threading.Lock(), {"open": 0}

        def gen(model, messages):
            with lock:
                state["open"] += 1
                now = state["open"]
            time.sleep(pause)
            with lock:
                state["open"] -= 1
            return f"{messages[0]['content']} {now}"
        return gen
    return factory


def test_calls_in_flight_are_bounded_and_shorten_the_run(spark):
    import time
    took = {}
    for n in (1, 8):
        began = time.perf_counter()
        got = rag.generate(_rows(spark, 40), _slow_client(0.1), in_flight=n).collect()
        took[n] = time.perf_counter() - began
        assert [r.query_id for r in got] == list(range(40))                  # in the order of the rows
        assert [r.answer.split()[0] for r in got] == [f"q{i}" for i in range(40)]
        most = max(int(r.answer.split()[1]) for r in got)
        assert most <= n and (n == 1 or most > 3)
    assert took[8] < 0.5 * took[1]


def test_pace_and_back_off(spark):
    import time

    def busy():
        calls = {}

        def gen(model, messages):
            q = messages[0]["content"]
            calls[q] = calls.get(q, 0) + 1
            if model == "gone":
                raise RuntimeError("404")
            if calls[q] < 3:
                raise RuntimeError("Error 429: rate limit")
            return f"after {calls[q]}"
        return gen

    got = rag.generate(_rows(spark, 4), busy, busy_retries=3, busy_wait_s=0.01, in_flight=2).collect()
    assert {(r.status, r.answer) for r in got} == {("answered", "after 3")}
    got = rag.generate(_rows(spark, 4), busy, busy_retries=1, busy_wait_s=0.01).collect()
    assert {(r.status, r.answer) for r in got} == {("failed", None)} and "429" in got[0].error
    began = time.perf_counter()
    rag.generate(_rows(spark, 10), lambda: lambda model, messages: "x", in_flight=10, calls_per_second=10).collect()
    assert time.perf_counter() - began > 0.85                                # nine gaps of a tenth


def test_generation_into_a_table_goes_on_where_it_was(spark, tmp_dir):
    import os
    path = f"{tmp_dir}/answers"
    first = rag.generate_to(_rows(spark, 30), path, lambda: lambda model, messages: "one", rows_per_task=7)
    assert first.count() == 30
    os.makedirs(f"{path}/run=broken")                        # a call that ended before it was complete
    spark.range(3).write.parquet(f"{tmp_dir}/part")
    again = rag.generate_to(_rows(spark, 45), path, lambda: lambda model, messages: "two", rows_per_task=7)
    got = {r.query_id: r.answer for r in again.collect()}
    assert got == {i: "one" if i < 30 else "two" for i in range(45)} and again.count() == 45
    assert rag.generate_to(_rows(spark, 45), path, lambda: lambda model, messages: "three").count() == 45
    assert rag.generate_to(_rows(spark, 1).limit(0), f"{tmp_dir}/none").collect() == []
