"""Mergeable quantile sketches beside the exact spread."""
import numpy as np
from pyspark.sql import functions as F

from kbforge.operators import evaluate as EV
from kbforge.operators import sketches as S


def _off(values, q, got):
    """How far the rank of ``got`` is from ``q``, as a share of the values."""
    below, upto = np.mean(values < got), np.mean(values <= got)
    return max(0.0, below - q, q - upto)


def test_merged_sketches_keep_the_stated_rank_error(spark):
    rng = np.random.default_rng(1)
    groups = {"hot": rng.lognormal(0, 1, 30_000), "even": rng.uniform(0, 1, 5_000), "ties": rng.integers(0, 4, 3_000) * 1.0,
              "one": np.array([2.5])}
    rows = [(g, int(i % 24), float(v)) for g, vs in groups.items() for i, v in enumerate(vs)] + [("hot", 1, None), (None, 2, 7.0)]
    df = spark.createDataFrame(rows, "kind string, hour int, v double").repartition(8)
    hourly = S.sketch(df, ["kind", "hour"], "v")
    assert hourly.count() == 24 * 3 + 2
    got = {r.kind: r for r in S.quantiles(S.merge(hourly, ["kind"]), ["kind"], (0.5, 0.9, 0.99)).collect()}
    assert got[None]["values"] == 1 and got[None].q50 == 7.0
    for kind, values in groups.items():
        r = got[kind]
        assert (r["values"], r.least, r.most) == (len(values), values.min(), values.max())
        for q, name in ((0.5, "q50"), (0.9, "q90"), (0.99, "q99")):
            assert _off(values, q, r[name]) <= S.rank_error()
    # a larger sketch is nearer
    fine = S.quantiles(S.sketch(df.where("kind = 'hot'"), ["kind"], "v", k=2000), ["kind"]).first()
    assert _off(groups["hot"], 0.5, fine.q50) <= S.rank_error(2000) < S.rank_error()


def test_a_hot_group_is_aggregated_before_it_moves(spark):
    df = spark.range(0, 3000).select(F.lit("hot").alias("g"), F.col("id").cast("double").alias("v"))
    plan = S.sketch(df, ["g"], "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_kll_sketch_agg_double") > plan.index("Exchange")     # printed from the top


def test_stream_of_sketches_replays_to_the_same(spark, tmp_dir):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.repartition(4).write.parquet(f"{tmp_dir}/in")
    run = lambda: S.sketch_stream(spark, f"{tmp_dir}/in", ev.schema, f"{tmp_dir}/out", f"{tmp_dir}/ck", ["event_type"],
                                  "value", "ts", "1 day", max_files_per_trigger=1)
    assert run() == 4 and run() == 0
    out = spark.read.parquet(f"{tmp_dir}/out")
    merged = S.quantiles(S.merge(out, ["event_type", "window_start"]), ["event_type", "window_start"]).collect()
    exact = {(r.event_type, r.day): r.n for r in ev.groupBy("event_type", F.date_format(
        F.date_trunc("day", "ts"), "yyyy-MM-dd HH:mm:ss").alias("day")).agg(F.count("value").alias("n")).collect() if r.n}
    assert {(r.event_type, r.window_start): r["values"] for r in merged} == exact
    # nothing in it: no sketch
    assert S.quantiles(S.sketch(ev.where("value is null"), ["event_type"], "value"), ["event_type"]).collect() == []


def test_spread_has_one_pass_and_takes_milliseconds(spark):
    rows = [("a", 1, 0.1004, "PASS"), ("a", 2, 0.1001, "PASS"), ("a", 3, 0.3, "PASS"), ("a", 4, 9.0, "FAIL"), ("a", 5, None, "PASS"),
            ("b", 6, None, "PASS")]
    df = spark.createDataFrame(rows, "g string, test_id long, latency_s double, status string")
    got = {r.g: r for r in EV.latency_spread(df, ["g"]).collect()}
    a = got["a"]
    assert (a.n, a.min_latency, a.max_latency, a.median_latency, a.fastest_id, a.slowest_id) == (4, 0.1, 0.3, 0.1, 1, 3)
    assert abs(a.p90_latency - 0.26) < 1e-9 and abs(a.mean_latency - 0.125) < 1e-9
    assert got["b"].n == 1 and got["b"].median_latency is None and got["b"].fastest_id is None
