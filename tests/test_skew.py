"""One key holding a third of all rows: results stay exact and plans reduce the hot
group inside each task before the shuffle."""
import duckdb
from pyspark.sql import functions as F

from kbforge.operators import rag
from kbforge.operators import relational as R
from kbforge.operators.history import recent_history

from conftest import SF01

HOT_LINES = "CASE WHEN l_linenumber <= 3 THEN 0 ELSE l_orderkey END"


def _duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF01}/lineitem.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF01}/events.parquet'")
    return con


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_parent_best_child_exact_and_partial(spark):
    li = spark.read.parquet(f"{SF01}/lineitem.parquet").withColumn("p", F.expr(HOT_LINES))
    share = li.where("p = 0").count() / li.count()
    assert share > 1 / 3
    best = R.best_child(li, "p", "l_extendedprice", ["l_linenumber", "l_partkey", "l_suppkey"], ["l_quantity"])
    assert "partial_max_by" in _plan(best)
    got = {r["p"]: (r["l_extendedprice"], r["l_quantity"]) for r in best.collect()}
    sql = f"""SELECT {HOT_LINES} AS p, max(l_extendedprice),
              arg_max(l_quantity, (l_extendedprice, -l_linenumber, -l_partkey, -l_suppkey)) FROM lineitem GROUP BY 1"""
    want = {r[0]: (r[1], r[2]) for r in _duck().execute(sql).fetchall()}
    assert got == want


def test_hot_key_dedupe_uses_partial_window_limit(spark):
    li = spark.read.parquet(f"{SF01}/lineitem.parquet").withColumn("p", F.expr(HOT_LINES))
    d = R.dedupe_by_key(li, "p", [F.col("l_extendedprice").desc(), F.col("l_linenumber"), F.col("l_partkey"),
                                  F.col("l_suppkey")])
    plan = _plan(d)
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert d.count() == li.select("p").distinct().count()


def test_hot_user_history_and_attempts(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet").withColumn(
        "u", F.when(F.col("event_type").isin("click", "view"), F.lit(0)).otherwise(F.col("user_id")))
    assert ev.where("u = 0").count() / ev.count() > 1 / 3
    h = recent_history(ev, "u", "ts", "event_type", depth=8)
    assert "WindowGroupLimit" in _plan(h)
    assert h.where("u = 0").count() == 8
    att = ev.select(F.col("u").alias("req"), F.col("event_id").alias("attempt_id"), "ts",
                    F.col("event_type").alias("model"),
                    F.when(F.col("event_type") == "error", F.lit("model_not_found")).alias("error"))
    res = rag.resolve_attempts(att, ["req"], ["ts", "attempt_id"])
    assert "partial_min_by" in _plan(res)
    hot = res.where("req = 0").first()
    want = _duck().execute("""SELECT arg_min(event_id, (ts, event_id)) FROM events
                              WHERE event_type IN ('click', 'view')""").fetchall()[0][0]
    assert hot["outcome"] == "answered" and hot["decided_by"] == want


def test_hot_group_first_seen_is_bounded(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet").withColumn("u", F.lit(0))   # every row in one group
    r = R.first_seen_distinct(ev, "u", F.col("event_type"), [F.col("ts"), F.col("event_id")], "types")
    plan = _plan(r)
    assert "partial_min" in plan
    assert len(r.first()["types"]) == 5
