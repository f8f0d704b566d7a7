"""Evaluation of answer runs (EVL-1, EVL-2, EVL-3, AGG-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Status names and observation texts of an evaluation row
# ---------------------------------------------------------------------------
PASS, FAIL, ERROR = "PASS", "FAIL", "ERROR"
OBS_PASS = "Answer returned successfully with sources."
OBS_FAIL_PREFIX = "Unexpected HTTP status "
OBS_ERROR = "Network or server error."
# ---------------------------------------------------------------------------


def eval_status(http_status: Column, error: Column) -> tuple[Column, Column]:
    """EVL-1: (status, observation) for one question.

    No HTTP status but an error -> ERROR (exception); 200 -> PASS; other -> FAIL.
    """
    status = (F.when(http_status.isNull() & error.isNotNull(), F.lit(ERROR))
              .when(http_status == 200, F.lit(PASS))
              .otherwise(F.lit(FAIL)))
    obs = (F.when(status == PASS, F.lit(OBS_PASS))
           .when(status == FAIL, F.concat(F.lit(OBS_FAIL_PREFIX), F.coalesce(http_status.cast("string"), F.lit("None")), F.lit(".")))
           .otherwise(F.lit(OBS_ERROR)))
    return status, obs


def latency_ms(latency: Column) -> Column:
    """Latency in whole milliseconds (latencies are recorded to 3 decimals)."""
    return F.round(latency * F.lit(1000.0), 0).cast("long")


def summary_columns(status: str = "status", latency: str = "latency_s") -> list[Column]:
    """AGG-4: total, passed, failed (= total - passed), mean PASS latency / max(passed, 1),
    to 3 decimals.

    The latency sum is exact (integer milliseconds), so the mean does not depend
    on the order in which partial sums are combined.
    """
    passed = F.count_if(F.col(status) == PASS)
    total = F.count(F.lit(1))
    pass_ms = F.coalesce(F.sum(F.when(F.col(status) == PASS, F.coalesce(latency_ms(F.col(latency)), F.lit(0)))), F.lit(0))
    return [
        total.cast("long").alias("total"),
        passed.cast("long").alias("passed"),
        (total - passed).cast("long").alias("failed"),
        (F.round(pass_ms / F.greatest(passed, F.lit(1)), 0) / F.lit(1000.0)).alias("avg_latency"),
    ]


def summarize(rows: DataFrame, group: list[str] | None = None) -> DataFrame:
    """AGG-4 overall or per group (partial aggregation, one row per group)."""
    g = rows.groupBy(*group) if group else rows
    return g.agg(*summary_columns())


def report_rows(results: DataFrame, id_col: str = "test_id") -> DataFrame:
    """EVL-2: one row per (test, source) with the source number; latency to 2 places."""
    return results.select(
        id_col, "question", F.round("latency_s", 2).alias("latency_s"), "status",
        F.coalesce(F.size("sources"), F.lit(0)).cast("long").alias("docs"),
        F.posexplode_outer("sources").alias("source_pos", "source"))


def latency_spread(rows: DataFrame, group: list[str], id_col: str = "test_id",
                   status: str = "status", latency: str = "latency_s") -> DataFrame:
    """EVL-3: min / max / mean / median / p90 of PASS latency, fastest and slowest test.

    Latencies are taken in whole milliseconds (three decimals), so a group has as many
    different ones as milliseconds it spans, however many rows it has.  Everything comes
    from one table of partial counts per group and latency: quantiles, exact, from its
    running totals, the rest from its sums and ends.  Rows without a latency count in ``n``
    and in the mean's divisor only.
    """
    known = F.col("_lat").isNotNull()
    counts = (rows.where(F.col(status) == PASS).withColumn("_lat", F.round(F.col(latency), 3))
              .groupBy(*group, "_lat").agg(F.count(F.lit(1)).alias("_n"), F.min(id_col).alias("_first")))
    by_group = Window.partitionBy(*group)
    upto = by_group.orderBy("_lat").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (counts.withColumn("_upto", F.sum(F.when(known, F.col("_n"))).over(upto))
              .withColumn("_all", F.sum(F.when(known, F.col("_n"))).over(by_group)))

    def quantile(q: float) -> Column:
        at = F.lit(q) * (F.col("_all") - 1)
        low = F.min(F.when(F.col("_upto") > F.floor(at), F.col("_lat")))
        high = F.min(F.when(F.col("_upto") > F.ceil(at), F.col("_lat")))
        share = F.max(at - F.floor(at))
        return F.round((F.lit(1.0) - share) * low + share * high, 6)

    n = F.sum("_n").cast("long")
    return ranked.groupBy(*group).agg(
        n.alias("n"), F.min("_lat").alias("min_latency"), F.max("_lat").alias("max_latency"),
        (F.sum(latency_ms(F.col("_lat")) * F.col("_n")) / n / F.lit(1000.0)).alias("mean_latency"),
        quantile(0.5).alias("median_latency"), quantile(0.9).alias("p90_latency"),
        F.min_by("_first", "_lat").alias("fastest_id"), F.max_by("_first", "_lat").alias("slowest_id"))
