"""Mixing sources to target weights by capped water-filling (operator 10).

Sources in code-point order (null last) get the weights in turn, repeating.  They
share ``budget`` times the words of all documents by weight; a source that would
pass ``max_epochs`` times its own words is held there and the excess is shared
again, by weight, among the rest until none is above.  The result of that loop is
the water level at which the held sources are a prefix of the sources ordered by
words per weight, so it is found with running sums over one row per source.

Each document is repeated as often as whole epochs fit in its source's target,
and the rest is a seeded sample of one more repetition: documents in the order of
a seeded hash until the remainder is used up, to the nearest document.  Running
sums are taken over hash buckets first and inside the one bucket where the
remainder ends, so no source is ever sorted in one task.

Null text has size 0.  Rows with a null doc_id are hashed as the empty id.
Rows of one doc_id share its hash and are taken or left together.  A source without
words has target 0, and an empty table gives an empty result.  Other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbforge.llm.common import save

WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"
HASH_CHARS = 3      # hex digits of the seeded hash that name a bucket


def size_of(text: Column) -> Column:
    """Number of words: starts of runs, counted without building the words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(doc_id: Column, text: Column, seed: str) -> Column:
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), own).cast("binary"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget_halves: int = 3, max_epochs: int = 2) -> DataFrame:
    """(source, source_size, target): one row per source of ``sizes`` (source, source_size).

    The budget is ``budget_halves`` / 2 of all words, kept in whole halves so that
    the sums are exact; only the final division is floating point.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]),
                                                (place % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * max_epochs
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    held = by_fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    free = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (ranked.withColumn("cap", cap)
             .withColumn("total", F.sum("source_size").over(every))
             .withColumn("held", F.sum("cap").over(held) - F.col("cap"))
             .withColumn("free_w", F.sum("w").over(free))
             # twice the words that this and the later sources share if all before are held
             .withColumn("share", F.col("total") * budget_halves - 2 * F.col("held"))
             # the first source, in order of fill, that stays under its cap sets the level
             .withColumn("under", F.col("w") * F.col("share") <= 2 * F.col("cap") * F.col("free_w")))
    first = F.min(F.when(F.col("under"), F.struct("held", "free_w", "share"))).over(every)
    level = level.withColumn("at", first)
    under = F.col("w") * F.col("at")["share"] <= 2 * F.col("cap") * F.col("at")["free_w"]
    return level.select("source", "source_size", F.when(
        F.col("at").isNotNull() & under,
        (F.col("w") * F.col("at")["share"]).cast("double") / (2 * F.col("at")["free_w"]).cast("double"))
        .otherwise(F.col("cap").cast("double")).alias("target"))


def cutoffs(slim: DataFrame, weights: tuple = WEIGHTS, budget_halves: int = 3, max_epochs: int = 2) -> DataFrame:
    """(s, source_size, target, epochs, cutoff, border, border_rows): one row per source of ``slim`` (source, size, h).

    A document is taken ``epochs`` times, and once more if its hash is at most ``cutoff``;
    of the rows whose hash is ``border``, ``border_rows`` are taken once more.
    """
    spots = slim.select("source", "size", "h", F.substring("h", 1, HASH_CHARS).alias("bucket"))
    per_bucket = spots.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    goal = targets(per_bucket.groupBy("source").agg(F.sum("words").alias("source_size")),
                   weights, budget_halves, max_epochs)
    whole = F.least(F.lit(max_epochs), F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                    .otherwise(0)).cast("long")
    goal = (goal.withColumnRenamed("source", "s").withColumn("epochs", whole)
            .withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the one bucket of each source in which the remainder ends
    border = (per_bucket.withColumn("upto", F.sum("words").over(running))
              .join(goal.select("s", "rest"), F.col("source").eqNullSafe(F.col("s")))
              .where("rest < upto and rest > upto - words")
              .select("s", F.col("bucket").alias("b"), (F.col("rest") - F.col("upto") + F.col("words")).alias("left")))
    inside = (spots.join(border, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
              .groupBy("s", "b", "left", "h").agg(F.sum("size").alias("words"), F.count("*").alias("n")))
    by_hash = Window.partitionBy("s", "b", "left").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a row is taken if more than half of it lies before the remainder's end; equal rows one after the other
    room = 2 * (F.col("left") - F.col("upto") + F.col("words")) + F.col("words") / F.col("n")
    taken = (F.when(F.col("words") > 0, F.least(F.floor(room / (2 * F.col("words") / F.col("n"))), F.col("n")))
             .otherwise(F.when(F.col("upto") <= F.col("left"), F.col("n")).otherwise(0)))
    last = (inside.withColumn("upto", F.sum("words").over(by_hash))
            .withColumn("k", F.greatest(taken, F.lit(0)).cast("long"))
            .groupBy("s", "b").agg(F.max(F.when(F.col("k") == F.col("n"), F.col("h"))).alias("last"),
                                   F.max(F.when((F.col("k") > 0) & (F.col("k") < F.col("n")), F.struct("h", "k"))).alias("cut"))
            # a bare bucket name sorts after all earlier hashes and before its own
            .select("s", F.coalesce("last", "b").alias("last"), F.col("cut.h").alias("border"), F.col("cut.k").alias("border_rows")))
    # without a border bucket the remainder ends between two buckets: after the last one that it fills
    filled = (per_bucket.withColumn("upto", F.sum("words").over(running))
              .join(goal.select("s", "rest"), F.col("source").eqNullSafe(F.col("s"))).where("upto <= rest")
              .groupBy("s").agg(F.concat(F.max("bucket"), F.lit("g")).alias("filled")))
    key = lambda df, name: df.withColumnRenamed("s", name)
    return (goal.join(key(last, "s1"), F.col("s").eqNullSafe(F.col("s1")), "left")
            .join(key(filled, "s2"), F.col("s").eqNullSafe(F.col("s2")), "left")
            .withColumn("full", F.col("epochs") >= max_epochs)
            .select("s", "source_size", "target", "epochs",
                    F.when(F.col("full"), F.lit("")).otherwise(F.coalesce("last", "filled", F.lit(""))).alias("cutoff"),
                    F.when(~F.col("full"), F.col("border")).alias("border"),
                    F.when(~F.col("full"), F.col("border_rows")).alias("border_rows")))


def _copies() -> Column:
    return (F.col("epochs") + (F.col("h") <= F.col("cutoff")).cast("long")).cast("long")


def _met(rows: DataFrame, goal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their source's goal: those that the cutoff decides, and those with the border's hash."""
    met = rows.join(goal, F.col("source").eqNullSafe(F.col("s")))
    at = F.col("h").eqNullSafe(F.col("border"))
    return met.where(~at), met.where(at)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, budget_halves: int = 3, max_epochs: int = 2,
        seed: str = "mix:") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``docs``."""
    slim = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of(F.col("text")).alias("size"),
                            seeded(F.col("doc_id"), F.col("text"), seed).alias("h")), "sizes")
    goal = save(cutoffs(slim, weights, budget_halves, max_epochs), "cutoffs")
    clear, border = _met(slim, goal)
    columns = ["doc_id", "source", "size", "source_size", "target"]
    counted = (border.groupBy(*columns, "epochs", "border_rows").agg(F.count("*").alias("n"))
               .withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
               .withColumn("copies", F.col("epochs") + (F.col("i") <= F.col("border_rows")).cast("long")))
    return (clear.withColumn("copies", _copies()).select(*columns, "copies").unionByName(counted.select(*columns, "copies"))
            .withColumn("taken", F.col("copies") * F.col("size")))


def repeated(docs: DataFrame, weights: tuple = WEIGHTS, budget_halves: int = 3, max_epochs: int = 2,
             seed: str = "mix:") -> DataFrame:
    """The rows of ``docs``, all columns, each as many times as the mix takes it.

    Only sizes and hashes are summed up; the rows themselves meet one small row per source.
    """
    h = seeded(F.col("doc_id"), F.col("text"), seed)
    goal = save(cutoffs(save(docs.select("source", size_of(F.col("text")).alias("size"), h.alias("h")), "sizes"),
                        weights, budget_halves, max_epochs).select("s", "epochs", "cutoff", "border", "border_rows"), "cutoffs")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").alias("source"), h.alias("h"))
    clear, border = _met(rows, goal)
    # rows of the border's hash: equal ones counted, then in the order of the other columns
    upto = Window.partitionBy("s").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = (border.groupBy("s", "row", "epochs", "border_rows").agg(F.count("*").alias("n"))
               .withColumn("before", F.sum("n").over(upto) - F.col("n")))
    more = F.greatest(F.least(F.col("border_rows") - F.col("before"), F.col("n")), F.lit(0))
    times = clear.select("row", _copies().alias("copies")).unionByName(
        counted.select("row", (F.col("epochs") * F.col("n") + more).alias("copies")))
    return times.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 2 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
         CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM per_source),
filled AS (
  SELECT *, CAST(total * 3 - 2 * coalesce(sum(cap) OVER (ORDER BY cap / w, encode(source) NULLS LAST
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS share,
         CAST(sum(w) OVER (ORDER BY cap / w, encode(source) NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS free_w
  FROM weighed),
level AS (SELECT share, free_w FROM filled WHERE w * share <= 2 * cap * free_w ORDER BY share DESC, free_w DESC LIMIT 1),
goal AS (
  SELECT f.source, f.source_size,
         CASE WHEN l.share IS NOT NULL AND f.w * l.share <= 2 * f.cap * l.free_w
              THEN CAST(f.w * l.share AS DOUBLE) / CAST(2 * l.free_w AS DOUBLE) ELSE CAST(f.cap AS DOUBLE) END AS target
  FROM filled f LEFT JOIN level l ON true),
parts AS (
  SELECT *, least(2, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT)) AS epochs FROM goal),
ordered AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY h
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized)
SELECT d.doc_id, d.size, p.source_size, p.target,
       CAST(d.size * (p.epochs + CASE WHEN p.epochs < 2 AND
            2 * d.upto - d.size <= 2 * round(p.target - p.epochs * p.source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ordered d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
"""
