"""Connected components of a link table, as repeated star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbforge.llm.common import save


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (u long, v long); root is the smallest node reachable.

    Each round points every node's larger neighbours, then its smaller ones, at the
    smallest neighbour, which at least halves path lengths in practice; rows stay
    at most the number of links.  All work is joins and partial aggregates: a hub's
    links are never gathered, and a skewed join is split by adaptive execution.
    Each round's table is written to the shared checkpoint folder.  Self links are
    ignored; an empty table gives an empty result.
    """
    edges = save(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .distinct(), "links")
    seen = _digest(edges)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        edges = save(_small_star(_large_star(edges)), "links")
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    # every link now points a node at its root
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))


def _digest(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*").alias("n"), F.sum(h % 1_000_000_007).alias("a"),
                    F.sum(F.xxhash64("v", "u") % 998_244_353).alias("b")).first()
    return row["n"], row["a"], row["b"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
