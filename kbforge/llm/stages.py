"""Stages of the corpus pipeline: each calls one operator and applies its decisions.

Every stage takes all rows its predecessor kept.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbforge.llm import bitplanes, rulefit, simhash_segments, tiling, waterfill
from kbforge.llm.common import kept_folder, prepare, read_table, save
from kbforge.llm.queries import tokenizer_path


# The workers of this stage have served the stages before, so it remembers fewer units than operator 1 alone.
STAGE_UNITS = 60_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the rule ensemble does not reject (score 0.3 or more).

    Null and empty texts are scored as empty ones, repeated rows each; null ids and
    columns of any name stay.  Without labels of both kinds all rows stay.
    """
    model = rulefit.train(docs, read_table(spark, sf_dir, "labels"))
    return rulefit.keep_good(docs, model)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate component: the one with the smallest doc_id.

    Rows that share that doc_id are reduced to the first by text hash, then by the
    columns but the text.  A component without any doc_id keeps one row in the same
    way, so components that share a doc_id, or have none, keep a row each.  Null and
    empty texts have no word and are one component.  Repeated rows are reduced in their
    tasks before any row moves.
    """
    prepare(spark)
    found = simhash_segments.near_duplicates(docs, words=3, max_bits=2, hashes=True)
    # what names the row that stays of each component: doc_id (nulls last), then the text's hash
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"),
                           "text_hash"))
    stay = save(found.groupBy("root").agg(first.alias("first")).select("first.*", "root"), "stay")
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("row"), doc_id.isNull().alias("no_id"),
                       F.coalesce(doc_id, F.lit(0)).alias("id"), simhash_segments.text_hash(F.col("text")).alias("text_hash"))
    # the join is on the keys of the aggregate, so its rows stay where they are
    keys = ["no_id", "id", "text_hash"]
    one_each = rows.groupBy(*keys).agg(F.min_by("row", row_order(docs.columns)).alias("chosen"))
    return one_each.join(stay.select(*keys, "root").distinct(), keys).select("chosen.*")


def row_order(columns: list[str]) -> Column:
    """Order of the rows of one component and text hash: by the columns but the text, then by the text."""
    return F.struct(*[F.col("row")[c] for c in columns if c != "text"], F.col("row")["text"])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents into which a benchmark item leaks.

    Decided row by row: repeated rows go or stay together, null and empty texts stay.
    An empty benchmark drops nothing; items below five tokens never leak.
    """
    return tiling.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it (0, 1 or 2).

    Null and empty texts have size 0 and go by their hash; a null source is a source;
    of repeated rows as many are taken as come nearest to the target.
    """
    prepare(spark)
    return waterfill.repeated(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token-id files and return the digests read back from them.

    One row per document, repeated ones and those without an id included; null and
    empty texts have the end id only.
    """
    path = kept_folder(prepare(spark), "token-ids")
    bitplanes.write_ids(docs, path, tokenizer_path(), max_units=STAGE_UNITS)
    return bitplanes.read_digests(spark, path)
