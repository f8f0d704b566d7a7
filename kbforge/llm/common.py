"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbforge.session import checkpoint_dir, run_folder, ship_package


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers and set the checkpoint folder."""
    ship_package(spark)
    checkpoint_dir(spark)
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, deleted when the driver program ends."""
    return run_folder(spark, name)


def kept_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` that stays, for results."""
    return f"{checkpoint_dir(spark).rstrip('/')}/kbforge-results/{name}-{uuid.uuid4().hex}"


# Parquet looks at its buffers every 100 rows; for rows of megabytes it has to after each.
LONG_ROWS = {"parquet.block.size": str(8 * 1024 * 1024), "parquet.page.size.row.check.min": "1"}


def save(df: DataFrame, name: str, long_rows: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back (cuts lineage).

    With ``long_rows`` the writer holds a few MB of a file at once, and a reader as much:
    readers take a row group at a time, however many bytes its rows have.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**(LONG_ROWS if long_rows else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only what a scorer needs; null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply ``fn`` (batch -> dict of column values) to each Arrow batch of ``df``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def held_out(fold_count: int, held_fold: int):
    """Column: crc32 of doc_id as text falls in the held-out fold (null id: counted as text '')."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % fold_count == held_fold


def training_ids(labels: DataFrame, label: str, fold_count: int, held_fold: int, max_rows: int) -> DataFrame:
    """At most ``max_rows`` (doc_id, label) rows outside the held-out fold.

    The rows are those with the smallest seeded hash of doc_id, so the choice does
    not depend on the partitioning.  Rows with a null id or label are not used; an
    id labelled more than once gets the larger label.  The result is written once, so
    that its ``max_rows`` rows of two numbers can be broadcast to find their texts.
    """
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
            .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(F.max(F.col(label).cast("int")).alias("label"))
            .where(~held_out(fold_count, held_fold))
            .orderBy(F.xxhash64(F.lit("train"), F.col("doc_id")), "doc_id").limit(max_rows))
    return save(chosen, "training-ids")
