"""SRC-1 / SRC-2 / SRC-3: CSV scans with the leniency rules of the curate job.

* lenient (questions, answers): rows with **more** fields than the schema are
  skipped; short rows are padded with nulls; values that do not parse as the
  column type become null; quoted commas, doubled quotes and quoted newlines
  are read correctly.
* strict (tags): any row with too many fields fails the job.
* NA words (``NA``, ``null``, ``None``, ``nan``, empty, ...) become null.

Files are read by byte ranges in many tasks (:mod:`.records`), also where quoted
fields hold newlines; files in an encoding that cannot be cut at bytes are read whole,
one task each.  :func:`csv_to_parquet` converts once, and every later step reads
parquet (pushdown, pruning).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import NA_TOKENS, normalize_na
from .records import csv_records, is_splittable

# Fixed value: the source files are decoded as latin-1 by default.
DEFAULT_ENCODING = "ISO-8859-1"
_CORRUPT = "_corrupt_record"


def field_count(line: Column) -> Column:
    """Number of comma-separated fields of a raw CSV record (quoted parts count as one).

    The quoted part is matched possessively: no backtracking state per character, so
    fields of any length are safe.
    """
    return F.size(F.split(F.regexp_replace(line, r'"(?:[^"]++|"")*+"', "q"), ",", -1))


_PARSE = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}


def _raw(spark: SparkSession, path: str, schema: T.StructType, encoding: str) -> DataFrame:
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields]
                           + [T.StructField(_CORRUPT, T.StringType())])
    if is_splittable(encoding):
        ddl = ", ".join(f"`{f.name}` STRING" for f in as_text.fields)
        parsed = F.from_csv("record", ddl, _PARSE)
        return csv_records(spark, path, encoding).select(parsed.alias("row")).select("row.*")
    return (spark.read.schema(as_text).options(header="true", multiLine="true", encoding=encoding, **_PARSE).csv(path))


def _touch_data(schema: T.StructType) -> Column:
    """Always-true predicate over the data columns: keeps them in the scan so a
    plan never reads only the corrupt-record column (which Spark rejects)."""
    return F.length(F.concat_ws("", *[F.col(f.name) for f in schema.fields])) >= 0


def _typed(df: DataFrame, schema: T.StructType, na_tokens: list[str]) -> DataFrame:
    cols = []
    for f in schema.fields:
        c = normalize_na(F.col(f.name), na_tokens)
        cols.append((c if isinstance(f.dataType, T.StringType) else c.try_cast(f.dataType)).alias(f.name))
    return df.select(*cols)


def read_posts_csv(spark: SparkSession, path: str, schema: T.StructType,
                   encoding: str = DEFAULT_ENCODING, na_tokens: list[str] | None = None) -> DataFrame:
    """SRC-1 lenient scan (see module doc)."""
    raw = _raw(spark, path, schema, encoding)
    n = len(schema.fields)
    kept = raw.where((F.col(_CORRUPT).isNull() | (field_count(F.col(_CORRUPT)) <= n)) & _touch_data(schema))
    return _typed(kept, schema, NA_TOKENS if na_tokens is None else na_tokens)


def read_tags_csv(spark: SparkSession, path: str, schema: T.StructType,
                  encoding: str = DEFAULT_ENCODING, na_tokens: list[str] | None = None) -> DataFrame:
    """SRC-2 strict scan: a row with more fields than the schema fails the job
    (short rows are padded, as in the lenient scan; FAILFAST would reject those too)."""
    raw = _raw(spark, path, schema, encoding)
    n = len(schema.fields)
    bad = F.col(_CORRUPT).isNotNull() & (field_count(F.col(_CORRUPT)) > n)
    # the check sits in the filter predicate so column pruning cannot drop it
    checked = raw.where(F.when(bad, F.raise_error(F.concat(F.lit("malformed CSV row: "), F.col(_CORRUPT))).cast("boolean"))
                        .otherwise(F.lit(True)) & _touch_data(schema))
    return _typed(checked, schema, NA_TOKENS if na_tokens is None else na_tokens)


def csv_to_parquet(df: DataFrame, out: str) -> DataFrame:
    """Write a scanned CSV once as parquet and return that table for the steps that follow."""
    df.write.mode("overwrite").parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)
