"""Vector collection storage (VEC-5, VEC-6, AGG-7, PRJ-2 records).

A collection is a parquet directory of records
``(key long, id string, document string, embedding array<double>, meta struct)``
plus a one-row ``_properties`` JSON folder (name, space, dim), in a version folder.
The newest file in ``_commits`` names the current version; a version without one is
an unfinished build and is never read.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import create_file, delete_path, list_names

RECORD_COLUMNS = ["key", "id", "document", "embedding", "meta"]


class DuplicateIdError(ValueError):
    pass


def is_committed(spark: SparkSession, path: str) -> bool:
    return current_version(spark, path) is not None


def duplicate_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """VEC-6 check: ids that occur more than once (partial count per id)."""
    return (df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def build_collection(spark: SparkSession, records: DataFrame, path: str, name: str = "collection",
                     mode: str = "skip", space: str = "cosine") -> DataFrame:
    """VEC-5: build once.

    ``mode='skip'``: reuse a committed collection, rebuild an unfinished one;
    ``'rebuild'``: always rebuild; ``'error'``: fail if one exists.
    The new build is written to a version folder of its own and made current by one
    small commit file, so readers never see a half-written collection, a crash at any
    point leaves the old one in place, and nothing is renamed.
    """
    if mode not in ("skip", "rebuild", "error"):
        raise ValueError(f"unknown mode {mode!r}")
    path = path.rstrip("/")
    if is_committed(spark, path):
        if mode == "skip":
            return open_collection(spark, path)
        if mode == "error":
            raise FileExistsError(f"collection already exists: {path}")
    recs = records.select(*RECORD_COLUMNS)
    version = f"v-{uuid.uuid4().hex}"
    staging = f"{path}/{version}"
    recs.write.mode("overwrite").parquet(staging)
    # checks run on the written copy (an id-only parquet read), not by recomputing the input
    if duplicate_ids(spark.read.parquet(staging).select("id")).limit(1).count() > 0:
        delete_path(spark, staging)
        raise DuplicateIdError("collection records must have unique ids")
    first = spark.read.parquet(staging).select("embedding").where(F.col("embedding").isNotNull()).limit(1).collect()
    dim = len(first[0][0]) if first else 0
    (spark.range(1).select(F.lit(name).alias("name"), F.lit(space).alias("space"),
                           F.lit(dim).alias("dim"))
     .coalesce(1).write.mode("overwrite").json(f"{staging}/_properties"))
    old = _pointers(spark, path)
    _commit(spark, path, version)
    # readers that opened an old version keep its files until the next rebuild
    for _, name in old[:-1]:
        delete_path(spark, f"{path}/{name}")
    return open_collection(spark, path)


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, version) of every commit, oldest first: empty files named by both."""
    folder = f"{path.rstrip('/')}/_commits"
    out = []
    for name in list_names(spark, folder):
        number, _, version = name.partition("-")
        if number.isdigit():
            out.append((int(number), version))
    return sorted(out)


def _commit(spark: SparkSession, path: str, version: str) -> None:
    """Make ``version`` current by creating the next commit file.

    Creating a file that must not exist is atomic on file systems and object stores
    alike; of two builds that end together one gets the next number and the other
    the one after.
    """
    for _ in range(100):
        last = _pointers(spark, path)
        number = last[-1][0] + 1 if last else 1
        if create_file(spark, f"{path}/_commits/{number:012d}-{version}"):
            return
    raise IOError(f"could not commit {version} in {path}")


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the committed version, or None."""
    commits = _pointers(spark, path)
    return f"{path.rstrip('/')}/{commits[-1][1]}" if commits else None


def collection_path(root: str, name: str) -> str:
    """Collections live as ``{root}/{name}``; names are plain identifiers."""
    if not name or "/" in name or name.startswith((".", "_")):
        raise ValueError(f"invalid collection name {name!r}")
    return f"{root.rstrip('/')}/{name}"


def open_collection_by_name(spark: SparkSession, root: str, name: str) -> DataFrame:
    """VEC-5: open a committed collection by name; absent -> error."""
    return open_collection(spark, collection_path(root, name))


def open_collection(spark: SparkSession, path: str) -> DataFrame:
    """Open by path; a missing or unfinished collection is an error."""
    if not is_committed(spark, path):
        raise FileNotFoundError(f"no committed collection at {path}")
    return spark.read.parquet(current_version(spark, path))


def collection_properties(spark: SparkSession, path: str) -> dict:
    row = spark.read.json(f"{current_version(spark, path)}/_properties").first()
    return row.asDict() if row else {}


def add_records(spark: SparkSession, records: DataFrame, path: str) -> int:
    """VEC-6: append records whose ids are new.

    The batch is computed once into a staging folder; repeated ids inside it or
    ids already in the collection fail the job (the staging folder is removed and
    the collection is untouched).  Otherwise the staged rows are appended.
    """
    path = path.rstrip("/")
    existing = open_collection(spark, path).select("id")
    staging = f"{path}/_add_{uuid.uuid4().hex}"
    records.select(*RECORD_COLUMNS).write.mode("overwrite").parquet(staging)
    try:
        staged = spark.read.parquet(staging)
        if duplicate_ids(staged.select("id")).limit(1).count() > 0:
            raise DuplicateIdError("batch contains repeated ids")
        if staged.select("id").join(existing, "id", "left_semi").limit(1).count() > 0:
            raise DuplicateIdError("batch contains ids already in the collection")
        n = staged.count()
        staged.write.mode("append").parquet(current_version(spark, path))
        return n
    finally:
        delete_path(spark, staging)


def index_size(spark: SparkSession, path: str) -> int:
    """AGG-7: record count, -1 when there is no committed collection or its files cannot be read."""
    try:
        return open_collection(spark, path).count()
    except (FileNotFoundError, AnalysisException, Py4JJavaError):
        return -1
